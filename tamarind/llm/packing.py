"""Filling fixed-capacity windows with documents: sum-of-squares online packing.

A document of s tokens goes to the fill level at which the sum over all levels of (number of open windows at
that level) squared becomes least; an array over the levels tracks the counts. Each task packs its own
documents as they stream by. Windows that stay open at the end are packed once more, across tasks, as items
of their own, in groups of a bounded number of tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.llm import codepoints as C
from tamarind.plans.shared import cut

#: Open windows of so many tasks are packed together in one task of the second round.
TASKS_A_GROUP = 64


class SumOfSquares:
    """Windows of one capacity, open and full."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open windows at each level; 0 and capacity stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for an item of 1 <= size <= capacity."""
        cap, count = self.capacity, self.count
        level = 0
        if size < cap:
            # Change of the sum of squares for each level h: the window leaves h and arrives at h + size.
            here, there = count[: cap - size + 1], count[size:]
            change = 2 * (there - here) + 2
            change[0] = 2 * there[0] + 1
            change[-1] = -2 * here[-1] + 1 if cap > size else 0
            change[1:][here[1:] == 0] = np.iinfo(np.int64).max
            level = cap - size - int(np.argmin(change[::-1]))  # ties: the fullest window
        if level:
            window = self.open[level].pop()
            count[level] -= 1
        else:
            window, self.made = self.made, self.made + 1
        to = level + size
        if to < cap:
            self.open[to].append(window)
            count[to] += 1
        return window, level

    def left_open(self) -> list[tuple[int, int]]:
        """(window, level) of all open windows."""
        return [(w, h) for h, ws in enumerate(self.open) for w in ws]


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters encoded at once, about: what the encoder's lists of one text hold at a time.
STRETCH = 100_000
#: A blank between two signs that are none: this tokenizer always cuts before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of a whole text.

    Texts beyond STRETCH are encoded by stretches that end before a single blank, where the tokenizer's own pattern cuts; where
    there is none, a stretch goes on until there is, so the count is that of the text encoded at once.
    """
    if not text:
        return 0
    enc = _encoding(path)
    n, at = 0, 0
    while at < len(text):
        m = _CUT.search(text, at + STRETCH)
        end = m.start() if m else len(text)
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


_ROWS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int32()), ("shard", pa.int32()), ("window", pa.int64()), ("offset", pa.int32()), ("open", pa.bool_())])
_SQL = "doc_id long, piece int, token_start long, n_tokens int, shard int, window long, offset int, open boolean"
_PACKED = "doc_id long, piece int, token_start long, n_tokens int, window_id string, offset int"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)


def _first_round(capacity: int, tokenizer: str):
    """Packs a task's documents; rows of a window come out when it is full, those of windows left open at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        packer = SumOfSquares(capacity)
        held: dict[int, list[tuple]] = {}
        for whole in batches:
            for b in C.pieces(whole, 1):
                out: list[tuple] = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    n = count_tokens(text, tokenizer)
                    if n == 0:
                        out.append((doc, 0, 0, 0, shard, None, 0, False))
                    for piece, start in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - start)
                        window, offset = packer.place(size)
                        rows = held.setdefault(window, [])
                        rows.append((doc, piece, start, size, shard, window, offset, False))
                        if offset + size == capacity:
                            out += held.pop(window)
                if out:
                    yield _table(out)
        if held:
            yield _table([(*r[:-1], True) for rows in held.values() for r in rows])

    return run


def _second_round(capacity: int):
    """Packs the windows that tasks left open, each as one item with all its rows, the fullest first."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group, packer = key[0].as_py(), SumOfSquares(capacity)
        rows: dict[tuple[int, int], list[tuple]] = {}
        for r in zip(*[table.column(c).to_pylist() for c in _ROWS.names]):
            rows.setdefault((r[4], r[5]), []).append(r)
        level = {w: sum(r[3] for r in rs) for w, rs in rows.items()}
        out = []
        for w in sorted(rows, key=lambda w: (-level[w], w)):
            to, base = packer.place(level[w])
            out += [(*r[:4], f"g{group}-{to}", r[6] + base) for r in rows[w]]
        kinds = [_ROWS.field(c).type for c in _ROWS.names[:4]] + [pa.string(), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "piece", "token_start", "n_tokens", "window_id", "offset"])

    return run


def pack(df: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, window_id, offset): where each document lies.

    A document is split only if it is longer than the capacity, into full windows and a rest. Null and empty
    texts have no tokens: they come out with a null window_id. Repeated ids are packed row by row; other
    columns are ignored. `tokenizer` is the path of a tiktoken ranks file that every executor has.
    Token counts are of whole texts. The first round is kept on shared storage, so that its result is one and the
    same for all who read it whatever executors are lost. Only the rows of windows left open are shuffled.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = cut(rows.mapInArrow(_first_round(capacity, tokenizer), _SQL))
    rest = first.where("open").withColumn("_group", F.floor(F.col("shard") / TASKS_A_GROUP))
    merged = rest.groupBy("_group").applyInArrow(_second_round(capacity), _PACKED)
    full = first.where("NOT open").withColumn("window_id", F.concat(F.lit("s"), "shard", F.lit("-"), "window"))
    return full.select("doc_id", "piece", "token_start", "n_tokens", "window_id", "offset").unionByName(merged)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: documents, windows, tokens, the share of unused space, and the fullest window."""
    w = packed.where(F.col("window_id").isNotNull()).groupBy("window_id").agg(F.sum("n_tokens").alias("t"))
    totals = w.agg(F.count(F.lit(1)).alias("n_windows"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return totals.withColumn("unused", 1 - F.col("n_tokens") / (F.col("n_windows") * capacity))
