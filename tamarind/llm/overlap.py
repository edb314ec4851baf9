"""Same or near-same records across splits: evaluation records found in training texts.

The evaluation records are normalised and cut into passages. Some, the probes, are chosen such that a training text which
shares enough of a record's words must contain one: Aho-Corasick automata over shards of the probes scan every training text
once a shard. What they hit is settled exactly. An automaton over all passages of a record then gives the places at which
the text runs along with it; merged to intervals, these are the record's coverage.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.llm import codepoints as C

#: Share of the longer text's words that must be shared.
LEAST_SHARE = 0.7
#: Words of the passages that coverage is made of; a shorter record is one passage.
PASSAGE = 3
#: Characters of evaluation text in one shard: what an automaton, its broadcast and the driver hold at once.
SHARD_CHARS = 4_000_000

PAIRS = "eval_id string, train_id long, shared int, longer int, coverage double, intervals array<struct<first:int,last:int>>"


def _flat(column: pa.Array) -> tuple[str, np.ndarray]:
    """All rows as one string of folded words, ' w w w ' each and a line end between, and where each row starts."""
    f, off, _ = C.fold(*C.to_codepoints(column))
    n = len(off) - 1
    lengths = np.diff(off) + 3
    start = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(start[-1], 0x20, np.uint32)
    out[start[1:] - 1] = 0x0A
    body = np.ones(len(out), bool)
    body[start[:-1]] = body[start[1:] - 2] = body[start[1:] - 1] = False
    out[body] = f
    single = np.ones(len(out), bool)
    single[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20)
    text = out[single]
    return text.tobytes().decode("utf-32-le"), np.concatenate([[0], np.cumsum(single)])[start[: n + 1]]


def _count_words(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        total: Counter[str] = Counter()
        for whole in batches:
            for b in C.pieces(whole, 0):
                for w, n in Counter(_flat(b.column(0))[0].split()).items():
                    if w in vocabulary:
                        total[w] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return run


def probes(words: list[str], frequency: dict[str, int], share: float = LEAST_SHARE) -> list[str]:
    """The passages of one record: whoever shares `share` of the longer text's words and all words with digits has one.

    All digit words must be shared, so the rarest one is enough. Else at least ceil(share * n) of the record's n
    words are shared, so one of its n - ceil(share * n) + 1 rarest is among them.
    """
    if not words:
        return []
    rare = lambda w: (frequency.get(w, 0), -len(w), w)
    with_digit = [w for w in words if any(c.isdigit() for c in w)]
    if with_digit:
        return [min(with_digit, key=rare)]
    least = math.ceil(share * len(words) - 1e-9)
    return sorted(set(sorted(words, key=rare)[: len(words) - least + 1]))


def _settle(record: Counter, n_record: int, text: Counter, n_text: int, share: float) -> tuple[int, int] | None:
    """(shared words, words of the longer) if the pair is a case."""
    longer = max(n_record, n_text)
    if min(n_record, n_text) < share * longer - 1e-9:
        return None
    shared = sum(min(n, text[w]) for w, n in record.items())
    return (shared, longer) if shared >= share * longer - 1e-9 else None


def passages_of(record: list[str]) -> ahocorasick.Automaton:
    """All passages of PASSAGE words of a record, each with the places at which it begins."""
    size = min(PASSAGE, len(record))
    at: dict[str, list[int]] = {}
    for i in range(len(record) - size + 1):
        at.setdefault(" ".join(record[i : i + size]), []).append(i)
    machine = ahocorasick.Automaton()
    for p, places in at.items():
        machine.add_word(f" {p} ", (size, places))
    machine.make_automaton()
    return machine


def matched(machine: ahocorasick.Automaton, line: str) -> list[dict]:
    """The intervals of the record's words that lie in a passage which the text has, merged."""
    spans = sorted({(i, i + size - 1) for _, (size, places) in machine.iter(line) for i in places})
    out: list[dict] = []
    for first, last in spans:
        if out and first <= out[-1]["last"] + 1:
            out[-1]["last"] = max(last, out[-1]["last"])
        else:
            out.append({"first": first, "last": last})
    return out


def _digits(words) -> frozenset[str]:
    return frozenset(w for w in words if any(c.isdigit() for c in w))


def _scan(shared, share: float):
    arrow = pa.schema([("eval_id", pa.string()), ("train_id", pa.int64()), ("shared", pa.int32()), ("longer", pa.int32()), ("coverage", pa.float64()), ("intervals", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, passages = shared.value
        machine = ahocorasick.Automaton()
        for p, owners in passages.items():
            machine.add_word(f" {p} ", owners)
        if not passages:
            return
        machine.make_automaton()
        digits = [_digits(ws) for _, ws in records]
        bags = [Counter(ws) for _, ws in records]
        machines: dict[int, ahocorasick.Automaton] = {}
        memo: dict[str, list] = {}
        for whole in batches:
            for b in C.pieces(whole, 1):
                text, start = _flat(b.column(1))
                ids = b.column(0).to_pylist()
                ends, owners = [], []
                for end, own in machine.iter(text):
                    ends.append(end)
                    owners.append(own)
                rows = np.searchsorted(start, np.array(ends, np.int64), side="right") - 1
                wanted: dict[int, set[int]] = {}
                for r, own in zip(rows.tolist(), owners):
                    wanted.setdefault(r, set()).update(own)
                out = []
                for r, who in wanted.items():
                    line = text[start[r] : start[r + 1] - 1]
                    found = memo.get(line)
                    if found is None:
                        ws = line.split()
                        bag, own_digits, found = Counter(ws), _digits(ws), []
                        for k in who:
                            name, record = records[k]
                            if digits[k] == own_digits and (case := _settle(bags[k], len(record), bag, len(ws), share)):
                                if k not in machines:
                                    if len(machines) > 5_000:
                                        machines.clear()
                                    machines[k] = passages_of(record)
                                intervals = matched(machines[k], line)
                                covered = sum(i["last"] - i["first"] + 1 for i in intervals)
                                found.append((name, *case, covered / len(record), intervals))
                        if len(memo) > 50_000:
                            memo.clear()
                        if len(line) < 1000:
                            memo[line] = found
                    out += [(f[0], ids[r], *f[1:]) for f in found if ids[r] is not None]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return run


def overlaps(evals: DataFrame, eval_id: str, eval_text: str, train: DataFrame, train_id: str, train_text: str, share: float = LEAST_SHARE) -> DataFrame:
    """(eval_id, train_id, shared, longer, coverage, intervals), distinct: every pair that is a case.

    A pair is a case if both texts have the same set of words that hold a digit and share, counted with
    repeats, at least `share` of the words of the longer text. intervals are the places of the record (from 0) that lie in passages
    of PASSAGE words which the text has too, coverage is their share of the record. Words are compared without case, accents and disguises.
    Texts that are null or have no words match nothing; null ids are left out. Redelivered rows and equal
    copies give each pair of ids once. Training rows are never shuffled: only hits are. The evaluation side is
    read in shards of at most about SHARD_CHARS characters, each broadcast and scanned for in turn; how frequent its words
    are is counted for all shards in one pass before.
    """
    ev = evals.where(F.col(eval_id).isNotNull() & F.col(eval_text).isNotNull()).select(F.col(eval_id).cast("string").alias("id"), F.col(eval_text).alias("text")).distinct()
    chars = ev.agg(F.coalesce(F.sum(F.length("text") + 50), F.lit(0))).first()[0]
    shards = max(1, -(-chars // SHARD_CHARS))
    texts = train.select(F.col(train_id).cast("long").alias("id"), F.col(train_text).alias("text"))
    found = None

    def read(s: int) -> list[tuple[str, list[str]]]:
        rows = ev.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == s).collect()
        return list(zip([r["id"] for r in rows], C.word_strings(*C.to_codepoints(pa.array([r["text"] for r in rows], pa.string())))))

    vocabulary = {w for s in range(shards) for _, ws in read(s) for w in ws}
    counted = texts.select("text").mapInArrow(_count_words(train.sparkSession.sparkContext.broadcast(vocabulary)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in counted}
    for s in range(shards):
        records = read(s)
        passages: dict[str, list[int]] = {}
        for k, (_, ws) in enumerate(records):
            for p in probes(ws, frequency, share):
                passages.setdefault(p, []).append(k)
        part = texts.mapInArrow(_scan(train.sparkSession.sparkContext.broadcast((records, passages)), share), PAIRS)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def coverage(pairs: DataFrame) -> DataFrame:
    """(eval_id, n_texts, best_coverage, covered_words): per evaluation record, over all its training texts.

    covered_words is the size of the union of the matched intervals; equal intervals meet before the union. A record whose words come
    in another order throughout has 0.
    """
    best = pairs.groupBy("eval_id").agg(F.count_distinct("train_id").alias("n_texts"), F.max("coverage").alias("best_coverage"))
    places = pairs.select("eval_id", F.explode("intervals").alias("i")).select("eval_id", "i.first", "i.last").distinct()
    words = places.select("eval_id", F.explode(F.sequence("first", "last")).alias("w")).distinct().groupBy("eval_id").agg(F.count(F.lit(1)).alias("covered_words"))
    return best.join(words, "eval_id", "left").withColumn("covered_words", F.coalesce("covered_words", F.lit(0)))
