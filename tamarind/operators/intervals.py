"""Overlapping and gapped time intervals: continuous periods per entity, and the gaps between them.

The aggregate's state for an entity is a sorted list of disjoint closed day intervals. States merge linearly:
two sorted runs are merged and swept once. Every task first reduces its own rows, then states meet in a
reduction tree (entity and salt, then entity), so an entity that owns a third of all rows is reduced in many
tasks, and what reaches its last merge is at most `salts` lists of disjoint intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a task holds before it reduces them to states.
HOLD_ROWS = 200_000


def sweep(group: np.ndarray, start: np.ndarray, end: np.ndarray, touch: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals per group; intervals at most `touch` apart become one.

    The stable sort is a run-merging one, so inputs made of sorted runs are merged linearly.
    """
    if not len(group):
        return group, start, end
    order = np.argsort(start, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    g, s, e = group[order], start[order].astype(np.int64), end[order].astype(np.int64)
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    # The running maximum of the ends within each group: ends are lifted by group so that no group sees another's.
    span = int(e.max() - e.min()) + 1
    rank = np.cumsum(new_group) - 1
    reach = np.maximum.accumulate(e - e.min() + rank * span) - rank * span + e.min()
    opens = new_group.copy()
    opens[1:] |= s[1:] > reach[:-1] + touch
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(s)]]) - 1
    return g[first], s[first], reach[last]


def _reduce(key: str, touch: int):
    """A task's rows (key, s, e) to states, in rows again: a state is the rows of its key, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            code = pc.dictionary_encode(t.column(key)).combine_chunks()
            g, s, e = sweep(code.indices.to_numpy(zero_copy_only=False), t.column("s").to_numpy(), t.column("e").to_numpy(), touch)
            names = code.dictionary.take(pa.array(g))
            return pa.RecordBatch.from_arrays([names, pa.array(s, pa.int64()), pa.array(e, pa.int64())], [key, "s", "e"])

        limit = HOLD_ROWS
        for b in batches:
            if b.num_rows:
                held.append(b.select([key, "s", "e"]))
                rows += b.num_rows
            if rows >= limit:
                held = [flush()]
                rows = held[0].num_rows
                if rows > HOLD_ROWS // 2:  # little was merged: pass it on rather than hold it
                    yield held[0]
                    held, rows = [], 0
        if held:
            yield flush()

    return run


def periods(df: DataFrame, entity: str, start: str, end: str, touch: int = 1, salts: int = 16) -> DataFrame:
    """(entity, start_day, end_day): the longest stretches of days covered by the intervals of one entity.

    Intervals are closed day ranges. Rows with a null entity, start or end, or with start after end, are left
    out. Repeated rows, nested and touching intervals change nothing twice; `touch` = 1 lets an interval that
    begins the day after another ends continue it. An empty table gives an empty result. Other columns of df
    are ignored, whatever their names.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    rows = df.select(F.col(entity).cast("string").alias("k"), day(start).alias("s"), day(end).alias("e"))
    rows = rows.where(F.col("k").isNotNull() & (F.col("s") <= F.col("e")))
    schema = "k string, s long, e long"
    states = rows.mapInArrow(_reduce("k", touch), schema)
    salted = states.withColumn("_salt", F.pmod(F.xxhash64("k", "s", "e"), F.lit(salts)))
    halves = salted.repartition("k", "_salt").sortWithinPartitions("k", "_salt", "s").mapInArrow(_merge_sorted("k", touch, "_salt"), schema)
    whole = halves.repartition("k").sortWithinPartitions("k", "s").mapInArrow(_merge_sorted("k", touch), schema)
    return whole.select(F.col("k").alias(entity), F.date_from_unix_date(F.col("s").cast("int")).alias("start_day"), F.date_from_unix_date(F.col("e").cast("int")).alias("end_day"))


def _merge_sorted(key: str, touch: int, salt: str | None = None):
    """Merges the states of rows that come sorted by (key, salt, s), in a stream: one open interval is all it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            k, s, e = b.column(key), b.column("s").to_numpy(), b.column("e").to_numpy()
            extra = b.column(salt) if salt else pa.array(np.zeros(b.num_rows, np.int64))
            if open_row:
                k = pa.concat_arrays([pa.array([open_row[0]], k.type), k])
                extra = pa.concat_arrays([pa.array([open_row[1]], extra.type), extra])
                s, e = np.concatenate([[open_row[2]], s]), np.concatenate([[open_row[3]], e])
            kd, xs = pc.dictionary_encode(k), extra.to_numpy(zero_copy_only=False)
            codes = kd.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            step = np.concatenate([[0], np.cumsum((codes[1:] != codes[:-1]) | (xs[1:] != xs[:-1]))])
            g, s2, e2 = sweep(step, s, e, touch)
            head = np.searchsorted(step, g)
            names = k.take(pa.array(head))
            open_row = (names[-1].as_py(), int(xs[head[-1]]), int(s2[-1]), int(e2[-1]))
            if len(g) > 1:
                yield pa.RecordBatch.from_arrays([names.slice(0, len(g) - 1), pa.array(s2[:-1], pa.int64()), pa.array(e2[:-1], pa.int64())], [key, "s", "e"])
        if open_row:
            yield pa.RecordBatch.from_arrays([pa.array([open_row[0]]), pa.array([open_row[2]], pa.int64()), pa.array([open_row[3]], pa.int64())], [key, "s", "e"])

    return run


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, touch: int = 1) -> DataFrame:
    """(entity, kind, start_day, end_day): kind 'period' as periods() gives them, kind 'gap' their complements.

    A gap is all days between two successive periods of one entity. The last merge already leaves the periods
    in order, so the complement is emitted in the same stream. Nulls, ties and repeats as in periods().
    """
    done = periods(df, entity, start, end, touch)
    cols = done.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = b.column(0)
            s, e = b.column(1).cast(pa.int32()).to_numpy(), b.column(2).cast(pa.int32()).to_numpy()
            codes = pc.dictionary_encode(k).indices.to_numpy(zero_copy_only=False)
            inner = np.flatnonzero(codes[1:] == codes[:-1]) + 1
            gap_s, gap_e, at = e[inner - 1] + 1, s[inner] - 1, inner
            if last and last[0] == k[0].as_py():
                gap_s, gap_e, at = np.concatenate([[last[1] + 1], gap_s]), np.concatenate([[s[0] - 1], gap_e]), np.concatenate([[0], at])
            last = (k[n - 1].as_py(), int(e[-1]))
            kind = pa.array(["period"] * n + ["gap"] * len(at))
            day = lambda a, g: pa.array(np.concatenate([a, g]).astype(np.int32)).cast(pa.date32())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([k, k.take(pa.array(at.astype(np.int64)))]), kind, day(s, gap_s), day(e, gap_e)], [cols[0], "kind", "start_day", "end_day"])

    return done.mapInArrow(emit, f"`{entity}` string, kind string, start_day date, end_day date")
