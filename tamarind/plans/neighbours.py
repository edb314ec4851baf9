"""The row before each row in a global order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamarind.plans.shared import cut


def with_previous(df: DataFrame, group: str, order: str, carry: list[str]) -> DataFrame:
    """df plus prev_<c> for each c of carry: the values of the row before within its group by `order`.

    prev_<order> is null on the first row of a group. Rows are range-partitioned by (group, order), so a group
    of any size spreads over tasks; a task's first row gets its predecessor from the last row of the partition
    before. Those last rows, one a partition, are all the driver sees. Expects `order` to be unique in a group.
    """
    carry = [order, *[c for c in carry if c != order]]
    # A number of its own keeps the partitions apart: what follows may cost far more than the bytes shuffled tell.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(df.repartitionByRange(parts, group, order).sortWithinPartitions(group, order))
    tail_schema = T.StructType([T.StructField("_pid", T.IntegerType()), *[ordered.schema[c] for c in [group, *carry]]])

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if b.num_rows:
                last = b.slice(b.num_rows - 1)
        if last is not None:
            pid = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([pid, *[last.column(c) for c in [group, *carry]]], ["_pid", group, *carry])

    tails = sorted(ordered.mapInArrow(tail, tail_schema).collect(), key=lambda r: r["_pid"])
    tails = df.sparkSession.sparkContext.broadcast([(r["_pid"], r[group], [r[c] for c in carry]) for r in tails])
    out_schema = T.StructType([*ordered.schema.fields, *[T.StructField(f"prev_{c}", ordered.schema[c].dataType, True) for c in carry]])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [t for t in tails.value if t[0] < TaskContext.get().partitionId()]
        g0, held = (before[-1][1], before[-1][2]) if before else (None, None)
        for b in batches:
            if not b.num_rows:
                continue
            groups = b.column(group)
            same_first = held is not None and groups[0].as_py() == g0
            equal = [same_first, *(pc.equal(groups.slice(1), groups.slice(0, len(groups) - 1)).to_pylist() if len(groups) > 1 else [])]
            mask = pa.array([not bool(e) for e in equal])
            cols = []
            for k, c in enumerate(carry):
                col = b.column(c)
                first = pa.array([held[k] if held is not None else None], col.type)
                shifted = pa.concat_arrays([first, col.slice(0, len(col) - 1)])
                cols.append(pc.if_else(mask, pa.scalar(None, col.type), shifted))
            g0, held = groups[-1].as_py(), [b.column(c)[-1].as_py() for c in carry]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *[f"prev_{c}" for c in carry]])

    return ordered.mapInArrow(shift, out_schema)
