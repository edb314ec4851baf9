"""Joins and groups in which one key may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 500
#: Hot keys are spread over this many salts.
SALTS = 16


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """The keys that hold at least `share` of the rows of df: at most 1 / share of them.

    Counts are combined before the shuffle. Null keys are never hot, as they match nothing.
    """
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    hot = counts.join(F.broadcast(total), F.col("_n") >= F.greatest(F.lit(1000), F.col("_all") * share))
    return hot.select(*keys)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """left LEFT JOIN right on keys, for a right side that is unique by keys.

    Rows of left under a hot key are spread over `salts`, and only the few right rows of the hot keys are
    repeated. `hot` is at most 1 / HOT_SHARE rows by its definition, which bounds the broadcast.
    Columns of right that left also has (other than the keys) are a caller's error and raise.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    if hot is None:
        hot = hot_keys(left, keys)
    mark = hot.select(*keys, F.lit(True).alias("_hot"))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    l2 = left.join(F.broadcast(mark), keys, "left").withColumn("_salt", spread).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r2 = right.join(F.broadcast(mark), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return l2.join(r2, [*keys, "_salt"], "left").drop("_salt")


def once(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """The rows of df with redelivered copies (same key, same content) counted once, as key + content.

    A row whose key is null stands alone and is kept.
    """
    alone = F.when(reduce(Column.__or__, [F.col(k).isNull() for k in key]), F.monotonically_increasing_id())
    return df.select(*key, *content, alone.alias("_alone")).distinct().drop("_alone")
