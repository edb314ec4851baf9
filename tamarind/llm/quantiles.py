"""Percentiles of very large numeric columns, per group, from mergeable sketches.

The sketch is a randomized compactor hierarchy (KLL): full compactors sort, keep alternate values and pass
them up a level; two sketches merge level by level. Spark's built-in aggregate keeps it in the JVM and
combines before the shuffle, so a group of any size costs one sketch a task. A sketch is a binary column:
keep it per run, day or partition and put any of them together later with merge().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compactor width. Larger is more exact and grows the sketch in proportion.
K = 2000


def rank_error(k: int = K) -> float:
    """The bound of |estimated rank - true rank| / n that one query keeps with 99 % probability (published fit for KLL)."""
    return 2.296 / k**0.9021


def sketch(df: DataFrame, groups: list[str], value: str, k: int = K) -> DataFrame:
    """groups, n, n_null, n_nan, sketch: one row a group, null groups included.

    Nulls and NaN have no rank: they are counted and stay out of the sketch; infinities are values. A group
    without any value has a null sketch. An empty table gives no rows. Ties count each.
    """
    v = F.col(value).cast("double")
    number = F.when(~F.isnan(v), v)
    n = F.count(number)
    return df.groupBy(*groups).agg(n.alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.isnan(v)).alias("n_nan"), F.when(n > 0, F.kll_sketch_agg_double(number, F.lit(k))).alias("sketch"))


def merge(sketches: DataFrame, groups: list[str], k: int = K) -> DataFrame:
    """The sketches of several runs, days or partitions put together per group."""
    n = F.sum("n")
    return sketches.groupBy(*groups).agg(n.alias("n"), F.sum("n_null").alias("n_null"), F.sum("n_nan").alias("n_nan"), F.when(n > 0, F.kll_merge_agg_double("sketch", F.lit(k))).alias("sketch"))


def percentiles(sketches: DataFrame, groups: list[str], probs: list[float], k: int = K) -> DataFrame:
    """groups, p, n, n_null, n_nan, value, low, high: a row for each group and probability.

    low and high are the values at the two ends of the rank-error bound. Groups without a value have null values.
    """
    e = rank_error(k)
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, p))))
    one = lambda p: F.struct(F.lit(float(p)).alias("p"), at(p).alias("value"), at(p - e).alias("low"), at(p + e).alias("high"))
    none = lambda p: F.struct(F.lit(float(p)).alias("p"), *[F.lit(None).cast("double").alias(c) for c in ("value", "low", "high")])
    rows = F.when(F.col("n") > 0, F.array(*map(one, probs))).otherwise(F.array(*map(none, probs)))
    return sketches.select(*groups, "n", "n_null", "n_nan", F.explode(rows).alias("_q")).select(*groups, "_q.p", "n", "n_null", "n_nan", "_q.value", "_q.low", "_q.high")


def rank_check(df: DataFrame, estimates: DataFrame, groups: list[str], value: str, k: int = K) -> DataFrame:
    """groups, p, error, within: how far each estimate's rank in df is from p, by exact counts over all rows.

    Both counts are combined before the shuffle, so hot groups are no matter. With ties an estimate has a range of
    ranks; the nearest counts.
    """
    v = F.col(value).cast("double")
    est = estimates.where(F.col("value").isNotNull()).groupBy(*groups).agg(F.collect_list(F.struct("p", "value")).alias("_est"))
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*groups, v.alias("_v")).alias("a").join(est.alias("b"), on)
    rows = rows.select(*[F.col(f"a.{g}").alias(g) for g in groups], "_v", F.explode("_est").alias("_e"))
    ranks = rows.groupBy(*groups, F.col("_e.p").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") < F.col("_e.value")).alias("below"), F.count_if(F.col("_v") <= F.col("_e.value")).alias("upto"))
    p, lo, hi = F.col("p"), F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    error = F.greatest(F.lit(0.0), lo - p, p - hi)
    return ranks.select(*groups, "p", error.alias("error"), (error <= rank_error(k) + 1 / F.col("n")).alias("within"))
