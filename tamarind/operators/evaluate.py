"""Scoring predictions against gold cases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact(gold: Column, predicted: Column) -> Column:
    """Whether both are the same; a null gold is met by anything."""
    return gold.isNull() | gold.eqNullSafe(predicted)


def covers(gold: Column, predicted: Column) -> Column:
    """Whether every gold element was predicted; none is always met."""
    return F.size(F.array_except(F.coalesce(gold, F.array().cast("array<string>")), F.coalesce(predicted, F.array().cast("array<string>")))) == 0


def contains_all(fragments: Column, text: Column) -> Column:
    """Whether the text holds every fragment, case aside."""
    return F.forall(F.coalesce(fragments, F.array().cast("array<string>")), lambda f: F.contains(F.lower(text), F.lower(f)))


def entity_counts(gold: Column, predicted: Column) -> Column:
    """array<struct<type, tp, fp, fn>>: a wrong value is missed, but not also found wrongly; a type that gold lacks is."""
    keys = F.array_union(F.map_keys(gold), F.map_keys(predicted))

    def one(k: Column) -> Column:
        g, p = F.try_element_at(gold, k), F.try_element_at(predicted, k)
        return F.struct(k.alias("type"), (g.isNotNull() & g.eqNullSafe(p)).cast("int").alias("tp"), (g.isNull() & p.isNotNull()).cast("int").alias("fp"), (g.isNotNull() & ~g.eqNullSafe(p)).cast("int").alias("fn"))

    return F.transform(keys, one)


def prf(df: DataFrame, by: list[str], tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """by, support, precision, recall, f1 from counts; 0 where a divisor is 0."""
    s = df.groupBy(*by).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumn("precision", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", div(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return s.select(*by, (F.col("tp") + F.col("fn")).alias("support"), F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def label_counts(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn) of a one-label classification; null labels are no label."""
    rows = df.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(True).alias("is_gold")), F.struct(F.col(predicted).alias("label"), F.lit(False).alias("is_gold")))).alias("e"), F.col(gold).eqNullSafe(F.col(predicted)).alias("hit"))
    rows = rows.select("e.label", "e.is_gold", "hit").where(F.col("label").isNotNull())
    return rows.groupBy("label").agg(F.count_if(F.col("is_gold") & F.col("hit")).alias("tp"), F.count_if(~F.col("is_gold") & ~F.col("hit")).alias("fp"), F.count_if(F.col("is_gold") & ~F.col("hit")).alias("fn"))


def accuracy_by(df: DataFrame, group: str, hit: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("int")), 4).alias("accuracy"))


def bootstrap(df: DataFrame, key: str, value: str, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(mean, low, high): the mean of a numeric column with its percentile interval over Poisson resamples.

    Each row draws its weight in each resample from its own key, so the result does not depend on partitions,
    and tasks pass on two sums a resample. Null values are left out; without values all is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(resamples), np.zeros(resamples)
        at = np.arange(resamples, dtype=np.uint64)
        limits = np.cumsum([np.exp(-1.0)] + [np.exp(-1.0) / np.prod(range(1, k + 1)) for k in range(1, 12)])
        for b in batches:
            keys, values = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for a in range(0, len(keys), 256):
                h = keys[a : a + 256].astype(np.uint64)[:, None] + at[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> np.uint64(s))) * np.uint64(m)
                w = np.searchsorted(limits, (h >> np.uint64(11)).astype(np.float64) / 2.0**53)
                total += w.T @ values[a : a + 256]
                weight += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total), pa.array(weight.astype(np.float64))], ["r", "total", "weight"])

    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), F.col(key)).alias("k"), F.col(value).cast("double").alias("v"))
    means = rows.mapInArrow(run, "r long, total double, weight double").groupBy("r").agg((F.try_divide(F.sum("total"), F.sum("weight"))).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high")).crossJoin(rows.agg(F.avg("v").alias("mean"))).select("mean", "low", "high")


def scorecard(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: cases, the share that passes each check, and the share that passes all."""
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return df.agg(F.count(F.lit(1)).alias("cases"), *[share(c).alias(n) for n, c in checks.items()], share(every).alias("all"))


def error_groups(df: DataFrame, case: str, checks: dict[str, Column]) -> DataFrame:
    """(error, n, cases): the failing cases of each check, their ids in order."""
    failed = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    rows = df.select(F.col(case).alias("case"), F.explode(failed).alias("error"))
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("case")).alias("cases"))
