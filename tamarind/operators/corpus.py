"""What a corpus teaches a tokenizer: frequencies, word pairs that belong together, stop words, stems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.functions import text as T


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """(w, df): in how many rows each word occurs; a null text has none."""
    return df.select(F.explode(F.array_distinct(T.words(F.lower(text)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))


def phrases(df: DataFrame, text: str, least: int = 3, least_pmi: float = 3.0) -> DataFrame:
    """(pair, n, pmi): word pairs that stand together at least `least` times with a PMI of at least `least_pmi`.

    Rare pairs go before the counts of their words are joined, so the join is small beside the corpus.
    """
    t = df.select(T.words(F.lower(text)).alias("t"))
    single = t.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("u"))
    neighbours = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = t.where(F.size("t") > 1).select(F.explode(neighbours).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    total = single.agg(F.sum("u").alias("total"))
    left, right = (single.select(F.col("w").alias(c), F.col("u").alias(f"u{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").join(F.broadcast(total))
    pmi = F.log(F.col("n") * F.col("total") / (F.col("ua") * F.col("ub")) + 1e-9)
    return joined.where(pmi >= least_pmi).select(F.concat_ws("_", "a", "b").alias("pair"), "n", F.round(pmi, 4).alias("pmi"))


def stop_words(df: DataFrame, text: str, share: float = 0.85, longest: int = 3) -> DataFrame:
    """(w, df): words of at most `longest` letters in at least `share` of the rows."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return document_frequency(df, text).where(F.length("w") <= longest).join(F.broadcast(n)).where(F.col("df") >= share * F.col("n")).select("w", "df")


def stems(df: DataFrame, text: str) -> DataFrame:
    """(stem, variants): words that differ in accents only; the stem is the most frequent, of equals the shortest, then the first."""
    n = df.select(F.explode(T.words(F.lower(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy(T.fold("w").alias("_base")).agg(F.min_by("w", F.struct(-F.col("n"), F.length("w"), F.col("w"))).alias("stem"), F.sort_array(F.collect_list("w")).alias("variants"))
    return g.where(F.size("variants") > 1).select("stem", "variants")
