"""Queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.llm import canonical, leakage, overlap, packing, personal, quantiles
from tamarind.llm import codepoints as C
from tamarind.plans.skew import once

PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
CAPACITY = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.col("eval_id").alias("gold_id"), F.col("train_id").alias("example_id"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "gold_test_set"), "id", "question", table(spark, d, "examples"), "example_id", "example_text")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, records and training rows involved, per split of the record and source of the example."""
    gold = table(spark, d, "gold_test_set").select(F.col("id").alias("eval_id"), F.col("split").alias("gold_split")).distinct()
    ex = table(spark, d, "examples").select(F.col("example_id").alias("train_id"), F.col("source").alias("example_source")).distinct()
    pairs = _overlaps(spark, d).join(gold, "eval_id").join(ex, "train_id")
    return pairs.groupBy("gold_split", "example_source").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("eval_id").alias("n_gold"), F.count_distinct("train_id").alias("n_examples"))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.coverage(_overlaps(spark, d))


def _timings(spark: SparkSession, d: str, by_day: bool = False) -> DataFrame:
    """The log's timings, redelivered rows counted once; only the columns that are needed are compared and moved."""
    log = table(spark, d, "query_log").withColumn("day", F.to_date("asked_at"))
    return once(log, ["query_id"], ["domain", "timing_sql_generation", *(["day"] if by_day else [])])


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(quantiles.sketch(_timings(spark, d), ["domain"], "timing_sql_generation"), ["domain"], PROBS)


def p3_percentiles_from_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from one sketch for each day and domain, put together afterwards."""
    days = quantiles.sketch(_timings(spark, d, True), ["day", "domain"], "timing_sql_generation")
    return quantiles.percentiles(quantiles.merge(days, ["domain"]), ["domain"], PROBS)


def p3_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether every estimate keeps the rank-error bound, by exact counts over all rows."""
    rows = _timings(spark, d, True)
    days = quantiles.sketch(rows, ["day", "domain"], "timing_sql_generation")
    estimates = quantiles.percentiles(quantiles.merge(days, ["domain"]), ["domain"], PROBS)
    checked = quantiles.rank_check(rows, estimates, ["domain"], "timing_sql_generation")
    return checked.groupBy("domain").agg(F.count(F.lit(1)).alias("n_checked"), F.count_if("within").alias("n_within"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    s = quantiles.sketch(_timings(spark, d), ["domain"], "timing_sql_generation")
    return s.select("domain", "n", "n_null", "n_nan")


P3_RANK_SQL = f"SELECT domain, {len(PROBS)} AS n_checked, {len(PROBS)} AS n_within FROM query_log WHERE timing_sql_generation IS NOT NULL AND NOT isnan(timing_sql_generation) GROUP BY domain"
P3_COUNTS_SQL = """SELECT domain, count(t) FILTER (NOT isnan(t)) AS n, count(*) FILTER (t IS NULL) AS n_null, count(*) FILTER (isnan(t)) AS n_nan
FROM (SELECT DISTINCT query_id, domain, timing_sql_generation AS t FROM query_log) GROUP BY domain"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "gold_test_set").select(F.lit("gold_test_set").alias("table_name"), F.col("id").alias("row_id"), F.col("question").alias("text"))
    ex = table(spark, d, "examples").select(F.lit("examples").alias("table_name"), F.col("example_id").cast("string").alias("row_id"), F.col("example_text").alias("text"))
    return canonical.canonical_text(gold.unionByName(ex), "text").where("changed").select("table_name", "row_id").distinct()


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    ex = table(spark, d, "examples").select("example_id", "example_text")
    return canonical.canonical_text(ex, "example_text").select("example_id", "canonical", "changed").distinct()


def tokenizer_path(spark: SparkSession) -> str:
    """The ranks file: spark.tamarind.tokenizer, else the public one installed on every machine."""
    named = spark.conf.get("spark.tamarind.tokenizer", None)
    if named:
        return named
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", tokenizer_path(spark), CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d), CAPACITY)


def _leaks(spark: SparkSession, d: str, paraphrases: bool) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "text", paraphrases)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, False).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, True)


def _personal(spark: SparkSession, d: str) -> DataFrame:
    names = personal.known_names((table(spark, d, "employee"), "employee_name"), (table(spark, d, "bank_customer"), "customer_name"))
    return personal.occurrences(table(spark, d, "documents"), "doc_id", "text", names)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("doc_id", "kind", "start_pos").distinct()


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal.masked(table(spark, d, "documents"), "doc_id", "text", _personal(spark, d))


_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
_SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_LIKE, _LATIN = "".join(C.LOOK_ALIKES), "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ0-9"
_STRONG = "".join(c for c in C.LOOK_ALIKES if c not in C.WEAK)
_FOREIGN = "".join(c for c in map(chr, range(0x370, 0x530)) if c.isalpha() and c not in C.LOOK_ALIKES)


def words_sql(x: str) -> str:
    """The folded words of a text, for texts in which words of other alphabets decide nothing."""
    plain = f"translate(translate(regexp_replace({x}, '{_INVISIBLE}', '', 'g'), '{_FULL}', '{_ASCII}'), '{_LIKE}', '{''.join(C.LOOK_ALIKES.values())}')"
    return f"regexp_extract_all(translate(lower(strip_accents({plain})), 'đ', 'd'), '[\\p{{L}}\\p{{N}}]+')"


_PAIRS_SQL = f"""WITH g AS (SELECT DISTINCT id AS gold_id, {words_sql('question')} AS t FROM gold_test_set), x AS (SELECT DISTINCT example_id, {words_sql('example_text')} AS t FROM examples),
gn AS (SELECT gold_id, t, len(t) AS n, list_sort(list_distinct(list_filter(t, lambda w: regexp_matches(w, '[0-9]')))) AS d FROM g), xn AS (SELECT example_id, t, len(t) AS n, list_sort(list_distinct(list_filter(t, lambda w: regexp_matches(w, '[0-9]')))) AS d FROM x),
gw AS (SELECT gold_id, w, count(*) AS c FROM (SELECT gold_id, unnest(t) AS w FROM gn) GROUP BY ALL), xw AS (SELECT example_id, w, count(*) AS c FROM (SELECT example_id, unnest(t) AS w FROM xn) GROUP BY ALL),
s AS (SELECT gold_id, example_id, sum(least(gw.c, xw.c)) AS s FROM gw JOIN xw USING (w) GROUP BY ALL),
p AS (SELECT gold_id, example_id FROM s JOIN gn USING (gold_id) JOIN xn USING (example_id) WHERE gn.d = xn.d AND s >= 0.7 * greatest(gn.n, xn.n) - 1e-9)"""
P2_FOUND_SQL = _PAIRS_SQL + " SELECT gold_id, example_id FROM p"
P2_REPORT_SQL = _PAIRS_SQL + """ SELECT gold_split, example_source, count(*) AS n_pairs, count(DISTINCT gold_id) AS n_gold, count(DISTINCT example_id) AS n_examples FROM p
JOIN (SELECT DISTINCT id AS gold_id, split AS gold_split FROM gold_test_set) USING (gold_id) JOIN (SELECT DISTINCT example_id, source AS example_source FROM examples) USING (example_id) GROUP BY ALL"""
P5_FOUND_SQL = f"""WITH t AS (SELECT 'gold_test_set' AS table_name, id AS row_id, question AS text FROM gold_test_set UNION ALL SELECT 'examples', CAST(example_id AS VARCHAR), example_text FROM examples)
SELECT DISTINCT table_name, row_id FROM t WHERE nfc_normalize(text) <> text OR regexp_matches(text, '[\\x{{FF01}}-\\x{{FF5E}}]|{_SPACES}|[ÐðƉɖ]')
OR regexp_matches(regexp_replace(text, '[\\x{{2190}}-\\x{{2BFF}}\\x{{1F000}}-\\x{{1FAFF}}]\\x{{FE0F}}?\\x{{200D}}', '', 'g'), '{_INVISIBLE}|\\x{{200D}}')
OR list_bool_or(list_transform(regexp_extract_all(nfc_normalize(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: regexp_matches(w, '[{_LIKE}]') AND regexp_matches(w, '^[{_LATIN}{_LIKE}]+$') AND (regexp_matches(w, '[{_LATIN.replace('À-ÖØ-öø-ɏ', 'À-ÏÑ-ÖØ-ïñ-öø-ƈƊ-ɏ')}]') OR regexp_matches(w, '[{_STRONG}]') AND NOT regexp_matches(nfc_normalize(text), '[{_FOREIGN}]'))))"""
P9_FOUND_SQL = f"""WITH d AS (SELECT doc_id, {words_sql('text')} AS t FROM documents), i AS (SELECT item_id, {words_sql('text')} AS t FROM eval_item),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(t) - 10), lambda k: array_to_string(t[k:k + 11], ' '))) AS g FROM d), ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(t) - 10), lambda k: array_to_string(t[k:k + 11], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_coverage, p3_percentiles, p3_percentiles_from_days, p3_rank_check, p3_counts, p5_found, p5_canonical, p8_packed, p8_fill, p9_found, p9_leaks, p10_found, p10_masked)}
ORACLE = {"p2_found": P2_FOUND_SQL, "p2_report": P2_REPORT_SQL, "p3_rank_check": P3_RANK_SQL, "p3_counts": P3_COUNTS_SQL, "p5_found": P5_FOUND_SQL, "p9_found": P9_FOUND_SQL}
