"""Queries that go through templates, the dialect adapter, profiles, the knowledge base and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.functions import entities
from tamarind.functions import text as T
from tamarind.operators import generate, kb
from tamarind.plans import execute, quality, spec
from tamarind.plans.shared import shared_dir
from tamarind.queries.retrieval import AS_OF
from tamarind.sources.tables import information_schema, register
from tamarind.sources.tables import read_table as table
from tamarind.streaming import batches

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TEMPLATES = {
    "orders_of_account": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = CAST('{account_number}' AS BIGINT) AND o_orderdate >= '{start_date}' AND o_orderdate < date_add('{end_date}', 1)",
    "orders_by_status": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = '{status}' AND o_totalprice >= {min_amount}",
}


def _bound(spark: SparkSession, d: str, template: str, values: dict[str, object]) -> DataFrame:
    register(spark, d, ["orders"])
    b = spec.bind(TEMPLATES[template], values)
    if b.unfilled:
        raise ValueError(f"unfilled {b.unfilled}")
    verdict, df = execute.prepare(spark, b.sql, b.args, None)
    if df is None:
        raise ValueError(verdict.message)
    return df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 490000")
def slot_fill_param(spark, d):
    return _bound(spark, d, "orders_by_status", {"status": "F", "amount_min": 490000})


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 899 AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def question_to_rows(spark, d):
    """A question in words: entities, template, parameters, guard, rows."""
    found = entities.extract("giao dịch của tài khoản 000000899 trong năm 1998", "banking", AS_OF)
    return _bound(spark, d, "orders_of_account", found)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, coalesce(sum(o_totalprice), 0) > 0 AS any_total, count(*) AS n FROM orders GROUP BY 1")
def dialect_adapted(spark, d):
    """SQL in another system's dialect, adapted."""
    register(spark, d, ["orders"])
    verdict, df = execute.prepare(spark, "SELECT strftime('%Y-%m', o_orderdate) AS month, TOTAL(o_totalprice) > 0 AS any_total, COUNT(*) AS n FROM \"orders\" GROUP BY 1;", None, None)
    if df is None:
        raise ValueError(verdict.message)
    return df


@query("""WITH q AS (SELECT DISTINCT query_id, validator, rows_found, confidence_score FROM query_log),
s AS (SELECT query_id, round((CASE WHEN validator <> 'FAIL' THEN 0.3 ELSE 0 END) + round(least(coalesce(confidence_score, 0), 1) * 0.3, 3) + (CASE WHEN validator <> 'DATA_ERROR' THEN 0.2 ELSE 0 END)
+ (CASE WHEN validator <> 'DOMAIN_AMBIGUOUS' THEN 0.1 ELSE 0 END) + (CASE WHEN rows_found > 0 THEN 0.1 ELSE 0 END), 2) AS score FROM q)
SELECT count(*) AS n, round(avg(score), 2) AS mean_score, count_if(score >= 0.65) > 0 AS some_pass FROM s""")
def confidence_expr(spark, d):
    q = table(spark, d, "query_log").select("query_id", "validator", "rows_found", "confidence_score").distinct()
    v = F.col("validator")
    c = quality.confidence(v != "FAIL", F.col("confidence_score"), v != "DATA_ERROR", v != "DOMAIN_AMBIGUOUS", F.col("rows_found"))
    return q.select(c["score"].alias("score")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 2).alias("mean_score"), (F.count_if(F.col("score") >= 0.65) > 0).alias("some_pass"))


@query("SELECT DISTINCT employee_id FROM attendance a WHERE employee_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM employee e WHERE e.employee_id = a.employee_id)")
def missing_entities(spark, d):
    """Which entity values no row of their table has, for a whole batch: one anti join."""
    wanted = table(spark, d, "attendance").where("employee_id IS NOT NULL").select(F.lit("employee_id").alias("k"), F.col("employee_id").alias("v")).distinct()
    return quality.missing_entities(wanted, "k", "v", {"employee_id": (table(spark, d, "employee"), "employee_id")}).select(F.col("v").alias("employee_id"))


@query()
def generated_intents(spark, d):
    """What each table can be asked, from the roles of its live columns."""
    register(spark, d, ["orders", "customer"])
    cols = information_schema(spark, ["orders"]).select(F.explode("columns").alias("c")).select(F.col("c.column").alias("name"), F.lit("").alias("description"))
    renamed = cols.withColumn("name", F.regexp_replace("name", "^o_", ""))
    return generate.intents(generate.profile(renamed.withColumn("name", F.regexp_replace("name", "(price|date|status|key)$", "_$1"))), "orders")


@query("SELECT e.doc_id, count(*) AS n_examples, max('passage: ' || example_text) AS last_formatted FROM (SELECT DISTINCT example_id, doc_id, example_text FROM examples) e JOIN documents d ON d.doc_id = e.doc_id GROUP BY e.doc_id")
def kb_examples(spark, d):
    e = table(spark, d, "examples").select("example_id", "doc_id", "example_text").distinct()
    return e.join(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_examples"), F.max(F.concat(F.lit("passage: "), "example_text")).alias("last_formatted"))


_SHEET_SQL = """WITH g AS (SELECT id AS document, question AS description, '"' || question || '"' AS examples, array_to_string(tags, ',') AS keyword FROM gold_test_set),
w AS (SELECT CASE WHEN document = (SELECT min(document) FROM g) THEN document || ' anew' ELSE document END AS document, CASE WHEN document = (SELECT min(document) FROM g) THEN '' ELSE description END AS description,
CASE WHEN document = (SELECT min(document) FROM g) THEN '"ví dụ mới" "ví dụ khác"' ELSE examples END AS examples, CASE WHEN document = (SELECT min(document) FROM g) THEN '' ELSE keyword END AS keyword FROM g WHERE document <> (SELECT max(document) FROM g)),
t AS (SELECT document, 'passage: ' || array_to_string(list_filter([trim(document), trim(coalesce(description, '')), trim(coalesce(keyword, ''))], lambda x: x <> ''), ' | ') AS search_text,
coalesce(len(list_filter(regexp_extract_all(examples, '"([^"]+)"', 1), lambda x: length(trim(x)) > 5)), 0) AS n_examples FROM w)"""


def _written(spark, d):
    """A knowledge base of the gold questions: two uploads, one document anew, one deleted."""
    sheet = table(spark, d, "gold_test_set").select(F.col("id").alias("document"), F.col("question").alias("description"), F.concat(F.lit('"'), "question", F.lit('"')).alias("examples"), F.array_join("tags", ",").alias("keyword"))
    k = kb.KnowledgeBase(spark, f"{shared_dir(spark)}/kb-{uuid.uuid4().hex}")
    k.create()
    early = F.right("document", F.lit(1)) < "5"
    k.insert(sheet.where(early))
    k.insert(sheet.where(~early))
    first, last = sheet.agg(F.min("document"), F.max("document")).first()
    ids = {r["document"]: r["doc_id"] for r in k.table("documents").where(F.col("document").isin(first, last)).collect()}
    k.update(ids[first], spark.createDataFrame([(f"{first} anew", '"ví dụ mới" "ví dụ khác"')], "document string, examples string"))
    k.delete(ids[last])
    return k


@query(_SHEET_SQL + " SELECT document, search_text, CAST(n_examples AS BIGINT) AS n_examples FROM t")
def kb_written(spark, d):
    """What a knowledge base holds after uploads, a change and a deletion."""
    k = _written(spark, d)
    n = k.table("examples").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return k.table("documents").join(n, "doc_id", "left").select("document", "search_text", F.coalesce("n", F.lit(0)).alias("n_examples"))


@query(_SHEET_SQL + " SELECT count(*) AS documents, CAST(sum(n_examples) AS BIGINT) AS examples, round(sum(n_examples) / count(*), 2) AS examples_per_document FROM t")
def kb_written_stats(spark, d):
    return _written(spark, d).stats()


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM examples) AS examples, round((SELECT count(*) FROM examples) / (SELECT count(*) FROM documents), 2) AS examples_per_document")
def kb_stats(spark, d):
    docs = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("documents"))
    ex = table(spark, d, "examples").agg(F.count(F.lit(1)).alias("examples"))
    return docs.join(F.broadcast(ex)).select("documents", "examples", F.round(F.col("examples") / F.col("documents"), 2).alias("examples_per_document"))


@query("SELECT id, 'passage: ' || question || CASE WHEN len(tags) > 0 THEN ' | ' || array_to_string(tags, ',') ELSE '' END AS search_text FROM gold_test_set WHERE trim(question) <> ''")
def search_texts(spark, d):
    g = table(spark, d, "gold_test_set").where(F.trim("question") != "")
    return g.select("id", F.concat(F.lit("passage: "), F.concat_ws(" | ", "question", F.nullif(F.array_join("tags", ","), F.lit("")))).alias("search_text"))


@query("SELECT id, regexp_replace(trim(regexp_replace(lower(trim(question, ' ')), '[?!.,;:]+$', ''), ' '), '\\s+', ' ', 'g') AS normal FROM gold_test_set")
def normalized_questions(spark, d):
    return table(spark, d, "gold_test_set").select("id", F.lower(T.normalize_question("question")).alias("normal"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_available_now(spark, d):
    """The events file as a stream, one batch a file, each written once to the shared folder; then counted."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(d)
    batches.process(stream, lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), f"{out}/parts", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/parts").groupBy("event_type").agg(F.sum("n").alias("n"))
