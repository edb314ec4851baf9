"""Sources and sinks: question sets, knowledge sheets, templates, profiles, logs."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

QUESTION = "id string, question string, expected_intent string, expected_entities map<string,string>"


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Questions without an id get q001, q002, ... by their place. Question sets are files a person wrote, so one window is no matter."""
    n = F.row_number().over(W.orderBy(*order))
    return df.withColumn("id", F.coalesce("id", F.format_string("q%03d", n))).select("id", "question", "expected_intent", "expected_entities")


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects with a question, or of bare strings; blank questions are left out."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("n", "item"))
    obj = F.from_json(F.col("item"), QUESTION)
    bare = ~F.ltrim("item").startswith("{")
    rows = text.select("n", F.when(bare, F.lit(None)).otherwise(obj["id"]).alias("id"), F.when(bare, F.col("item")).otherwise(obj["question"]).alias("question"), F.when(~bare, obj["expected_intent"]).alias("expected_intent"), F.when(~bare, obj["expected_entities"]).alias("expected_entities"))
    return _numbered(rows.where(F.length(F.trim("question")) > 0), [F.col("n")])


def questions_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header and a question column. Blank questions are left out; entities that are no JSON are null."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if "question" not in df.columns:
        raise ValueError(f"{path} has no column question")
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    rows = df.withColumn("_n", F.monotonically_increasing_id()).select("_n", col("id").alias("id"), F.trim("question").alias("question"), col("expected_intent").alias("expected_intent"), F.from_json(col("expected_entities"), "map<string,string>").alias("expected_entities"))
    return _numbered(rows.where(F.length("question") > 0), [F.col("_n")])


def questions_markdown(spark: SparkSession, path: str) -> DataFrame:
    """The bullets ('- ') of a Markdown file."""
    rows = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id()).where(F.col("value").startswith("- "))
    none = F.lit(None)
    return _numbered(rows.select("_n", none.cast("string").alias("id"), F.trim(F.substring("value", F.lit(3), F.length("value"))).alias("question"), none.cast("string").alias("expected_intent"), none.cast("map<string,string>").alias("expected_entities")).where("question <> ''"), [F.col("_n")])


def questions_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An Excel sheet with a question column, read on the driver; needs pandas' Excel reader."""
    import pandas as pd

    df = pd.read_excel(path, dtype=str)
    if "question" not in df.columns:
        raise ValueError(f"{path} has no column question")
    df = df[df["question"].notna() & ~df["question"].str.strip().str.lower().isin(["", "nan"])]
    rows = [(i, r.get("id"), r["question"].strip()) for i, r in enumerate(df.to_dict("records"))]
    made = spark.createDataFrame(rows, "n int, id string, question string")
    return _numbered(made.select("n", "id", "question", F.lit(None).cast("string").alias("expected_intent"), F.lit(None).cast("map<string,string>").alias("expected_entities")), [F.col("n")])


READERS = {".json": questions_json, ".csv": questions_csv, ".md": questions_markdown, ".xlsx": questions_sheet, ".xls": questions_sheet}


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set by its file's extension. A missing file is FileNotFoundError, another extension ValueError."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    kind = os.path.splitext(path)[1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {kind or path}")
    return READERS[kind](spark, path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sql_files(spark: SparkSession, folder: str) -> DataFrame:
    """(template_id, sql): every .sql file of a folder by its stem; empty files are left out."""
    df = spark.read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True).withColumn("_file", F.input_file_name())
    return df.select(F.regexp_extract("_file", r"([^/]+)\.sql$", 1).alias("template_id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("sql")).where("sql <> ''")


def save_template(spark: SparkSession, folder: str, intent_id: str, sql: str) -> str:
    """A template as a file of its own on the folder's file system, named by its intent; the name is made safe."""
    path = f"{folder.rstrip('/')}/{re.sub(r'[^\w\-]+', '_', intent_id)[:50]}.sql"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(sql.strip() + "\n", "utf-8"))
    out.close()
    return path


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, name, role, description, suggested_keywords): the columns of every profile of a folder; a file without a table_name goes by its stem."""
    column = "struct<name:string,role:string,description:string,suggested_keywords:array<string>,sql_logic:string,value_ref:string>"
    df = spark.read.schema(f"table_name string, columns array<{column}>").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    df = df.select(F.coalesce("table_name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).alias("table_name"), F.explode("columns").alias("c"))
    return df.select("table_name", "c.*")


NAME_HEADS = r"(?i)^(?:column|field|name|tên|ten|cột|cot|trường|truong)"
DESCRIPTION_HEADS = r"(?i)(?:desc|mô tả|mo ta|ý nghĩa|y nghia|meaning|comment|ghi chú)"


def schema_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(name, description) of a CSV that describes a schema; its two columns are told by their heads, else the first two are taken."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    name = next((c for c in df.columns if re.search(NAME_HEADS, c)), df.columns[0])
    desc = next((c for c in df.columns if c != name and re.search(DESCRIPTION_HEADS, c)), next((c for c in df.columns if c != name), name))
    return df.select(F.trim(F.col(f"`{name}`")).alias("name"), F.coalesce(F.trim(F.col(f"`{desc}`")), F.lit("")).alias("description")).where("name <> ''")


def knowledge_sheets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Uploaded sheets (CSV) as one: document is required, other columns may be missing; metadata that is no JSON becomes {"raw_text": ...}."""
    from tamarind.functions.text import with_fallback_json

    out = None
    for p in paths:
        df = spark.read.csv(p, header=True, multiLine=True, escape='"')
        if "document" not in df.columns:
            raise ValueError(f"{p} has no column document")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    for c in ("description", "examples", "keyword", "metadata"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.where(F.length(F.trim("document")) > 0).withColumn("metadata", F.when(F.col("metadata").isNotNull(), with_fallback_json("metadata")))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; drivers and credentials come with the options, never from this library."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def append_log(df: DataFrame, folder: str) -> None:
    """Query records as JSON lines, appended; parts are written once each."""
    df.write.mode("append").json(folder)


BATCH_FIELDS = ["question", "domain", "candidate_domains", "tables", "intent", "entities", "sql", "validator", "rows", "confidence", "timing"]


def write_batch(df: DataFrame, folder: str, more: list[str] = []) -> None:  # noqa: B006
    """A batch's results as JSON: the usual fields that df has, and `more`."""
    df.select(*[c for c in [*BATCH_FIELDS, *more] if c in df.columns]).write.mode("overwrite").json(folder)


def write_json(df: DataFrame, folder: str) -> None:
    """Processed questions, or anything else, as JSON lines."""
    df.write.mode("overwrite").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def merge_results(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Result sheets as one: by name, missing columns null, one row for each key (the smallest by `order`), sorted with nulls last."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    first = every.groupBy(*keys).agg(F.min_by(F.struct(*every.columns), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("￿")) for c in [*order, *every.columns]])).alias("r"))
    return first.select("r.*").orderBy(*[F.asc_nulls_last(c) for c in order])
