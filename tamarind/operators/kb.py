"""Knowledge-base upkeep: documents and their examples as two tables of immutable versions.

A write makes a new version of each table it changes and then a pointer with the next number; the pointer with the
greatest number counts. It comes into being by one rename to a name that is not taken, so readers never see half a change,
a write that stops at any point leaves the version before, and of two writers at once the second fails. Tables that no
pointer names any more are removed after the next write but one, so that readers of the version before can end.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.functions import text as T
from tamarind.plans.shared import cut

DOCUMENTS = "doc_id long, document string, metadata string, description string, examples_raw string, keyword string, search_text string, similarity_score double, duplicate_with_id long, duplicate_with_name string"
POINTER = "current-{:09d}.json"
EXAMPLES = "doc_id long, example_text string, example_formatted string"


class KnowledgeBase:
    """Tables under `folder`, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """The numbers of the pointers that are there, in order."""
        there = self._fs.globStatus(self._path("current-*.json")) or []
        return sorted(int(f.getPath().getName()[8:-5]) for f in there)

    def exists(self) -> bool:
        return bool(self._pointers())

    def _read(self, number: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.folder}/{POINTER.format(number)}", wholetext=True).first()[0])

    def _current(self) -> dict[str, str]:
        there = self._pointers()
        if not there:
            raise FileNotFoundError(f"no knowledge base in {self.folder}")
        return self._read(there[-1])

    def create(self) -> None:
        """Empty tables, if there are none."""
        if not self.exists():
            self._write({"documents": self.spark.createDataFrame([], DOCUMENTS), "examples": self.spark.createDataFrame([], EXAMPLES)})

    def valid(self) -> bool:
        """Whether both tables are there and have their columns."""
        try:
            want = {"documents": DOCUMENTS, "examples": EXAMPLES}
            return all([f.name for f in self.table(t).schema] == [c.split()[0] for c in s.split(", ")] for t, s in want.items())
        except (OSError, KeyError, ValueError):
            return False

    def drop(self) -> None:
        """All pointers and tables go, the newest pointer last."""
        there = self._pointers()
        kept = {v for n in there for v in self._read(n).values()}
        for n in there:
            self._fs.delete(self._path(POINTER.format(n)), False)
        for v in kept:
            self._fs.delete(self._path(v), True)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(DOCUMENTS if name == "documents" else EXAMPLES).parquet(f"{self.folder}/{self._current()[name]}")

    def _write(self, changed: dict[str, DataFrame]) -> None:
        there = self._pointers()
        now = self._read(there[-1]) if there else {}
        for name, df in changed.items():
            version = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{version}")
            now[name] = version
        new = POINTER.format(there[-1] + 1 if there else 1)
        made = f"{new}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(made), True)
        out.write(bytearray(json.dumps(now), "utf-8"))
        out.close()
        # Where rename overwrites, the test before it leaves only a moment in which two writers could meet.
        if self._fs.exists(self._path(new)) or not self._fs.rename(self._path(made), self._path(new)):
            raise FileExistsError(f"another write to {self.folder} came first")
        kept = {v for n in there[-1:] for v in self._read(n).values()} | set(now.values())
        for n in there[:-1]:
            old = self._read(n)
            self._fs.delete(self._path(POINTER.format(n)), False)
            for v in set(old.values()) - kept:
                self._fs.delete(self._path(v), True)

    def _rows(self, sheet: DataFrame, doc_id: Column) -> DataFrame:
        has = lambda c: F.col(c) if c in sheet.columns else F.lit(None).cast("string")
        rows = sheet.select(doc_id.alias("doc_id"), F.trim("document").alias("document"), T.with_fallback_json(has("metadata")).alias("metadata"), has("description").alias("description"), has("examples").alias("examples_raw"), has("keyword").alias("keyword"))
        return rows.withColumns({"search_text": T.search_text("document", "description", "keyword"), "similarity_score": F.lit(None).cast("double"), "duplicate_with_id": F.lit(None).cast("long"), "duplicate_with_name": F.lit(None).cast("string")})

    @staticmethod
    def _examples(docs: DataFrame) -> DataFrame:
        e = docs.select("doc_id", F.explode(T.parse_examples("examples_raw")).alias("example_text"))
        return e.withColumn("example_formatted", F.concat(F.lit("passage: "), "example_text"))

    def insert(self, sheet: DataFrame) -> None:
        """Documents (column document, and any of metadata, description, examples, keyword) with their examples; ids go on from the greatest."""
        docs = self.table("documents")
        start = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        # The rows are kept, so that their partitions stay as they are; the counts of these give each its first number.
        placed = cut(sheet.where(F.length(F.trim("document")) > 0)).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        before, at = [], start
        for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():
            before.append((r["_p"], at))
            at += r["n"]
        numbered = placed.join(F.broadcast(self.spark.createDataFrame(before, "_p int, _before long")), "_p")
        new = self._rows(numbered, F.col("_before") + F.col("_i") + 1)
        self._write({"documents": docs.unionByName(new), "examples": self.table("examples").unionByName(self._examples(new))})

    def update(self, doc_id: int, sheet: DataFrame) -> None:
        """One document anew under its id; what is known of its duplicates stays. LookupError if there is none."""
        docs = self.table("documents")
        old = docs.where(F.col("doc_id") == doc_id)
        if old.isEmpty():
            raise LookupError(doc_id)
        kept = ["similarity_score", "duplicate_with_id", "duplicate_with_name"]
        new = self._rows(sheet, F.lit(doc_id).cast("long")).drop(*kept).join(old.select("doc_id", *kept), "doc_id").select(docs.columns)
        self._write({"documents": docs.where(F.col("doc_id") != doc_id).unionByName(new), "examples": self.table("examples").where(F.col("doc_id") != doc_id).unionByName(self._examples(new))})

    def delete(self, doc_id: int) -> None:
        """One document and its examples. LookupError if there is none."""
        docs = self.table("documents")
        if docs.where(F.col("doc_id") == doc_id).isEmpty():
            raise LookupError(doc_id)
        self._write({"documents": docs.where(F.col("doc_id") != doc_id), "examples": self.table("examples").where(F.col("doc_id") != doc_id)})

    def delete_all(self) -> None:
        self._write({"documents": self.spark.createDataFrame([], DOCUMENTS), "examples": self.spark.createDataFrame([], EXAMPLES)})

    def stats(self) -> DataFrame:
        """(documents, examples, examples_per_document)."""
        d = self.table("documents").agg(F.count(F.lit(1)).alias("documents"))
        e = self.table("examples").agg(F.count(F.lit(1)).alias("examples"))
        return d.join(e).select("documents", "examples", F.round(F.coalesce(F.try_divide("examples", "documents"), F.lit(0.0)), 2).alias("examples_per_document"))

    def export(self, doc_id: int | None = None) -> DataFrame:
        """The sheet of all documents, or of one, in the form uploads have."""
        docs = self.table("documents")
        docs = docs if doc_id is None else docs.where(F.col("doc_id") == doc_id)
        return docs.select(*[T.sanitize(c).alias(n) for c, n in (("document", "document"), ("description", "description"), ("examples_raw", "examples"), ("keyword", "keyword"), ("metadata", "metadata"))])


def merge_synonyms(*parts: DataFrame) -> DataFrame:
    """(canonical, variants): dictionaries of (canonical, variant) rows as one, each variant once, in order."""
    from functools import reduce

    return reduce(DataFrame.unionByName, parts).groupBy("canonical").agg(F.sort_array(F.collect_set("variant")).alias("variants"))
