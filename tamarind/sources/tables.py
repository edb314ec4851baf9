"""Tables as views, live schema, and row-filtered views for tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str], only: dict[str, Column] | None = None) -> None:
    """Views over the tables of a folder. `only` gives a row filter for a table: whoever queries the view sees those rows alone."""
    for name in names:
        df = read_table(spark, folder, name)
        if only and name in only:
            df = df.where(only[name])
        df.createOrReplaceTempView(name)


def information_schema(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table_name, columns): the live columns of views, in their order."""
    rows = [(n, i, f.name, f.dataType.simpleString()) for n in names for i, f in enumerate(spark.table(n).schema.fields)]
    cols = spark.createDataFrame(rows, "table_name string, ordinal int, column string, type string")
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "column", "type")))
    return cols.groupBy("table_name").agg(F.transform(listed, lambda c: F.struct(c["column"], c["type"])).alias("columns"))
