"""Question batches as streams over files: every arriving file is answered once, with progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", per_batch: int = 1) -> DataFrame:
    """New files of a folder as a stream, `per_batch` at a time."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_batch).load(folder)


def process(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, progress: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """answer(batch) of each micro-batch to Parquet under `out`/batch=<n>, each batch once: a batch that is run again overwrites its own part."""

    def one(batch: DataFrame, epoch: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        if progress:
            progress(epoch, batch.count())

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, group: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, group, n): rows per tumbling window; rows later than `late` behind the newest are left out. An extension beside the batch queries."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, size), group).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), group, "n")
