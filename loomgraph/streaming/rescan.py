"""Continuous rescans: new versions of files stream in, and what changed is merged into the hash table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import changed_files, file_hashes


def file_stream(spark, folder: str, schema: str = "path string, content string, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def changes_per_window(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Versions of files and bytes by event-time window; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("versions"), F.sum(F.length("content")).alias("chars")).select(F.col("w.start").alias("start"), "versions", "chars")


def merge_hashes(stream: DataFrame, table: str, log: str, checkpoint: str):
    """Keeps a Parquet table of (path, sha256), a folder a batch, and appends (path, change) to log. Returns the query.

    A batch reads the table of the batch before it and writes its own, so a batch run again
    after a failure gives the same result.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("path").agg(F.max_by("content", "ts").alias("content"))
        new = file_hashes(latest)
        old = spark.read.parquet(f"{table}/{number - 1}") if number else new.limit(0)
        changed_files(new, old.join(new.select("path"), "path", "left_semi")).write.mode("overwrite").parquet(f"{log}/{number}")
        old.join(new.select("path"), "path", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{table}/{number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
