"""File hashes and what changed since they were kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_hashes(files: DataFrame) -> DataFrame:
    """path, sha256 of files (path, content)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, change: added, modified or deleted, of two tables of path and sha256."""
    j = now.select("path", F.col("sha256").alias("n")).join(before.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("n") != F.col("b"), "modified")
    return j.select("path", change.alias("change")).where("change IS NOT NULL")
