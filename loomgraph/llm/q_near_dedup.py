"""Query of operator 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .near_dedup import near_duplicates


def op9_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate components."""
    return near_duplicates(read(spark, sf_dir, "documents"))
