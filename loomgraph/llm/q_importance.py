"""Query of operator 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .importance import resample


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their importance weight and whether they are drawn."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
