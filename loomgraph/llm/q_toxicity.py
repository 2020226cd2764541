"""Query of operator 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .toxicity import learn, score_table


def op10_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' toxicity, learnt from the labelled ones outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return score_table(docs, learn(docs, read(spark, sf_dir, "labels")))
