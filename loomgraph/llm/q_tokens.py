"""Query of operator 4."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .token_file import token_table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    if found := os.environ.get("LOOMGRAPH_TOKENIZERS"):
        return os.path.join(found, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded, written in the Elias-Fano format and read back."""
    return token_table(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
