"""A corpus pipeline of five stages; each reads what its predecessor kept, written as Parquet.

documents -> without toxic ones -> one of each near-duplicate group -> without benchmark
leaks -> mixed to the sources' target weights -> token file.

Every stage takes all rows that its predecessor kept and gives them back with all their
columns, whatever their names; only the last has columns of its own. Null and empty texts,
null ids, repeated rows and an empty table have a defined result in each, told below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import read, scratch_path
from loomgraph.llm.decontaminate import clean
from loomgraph.llm.mixing import mix
from loomgraph.llm.near_dedup import one_of_each
from loomgraph.llm.q_tokens import tokenizer_path
from loomgraph.llm.token_file import token_table
from loomgraph.llm.toxicity import learn, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine doesn't reject; labels come from the table, texts from docs.

    Each row is judged by its text alone, so repeated rows stay or go together. Null and
    empty texts have no word to reject and stay, unless most labelled texts are toxic.
    Without labels, or without documents to learn from, nothing is rejected.
    """
    return without_toxic(docs, learn(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null and empty texts, and rows without an id, are in no group and stay. Rows of one id
    are one document: all of them stay or go.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay; items without a word are in no document. All
    rows of an id go if one of its texts holds an item, and so for rows without an id.
    """
    return clean(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice.

    Documents without a word are taken once. A null source is a source of its own; rows
    that agree in id, source and size are taken equally often.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's rows: doc_id, start, n_tokens, ids_crc32.

    A text without words is its end id alone; rows without an id come first, and copies of
    a document one after the other.
    """
    return token_table(docs, tokenizer_path(), end_id=2)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("tokens", tokens)]

#: Neither the machine's scores nor the tokenizer have a form in SQL; tests/llm/test_pipeline.py has the stages checked one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
