"""JSON documents of graphs and of behavioural facts, read with fixed schemas and missing keys as defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = """entities ARRAY<STRUCT<id STRING, type STRING, name STRING, file STRING, line LONG, metadata MAP<STRING,STRING>>>,
relationships ARRAY<STRUCT<source STRING, target STRING, type STRING, confidence STRING, evidence STRING, line LONG>>,
clusters ARRAY<STRUCT<id STRING, name STRING, members ARRAY<STRING>, description STRING>>"""
BEHAVIOR = """call_graph MAP<STRING, STRUCT<calls ARRAY<STRUCT<target STRING, line LONG>>, called_by ARRAY<STRING>>>,
state_mutations ARRAY<STRUCT<type STRING, file STRING, line LONG, enclosing_method STRING, enclosing_class STRING, context STRING>>,
widget_lifecycle ARRAY<STRUCT<widget STRING, component STRING, file STRING, line LONG, overrides ARRAY<STRING>>>,
providers ARRAY<STRUCT<type STRING, file STRING, line LONG, notifier_class STRING, state_type STRING, enclosing_class STRING>>,
entry_points ARRAY<STRUCT<file STRING, line LONG, type STRING>>,
change_notifiers ARRAY<STRUCT<class STRING, file STRING, line LONG>>"""


def _rows(doc: DataFrame, field: str) -> DataFrame:
    return doc.select(F.posexplode(field).alias("seq", "x")).select("x.*", F.col("seq").cast("long").alias("seq"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of a graph document."""
    d = spark.read.schema(GRAPH).json(path, multiLine=True)
    e = _rows(d, "relationships").withColumn("confidence", F.coalesce("confidence", F.lit("EXTRACTED")))
    return _rows(d, "entities"), e


def read_behavior(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """calls, mutations, components, providers, entries and containers of a behavioural document."""
    d = spark.read.schema(BEHAVIOR).json(path, multiLine=True)
    calls = d.select(F.explode("call_graph").alias("source", "v")).select("source", F.explode("v.calls").alias("c")).select("source", "c.target", "c.line")
    comp = _rows(d, "widget_lifecycle").select(F.coalesce("widget", "component").alias("name"), "file", "line", F.coalesce("overrides", F.array().cast("array<string>")).alias("overrides"), "seq")
    return {"calls": calls, "mutations": _rows(d, "state_mutations"), "components": comp, "providers": _rows(d, "providers"), "entries": _rows(d, "entry_points"), "containers": _rows(d, "change_notifiers").select(F.col("class").alias("name"), "file", "line")}
