"""Query and SQL of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .decontaminate import contained


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, least(len(w), 4) AS k, s FROM (
    SELECT item_id, w, unnest([array_to_string(w[i:i + least(len(w), 4) - 1], ' ') for i in range(1, len(w) - least(len(w), 4) + 2)]) AS s FROM b WHERE len(w) > 0)
), n AS (
  SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id
), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7F]+') AS w FROM documents
), ds AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s
    FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k)
)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.5 * n_item
"""
