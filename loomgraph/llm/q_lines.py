"""Query and SQL of operator 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .line_dedup import remove_boilerplate


def op8_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that six sources or more share: counts, length and digest of what is left."""
    d = remove_boilerplate(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("clean_chars"), F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), u AS (
  SELECT r, t, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d WHERE t <> ''
), n AS (
  SELECT r, i, l, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]', ' ', 'g'), '[0-9]+', '0', 'g')) AS k FROM u
), bad AS (
  SELECT k FROM n JOIN d USING (r) WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 6
), o AS (
  SELECT r, count(*) AS n_lines, count(bad.k) AS n_removed, coalesce(string_agg(CASE WHEN bad.k IS NULL THEN l END, chr(10) ORDER BY i), '') AS c
  FROM n LEFT JOIN bad USING (k) GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(length(coalesce(c, '')) AS BIGINT) AS clean_chars, md5(coalesce(c, '')) AS clean_md5
FROM d LEFT JOIN o USING (r)
"""
