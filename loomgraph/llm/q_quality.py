"""Query and SQL of operator 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .quality_rules import judge


def op1_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; its source is its host."""
    return judge(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), starts AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5
), found AS (
  SELECT r, list(i) AS pos FROM starts GROUP BY r, w[i:i + 4] HAVING count(*) > 1
), spread AS (
  SELECT r, count(DISTINCT i + k.k) AS n FROM (SELECT r, unnest(pos) AS i FROM found), (SELECT unnest(range(5)) AS k) AS k GROUP BY r
), counts AS (
  SELECT d.r, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(spread.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN spread USING (r)
), raw_lines AS (
  SELECT r, unnest(string_split(t, chr(10))) AS l FROM d
), dup AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM raw_lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), norm AS (
  SELECT DISTINCT r, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]', ' ', 'g'), '[0-9]+', '0', 'g')) AS l FROM raw_lines
), line AS (
  SELECT r, d.source, l, length(l) - length(replace(l, ' ', '')) + 1 AS w FROM norm JOIN d USING (r) WHERE l <> ''
), hosts AS (
  SELECT source, count(*) AS n FROM (SELECT DISTINCT source, doc_id, t FROM d) GROUP BY source
), often AS (
  SELECT source, l FROM (SELECT DISTINCT line.source, l, doc_id, t, hosts.n FROM line JOIN d USING (r) JOIN hosts ON line.source IS NOT DISTINCT FROM hosts.source)
  GROUP BY source, l HAVING count(*) > 50 AND count(*) > 0.01 * max(n)
), sums AS (
  SELECT r, sum(w) AS line_words, sum(CASE WHEN often.l IS NULL THEN 0 ELSE w END) AS removed_words
  FROM line LEFT JOIN often ON line.l = often.l AND line.source IS NOT DISTINCT FROM often.source GROUP BY r
), out AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(line_words, 0) AS line_words, coalesce(removed_words, 0) AS removed_words
  FROM d JOIN counts USING (r) LEFT JOIN dup USING (r) LEFT JOIN sums USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  CAST(line_words AS BIGINT) AS line_words, CAST(removed_words AS BIGINT) AS removed_words,
  NOT base_failed AND line_words - removed_words >= 5 AND line_words - removed_words >= 0.5 * line_words AS kept
FROM out
"""
