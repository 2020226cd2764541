"""Query and SQL of operator 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .suffixes import SUFFIXES
from .url_filter import filter_urls, path_of

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. A page shows the document whose number its path has; that document's labels are the page's outcome."""
    item = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})", 1).try_cast("bigint")
    pages = read(spark, sf_dir, "pages").select("page_id", "url", item.alias("item"))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(pages, labels, RULES)


def _strength_sql(name: str, children: str, parent: str) -> str:
    return f"""{name} AS (
  SELECT 1 / CASE WHEN b > 0 THEN least(0.99, greatest(0.0001, a / b)) ELSE 1 / 11.0 END - 1 AS k FROM (
    SELECT sum(xx - x * x / n - x / n * (1 - x / n) * (c - 1)) AS a, sum(x / n * (1 - x / n) * (n - nn / n - (c - 1))) AS b FROM (
      SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS x, sum(x * x / CAST(n AS DOUBLE)) AS xx, sum(CAST(n AS DOUBLE) * n) AS nn, count(*) AS c
      FROM {children} WHERE n > 0 GROUP BY {parent})))"""


_LIST = ", ".join(f"'{x}'" for x in SUFFIXES)


def _ending(labels: int) -> str:
    return rf"regexp_extract(host, '([^.]*\.){{0,{labels - 1}}}[^.]*$')"


_LABELS = f"CASE WHEN {_ending(3)} IN ({_LIST}) AND contains(host, '.') THEN len(string_split({_ending(3)}, '.')) WHEN {_ending(2)} IN ({_LIST}) THEN 2 ELSE 1 END"
_G = "CASE WHEN abs(1 - {0}) < 1e-3 THEN (1 - {0}) / 3 + (1 - {0}) * (1 - {0}) / 6 ELSE (1 - {0} * {0} + 2 * {0} * ln({0})) / ((1 - {0}) * (1 - {0})) END"

OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), told AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), p AS (
  SELECT u.*, bad FROM u LEFT JOIN told ON told.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT)
), hosts AS (
  SELECT host, CASE labels WHEN 3 THEN {_ending(4)} WHEN 2 THEN {_ending(3)} ELSE {_ending(2)} END AS domain,
    CASE labels WHEN 3 THEN {_ending(3)} WHEN 2 THEN {_ending(2)} ELSE {_ending(1)} END AS suffix, n, x FROM (
    SELECT host, {_LABELS} AS labels, count(bad) AS n, coalesce(sum(bad), 0) AS x FROM p GROUP BY host)
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, 1 AS everything, sum(n) AS n, sum(x) AS x FROM domains GROUP BY suffix
), m AS (
  SELECT (sum(x) + 0.5) / (sum(n) + 1.0) AS m0 FROM suffixes
), {_strength_sql("k0", "suffixes", "everything")}, {_strength_sql("k1", "domains", "suffix")}, {_strength_sql("k2", "hosts", "domain")}, s AS (
  SELECT suffix, (x + k0.k * m0) / (n + k0.k) AS ms FROM suffixes, k0, m
), d AS (
  SELECT domain, (x + k1.k * ms) / (n + k1.k) AS md FROM domains JOIN s USING (suffix), k1
), h AS (
  SELECT host, n, x + k2.k * md AS a, n - x + k2.k * (1 - md) AS b FROM hosts JOIN d USING (domain), k2
), g AS (
  SELECT *, 0.3::DOUBLE AS q, 0.7::DOUBLE AS p, a + b + 1 AS m, (b + 0.5) / ((a + b + 1) * 0.7::DOUBLE) AS rs, (a + 0.5) / ((a + b + 1) * 0.3::DOUBLE) AS rt FROM h
), z AS (
  SELECT *, (b + 0.5 + 1 / 6.0::DOUBLE - (m + 1 / 3.0::DOUBLE) * p + 0.02::DOUBLE * (q / (b + 1) - p / (a + 1) + (q - 0.5) / (m + 1)))
    * sqrt((1 + q * ({_G.format("rs")}) + p * ({_G.format("rt")})) / ((m + 1 / 6.0::DOUBLE) * p * q)) AS z,
    exp(a * ln(q) + b * ln(p) - lgamma(a) - lgamma(b) + lgamma(a + b)) AS e FROM g
), t AS (
  SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z
), c AS (
  SELECT *, t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) * exp(-z * z / 2) * 0.3989422804014327::DOUBLE AS tail FROM t
), b AS (
  SELECT host, n, 1 - least(1, greatest(0, CASE WHEN z > 0 THEN 1 - tail ELSE tail END + e / a - e * q * (a + b) / (a * b))) AS sure FROM c
), o AS (
  SELECT page_id, host, path, n, sure, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM p JOIN b USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN sure > 0.95 THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n AS BIGINT) AS n_labelled, round(sure, 5) AS bad_sure
FROM o
"""
