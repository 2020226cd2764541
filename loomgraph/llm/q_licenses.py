"""Query and SQL of operator 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .licenses import FILE_NAMES, TEMPLATES, THRESHOLD, scan, vectors


def op7_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree: ten to a directory, a hundred directories to a parent; ids that 10 divides are licence files, those that 1000 divides their parent's."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    path = F.when(i % 1000 == 0, F.concat(F.expr("doc_id div 1000"), F.lit("/COPYING.txt"))).otherwise(F.concat(F.expr("doc_id div 1000"), F.lit("/"), F.expr("doc_id div 10"), F.lit("/"), F.when(i % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))))
    found = scan(d.select(path.alias("path"), "text"))
    # a path names its document
    name = F.substring_index("path", "/", -1)
    back = F.when(name == "COPYING.txt", F.substring_index("path", "/", 1).cast("long") * 1000).when(name == "LICENSE", F.element_at(F.split("path", "/"), 2).cast("long") * 10).otherwise(F.substring_index(name, ".", 1).cast("long"))
    return found.select(back.alias("doc_id"), "own_license", "own_score", "license", "origin", "licence_file")


def _sql() -> str:
    unit, idf, rare = vectors()
    text = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ", ".join(f"({text(t)}, {j}, {text(TEMPLATES[j][0])}, CAST({x!r} AS DOUBLE))" for j, v in enumerate(unit) for t, x in v.items())
    idfs = ", ".join(f"({text(t)}, CAST({x!r} AS DOUBLE))" for t, x in idf.items())
    names = ", ".join(map(text, FILE_NAMES))
    return rf"""
WITH idf(term, idf) AS (VALUES {idfs}), weight(term, j, license, w) AS (VALUES {weights}), f AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 1000 = 0 THEN (doc_id // 1000) || '/COPYING.txt'
    ELSE (doc_id // 1000) || '/' || (doc_id // 10) || '/' || CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END END AS path FROM documents
), g AS (
  SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, lower(split_part(regexp_extract(path, '[^/]*$'), '.', 1)) IN ({names}) AS is_file FROM f
), u AS (
  SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
    SELECT doc_id, CASE WHEN is_file THEN list_append(string_split(t, chr(10)), t) ELSE string_split(t, chr(10)) END AS ls FROM g)
), tf AS (
  SELECT doc_id, i, term, count(*) AS tf FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(l), '[^\x00-/:-@\[-`{{-\x7F]+')) AS term FROM u) GROUP BY doc_id, i, term
), norm AS (
  SELECT doc_id, i, sqrt(sum(power(tf * coalesce(idf, {rare!r}), 2))) AS norm FROM tf LEFT JOIN idf USING (term) GROUP BY doc_id, i
), dot AS (
  SELECT doc_id, i, j, license, sum(tf * idf * w) AS dot FROM tf JOIN idf USING (term) JOIN weight USING (term) GROUP BY doc_id, i, j, license
), own AS (
  SELECT doc_id, max({{'score': score, 'license': license}}) AS b FROM (SELECT doc_id, license, round(dot / norm, 9) AS score FROM dot JOIN norm USING (doc_id, i)) WHERE score >= {THRESHOLD} GROUP BY doc_id
), k AS (
  SELECT g.doc_id, path, dir, is_file, b.license AS own_license, b.score AS own_score FROM g LEFT JOIN own USING (doc_id)
), src AS (
  SELECT dir, max({{'score': own_score, 'license': own_license, 'path': path}}) AS s FROM k WHERE is_file AND own_license IS NOT NULL GROUP BY dir
), near AS (
  SELECT k.doc_id, arg_max(s, length(src.dir)) AS s FROM k JOIN src ON k.dir = src.dir OR starts_with(k.dir, src.dir || '/') GROUP BY k.doc_id
)
SELECT k.doc_id, own_license, own_score, coalesce(own_license, s.license) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN s IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own_license IS NULL THEN s.path END AS licence_file
FROM k LEFT JOIN near USING (doc_id)
"""


OP7_SQL = _sql()
