"""Line dedup across sites: lines that many distinct sites share are boilerplate.

A line is normalised and hashed. For each hash a HyperLogLog sketch of its sites is
built and merged by aggregation, which stays small however often a line occurs. Only
lines whose estimate is near the threshold get an exact distinct count; those clearly
above or below are decided by the sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table
from .quality_rules import line_texts

LG_K = 10
SALTS = 8


def shared_lines(lines: Table, min_sites: int) -> DataFrame:
    """k: hashes of lines of at least min_sites distinct sites. lines: k, site (bigint hash of the site).

    The sketch's standard error is 1.04 / sqrt(2 ** LG_K), 3.25 %; within five of them the
    count is exact, from distinct (line, site) pairs, of which a line has no more than
    there are sites.
    """
    near = max(2.0, 5 * 1.04 / (1 << LG_K) ** 0.5 * min_sites)
    est = lines.df.groupBy("k").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("est")).where(F.col("est") >= min_sites - near)
    est = Table(est, "line-sketches").df
    sure = est.where(F.col("est") > min_sites + near).select("k")
    doubt = est.where(F.col("est") <= min_sites + near).select("k")
    pairs = lines.df.select("k", "site").distinct().join(doubt, "k", "left_semi")
    exact = pairs.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("k")
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 6, min_chars: int = 1) -> DataFrame:
    """doc_id, clean_text, n_lines, n_removed of every row.

    Lines are compared in lower case, with blanks collapsed and digit runs as 0; lines
    without a word stay, as do normalised lines under min_chars characters where a caller
    asks for more than the 1 that every line with a word has. A line is removed,
    every time, from every document if at least min_sites distinct sites have it; other
    lines keep their bytes and order. Null and empty texts have no lines; clean_text is
    then empty. A null site is a site of its own. Rows that agree in doc_id and text get
    one result each. Only hashes are shuffled for counting; the texts are shuffled once,
    to meet their removed lines. A line in a third of all documents is counted before the
    shuffle and joined under SALTS keys.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").alias("doc_id"), t.alias("_t"), F.xxhash64(F.col(site).cast("string")).alias("_site"))
    own = own.withColumn("_th", F.xxhash64("_t"))
    norm = F.filter(F.array_distinct(line_texts(F.col("_t"))), lambda s: F.length(s) >= min_chars)
    keys = own.select("doc_id", "_th", "_site", F.transform(norm, lambda s: F.xxhash64(s)).alias("_k"))
    lines = Table(keys.select("doc_id", "_th", F.col("_site").alias("site"), F.explode_outer("_k").alias("k")).where("k IS NOT NULL"), "lines")
    bad = shared_lines(lines, min_sites).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = lines.df.withColumn("salt", F.pmod("_th", F.lit(SALTS)).cast("int")).join(bad, ["k", "salt"])
    lost = hits.groupBy("doc_id", "_th").agg(F.collect_set("k").alias("_bad")).withColumnRenamed("doc_id", "_d").withColumnRenamed("_th", "_h")
    d = own.drop("_site").join(lost, own["doc_id"].eqNullSafe(lost["_d"]) & (own["_th"] == lost["_h"]), "left").drop("_d", "_h")
    d = d.withColumn("_raw", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", "\n")))
    one = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " "), "[0-9]+", "0"))
    kept = F.when(F.col("_bad").isNull(), F.col("_raw")).otherwise(F.filter("_raw", lambda s: (F.length(one(s)) < min_chars) | ~F.array_contains("_bad", F.xxhash64(one(s)))))
    d = d.withColumn("_left", kept)
    return d.select("doc_id", F.when(F.col("_bad").isNull(), F.col("_t")).otherwise(F.array_join("_left", "\n")).alias("clean_text"), F.size("_raw").cast("long").alias("n_lines"), (F.size("_raw") - F.size("_left")).cast("long").alias("n_removed"))
