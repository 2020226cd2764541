"""Quality rules: counts on each text, and line frequency across the documents of a host."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Table, words

SYMBOLS = "#*$%&|<>"
SALTS = 8


def _without(text: Column, chars) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), chars, text)


def line_texts(text: Column) -> Column:
    r"""Array of normalised lines: lower case, blanks collapsed and trimmed, digit runs as 0; lines without a word are left out."""
    t = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    t = F.regexp_replace(t, "[0-9]+", "0")
    return F.filter(F.transform(F.split(t, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def text_counts(docs: DataFrame, text: str, window: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) of a non-null text column.

    Everything happens within a row. Windows of words are compared by 64-bit hashes of
    the words' hashes; a text whose windows all differ costs one hash set, others a sort.
    """
    t = F.col(text)
    d = docs.withColumn("_w", words(t))
    d = d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("_n", F.size("_w"))
    d = d.withColumn("_win", F.when(F.col("_n") >= window, F.transform(F.sequence(F.lit(0), F.col("_n") - window), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_win")) < F.size("_win")
    d = d.withColumn("_sorted", F.when(again, F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    d = d.withColumn("_twice", F.array_sort(F.transform(F.filter("_sorted", lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"])), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_twice", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_twice", i + 1) - p, F.lit(window)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_lines", lines)
    return d.select(
        *docs.columns,
        F.col("_n").cast("long").alias("n_words"),
        F.length(_without(t, BLANKS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def _salted(keys: DataFrame) -> DataFrame:
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def judge(docs: DataFrame, host: str = "source", min_line_docs: int = 50, line_share: float = 0.01, min_left_share: float = 0.5, min_left_words: int = 5) -> DataFrame:
    """Per document its counts, base_failed, line_words, removed_words and kept.

    Lines are normalised and hashed with their host; a line found in more than
    max(min_line_docs, line_share * the host's documents) distinct documents of one host is
    boilerplate. A document is depleted, and not kept, if of the words of its different
    lines under min_left_words or under min_left_share are left without boilerplate.

    docs: needs doc_id, text and the host column. Rows that agree in doc_id, text and host
    are one document: they count once and get one verdict each; under another host the
    same text is judged by that host's lines. A null text is empty: it has no words, so
    its base rules fail; a null host is a host of its own, and a null doc_id an id like
    any other. Whole texts are read once; what is shuffled is two numbers a line. A line's
    documents are counted before the shuffle and spread over SALTS keys for the join, so a
    line that a third of all documents hold is no hot key. An empty table gives no rows.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").alias("doc_id"), t.alias("_t"), F.xxhash64(F.col(host).cast("string")).alias("_hh"))
    lines = line_texts(F.col("_t"))
    own = own.withColumn("_norm", F.array_distinct(lines))
    n_terms = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1
    key = F.transform("_norm", lambda s: F.struct(F.xxhash64(F.col("_hh"), s).alias("k"), n_terms(s).alias("w")))
    own = own.select("doc_id", "_hh", F.xxhash64("_t").alias("_th"), key.alias("_keys"), "_t")
    table = Table(text_counts(own, "_t").drop("_t"), "line-rules")
    same = ["doc_id", "_th", "_hh"]
    hosts = table.df.select(*same).distinct().groupBy("_hh").agg(F.count("*").alias("n_host"))
    line = table.df.select(*same, F.explode("_keys").alias("_l")).select(*same, "_l.k", "_l.w")
    found = line.groupBy("k").agg(F.count("*").alias("n"), F.min("_hh").alias("_hh")).where(F.col("n") > min_line_docs)
    found = found.join(hosts, "_hh").where(F.col("n") > line_share * F.col("n_host"))
    # rows are at least as many as documents: of the lines that rows make frequent, documents are counted
    often = Table(_salted(found.select("k", "n_host")), "often")
    hits = Table(line.withColumn("salt", F.pmod(F.col("_th"), F.lit(SALTS)).cast("int")).join(often.df, ["k", "salt"]).groupBy(*same, "k", "n_host").agg(F.max("w").alias("w")), "hits")
    sure = hits.df.groupBy("k").agg(F.count("*").alias("n"), F.max("n_host").alias("n_host"))
    sure = sure.where((F.col("n") > min_line_docs) & (F.col("n") > line_share * F.col("n_host"))).select("k")
    bad = hits.df.withColumn("salt", F.pmod(F.col("_th"), F.lit(SALTS)).cast("int")).join(_salted(sure), ["k", "salt"])
    lost = bad.groupBy(*same).agg(F.sum("w").alias("r")).withColumnsRenamed({"doc_id": "_d", "_th": "_h", "_hh": "_g"})
    d = table.df.withColumn("line_words", F.aggregate("_keys", F.lit(0).cast("long"), lambda a, x: a + x["w"])).drop("_keys")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("line_words") - F.col("removed_words")
    d = d.join(lost, d["doc_id"].eqNullSafe(lost["_d"]) & (d["_th"] == lost["_h"]) & (d["_hh"] == lost["_g"]), "left").withColumn("removed_words", F.coalesce("r", F.lit(0)).cast("long"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "line_words", "removed_words", (~base_failed & (left >= min_left_words) & (left >= min_left_share * F.col("line_words"))).alias("kept"))
