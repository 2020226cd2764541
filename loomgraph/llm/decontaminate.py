r"""Benchmark decontamination: test items found inside documents by size-partitioned MinHash containment search.

Words are runs of letters and digits, lower-cased; an item's set holds its distinct
SHINGLE-word shingles (an item with fewer words: its whole sequence as one). Items are
partitioned by set size in powers of two. From each set the m smallest hash values are
kept, m = floor((1 - threshold) * partition's upper size) + 1: the item's MinHash sketch
without repetition. A document that holds at least threshold of an item's set lacks at
most (1 - threshold) * size of it, so it holds one of any m: a document whose own set
meets the sketch is a candidate, and none is missed. The few candidates are verified by
exact containment of the full sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, without_ids

TERM = r"[^\x00-/:-@\[-`{-\x7F]+"
SHINGLE = 4
SALTS = 16
#: Sides of up to so many rows of a few longs are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 200_000


def terms(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def shingles_of(w: Column, n: Column, length: int) -> Column:
    """Hashes of the runs of length words of an array column."""
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(length)]))).otherwise(F.array().cast("array<bigint>"))


def _sets(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows, with its array _w replaced by distinct hashes _h of runs of each length."""
    n = F.size("_w")
    parts = [shingles_of(F.col("_w"), n, j) for j in lengths]
    return rows.withColumn("_h", F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])).drop("_w")


def _flat(sets: DataFrame) -> DataFrame:
    """A row a hash. The outer form keeps the optimizer from inferring a filter on the array, which would compute it inside its own lambda, once an element."""
    return sets.select("doc_id", "_th", F.explode_outer("_h").alias("h")).where("h IS NOT NULL")


def item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """item_id, h, len, n_item: an item's distinct hashes; items without a word have none. Equal ids are joined into one set."""
    own = items.select(F.col("item_id"), terms(F.col("text")).alias("_w")).withColumn("len", F.least(F.size("_w"), F.lit(shingle))).where("len > 0")
    n = F.size("_w")
    pick = None
    for j in range(1, shingle + 1):
        s = shingles_of(F.col("_w"), n, j)
        pick = F.when(F.col("len") == j, s) if pick is None else pick.when(F.col("len") == j, s)
    flat = own.select("item_id", "len", F.explode_outer(F.array_distinct(pick)).alias("h")).where("h IS NOT NULL").distinct()
    size = flat.groupBy("item_id").agg(F.count("*").alias("n_item")).withColumnRenamed("item_id", "_i")
    return flat.join(size, flat["item_id"].eqNullSafe(size["_i"])).drop("_i")


def _probe(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Inner join of the many-row left side with a side of a counted number of rows; salted where it is too large to broadcast."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys)
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_th"), F.lit(SALTS)).cast("int")).join(right, [*keys, "_salt"]).drop("_salt")


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.5, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair with containment >= threshold.

    docs: doc_id and text; items: item_id and text; other columns are not read. Null and
    empty texts match nothing; a null doc_id or item_id is an id like any other; rows that
    agree in doc_id and text give one result; items of one id are one item. Empty tables
    give no rows. Texts are scanned whole, once for candidates; candidates' texts once more.
    """
    found = Table(item_shingles(items, shingle), "items")
    lengths = sorted(r.len for r in found.df.select("len").distinct().collect())  # at most `shingle` values
    keyed = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")).withColumn("_th", F.xxhash64("_t"))
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_item").cast("double"))))
    m = F.least(F.floor((1 - threshold) * upper).cast("long") + 1, F.col("n_item"))
    kept = found.df.groupBy("item_id", "n_item").agg(F.array_sort(F.collect_list("h")).alias("hs")).withColumn("h", F.explode(F.slice("hs", F.lit(1), m.cast("int"))))
    sketch = Table(kept.select("h").distinct(), "sketch")
    n_sketch = sketch.df.count()
    hashes = _sets(keyed.select("doc_id", "_th", terms(F.col("_t")).alias("_w")), lengths or [shingle])
    hits = _probe(_flat(hashes), sketch.df, ["h"], n_sketch)
    candidates = Table(hits.select("doc_id", "_th").distinct(), "candidates")
    n_docs = candidates.df.count()
    c = candidates.df.withColumnsRenamed({"doc_id": "_d", "_th": "_c"})
    c = F.broadcast(c) if n_docs <= BROADCAST_ROWS else c
    again = keyed.join(c, (keyed["_th"] == c["_c"]) & keyed["doc_id"].eqNullSafe(c["_d"]), "left_semi").dropDuplicates(["doc_id", "_th"])
    sets = _sets(again.select("doc_id", "_th", terms(F.col("_t")).alias("_w")), lengths or [shingle])
    n_items = found.df.count()
    shared = _probe(_flat(sets), found.df.select("h", "item_id", "n_item"), ["h"], n_items)
    pairs = shared.groupBy("doc_id", "_th", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    pairs = pairs.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_item")
    return pairs.where(share >= threshold).select("doc_id", "item_id", "n_shared", "n_item", share.alias("containment"))


def clean(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """docs' rows without those whose doc_id has a contained item."""
    return without_ids(docs, contained(docs, items, **params).select("doc_id"))
