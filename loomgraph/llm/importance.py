"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two bag-of-n-grams models over hashed words and word pairs are counted: the raw one over
every document, the target one over labelled documents of high quality. A document's log
importance weight is the log ratio of the two models' likelihoods of its text: the sum
over all its n-grams, whatever their number. With Gumbel noise from the document's own
hash added, the k largest keys are a sample of k documents without replacement, drawn by
weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, kth_largest
from .shingles import mix, pair_hashes, slices, word_hashes

BUCKETS = 1 << 16


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words and word pairs, text of each)."""
    h, b = word_hashes(texts)
    s, c = pair_hashes(h, b)
    owner = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(b)), np.repeat(np.arange(len(texts)), np.diff(c))])
    return (np.concatenate([h, mix(s)]) >> np.uint64(48)).astype(np.int64), owner


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of two count vectors, each smoothed towards the raw shares by half a thousandth of its mass."""
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    strength = max(1.0, 5e-4 * target.sum())
    q = (target + strength * p) / (target.sum() + strength)
    return np.log(q / p)


def log_weights(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Log importance weight of each text of a large_string array; 0 without words."""
    k, owner = buckets_of(texts)
    return np.bincount(owner, ratio[k], len(texts)).astype(np.float64)


def _ordered(x: np.ndarray) -> np.ndarray:
    """int64 in the order of finite doubles."""
    b = (x + 0.0).view(np.int64)
    return np.where(b < 0, b ^ np.int64((1 << 63) - 1), b)


def good_share(labels: DataFrame) -> float:
    """The share of quality 1 among labelled documents, one of several labels counting by its worst; 1 without labels."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    r = told.agg(F.avg((F.col("q") == 1).cast("double"))).first()[0]
    return 1.0 if r is None else float(r)


def learn_ratio(docs: DataFrame, labels: DataFrame, max_target: int = 20_000) -> np.ndarray:
    """The log ratio of each bucket. Raw counts cover all documents.

    Target documents are those labelled with quality 1 (and not toxic, where that is told),
    at most max_target of them, the ones whose ids' hashes come first; their ids are
    broadcast. Null labels don't count; an id labelled twice needs every label good. Each
    task sums its texts' counts before anything is shuffled.
    """
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.min("quality").alias("q"), F.max(toxic).alias("t"))
    good = told.where("q = 1 AND t = 0").orderBy(F.xxhash64("k"), "k").limit(max_target).select("k", F.lit(True).alias("good"))

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            flag = b.column("good").fill_null(False).to_numpy(zero_copy_only=False)
            for at, texts in slices(b.column("text")):
                k, owner = buckets_of(texts)
                raw += np.bincount(k, minlength=BUCKETS)
                target += np.bincount(k[flag[at : at + len(texts)][owner]], minlength=BUCKETS)
        on = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(raw[on]), pa.array(target[on])], ["b", "raw", "target"])

    d = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("text")).join(F.broadcast(good), "k", "left").select("text", "good")
    sums = d.mapInArrow(count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:  # at most BUCKETS rows
        raw[r.b], target[r.b] = r.raw, r.target
    return log_ratio(raw, target)


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 1) -> DataFrame:
    """doc_id, log_weight, gumbel_key and kept of every row of docs; round(keep * rows) rows are kept.

    keep is the share to draw; where none is given, the share of good documents among the
    labelled ones, so that the sample is as large as the target's part of the corpus.

    docs: doc_id and text; labels: doc_id, quality and perhaps toxic; other columns are not
    read. Null and empty texts weigh 1 (log weight 0). The noise is a hash of doc_id, text
    and seed, so reruns agree; repeated rows have equal keys, and rows that tie with the
    last one kept are kept too. The cut is found by radix selection over the scores, not
    by a sort of all rows. Empty tables give no rows; without good labels all weigh 1.
    """
    ratio = learn_ratio(docs, labels)

    def run(batches):
        for b in batches:
            out = np.concatenate([log_weights(t, ratio) for _, t in slices(b.column("text"))]) if b.num_rows else np.zeros(0)
            u = ((b.column("h").to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            key = out - np.log(-np.log(u))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out), pa.array(key), pa.array(_ordered(key))], ["doc_id", "log_weight", "gumbel_key", "place"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    scored = Table(d.mapInArrow(run, "doc_id long, log_weight double, gumbel_key double, place long"), "importance")
    n = scored.df.count()
    k = round((good_share(labels) if keep is None else keep) * n)
    cut = kth_largest(lambda: scored.df, "place", k) if k > 0 else (1 << 63) - 1
    return scored.df.select("doc_id", "log_weight", "gumbel_key", (F.col("place") >= cut).alias("kept"))
