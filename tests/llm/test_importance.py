import math
import random

import numpy as np
import pyarrow as pa

from loomgraph.llm.common import kth_largest
from loomgraph.llm.importance import BUCKETS, buckets_of, log_ratio, log_weights, resample
from loomgraph.llm.q_importance import op5_importance_resampling

R = random.Random(2)


def prose(good):
    return " ".join("".join(R.choice("abcde" if good else "vwxyz") for _ in range(2)) + ("" if good else "###") for _ in range(R.randint(8, 60)))


def test_weights_equal_plain_python(spark):
    texts = [prose(i % 4 > 0) for i in range(40)]
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    k, owner = buckets_of(pa.array(texts, pa.large_string()))
    for b, o in zip(k, owner):
        raw[b] += 1
        target[b] += o % 4 > 0
    ratio = log_ratio(raw, target)
    got = log_weights(pa.array(texts, pa.large_string()), ratio)
    for i, t in enumerate(texts):
        own = k[owner == i]
        assert len(own) == 2 * len(t.split()) - 1
        assert math.isclose(got[i], sum(ratio[b] for b in own), rel_tol=1e-9)


def test_held_out_documents(spark):
    rows = [(i, prose(i % 5 > 0), i % 5 > 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows if i % 2] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in resample(docs, labels, keep=0.8).collect()}
    assert sum(got.values()) == 320
    assert np.mean([got[i] == g for i, _, g in rows if i % 2 == 0]) > 0.95
    assert got == {r.doc_id: r.kept for r in resample(docs.repartition(7), labels, keep=0.8).collect()}


def test_cut_equals_a_sort(spark):
    vals = [R.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + [5, 5, 5, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    for k in (1, 2, 150, 304, 305):
        assert kth_largest(lambda: df, "v", k) == sorted(vals, reverse=True)[k - 1]


def test_odd_rows(spark, sf_dir):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "w " * 60000), (4, "a b c"), (4, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    got = resample(docs, labels, keep=1.0).collect()
    assert len(got) == 6 and all(r.kept for r in got) and {r.log_weight for r in got if r.doc_id in (1, 2)} == {0.0}
    assert {r.log_weight for r in resample(docs, labels.limit(0)).collect()} == {0.0}
    assert resample(docs.limit(0), labels).count() == 0


def test_length_counts():
    """A hundred times a text weighs a hundred times its sum and more, without a bound."""
    ratio = np.linspace(-1, 1, BUCKETS)
    one, many = log_weights(pa.array(["alpha beta gamma", " ".join(["alpha beta gamma"] * 5000)], pa.large_string()), ratio)
    k, _ = buckets_of(pa.array(["gamma alpha"], pa.large_string()))
    assert math.isclose(many, 5000 * one + 4999 * ratio[k[-1]], rel_tol=1e-9)


def test_query_equals_brute_force(spark, sf_dir):
    """Counts, weights, noise and cut from plain Python over the tables."""
    got = op5_importance_resampling(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(1, doc_id, text) AS h").collect()
    quality, toxic = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
        toxic[r.doc_id] = max(r.toxic or 0, toxic.get(r.doc_id, 0))
    raw, target, own = np.zeros(BUCKETS), np.zeros(BUCKETS), {}
    for r in docs:
        k, _ = buckets_of(pa.array([r.text or ""], pa.large_string()))
        own[r.doc_id, r.h] = k
        np.add.at(raw, k, 1)
        if quality.get(r.doc_id) == 1 and not toxic[r.doc_id]:
            np.add.at(target, k, 1)
    ratio = log_ratio(raw, target)
    key = {}
    for (d, h), k in own.items():
        u = (((h + (1 << 64)) % (1 << 64) >> 11) + 0.5) / (1 << 53)
        key[d] = ratio[k].sum() - math.log(-math.log(u))
    n = round(len(docs) * sum(q == 1 for q in quality.values()) / len(quality))
    kept = set(sorted(key, key=lambda d: -key[d])[:n])
    assert len(got) == len(docs) and all(math.isclose(r.gumbel_key, key[r.doc_id], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    assert {r.doc_id for r in got if r.kept} == kept and 0 < n < len(docs)
