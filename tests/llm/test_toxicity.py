import random
import zlib

import numpy as np
import pyarrow as pa

from loomgraph.llm.q_toxicity import op10_string_kernel_toxicity
from loomgraph.llm.toxicity import _gram, _sparse, fit, held_out, learn, score_table, score_words, without_toxic

R = random.Random(11)
SYL = ["an", "the", "ou", "re", "ti", "on", "er", "ing", "ha", "st"]
BAD = ["dolt", "grumblefuss", "nincompoop", "wretch", "vermin"]


def prose(n):
    return ["".join(R.choice(SYL) for _ in range(R.randint(1, 4))) for _ in range(n)]


def text(bad):
    w = prose(R.randint(20, 80))
    for _ in range(R.randint(2, 5) if bad else 0):
        w[R.randrange(len(w))] = R.choice(BAD)
    return " ".join(w)


ROWS = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
MODEL = fit([t for _, t, _ in ROWS[:400]], [y for _, _, y in ROWS[:400]], landmarks=80, negatives=500)


def test_held_out_accuracy():
    s = MODEL.score(pa.array([t for _, t, _ in ROWS[400:]]))
    y = np.array([y for _, _, y in ROWS[400:]])
    assert ((s >= 0.5) == y).mean() > 0.97


def test_gapped_insults_score_above_plain_words():
    f = lambda w: score_words(pa.array([w], pa.large_string()), MODEL.weights, MODEL.bias)[0]
    for w in ("vermin", "ver-min", "verminn", "ninxcompoop", "g.r.u.m.b.l.e.f.u.s.s"):
        assert f(w) > max(f(p) for p in ("there", "anouti", "onhaer", "stingre"))


def test_folded_weights_equal_the_kernel_sum():
    words = pa.array(["vermin", "vexrmin", "thering", "a"], pa.large_string())
    s = _sparse(words)
    g = _gram(s, s)
    assert np.allclose(g, g.T) and np.linalg.eigvalsh(g).min() > -1e-9
    w = np.zeros_like(MODEL.weights, dtype=float)
    for k, v in s[0].items():
        w[k] += v
    assert np.allclose(score_words(words, w, 0.0), g[:, 0], atol=1e-6)


def test_tables(spark):
    rows = [(i, t, "x", 0.5) for i, t, _ in ROWS] + [(None, "vermin", "x", 0.1), (900, None, "x", 0.1), (901, "", "x", 0.1), (902, "the " * 50000, "x", 0.1), (902, "the " * 50000, "x", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in ROWS] + [(0, None, 1), (None, 1, 1), (3, 0, 0)], "doc_id long, toxic int, quality int")
    got = score_table(docs, MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    left = without_toxic(docs, MODEL)
    assert left.schema == docs.schema and left.count() == sum(1 - r.predicted for r in got)
    assert learn(docs.limit(0), labels).score(pa.array(["a", None])).tolist() == learn(docs, labels.limit(0)).score(pa.array(["a", ""])).tolist()
    assert score_table(docs.limit(0), MODEL).count() == 0


def test_query_on_the_tables(spark):
    """Held-out precision and recall over the given labels, of the query as it is."""
    sf = "/root/testdata/sf0.1"  # smaller tables have a handful of labels
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.predicted, toxic[r.doc_id]) for r in op10_string_kernel_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    hits = sum(p and y for p, y in rows)
    # 89 of 97 found and 18 clean ones taken for toxic, when this was written
    assert len(rows) > 500 and hits >= 0.85 * sum(y for _, y in rows) and hits >= 0.75 * sum(p for p, _ in rows)


def test_many_rows_of_one_id(spark):
    """The sample is bounded by rows, whatever rows an id has, and their order doesn't matter."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in ROWS[:300]] + [(3, f"other text {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in ROWS[:300]], "doc_id long, toxic int")
    a, b = learn(docs, labels), learn(docs.repartition(5), labels)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_held_out_rows_are_never_learnt(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in ROWS[:200]], "doc_id long, text string")
    assert docs.where(~held_out(docs.doc_id)).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))
