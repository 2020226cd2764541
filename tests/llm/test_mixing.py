import math
import re
from collections import defaultdict

import pytest

from loomgraph.llm.mixing import mix, mixed, water_levels
from loomgraph.llm.q_mixing import op6_entropy_mix


def test_water_levels():
    assert water_levels([100, 100, 100], [5, 2, 1], 450, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert water_levels([10, 1000], [5, 2], 1515, 2) == pytest.approx([20, 1495])
    assert water_levels([0, 10], [5, 2], 15, 2) == [0, 15]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = op6_entropy_mix(spark, sf_dir).collect()
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    total = defaultdict(int)
    for i, s in source.items():
        total[s] += size[i]
    assert len(got) == len(docs) and all(r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] for r in got)
    taken, target, tilted = defaultdict(int), {}, defaultdict(float)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        tilted[source[r.doc_id]] += r.rate * r.size
        target[source[r.doc_id]] = r.target
    assert math.isclose(sum(target.values()), 1.5 * sum(total.values()), rel_tol=1e-9)
    for s in total:
        assert math.isclose(tilted[s], target[s], rel_tol=1e-6)
        assert abs(taken[s] - target[s]) <= max(60, 0.02 * target[s])
    # brute force: the multiplier by bisection in plain Python gives the same rates
    s = min(total)
    own = [r for r in got if source[r.doc_id] == s]
    if own[0].target < 2 * total[s]:
        mean, lo, hi = total[s] / len(own), -1e3, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(r.size * min(2, math.exp(min(50, mid * r.size / mean))) for r in own) < own[0].target else (lo, mid)
        assert all(math.isclose(r.rate, min(2, math.exp(min(50, lo * r.size / mean))), rel_tol=1e-5) for r in own)
    again = {r.doc_id: r.taken for r in op6_entropy_mix(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_odd_rows(spark):
    rows = [(1, "a b c", "x", 7), (1, "a b c", "x", 8), (None, None, None, 9), (2, "", "x", 1), (3, "w " * 20000, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    m = mixed(docs).collect()
    assert len(m) == 5 and {r.row.copies for r in m} == {7, 8, 9, 1, 2}
    assert set(mix(docs).columns) == set(docs.columns)
    assert mix(docs.limit(0)).count() == 0
    clash = ["op_copies", "op_id", "k_size", "size", "rate", "row", "sid", "k", "part", "target", "a.b"]
    more = docs
    for c in clash:
        more = more.withColumn(c, docs["copies"])
    got = mix(more)
    assert got.columns == more.columns
    assert sorted(map(str, got.select("doc_id", "copies", "row").collect())) == sorted(map(str, mix(docs).selectExpr("doc_id", "copies", "copies AS row").collect()))
