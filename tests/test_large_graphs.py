"""Steps whose cost grew faster than their input, against brute force and by their plans."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import runtime as rt
from loomgraph.operators import traverse as t


def test_communities_of_more_than_200000_edges(spark):
    pairs = spark.range(205_000).select(F.format_string("a%07d", "id").alias("source"), F.format_string("b%07d", "id").alias("target"))
    r = t.greedy_modularity(pairs).agg(F.count("*"), F.countDistinct("community"), F.max("size")).first()
    assert tuple(r) == (410_000, 205_000, 2)


def merged(edges):
    m, c = len(edges), {x: {x} for e in edges for x in e}
    while True:
        of, links, degree = {x: k for k, g in c.items() for x in g}, {}, {}
        for e in edges:
            for x in e:
                degree[of[x]] = degree.get(of[x], 0) + 1
            k = tuple(sorted(of[x] for x in e))
            links[k] = links.get(k, 0) + 1
        best = min(((degree[x] * degree[y] - 2 * m * n, x, y) for (x, y), n in links.items() if x != y), default=(0,))
        if best[0] >= 0:
            return {(x, k, len(g)) for k, g in c.items() if len(g) > 1 for x in g}
        c[best[1]] |= c.pop(best[2])


def test_communities_by_brute_force(spark):
    R = random.Random(2)
    for n in (5, 12, 30, 60):
        edges = sorted({tuple(sorted(R.sample(range(n), 2))) for _ in range(2 * n)})
        edges = [(f"n{a:02}", f"n{b:02}") for a, b in edges]
        got = t.greedy_modularity(spark.createDataFrame(edges, "source string, target string")).collect()
        assert {(r.id, r.community, r.size) for r in got} == merged(edges) and got


def test_components_send_no_labels_through_the_driver(spark, monkeypatch):
    plans, write = [], t.materialize
    monkeypatch.setattr(t, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("f", "f")], "source string, target string")
    got = t.components(edges, spark.createDataFrame([(x,) for x in "abcdefg"], "id string")).collect()
    assert {(r.id, r.component) for r in got} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f"), ("g", "g")}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_coverage_of_odd_names(spark):
    """Stems that begin alike, are short, empty or repeat themselves; no source is compared with all tests that begin like it."""
    R = random.Random(4)
    stems = ["_", "a", "ab", "aaaaaaa", "authsvc", "auth_svc1", "auth_svc12", "authsvc123", "Page", "Page1", "ééééééé", "aaaaaaaaaab", "x.y", "main"]
    names = [f"d{i}/{R.choice(stems)}.py" for i in range(60)] + [f"d{i}/test_{R.choice(stems)}{R.choice(stems)}_.py" for i in range(60)]
    files = spark.createDataFrame([(p, "def test_a(): pass", R.randint(0, 50)) for p in names], "path string, content string, seq long")
    rows = rt.known(files).select("path", "seq", rt.is_test(F.col("path")).alias("test"), F.replace(rt.stem(F.col("path")), F.lit("_"), F.lit("")).alias("k")).collect()
    tests = [(r.seq, r.path, r.k) for r in rows if r.test]
    want = {r.path: min(((s, p) for s, p, k in tests if r.k in k), default=(0, None))[1] for r in rows if not r.test}
    df = rt.coverage_map(files)
    assert {r.path: r.test_path for r in df.collect()} == want and len(set(want.values())) > 5
    assert "Contains(" not in df._jdf.queryExecution().optimizedPlan().toString()
