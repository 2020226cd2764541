"""Brute force and properties on small random graphs."""

import random

from loomgraph.operators import graph as g
from loomgraph.operators import journeys as jo
from loomgraph.operators import traverse as t

R = random.Random(9)
N = 14
PAIRS = sorted({(R.randrange(N), R.randrange(N)) for _ in range(26)})
E = [(f"f{a % 3}.x::n{a:02d}", f"f{b % 3}.x::n{b:02d}") for a, b in PAIRS]
NODES = sorted({x for e in E for x in e})


def closure(seeds):
    seen, todo = dict.fromkeys(seeds, 0), list(seeds)
    for x in todo:
        for a, b in E:
            if a == x and b not in seen:
                seen[b] = seen[a] + 1
                todo.append(b)
    return seen


def paths(a, ends, limit, at=None):
    at = at or [a]
    for x, y in E:
        if x == at[-1] and y not in at and len(at) <= limit:
            if y in ends:
                yield [*at, y]
            yield from paths(a, ends, limit, [*at, y])


def frames(spark):
    edges = spark.createDataFrame([(a, b, "imports", "EXTRACTED", i) for i, (a, b) in enumerate(E)], "source string, target string, type string, confidence string, seq long")
    ent = spark.createDataFrame([(n, "function", n, n.split("::")[0], 1, i) for i, n in enumerate(NODES)], "id string, type string, name string, file string, line long, seq long")
    return edges, ent


def test_reach_dead_and_components(spark):
    edges, ent = frames(spark)
    seeds = spark.createDataFrame([(NODES[0],)], "id string")
    assert {r.id: r.depth for r in t.reachable(edges, seeds).collect()} == closure([NODES[0]])
    dead = {r.id for r in t.dead_code(edges, spark.createDataFrame([("f0.x",)], "file string"), n=None).collect()}
    live = closure([n for n in NODES if n.startswith("f0.x::")])
    assert dead == {n for n in NODES if n not in live}
    label = {n: n for n in NODES}
    for _ in NODES:
        for a, b in E:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.component for r in t.components(edges, ent).collect()} == label


def test_degrees_paths_and_cycles(spark):
    edges, ent = frames(spark)
    simple = g.simple_edges(edges, ent)
    assert sum(r.connections for r in g.hubs(simple, ent, 1000).collect()) == 2 * simple.count()
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r.path for r in g.simple_paths(simple, one(NODES[0], NODES[1]), one(NODES[5], NODES[7]), 5).collect()}
    assert got == {">".join(p) for s in NODES[:2] for p in paths(s, {NODES[5], NODES[7]}, 5)}
    want = set()
    for n in NODES:
        for m in (p for p in [[n], *paths(n, set(NODES), N)] if all(x >= n for x in p)):
            if len(m) > 1 and (m[-1], n) in E:
                want.add(">".join(m))
    assert {r.cycle for r in g.import_cycles(edges).collect()} == want
    assert {r.cycle for r in g.import_cycles(edges, max_len=4).collect()} == {c for c in want if c.count(">") < 4}
    assert [r.length for r in g.import_cycles(edges, n=2).collect()] == sorted(c.count(">") + 1 for c in want)[:2]


def test_depth_on_a_chain_with_a_loop(spark):
    calls = spark.createDataFrame([("a::1", "a::2"), ("a::2", "a::3"), ("a::3", "x"), ("a::9", "a::9b"), ("a::9b", "a::9")], "source string, target string")
    got = {r.id: r.depth for r in t.call_depth(calls, least=0).collect()}
    assert got == {"a::1": 3, "a::2": 2, "a::3": 1}


def test_depth_above_cycles(spark):
    named = lambda pairs: spark.createDataFrame([(f"a::{x}", f"a::{y}") for x, y in pairs], "source string, target string")
    depths = lambda pairs, n=1000: {r.id[3:]: r.depth for r in t.call_depth(named(pairs), n=n, least=0).collect()}
    assert depths(["AB", "BC", "CD", "DC", "CE", "EF"]) == {"A": 4, "B": 3, "C": 2, "D": 2, "E": 1}
    # two loops one above the other, and a caller of a loop that calls nothing else
    assert depths(["AB", "BC", "CB", "CD", "DE", "ED", "EF", "XY", "YZ", "ZY"]) == {"A": 3, "B": 2, "C": 2, "D": 1, "E": 1, "X": 1}


def test_depth_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"a::{i:03}", f"a::{i + 1:03}") for i in range(20)], "source string, target string")
    assert [(r.id, r.depth) for r in t.call_depth(chain).collect()] == [(f"a::{i:03}", 20 - i) for i in range(10)]


def test_checkout_journey(spark):
    ent = [("r", "route", "/checkout"), ("CheckoutScreen", "class", "CheckoutScreen"), ("h", "function", "onPressed"), ("o", "function", "processOrder"), ("u", "function", "setState"), ("k", "function", "onward")]
    edges = [("r", "CheckoutScreen"), ("CheckoutScreen", "h"), ("h", "o"), ("o", "u")]
    e = spark.createDataFrame([(i, ty, n, "lib/checkout.dart", 1, k) for k, (i, ty, n) in enumerate(ent)], "id string, type string, name string, file string, line long, seq long")
    d = spark.createDataFrame([(a, b, "calls", "EXTRACTED", k) for k, (a, b) in enumerate(edges)], "source string, target string, type string, confidence string, seq long")
    assert {r.id: r.step_type for r in jo.classify(e, d).collect()} == {"r": "ui_entry", "CheckoutScreen": "ui_entry", "h": "handler", "o": "service_call", "u": "state_update", "k": "service_call"}
    assert {(r.entry, r.handler, r.confidence) for r in jo.event_handlers(jo.ui_entry_points(e, d), e, d).collect()} == {("r", "h", 0.5), ("CheckoutScreen", "h", 0.8)}
    # one handler is one journey, of the surest entry; the call chain begins at the handler
    (row,) = jo.journeys(e, d).collect()
    assert (row.entry, row.root, row.name, row.feature, row.n_steps, row.chain) == ("r", "h", "/checkout → onPressed", "checkout", 3, "h>o>u")
    assert row.confidence == round(min(1, (1 + 0.85 + 0.7225) / 3 + 0.15 * 3 / 8), 6)
    assert jo.journeys(e.limit(0), d).count() == 0 and jo.journeys(e, d.limit(0)).count() == 0
    assert [(r.pos, r.name, r.step_type) for r in jo.steps(jo.journeys(e, d), e, d).orderBy("pos").collect()] == [(0, "onPressed", "handler"), (1, "processOrder", "service_call"), (2, "setState", "state_update")]


def test_near_duplicate_journeys(spark):
    rows = [(f"h{i:02}", sorted(R.sample("abcdefgh", R.randint(3, 7))), round(R.random(), 3)) for i in range(40)]
    j = spark.createDataFrame([(a, n, (-c, 0.0, 0, 0, a)) for a, n, c in rows], "root string, nodes array<string>, rank struct<a:double,b:double,c:long,d:long,e:string>")
    left = []
    for a, n, c in sorted(rows, key=lambda r: (-r[2], r[0])):
        if all(len(set(n) & set(m)) <= 0.7 * len(set(n) | set(m)) for _, m in left):
            left.append((a, n))
    assert {r.root for r in jo.drop_near_duplicates(j).collect()} == {a for a, _ in left} and 1 < len(left) < 40


def test_communities(spark):
    """Two cliques and a bridge, and merges that agree with modularity counted anew."""
    pairs = [(a, b) for g_ in ("abcd", "wxyz") for a in g_ for b in g_ if a < b] + [("d", "w")]
    simple = spark.createDataFrame(pairs, "source string, target string")
    got = t.greedy_modularity(simple)
    assert {(r.id, r.community, r.size) for r in got.collect()} == {(x, "a", 4) for x in "abcd"} | {(x, "w", 4) for x in "wxyz"}
    assert abs(t.modularity(simple, got) - (12 / 13 - 0.5)) < 1e-9
    nodes = spark.createDataFrame([(x,) for x in "abcdwxyz"], "id string")
    assert t.label_propagation(simple, nodes).count() == 8
    assert t.greedy_modularity(simple.limit(0)).count() == 0


def test_path_ends(spark):
    edges = spark.createDataFrame([("lib/a.x", "lib/b.x", "imports", 1), ("lib/b.x", "lib/c.x", "imports", 2), ("lib/a.x", "lib/c.x", "imports", 3)], "source string, target string, type string, seq long")
    ent = spark.createDataFrame([("Alpha", "Alpha", "lib/a.x", 1), ("Gamma", "Gamma", "lib/c.x", 2)], "id string, name string, file string, seq long")
    assert [r.path for r in g.paths_between(edges, ent, "alpha", "gamma").collect()] == ["lib/a.x>lib/c.x", "lib/a.x>lib/b.x>lib/c.x"]
    assert [r.id for r in g.nodes_like(edges, ent, "b.x").collect()] == ["lib/b.x"]
    assert g.paths_between(edges, ent, "nowhere", "gamma").count() == 0
