"""Iterative operators: each round is one join on the frontier, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


#: Up to so many rows a frontier goes SEVERAL hops in one job, which then costs more joins but fewer rounds.
SMALL, SEVERAL = 200_000, 3


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, depth: nodes that seeds (id) reach, seeds included, with the least number of hops.

    Only the frontier is joined with the edges, and what was seen before is removed by an
    anti-join. The nodes of a round's last hop are the next frontier.
    """
    adj = materialize(edges.select("source", "target").distinct(), "adjacency")
    layer = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0).cast("long")), "bfs")
    seen, depth, rounds, n = layer, 0, 0, layer.count()
    while n and (max_depth is None or depth < max_depth):
        hops = SEVERAL if n <= SMALL else 1
        hops = hops if max_depth is None else min(hops, max_depth - depth)
        at, met = layer.select("id"), None
        for h in range(1, hops + 1):
            at = at.select(F.col("id").alias("source")).join(adj, "source").select(F.col("target").alias("id")).distinct()
            step = at.withColumn("depth", F.lit(depth + h).cast("long"))
            met = step if met is None else met.unionByName(step)
        new = met.groupBy("id").agg(F.min("depth").alias("depth")) if hops > 1 else met
        new = materialize(new.join(seen.select("id"), "id", "left_anti"), "bfs")
        depth, rounds = depth + hops, rounds + 1
        layer = new.where(F.col("depth") == depth)
        n = layer.count()
        seen = seen.unionByName(new)
        if rounds % 8 == 0:  # keeps plans small on long chains
            seen = materialize(seen, "bfs")
    return seen


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: the smallest id of each node's undirected component. edges: source, target; nodes: id.

    Labels spread to neighbours and then jump to their label's label, so that long chains
    need a logarithmic number of rounds.
    """
    und = materialize(edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct(), "cc")
    now = materialize(nodes.select("id", F.col("id").alias("component")), "cc")
    while True:
        near = und.hint("merge").join(now.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("component").alias("c"))
        step = now.hint("merge").join(near, "id", "left").select("id", F.least("component", "c").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("c"))
        new = materialize(step.hint("merge").join(jump, "component", "left").select("id", F.least("component", "c").alias("component")), "cc")
        moved = new.hint("merge").join(now.withColumnRenamed("component", "old"), "id").where("component <> old")
        now = new
        if moved.isEmpty():
            return now


def adjacency(calls: DataFrame) -> DataFrame:
    return calls.select("source").unionByName(calls.select(F.col("target").alias("source"))).distinct().withColumnRenamed("source", "id")


ENTRY_NAMES = ("componentDidMount", "configure", "init", "main", "mounted", "ngOnInit", "run", "setup", "start", "useEffect")


def dead_code(calls: DataFrame, entry_files: DataFrame, names=ENTRY_NAMES, n: int | None = 30) -> DataFrame:
    """Qualified nodes (file::name) that no seed reaches and that call or are called.

    Seeds: nodes of an entry file, and nodes whose part after :: is one of names. calls:
    source, target; entry_files: file. calls_count counts call sites, called_by_count
    different callers. The first n by name.
    """
    nodes = adjacency(calls)
    file, rest = F.substring_index("id", "::", 1), F.get(F.split("id", "::"), F.lit(1))
    named = nodes.where(F.col("id").contains("::"))
    seeds = named.join(entry_files.distinct(), file == F.col("file"), "left_semi").unionByName(named.where(rest.isin(*names)))
    out = calls.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("calls_count"))
    in_ = calls.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("called_by_count"))
    live = reachable(calls, seeds)
    dead = named.join(live.select("id"), "id", "left_anti").join(out, "id", "left").join(in_, "id", "left").fillna(0, ["calls_count", "called_by_count"])
    dead = dead.where("calls_count + called_by_count > 0")
    dead = dead.select("id", rest.alias("function"), file.alias("file"), "calls_count", "called_by_count")
    return dead if n is None else dead.orderBy("id").limit(n)


def hot_paths(calls: DataFrame, least: int = 3, n: int = 15) -> DataFrame:
    """Qualified nodes with at least `least` call sites."""
    g = calls.where(F.col("target").contains("::")).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("call_sites"))
    return g.where(F.col("call_sites") >= least).orderBy(F.desc("call_sites"), "id").limit(n)


def called_by(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n_callers"), F.min("source").alias("first_caller"))


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component: the nodes that lie on a cycle of two or more, with the smallest id of their strongly connected component. edges: source, target.

    A node's colour is the smallest id that reaches it; what reaches the colour's own node
    back over edges of that colour is its component. The rest is coloured again.
    """
    left = materialize(edges.select("source", "target").where("source <> target").distinct(), "scc")
    found = None
    while True:
        # a node without callers or callees is on no cycle
        left = materialize(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi"), "scc")
        if left.isEmpty():
            break
        now = materialize(left.select(F.col("source").alias("id")).unionByName(left.select(F.col("target").alias("id"))).distinct().withColumn("c", F.col("id")), "scc")
        while True:
            step = now
            for _ in range(SEVERAL):
                best = left.join(step.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("c").alias("m"))
                step = step.join(best, "id", "left").select("id", F.least("c", "m").alias("c"))
            nxt = materialize(step.join(now.withColumnRenamed("c", "old"), "id").select("id", "c", (F.col("c") < F.col("old")).alias("moved")), "scc")
            now = nxt.drop("moved")
            if nxt.where("moved").isEmpty():
                break
        inside = materialize(left.join(now.withColumnsRenamed({"id": "source", "c": "a"}), "source").join(now.withColumnsRenamed({"id": "target", "c": "b"}), "target").where("a = b").select("source", "target"), "scc")
        back = reachable(inside.select(F.col("target").alias("source"), F.col("source").alias("target")), now.where("id = c").select("id"))
        own = materialize(now.join(back.select("id"), "id", "left_semi").select("id", F.col("c").alias("component")), "scc")
        found = own if found is None else found.unionByName(own)
        left = inside.join(own.select(F.col("id").alias("source")), "source", "left_anti").join(own.select(F.col("id").alias("target")), "target", "left_anti")
    if found is None:
        return edges.select(F.col("source").alias("id"), F.col("source").alias("component")).limit(0)
    big = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return materialize(found.join(big, "component", "left_semi").select("id", "component"), "scc")


def _heights(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, depth of each node that no cycle is below; edges of the others). adj: distinct source, target.

    Chains grow backwards from the leaves: what calls nothing but finished nodes is
    finished a round, and a hop, after the last of them.
    """
    sources = adj.select(F.col("source").alias("id")).distinct()
    new = materialize(adj.select(F.col("target").alias("id")).distinct().join(sources, "id", "left_anti").withColumn("depth", F.lit(0).cast("long")), "depth")
    done, open_, depth = new, adj, 0
    while not new.isEmpty():
        depth += 1
        met = open_.join(new.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
        open_ = materialize(open_.join(new.select(F.col("id").alias("target")), "target", "left_anti"), "depth")
        new = materialize(met.join(open_.select(F.col("source").alias("id")).distinct(), "id", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "depth")
        done = done.unionByName(new)
        if depth % 8 == 0:  # keeps plans small on long chains
            done = materialize(done, "depth")
    return done, open_


def call_depth(calls: DataFrame, n: int = 10, least: int = 3) -> DataFrame:
    """Longest chain of calls from each qualified caller: the n deepest, then those of at least `least`.

    Functions that call each other in a cycle are one node, so calls among them add
    nothing and all have the depth below the cycle; callers above it go on from there.
    """
    adj = materialize(calls.where("source <> target").select("source", "target").distinct(), "depth")
    all_, open_ = _heights(adj)
    if not open_.isEmpty():
        scc = strong_components(open_)
        one = lambda c: scc.select(F.col("id").alias(c), F.col("component").alias(c + "_"))
        whole = adj.join(one("source"), "source", "left").join(one("target"), "target", "left").select(F.coalesce("source_", "source").alias("source"), F.coalesce("target_", "target").alias("target"))
        depths = _heights(materialize(whole.where("source <> target").distinct(), "depth"))[0]
        members = scc.select("id", F.col("component").alias("node"))
        all_ = depths.withColumnRenamed("id", "node").join(members, "node", "left").select(F.coalesce("id", "node").alias("id"), "depth")
    return all_.where(F.col("id").contains("::")).where("depth > 0").orderBy(F.desc("depth"), "id").limit(n).where(F.col("depth") >= least)


def resolve_callees(calls: DataFrame) -> DataFrame:
    """Bare callee names replaced by the qualified node they name, where exactly one caller bears the name."""
    q = calls.where(F.col("source").contains("::")).select("source").distinct()
    bare = F.substring_index(F.substring_index("source", "::", -1), ".", -1)
    one = q.groupBy(bare.alias("target")).agg(F.min("source").alias("full"), F.count("*").alias("k")).where("k = 1").drop("k")
    return calls.join(one, "target", "left").withColumn("target", F.coalesce("full", "target")).drop("full")


def label_propagation(simple: DataFrame, entities: DataFrame, max_rounds: int = 100) -> DataFrame:
    """id, community, size: each node takes the commonest label of its neighbours and itself, ties to the smallest; communities of two and more.

    Rounds go on until no label changes, or until the labels are those of two rounds
    before, as two sides can swap theirs for ever; max_rounds only guards longer circles.
    """
    und = materialize(simple.select("source", "target").unionByName(simple.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct(), "lp")
    now = entities.select("id", F.col("id").alias("community"))
    marks: list = []
    for _ in range(max_rounds):
        votes = und.join(now.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), "community").unionByName(now)
        n = votes.groupBy("id", "community").agg(F.count("*").alias("n"))
        now = materialize(n.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b")).select("id", "b.community"), "lp")
        marks.append(now.agg(F.sum(F.xxhash64("id", "community").cast("decimal(38,0)"))).first()[0])
        if marks[-1] in marks[-3:-1]:
            break
    big = now.groupBy("community").agg(F.count("*").alias("size")).where("size >= 2")
    return now.join(big, "community").select("id", "community", "size")


def greedy_modularity(simple: DataFrame) -> DataFrame:
    """id, community (its smallest id), size: communities of two and more by merging, again and again, the two whose union raises modularity most.

    Each merge depends on the one before, so the graph is one task's. Gains are whole
    numbers, 2 m L - d e for m edges in all, L between two communities and their degrees d
    and e. Ties go to the smaller ids. A union's other gains only fall as its degree rises,
    so those in the heap are bounds, and are counted anew when they come up; only those of
    the side with fewer neighbours are entered at once.
    """
    e = simple.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()

    def run(table):
        import heapq

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        m = table.num_rows
        ends = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks()
        ids = pc.unique(ends)
        ids = ids.take(pc.sort_indices(ids))
        at = pc.index_in(ends, ids).to_numpy().astype(np.int64)
        n = len(ids)
        first, second = at[:m].tolist(), at[m:].tolist()
        degree = np.bincount(at, minlength=n).tolist()
        del table, ends, at
        near: list = [{} for _ in range(n)]
        for x, y in zip(first, second):
            near[x][y] = near[y][x] = 1
        # a community is a place in near; its name is its smallest member, and an entry has the names of two
        top, place, root = 2 * m * m + 1, list(range(n)), list(range(n))
        heap = [((top - 2 * m + degree[x] * degree[y]) * n + min(x, y)) * n + max(x, y) for x, y in zip(first, second) if degree[x] * degree[y] < 2 * m]
        del first, second
        name = list(range(n))
        heapq.heapify(heap)

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        while heap:
            entry = heap[0]
            rest, old_y = divmod(entry, n)
            key, old_x = divmod(rest, n)
            x, y = find(old_x), find(old_y)
            if x == y:
                heapq.heappop(heap)
                continue
            x, y = (x, y) if x < y else (y, x)
            p, q = place[x], place[y]
            now = top - 2 * m * near[p][q] + degree[p] * degree[q]
            if now >= top:
                heapq.heappop(heap)
                continue
            if now != key or (x, y) != (old_x, old_y):
                heapq.heapreplace(heap, (now * n + x) * n + y)
                continue
            heapq.heappop(heap)
            root[y] = x
            if len(near[p]) < len(near[q]):
                p, q = q, p
            degree[p] += degree[q]
            place[x], name[p] = p, x
            mine, gone, near[q] = near[p], near[q], None
            del mine[q], gone[p]
            for z, w in gone.items():
                other = near[z]
                del other[q]
                mine[z] = other[p] = w = mine.get(z, 0) + w
                value = top - 2 * m * w + degree[p] * degree[z]
                if value < top:
                    heapq.heappush(heap, (value * n + min(x, name[z])) * n + max(x, name[z]))
        of = np.array([find(x) for x in range(n)])
        size = np.bincount(of, minlength=n)[of]
        some = np.flatnonzero(size > 1)
        return pa.table({"id": ids.take(some).cast(pa.string()), "community": ids.take(of[some]).cast(pa.string()), "size": size[some].astype(np.int64)})

    return e.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(run, "id string, community string, size long")


def modularity(simple: DataFrame, communities: DataFrame) -> float:
    """Of a partition (id, community) over undirected edges; nodes without a community stand alone."""
    e = simple.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    c = communities.select("id", "community")
    j = e.join(c.withColumnsRenamed({"id": "source", "community": "a"}), "source", "left").join(c.withColumnsRenamed({"id": "target", "community": "b"}), "target", "left")
    a, b = F.coalesce("a", F.concat(F.lit("~"), "source")), F.coalesce("b", F.concat(F.lit("~"), "target"))
    j = j.select(a.alias("a"), b.alias("b"))
    m, inside = j.agg(F.count("*"), F.count_if(F.col("a") == F.col("b"))).first()
    if not m:
        return 0.0
    deg = j.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").count().agg(F.sum(F.pow(F.col("count") / (2.0 * m), 2))).first()[0]
    return inside / m - deg
