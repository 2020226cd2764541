"""Property graph: building, statistics, hubs, clusters, unexpected links, look-ups, paths and cycles.

entities: id, type, name, file, line, seq. edges: source, target, type, confidence, seq.
seq orders rows as they were found; every rule of "first" or "last" goes by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import module_key
from ..sources.scratch import materialize
from .traverse import reachable, strong_components


def merge_entities(raw: DataFrame) -> DataFrame:
    """One row an id: the first name, file and line; the last type that isn't module."""
    plain = F.col("type") != "module"
    return raw.groupBy("id").agg(
        F.coalesce(F.max_by(F.when(plain, F.col("type")), F.when(plain, F.col("seq"))), F.lit("module")).alias("type"),
        *[F.min_by(c, "seq").alias(c) for c in ("name", "file", "line")],
        F.min("seq").alias("seq"),
    )


def simple_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges between known entities, one for each ordered pair: the last one's attributes at the first one's place. One shuffle by pair; the look-ups are semi-joins."""
    ids = entities.select("id")
    known = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    last = F.max_by(F.struct("type", "confidence"), "seq")
    return known.groupBy("source", "target").agg(last.alias("a"), F.min("seq").alias("seq"), F.count("*").alias("n")).select("source", "target", "a.type", "a.confidence", "seq", "n")


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, key, n: entity types, and relationship types and confidences over all edges in one pass."""
    e = entities.groupBy(F.col("type").alias("key")).count().select(F.lit("entity").alias("kind"), "key", F.col("count").alias("n"))
    r = edges.select(F.explode(F.array(F.struct(F.lit("relationship").alias("kind"), F.col("type").alias("key")), F.struct(F.lit("confidence").alias("kind"), F.col("confidence").alias("key")))).alias("x"))
    return e.unionByName(r.groupBy("x.kind", "x.key").count().withColumnRenamed("count", "n"))


def degree_multiset_topk(edges: DataFrame, entities: DataFrame, n: int = 10) -> DataFrame:
    """The n ids that stand in most edges, parallel and dangling ones included; unknown ids are dropped after the cut."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    top = ends.groupBy("id").agg(F.count("*").alias("connections")).orderBy(F.desc("connections"), "id").limit(n)
    return entities.join(F.broadcast(top), "id").select("id", "name", "type", "connections")


def hubs(simple: DataFrame, entities: DataFrame, n: int = 10) -> DataFrame:
    """The n entities of highest degree, in and out; a loop counts twice, an isolated entity 0. Ties: first found."""
    ends = simple.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return entities.join(ends, "id", "left").select("id", "name", "seq", F.coalesce("d", F.lit(0)).alias("connections")).orderBy(F.desc("connections"), "seq").limit(n).select("id", "name", "connections")


def file_clusters(entities: DataFrame) -> DataFrame:
    """Entities but modules by their module key; groups of two and more, numbered among all keys, called by the key's last part. Only keys, not members, are numbered in one task."""
    plain = entities.where("type <> 'module'").select("id", module_key(F.col("file")).alias("key"))
    keys = plain.groupBy("key").agg(F.count("*").alias("size")).withColumn("pos", F.row_number().over(Window.orderBy("key")) - 1)
    g = plain.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))
    d = g.join(keys.where("size >= 2"), "key")
    return d.select(F.concat(F.lit("cluster_"), "pos").alias("id"), F.substring_index("key", "/", -1).alias("name"), "key", "size", "members")


def path_communities(entities: DataFrame) -> DataFrame:
    g = entities.groupBy(module_key(F.col("file")).alias("community")).agg(F.count("*").alias("size"), F.min("id").alias("first_id"))
    return g.where("size >= 2")


def community_names(members: DataFrame, share: float = 0.3) -> DataFrame:
    """community, name: the last part of the commonest two-segment prefix, with the commonest third segment where more than share of the members have it. members: community, file."""
    seg = F.split("file", "/")
    m = members.select("community", F.concat_ws("/", seg[0], seg[1]).alias("p"), F.get(seg, F.lit(1)).alias("last"), F.get(seg, F.lit(2)).alias("third"))
    n = m.groupBy("community").agg(F.count("*").alias("n"))
    first = lambda c: m.groupBy("community", c).agg(F.count("*").alias("k")).where(F.col(c).isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("k"), c))).where("r = 1")
    p = first("p").select("community", F.element_at(F.split("p", "/"), -1).alias("base"))
    t = first("third").select("community", "third", F.col("k").alias("k3"))
    return n.join(p, "community").join(t, "community", "left").select("community", F.when(F.col("k3") > share * F.col("n"), F.concat_ws("/", "base", "third")).otherwise(F.col("base")).alias("name"), F.col("n").alias("size"))


def circular_pairs(simple: DataFrame) -> DataFrame:
    """Pairs with an edge each way, once, source < target."""
    pair = simple.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("k"), F.min("seq").alias("seq"))
    return pair.where("k = 2").select(F.col("a").alias("source"), F.col("b").alias("target"), "seq")


def with_files(simple: DataFrame, entities: DataFrame) -> DataFrame:
    f = entities.select("id", "file", "name")
    s = f.select(F.col("id").alias("source"), F.col("file").alias("source_file"), F.col("name").alias("source_name"))
    t = f.select(F.col("id").alias("target"), F.col("file").alias("target_file"), F.col("name").alias("target_name"))
    return simple.join(s, "source").join(t, "target")


def private_imports(simple: DataFrame, entities: DataFrame) -> DataFrame:
    """Imports by a test of something below a path part that begins with an underscore."""
    e = with_files(simple, entities)
    hidden = F.exists(F.split("target_file", "/"), lambda p: p.startswith("_"))
    return e.where((F.col("type") == "imports") & F.col("source_file").contains("/test/") & F.col("target_file").contains("/lib/") & hidden).select("source", "target", "seq")


def cross_module_inheritance(simple: DataFrame, entities: DataFrame) -> DataFrame:
    e = with_files(simple.where(F.col("type").isin("extends", "implements")), entities)
    a, b = module_key(F.col("source_file")), module_key(F.col("target_file"))
    return e.where(a != b).select("source", "target", a.alias("source_module"), b.alias("target_module"), "seq")


def surprising_links(simple: DataFrame, entities: DataFrame, n: int = 20) -> DataFrame:
    """The three kinds in turn, each in order of discovery; the first n."""
    kinds = [("circular dependency", circular_pairs(simple)), ("test imports private", private_imports(simple, entities)), ("inherits across modules", cross_module_inheritance(simple, entities))]
    all_ = None
    for rank, (reason, d) in enumerate(kinds):
        d = d.select("source", "target", F.lit(reason).alias("reason"), F.lit(rank).alias("rank"), "seq")
        all_ = d if all_ is None else all_.unionByName(d)
    return all_.orderBy("rank", "seq", "source", "target").limit(n).select("source", "target", "reason")


_LAYERS = (("ui", "screen|widget|page|view|component"), ("service", "service|client|repository|provider"), ("model", "model|schema|entity|dto|data"), ("database", "database|db|drift|sqlite|supabase"))


def layer_of(name: Column, file: Column) -> Column:
    c = None
    for i, (_, rx) in enumerate(_LAYERS):
        hit = F.lower(name).rlike(rx) | F.lower(file).rlike(rx)
        c = F.when(hit, F.lit(i)) if c is None else c.when(hit, F.lit(i))
    return c


def layer_violations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Imports of a lower layer by a higher one."""
    layers = entities.select("id", layer_of(F.col("name"), F.col("file")).alias("layer"))
    e = edges.where("type = 'imports'").join(layers.withColumnsRenamed({"id": "source", "layer": "a"}), "source").join(layers.withColumnsRenamed({"id": "target", "layer": "b"}), "target").where("a < b")
    names = F.array(*[F.lit(n) for n, _ in _LAYERS])
    return e.select("source", "target", F.get(names, "a").alias("source_layer"), F.get(names, "b").alias("target_layer"))


def naming_violations(entities: DataFrame) -> DataFrame:
    """Classes without an upper and functions without a lower initial or underscore."""
    i = F.substring("name", 1, 1)
    bad = ((F.col("type") == "class") & ~i.rlike(r"\p{Lu}")) | ((F.col("type") == "function") & ~i.rlike(r"\p{Ll}") & (i != "_"))
    return entities.where(bad).groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


def find_entities(entities: DataFrame, term: str) -> DataFrame:
    t = term.lower()
    return entities.where(F.lower("id").contains(t) | F.lower("name").contains(t))


def query_entities(entities: DataFrame, edges: DataFrame, term: str, max_edges: int = 10, matches: int | None = None) -> DataFrame:
    """Matches by substring of id or name, the first `matches` or all, each with up to max_edges edges of either direction."""
    hit = find_entities(entities, term)
    hit = (hit if matches is None else hit.orderBy("seq").limit(matches)).select("id", "name")
    out = edges.join(hit, edges["source"] == hit["id"]).select("id", "name", F.lit("out").alias("direction"), F.col("target").alias("other"), "type", "seq")
    in_ = edges.join(hit, edges["target"] == hit["id"]).select("id", "name", F.lit("in").alias("direction"), F.col("source").alias("other"), "type", "seq")
    w = Window.partitionBy("id", "direction").orderBy("seq", "other", "type")
    return out.unionByName(in_).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_edges).select("id", "name", "direction", "other", "type", F.col("r").cast("long").alias("pos"))


def entity_context(entities: DataFrame, simple: DataFrame, entity: str) -> DataFrame:
    """One row: the entity with its incoming and outgoing neighbours; none for an unknown id."""
    e = entities.where(F.col("id") == entity)
    near = simple.where((F.col("source") == entity) | (F.col("target") == entity)).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("source") == entity, F.concat("type", F.lit(":"), "target")))), ",").alias("outgoing"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("target") == entity, F.concat("type", F.lit(":"), "source")))), ",").alias("incoming"),
        (F.count_if(F.col("source") == entity) + F.count_if(F.col("target") == entity)).alias("total_connections"),
    )
    return e.select("id", "type", "name", "file", "line").join(near, F.lit(True))


def cluster_edges(simple: DataFrame, members: DataFrame, n: int = 40) -> DataFrame:
    """The n strongest links between clusters with their edge types. members: id, cluster."""
    e = simple.join(members.withColumnsRenamed({"id": "source", "cluster": "a"}), "source").join(members.withColumnsRenamed({"id": "target", "cluster": "b"}), "target").where("a <> b")
    g = e.groupBy("a", "b").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return g.orderBy(F.desc("n"), "a", "b").limit(n).select(F.col("a").alias("source_cluster"), F.col("b").alias("target_cluster"), "n", "types")


def module_dependencies(simple: DataFrame, entities: DataFrame, sources: int = 20, targets: int = 5) -> DataFrame:
    """Imports between files: the first source files in order, each with its first targets."""
    d = with_files(simple.where("type = 'imports'"), entities).where("source_file <> target_file").select("source_file", "target_file").distinct()
    d = d.withColumn("t", F.row_number().over(Window.partitionBy("source_file").orderBy("target_file"))).where(F.col("t") <= targets)
    first = d.select("source_file").distinct().orderBy("source_file").limit(sources)
    return d.join(F.broadcast(first), "source_file", "left_semi").select("source_file", "target_file", F.col("t").cast("long").alias("pos"))


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, cutoff: int = 8) -> DataFrame:
    """All paths without a repeated node from a source to a target of up to cutoff edges; sources, targets: id.

    The hops that each node is away from the targets are found first, backwards, so that
    nothing but paths that still can end is held. Each round extends the open paths by a
    join on their last node and is written; a path is kept when it meets a target and goes on.
    """
    adj = edges.where("source <> target").select("source", "target").distinct()
    away = reachable(adj.select(F.col("target").alias("source"), F.col("source").alias("target")), targets.select("id"), cutoff)
    adj = adj.join(away.withColumnsRenamed({"id": "target", "depth": "away"}), "target")
    adj = materialize(adj.select(F.col("source").alias("tail"), F.col("target").alias("next"), "away"), "paths")
    now = sources.distinct().select(F.array("id").alias("path"), F.col("id").alias("tail"))
    found = None
    for hops in range(1, cutoff + 1):
        step = now.join(adj, "tail").where((F.col("away") + hops <= cutoff) & ~F.array_contains("path", F.col("next")))
        now = materialize(step.select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("tail"), "away"), "paths")
        hit = now.where("away = 0").select("path")
        found = hit if found is None else found.unionByName(hit)
        if now.isEmpty():
            break
        now = now.drop("away")
    return found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))


def nodes_like(edges: DataFrame, entities: DataFrame, term: str, ends: int = 3) -> DataFrame:
    """id: the first `ends` nodes of edges whose id holds term, in order of discovery; if none does, the files of the entities it names."""
    t = term.lower()
    x = F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("k")), F.struct(F.col("target").alias("id"), F.lit(1).alias("k")))
    direct = edges.select("seq", F.explode(x).alias("x")).where(F.lower("x.id").contains(t)).groupBy("x.id").agg(F.min(F.struct("seq", "x.k")).alias("r"))
    files = find_entities(entities, term).groupBy(F.col("file").alias("id")).agg(F.min(F.struct("seq", F.lit(0).alias("k"))).alias("r"))
    none = direct.limit(1).agg((F.count("*") == 0).alias("none"))
    both = direct.unionByName(files.join(none, F.lit(True)).where("none").drop("none"))
    return both.orderBy("r", "id").limit(ends).select("id")


def paths_between(edges: DataFrame, entities: DataFrame, a: str, b: str, cutoff: int = 8, ends: int = 3, n: int = 3) -> DataFrame:
    """source, target, path, hops: the n shortest paths over all edges between each of the first nodes like a and like b."""
    p = simple_paths(edges, nodes_like(edges, entities, a, ends), nodes_like(edges, entities, b, ends), cutoff)
    p = p.select(F.substring_index("path", ">", 1).alias("source"), F.substring_index("path", ">", -1).alias("target"), "path", "hops")
    w = Window.partitionBy("source", "target").orderBy("hops", "path")
    return p.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def import_cycles(edges: DataFrame, n: int | None = None, max_len: int | None = None) -> DataFrame:
    """Simple cycles of two imports and more, each once, beginning at its smallest id; of any length unless max_len is given. The n shortest, or all.

    Only edges inside strongly connected components are followed, as no other is on a
    cycle; a round is written. There can be as many cycles as there are subsets, so a
    caller with a large tangle asks import_tangles instead, or bounds the length.
    """
    adj = edges.where("type = 'imports' AND source <> target").select("source", "target").distinct()
    scc = strong_components(adj)
    one = lambda c: scc.select(F.col("id").alias(c), F.col("component").alias(c + "_"))
    adj = materialize(adj.join(one("source"), "source").join(one("target"), "target").where("source_ = target_").select(F.col("source").alias("tail"), F.col("target").alias("next")), "cycles")
    now = adj.where(F.col("next") > F.col("tail")).select(F.array("tail", "next").alias("path"), F.col("tail").alias("head"), F.col("next").alias("tail"))
    found, length = None, 1
    while max_len is None or length < max_len:
        length += 1
        step = materialize(now.join(adj, "tail").where(F.col("next") >= F.col("head")), "cycles")
        closed = step.where("next = head").select("path")
        found = closed if found is None else found.unionByName(closed)
        now = step.where((F.col("next") > F.col("head")) & ~F.array_contains("path", F.col("next"))).select(F.array_append("path", F.col("next")).alias("path"), "head", F.col("next").alias("tail"))
        if step.isEmpty():
            break
    out = found.select(F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("length"))
    return out if n is None else out.orderBy("length", "cycle").limit(n)


def import_tangles(edges: DataFrame) -> DataFrame:
    """component, size, edges of each group of modules that import each other in cycles, whatever their lengths."""
    adj = edges.where("type = 'imports' AND source <> target").select("source", "target").distinct()
    scc = strong_components(adj)
    n = scc.groupBy("component").agg(F.count("*").alias("size"))
    inside = adj.join(scc.withColumnRenamed("id", "source"), "source").join(scc.withColumnsRenamed({"id": "target", "component": "other"}), "target").where("component = other")
    return n.join(inside.groupBy("component").agg(F.count("*").alias("edges")), "component")
