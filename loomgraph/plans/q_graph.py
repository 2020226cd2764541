"""Graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import module_key
from ..operators import graph as g
from ..sources.adapters import DEP, DEP_ENT, ENT, ENT_RAW, FN, view


#: Imports in rings of one to nine modules, and bridges from ring to ring that close none.
RING = """
SELECT 'M' || g || '_' || p AS source, 'M' || g || '_' || CASE WHEN p % 9 >= g % 9 THEN p - p % 9 ELSE p + 1 END AS target, 'imports' AS type, 'EXTRACTED' AS confidence, p AS seq FROM (SELECT p_partkey AS p, CAST(floor(p_partkey / 9) AS BIGINT) AS g FROM part WHERE p_partkey <= 900)
UNION ALL SELECT 'M' || g || '_' || p, 'M' || (g + 1) || '_' || (p + 9), 'imports', 'EXTRACTED', 10000 + p FROM (SELECT p_partkey AS p, CAST(floor(p_partkey / 9) AS BIGINT) AS g FROM part WHERE p_partkey % 18 = 0 AND p_partkey <= 900)
UNION ALL SELECT 'M' || g || '_' || p, 'M' || g || '_' || (p - 2), 'calls', 'EXTRACTED', 20000 + p FROM (SELECT p_partkey AS p, CAST(floor(p_partkey / 9) AS BIGINT) AS g FROM part WHERE p_partkey % 9 = 2)
UNION ALL SELECT 'M' || g || '_' || p, 'M' || g || '_' || (p - 3), 'imports', 'EXTRACTED', 30000 + p FROM (SELECT p_partkey AS p, CAST(floor(p_partkey / 9) AS BIGINT) AS g FROM part WHERE p_partkey % 9 = 5 AND p_partkey <= 900)
"""


def _fn(spark, sf):
    ent = g.merge_entities(view(spark, sf, ENT_RAW))
    edges = view(spark, sf, FN)
    return ent, edges, g.simple_edges(edges, ent)


def _dep(spark, sf):
    ent, edges = view(spark, sf, DEP_ENT), view(spark, sf, DEP)
    return ent, edges, g.simple_edges(edges, ent)




def god_nodes(spark, sf):
    ent, _, simple = _dep(spark, sf)
    return g.hubs(simple, ent)


def degree_multiset_topk(spark, sf):
    ent, edges, _ = _dep(spark, sf)
    return g.degree_multiset_topk(edges, ent)


def graph_stats(spark, sf):
    ent, edges, _ = _dep(spark, sf)
    return g.stats(ent, edges)


def entity_merge(spark, sf):
    return g.merge_entities(view(spark, sf, ENT_RAW))


def edge_dedupe(spark, sf):
    return _dep(spark, sf)[2]


def entity_query(spark, sf):
    ent, edges, _ = _fn(spark, sf)
    return g.query_entities(ent, edges, "service")


def entity_context(spark, sf):
    ent, _, simple = _fn(spark, sf)
    return g.entity_context(ent, simple, "P12")


def file_clusters(spark, sf):
    return g.file_clusters(_fn(spark, sf)[0])


def path_communities(spark, sf):
    return g.path_communities(_fn(spark, sf)[0])


def community_names(spark, sf):
    ent = _fn(spark, sf)[0]
    return g.community_names(ent.select(F.concat(F.lit("c"), F.expr("seq div 10 % 20")).alias("community"), "file"))


def circular_pairs(spark, sf):
    return g.circular_pairs(_fn(spark, sf)[2])


def test_private_imports(spark, sf):
    ent, _, simple = _fn(spark, sf)
    return g.private_imports(simple, ent)


def cross_module_inherit(spark, sf):
    ent, _, simple = _fn(spark, sf)
    return g.cross_module_inheritance(simple, ent)


def surprising_links(spark, sf):
    ent, _, simple = _fn(spark, sf)
    return g.surprising_links(simple, ent)


def layer_violations(spark, sf):
    ent, edges, _ = _fn(spark, sf)
    return g.layer_violations(edges, ent)


def naming_violations(spark, sf):
    return g.naming_violations(_fn(spark, sf)[0])


def import_cycles(spark, sf):
    return g.import_cycles(view(spark, sf, RING))


def import_tangles(spark, sf):
    return g.import_tangles(view(spark, sf, RING))


def simple_paths(spark, sf):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    return g.simple_paths(_fn(spark, sf)[2], ids("P1", "P3", "P9", "P17", "P33"), ids("P20", "P77", "P110", "P12", "P58"), 8)


def paths_between(spark, sf):
    ent, edges, _ = _fn(spark, sf)
    return g.paths_between(edges, ent, "p", "p1")


def paths_by_file(spark, sf):
    """No node is called so: the entities' files stand for them, which are nodes of the files' own imports."""
    ent, edges, _ = _fn(spark, sf)
    f = ent.select("id", "file")
    by = edges.join(f.withColumnsRenamed({"id": "source", "file": "a"}), "source").join(f.withColumnsRenamed({"id": "target", "file": "b"}), "target").select(F.col("a").alias("source"), F.col("b").alias("target"), "type", "confidence", "seq")
    return g.paths_between(by, ent, "item1", "setstate", 4)


def entity_query_first(spark, sf):
    ent, edges, _ = _fn(spark, sf)
    return g.query_entities(ent, edges, "service", matches=5)


def cluster_edges(spark, sf):
    ent, _, simple = _fn(spark, sf)
    return g.cluster_edges(simple, ent.select("id", module_key(F.col("file")).alias("cluster")))


def module_deps(spark, sf):
    ent, _, simple = _fn(spark, sf)
    return g.module_dependencies(simple, ent)


QUERIES = {f.__name__: f for f in (god_nodes, degree_multiset_topk, graph_stats, entity_merge, edge_dedupe, entity_query, entity_context, file_clusters, path_communities, community_names, circular_pairs, test_private_imports, cross_module_inherit, surprising_links, layer_violations, naming_violations, import_cycles, import_tangles, simple_paths, paths_between, paths_by_file, entity_query_first, cluster_edges, module_deps)}

_SIMPLE = """known AS (
  SELECT * FROM edges WHERE source IN (SELECT id FROM ent) AND target IN (SELECT id FROM ent)
), simple AS (
  SELECT source, target, max_by(type, seq) AS type, max_by(confidence, seq) AS confidence, min(seq) AS seq, count(*) AS n FROM known GROUP BY source, target
)"""
_D = f"WITH RECURSIVE ent AS ({DEP_ENT}), edges AS ({DEP}), {_SIMPLE}"
_F = f"WITH RECURSIVE ent AS ({ENT}), edges AS ({FN}), {_SIMPLE}"
_KEY = "CASE WHEN contains({0}, '/') THEN split_part({0}, '/', 1) || '/' || split_part({0}, '/', 2) ELSE {0} END"
_FILES = ", f AS (SELECT s.*, a.file AS source_file, b.file AS target_file, a.name AS source_name, b.name AS target_name FROM simple s JOIN ent a ON a.id = s.source JOIN ent b ON b.id = s.target)"
_CIRC = ", circ AS (SELECT least(source, target) AS source, greatest(source, target) AS target, min(seq) AS seq FROM simple WHERE source <> target GROUP BY 1, 2 HAVING count(*) = 2)"
_PRIV = ", priv AS (SELECT source, target, seq FROM f WHERE type = 'imports' AND contains(source_file, '/test/') AND contains(target_file, '/lib/') AND regexp_matches(target_file, '(^|/)_'))"
_CROSS = f", cross_ AS (SELECT source, target, {_KEY.format('source_file')} AS source_module, {_KEY.format('target_file')} AS target_module, seq FROM f WHERE type IN ('extends', 'implements') AND {_KEY.format('source_file')} <> {_KEY.format('target_file')})"


def _layer(t):
    rules = (("ui", "screen|widget|page|view|component"), ("service", "service|client|repository|provider"), ("model", "model|schema|entity|dto|data"), ("database", "database|db|drift|sqlite|supabase"))
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({t}.name), '{rx}') OR regexp_matches(lower({t}.file), '{rx}') THEN {i}" for i, (_, rx) in enumerate(rules)) + " END"


#: Nodes of a graph whose id holds a term, files of entities that it names, walks between two sets of nodes, and the shortest of each pair.
_LIKE = ", {0} AS (SELECT id FROM (SELECT source AS id, seq * 2 AS r FROM {2} UNION ALL SELECT target, seq * 2 + 1 FROM {2}) WHERE contains(lower(id), '{1}') GROUP BY id ORDER BY min(r), id LIMIT 3)"
_NAMED = ", {0} AS (SELECT file AS id FROM ent WHERE contains(lower(id), '{1}') OR contains(lower(name), '{1}') GROUP BY file ORDER BY min(seq), file LIMIT 3)"
_WALKS = """, adj AS (SELECT DISTINCT source AS s, target AS t FROM {3} WHERE source <> target
  ), walk AS (SELECT id AS tail, [id] AS path FROM {0} UNION ALL SELECT t, list_append(path, t) FROM walk JOIN adj ON s = tail WHERE NOT list_contains(path, t) AND len(path) <= {2}
  ), hit AS (SELECT path FROM walk WHERE len(path) > 1 AND tail IN (SELECT id FROM {1}))"""
_SHORTEST = """ SELECT source, target, path, hops FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY hops, path) AS r FROM (
  SELECT path[1] AS source, path[-1] AS target, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS BIGINT) AS hops FROM hit)) WHERE r <= 3"""
ORACLE_SQL = {
    "god_nodes": _D + ", deg AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM simple UNION ALL SELECT target FROM simple) GROUP BY id) SELECT id, name, coalesce(d, 0) AS connections FROM ent LEFT JOIN deg USING (id) ORDER BY connections DESC, seq LIMIT 10",
    "degree_multiset_topk": _D + ", top AS (SELECT id, count(*) AS connections FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY connections DESC, id LIMIT 10) SELECT id, name, type, connections FROM ent JOIN top USING (id)",
    "graph_stats": _D + " SELECT 'entity' AS kind, type AS key, count(*) AS n FROM ent GROUP BY type UNION ALL SELECT 'relationship', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'confidence', confidence, count(*) FROM edges GROUP BY confidence",
    "entity_merge": ENT,
    "edge_dedupe": _D + " SELECT source, target, type, confidence, seq, n FROM simple",
    "entity_query": _F + """, hit AS (SELECT id, name FROM ent WHERE contains(lower(id), 'service') OR contains(lower(name), 'service')
      ), near AS (SELECT id, name, 'out' AS direction, target AS other, type, seq FROM edges JOIN hit ON source = id UNION ALL SELECT id, name, 'in', source, type, seq FROM edges JOIN hit ON target = id)
      SELECT id, name, direction, other, type, pos FROM (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY seq, other, type) AS pos FROM near) WHERE pos <= 10""",
    "entity_context": _F + " SELECT id, type, name, file, line, (SELECT count(*) FROM simple WHERE source = 'P12') + (SELECT count(*) FROM simple WHERE target = 'P12') AS total_connections, (SELECT coalesce(string_agg(type || ':' || target, ',' ORDER BY type || ':' || target), '') FROM simple WHERE source = 'P12') AS outgoing, (SELECT coalesce(string_agg(type || ':' || source, ',' ORDER BY type || ':' || source), '') FROM simple WHERE target = 'P12') AS incoming FROM ent WHERE id = 'P12'",
    "file_clusters": _F + f", c AS (SELECT {_KEY.format('file')} AS name, count(*) AS size, string_agg(id, ',' ORDER BY id) AS members FROM ent WHERE type <> 'module' GROUP BY 1) SELECT * FROM (SELECT 'cluster_' || (row_number() OVER (ORDER BY name) - 1) AS id, split_part(name, '/', -1) AS name, name AS key, size, members FROM c) WHERE size >= 2",
    "path_communities": _F + f" SELECT {_KEY.format('file')} AS community, count(*) AS size, min(id) AS first_id FROM ent GROUP BY 1 HAVING count(*) >= 2",
    "community_names": _F + f""", m AS (SELECT 'c' || (seq // 10 % 20) AS community, {_KEY.format('file')} AS p, split_part(file, '/', 3) AS third FROM ent
      ), n AS (SELECT community, count(*) AS size FROM m GROUP BY 1
      ), p AS (SELECT community, p FROM (SELECT community, p, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, p) AS r FROM m GROUP BY 1, 2) WHERE r = 1
      ), t AS (SELECT community, third, k FROM (SELECT community, third, count(*) AS k, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, third) AS r FROM m WHERE third <> '' GROUP BY 1, 2) WHERE r = 1)
      SELECT community, CASE WHEN k > 0.3 * size THEN split_part(p, '/', -1) || '/' || third ELSE split_part(p, '/', -1) END AS name, size FROM n JOIN p USING (community) LEFT JOIN t USING (community)""",
    "circular_pairs": _F + _CIRC + " SELECT * FROM circ",
    "test_private_imports": _F + _FILES + _PRIV + " SELECT * FROM priv",
    "cross_module_inherit": _F + _FILES + _CROSS + " SELECT * FROM cross_",
    "surprising_links": _F + _FILES + _CIRC + _PRIV + _CROSS + """ SELECT source, target, reason FROM (SELECT source, target, 'circular dependency' AS reason, 0 AS k, seq FROM circ
      UNION ALL SELECT source, target, 'test imports private', 1, seq FROM priv UNION ALL SELECT source, target, 'inherits across modules', 2, seq FROM cross_) ORDER BY k, seq, source, target LIMIT 20""",
    "layer_violations": _F + f", l AS (SELECT e.source, e.target, {_layer('a')} AS a, {_layer('b')} AS b FROM edges e JOIN ent a ON a.id = e.source JOIN ent b ON b.id = e.target WHERE e.type = 'imports') SELECT source, target, ['ui', 'service', 'model', 'database'][a + 1] AS source_layer, ['ui', 'service', 'model', 'database'][b + 1] AS target_layer FROM l WHERE a < b",
    "naming_violations": _F + r" SELECT type AS kind, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM ent WHERE (type = 'class' AND NOT regexp_matches(name, '^\p{Lu}')) OR (type = 'function' AND NOT regexp_matches(name, '^[\p{Ll}_]')) GROUP BY type",
    "import_cycles": f"""WITH RECURSIVE adj AS (SELECT DISTINCT source AS s, target AS t FROM ({RING}) WHERE source <> target AND type = 'imports'
      ), walk AS (SELECT s AS head, t AS tail, [s, t] AS path FROM adj WHERE t > s
        UNION ALL SELECT head, adj.t, list_append(path, adj.t) FROM walk JOIN adj ON adj.s = tail WHERE adj.t > head AND NOT list_contains(path, adj.t))
      SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS BIGINT) AS length FROM walk JOIN adj ON adj.s = tail AND adj.t = head""",
    "import_tangles": f"""WITH RECURSIVE adj AS (SELECT DISTINCT source AS s, target AS t FROM ({RING}) WHERE source <> target AND type = 'imports'), reach(a, b) AS (SELECT s, t FROM adj UNION SELECT a, t FROM reach JOIN adj ON s = b
      ), scc AS MATERIALIZED (SELECT x.a AS id, least(x.a, min(x.b)) AS c FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(*) > 1)
      SELECT c AS component, count(*) AS size, (SELECT count(*) FROM adj JOIN scc u ON u.id = s JOIN scc v ON v.id = t WHERE u.c = scc.c AND v.c = scc.c) AS edges FROM scc GROUP BY c""",
    "simple_paths": _F + _WALKS.format("(VALUES ('P1'), ('P3'), ('P9'), ('P17'), ('P33')) v(id)", "(VALUES ('P20'), ('P77'), ('P110'), ('P12'), ('P58')) v(id)", 8, "simple") + " SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS BIGINT) AS hops FROM hit",
    "paths_between": _F + _LIKE.format("a", "p", "edges") + _LIKE.format("b", "p1", "edges") + _WALKS.format("a", "b", 8, "edges") + _SHORTEST,
    "paths_by_file": _F + ", by_ AS (SELECT a.file AS source, b.file AS target, e.seq FROM edges e JOIN ent a ON a.id = e.source JOIN ent b ON b.id = e.target)" + _NAMED.format("a", "item1") + _NAMED.format("b", "setstate") + _WALKS.format("a", "b", 4, "by_") + _SHORTEST,
    "entity_query_first": _F + """, hit AS (SELECT id, name FROM ent WHERE contains(lower(id), 'service') OR contains(lower(name), 'service') ORDER BY seq LIMIT 5
      ), near AS (SELECT id, name, 'out' AS direction, target AS other, type, seq FROM edges JOIN hit ON source = id UNION ALL SELECT id, name, 'in', source, type, seq FROM edges JOIN hit ON target = id)
      SELECT id, name, direction, other, type, pos FROM (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY seq, other, type) AS pos FROM near) WHERE pos <= 10""",
    "cluster_edges": _F + _FILES + f", c AS (SELECT {_KEY.format('source_file')} AS source_cluster, {_KEY.format('target_file')} AS target_cluster, type FROM f) SELECT source_cluster, target_cluster, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM c WHERE source_cluster <> target_cluster GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 40",
    "module_deps": _F + _FILES + """, d AS (SELECT DISTINCT source_file, target_file FROM f WHERE type = 'imports' AND source_file <> target_file
      ), r AS (SELECT source_file, target_file, row_number() OVER (PARTITION BY source_file ORDER BY target_file) AS pos, dense_rank() OVER (ORDER BY source_file) AS k FROM d)
      SELECT source_file, target_file, pos FROM r WHERE pos <= 5 AND k <= 20""",
}
