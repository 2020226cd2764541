"""Traversal, state-flow and journey queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import journeys as jo
from ..operators import stateflow as sf_
from ..operators import traverse as t
from ..sources.adapters import DAG, ENT, ENT_RAW, FN, MUT, view
from ..sources.scratch import materialize

_NAMED = "CASE {0} % 97 WHEN 3 THEN 'main' WHEN 5 THEN 'run' WHEN 7 THEN 'start' WHEN 11 THEN 'init' WHEN 13 THEN 'setup' WHEN 17 THEN 'configure' WHEN 19 THEN 'componentDidMount' WHEN 23 THEN 'ngOnInit' WHEN 29 THEN 'mounted' WHEN 31 THEN 'useEffect' WHEN 37 THEN 'build' WHEN 41 THEN 'mainly' WHEN 43 THEN 'initState' ELSE 'fn' || {0} END"
#: Calls between functions of files: f<k>.dart::fn. Entry names and some that only look like them.
CALLS = f"""
SELECT 'f' || (p % 40) || '.dart::' || {_NAMED.format("p")} AS source, CASE WHEN p % 31 = 4 THEN 'print' ELSE 'f' || (t % 40) || '.dart::' || {_NAMED.format("t")} END AS target FROM (
  SELECT p_partkey AS p, (p_partkey * 7 + p_size) % n AS t FROM part, (SELECT count(*) AS n FROM part) WHERE p_partkey % 4 <> 0
  UNION ALL SELECT p_partkey, (p_partkey * 13 + p_size * 5) % n FROM part, (SELECT count(*) AS n FROM part) WHERE p_partkey % 3 = 0)
"""
COMP = """
SELECT p_name || p_partkey AS name, p_partkey AS seq, CASE p_partkey % 16 WHEN 0 THEN 'initState,dispose' WHEN 1 THEN 'componentDidMount,componentWillUnmount' WHEN 2 THEN 'didUpdateWidget,initState' WHEN 3 THEN 'didChangeDependencies' WHEN 4 THEN 'deactivate,dispose'
  WHEN 5 THEN 'ngOnInit,ngOnDestroy,ngOnChanges' WHEN 6 THEN 'mounted,unmounted,template' WHEN 7 THEN 'useEffect,cleanup' WHEN 8 THEN 'build,setState' WHEN 9 THEN 'render,forceUpdate' WHEN 10 THEN 'view,markNeedsBuild' WHEN 11 THEN 'scheduleRebuild,componentDidUpdate'
  WHEN 12 THEN 'shouldComponentUpdate' WHEN 13 THEN 'initStates,disposed,rebuild' ELSE '' END AS hooks FROM part WHERE p_partkey > 3
"""
CONT = "SELECT s_name AS name FROM supplier"
PROV = "SELECT 'Provider' AS type, 'lib/n' || s_nationkey || '.dart' AS file, s_name || 'Notifier' AS notifier_class, CAST(NULL AS STRING) AS state_type, 'Box' || (s_suppkey % 5) AS enclosing_class FROM supplier"


def _calls(spark, sf):
    return view(spark, sf, CALLS)


def _files(spark):
    return spark.createDataFrame([("f7.dart",)], "file string")


def _fn(spark, sf):
    ent = g.merge_entities(view(spark, sf, ENT_RAW))
    return ent, view(spark, sf, FN)


def _comp(spark, sf):
    return view(spark, sf, COMP).withColumn("overrides", F.split("hooks", ","))


def reachability(spark, sf):
    seeds = view(spark, sf, "SELECT 'P' || p_partkey AS id FROM part WHERE p_partkey % 100 = 7")
    return t.reachable(view(spark, sf, FN), seeds)


def dead_code(spark, sf):
    return t.dead_code(_calls(spark, sf), _files(spark))


def hot_paths(spark, sf):
    return t.hot_paths(_calls(spark, sf))


def called_by(spark, sf):
    return t.called_by(_calls(spark, sf))


def call_depth(spark, sf):
    return t.call_depth(view(spark, sf, DAG).select("source", "target"))


def connected_components(spark, sf):
    e = view(spark, sf, FN).where("type <> 'calls'")
    return t.components(e, view(spark, sf, "SELECT 'P' || p_partkey AS id FROM part"))


def label_propagation(spark, sf):
    ent, edges = _fn(spark, sf)
    return t.label_propagation(g.simple_edges(edges, ent), ent)


def greedy_modularity(spark, sf):
    ent, edges = _fn(spark, sf)
    return t.greedy_modularity(g.simple_edges(edges, ent))


def mutation_hotspots(spark, sf):
    return sf_.mutation_hotspots(view(spark, sf, MUT))


def listener_pairing(spark, sf):
    return sf_.listener_pairing(view(spark, sf, MUT))


def notify_chains(spark, sf):
    return sf_.notify_chains(view(spark, sf, CONT), _comp(spark, sf))


def lifecycle_summary(spark, sf):
    return sf_.lifecycle_summary(_comp(spark, sf))


def provider_deps(spark, sf):
    return sf_.provider_deps(view(spark, sf, PROV))


def behavior_summary(spark, sf):
    return sf_.behavior_summary(dead_code(spark, sf), hot_paths(spark, sf), view(spark, sf, MUT), 12)


def ui_entry_points(spark, sf):
    return jo.ui_entry_points(*_fn(spark, sf)).drop("seq")


def event_handlers(spark, sf):
    ent, edges = _fn(spark, sf)
    return jo.event_handlers(jo.ui_entry_points(ent, edges), ent, edges)


def journey_trace(spark, sf):
    ent, edges = _fn(spark, sf)
    return jo.trace(jo.ui_entry_points(ent, edges), ent, edges)


def step_classification(spark, sf):
    return jo.classify(*_fn(spark, sf)).select("id", "step_type")


def _journeys(spark, sf):
    return materialize(jo.journeys(*_fn(spark, sf)), "journeys")


def journey_confidence(spark, sf):
    return _journeys(spark, sf).drop("nodes", "rank", "file")


def journey_report(spark, sf):
    return jo.report(_journeys(spark, sf))


def journeys_query(spark, sf):
    return jo.find(_journeys(spark, sf), "item1").select("root", "name", "feature", "confidence")


def journey_dedup(spark, sf):
    return jo.drop_near_duplicates(_journeys(spark, sf)).drop("nodes", "rank", "file")


def journey_steps(spark, sf):
    return jo.steps(_journeys(spark, sf), *_fn(spark, sf))


QUERIES = {f.__name__: f for f in (reachability, dead_code, hot_paths, called_by, call_depth, connected_components, label_propagation, greedy_modularity, mutation_hotspots, listener_pairing, notify_chains, lifecycle_summary, provider_deps, behavior_summary, ui_entry_points, event_handlers, journey_trace, step_classification, journey_confidence, journey_report, journeys_query, journey_dedup, journey_steps)}

_OWN = "coalesce(nullif(enclosing_class, ''), nullif(enclosing_method, ''), 'unknown') AS owner"
_HOT = """hot AS (SELECT owner, n, breakdown, notify, file, risk, n || ' mutations' || CASE WHEN notify > 0 THEN ', ' || notify || ' notify-style' ELSE '' END || CASE WHEN adds THEN ', has listeners' ELSE '' END AS reason FROM (
  SELECT *, CASE WHEN n >= 10 THEN 'High' WHEN n >= 5 OR (notify >= 3 AND adds) THEN 'Medium' ELSE 'Low' END AS risk FROM (
    SELECT owner, count(*) AS n, count(*) FILTER (type IN ('notifyListeners', 'emit', 'setState', 'update', 'set')) AS notify, bool_or(type = 'addListener') AS adds, arg_max(file, seq) AS file,
      (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT type || ':' || count(*) AS t FROM m x WHERE x.owner = m.owner GROUP BY type)) AS breakdown FROM m GROUP BY owner HAVING count(*) >= 2)))"""
_PAIR = """pair AS (SELECT owner, file, adds, removes, greatest(adds - removes, 0) AS unpaired, array_to_string(a[least(adds, removes) + 1:], ',') AS contexts, CASE WHEN adds <= removes THEN 'paired' ELSE 'unpaired' END AS status FROM (
  SELECT owner, arg_min(file, seq) FILTER (type = 'addListener') AS file, count(*) FILTER (type = 'addListener') AS adds, count(*) FILTER (type = 'removeListener') AS removes, list(coalesce(context, 'other') ORDER BY seq) FILTER (type = 'addListener') AS a FROM m WHERE type IN ('addListener', 'removeListener') GROUP BY owner) WHERE adds > 0)"""
_M = f"WITH m AS (SELECT *, {_OWN} FROM ({MUT}))"
_J = f"""WITH RECURSIVE ent AS ({ENT}), edges AS ({FN}), entries AS (
  SELECT * FROM (SELECT id, name, file, seq, greatest(CASE WHEN type = 'route' THEN 0.9 ELSE 0.0 END, CASE WHEN regexp_matches(name, '(Screen|Page|View|Widget|Component)$') THEN 0.85 ELSE 0.0 END,
    CASE WHEN id IN (SELECT target FROM edges WHERE type = 'routes_to') THEN 0.8 ELSE 0.0 END)::DOUBLE AS confidence FROM ent) WHERE confidence > 0
), adj AS (SELECT DISTINCT source, target FROM edges WHERE type IN ('calls', 'routes_to') AND target IN (SELECT id FROM ent)
), pairs AS (SELECT e.id AS entry, e.name AS entry_name, e.file, h.id AS root, h.name AS handler_name, row_number() OVER (PARTITION BY h.id ORDER BY e.confidence DESC, e.seq) AS k, e.confidence AS score, e.seq AS entry_seq, h.seq AS handler_seq
    FROM entries e JOIN ent h ON h.file = e.file AND h.id <> e.id AND h.type = 'function' AND regexp_matches(h.name, '^on[A-Z]|^handle[A-Z]|^_on[A-Z]|^(?i:change|click|input|press|scroll|submit|swipe|tap)')
  ), starts AS (SELECT * FROM pairs WHERE k = 1
  ), walk(root, id, depth) AS (SELECT root, root, 0 FROM starts UNION SELECT root, target, depth + 1 FROM walk JOIN adj ON source = id WHERE depth < 8
), trace AS (SELECT root, id, CAST(min(depth) AS BIGINT) AS depth, round(power(0.85, min(depth)), 9) AS confidence FROM walk GROUP BY root, id
), cls AS (SELECT id, name, seq, CASE WHEN type = 'route' THEN 'ui_entry' WHEN regexp_matches(lower(name), 'screen|page|view|widget|component') THEN 'ui_entry'
    WHEN regexp_matches(name, '^_?on[A-Z]|^handle[A-Z]|^(?i:change|click|input|press|scroll|submit|swipe|tap)') THEN 'handler'
    WHEN lower(name) IN ('setstate', 'notifylisteners', 'emit', 'update', 'markneedsbuild', 'setstateasync', 'addlistener') OR regexp_matches(lower(name), 'set\\s*state|notify\\s*listeners|\\.emit\\(') THEN 'state_update'
    WHEN regexp_matches(lower(name), 'navigate|redirect|push|pop|replace|goto|route') OR id IN (SELECT source FROM edges WHERE type = 'routes_to') THEN 'navigation'
    WHEN regexp_matches(lower(name), 'create|delete|fetch|find|insert|load|query|save|store|update') AND regexp_matches(lower(file), 'dao|database|db|drift|firebase|model|repository|supabase|table') THEN 'data_operation'
    WHEN regexp_matches(lower(name), 'api|http|request|fetch|dio|axios|client') THEN 'api_call' ELSE 'service_call' END AS step_type FROM ent
), jj AS (SELECT root, count(*) AS n_steps, count(DISTINCT step_type) AS n_types, avg(confidence) AS mean, string_agg(id, '>' ORDER BY depth, seq, id) AS chain, string_agg(DISTINCT step_type, ',' ORDER BY step_type) AS types FROM trace JOIN cls USING (id) GROUP BY root
), jk AS (SELECT *, round(least(1.0, mean * least(n_steps / 3, 1.0) + 0.15 * n_types / 8), 6) AS confidence FROM jj
), j AS (SELECT entry, root, entry_name || ' → ' || handler_name AS name, CASE WHEN regexp_matches(entry, '(Screen|Page|View|Widget|Component)$') THEN regexp_extract(entry, '^(.*)(Screen|Page|View|Widget|Component)$', 1) ELSE regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', '') END AS feature,
    n_steps, n_types, types, confidence, chain, score, entry_seq, handler_seq FROM jk JOIN starts USING (root) WHERE n_steps >= 3 AND confidence >= 0.3)"""
ORACLE_SQL = {
    "reachability": f"WITH RECURSIVE edges AS ({FN}), seeds AS (SELECT 'P' || p_partkey AS id FROM part WHERE p_partkey % 100 = 7), adj AS (SELECT DISTINCT source, target FROM edges), walk(id, depth) USING KEY (id) AS (SELECT id, 0 FROM seeds UNION (SELECT target, min(depth) + 1 FROM walk JOIN adj ON source = id WHERE target NOT IN (SELECT id FROM recurring.walk) GROUP BY target)) SELECT id, CAST(depth AS BIGINT) AS depth FROM walk",
    "dead_code": f"""WITH RECURSIVE calls AS ({CALLS}), nodes AS (SELECT source AS id FROM calls UNION SELECT target FROM calls
      ), live(id) AS (SELECT id FROM nodes WHERE starts_with(id, 'f7.dart::') OR (contains(id, '::') AND split_part(id, '::', 2) IN ('main', 'run', 'start', 'init', 'setup', 'configure', 'componentDidMount', 'ngOnInit', 'mounted', 'useEffect')) UNION SELECT target FROM live JOIN calls ON source = id)
      SELECT id, split_part(id, '::', 2) AS function, split_part(id, '::', 1) AS file, (SELECT count(*) FROM calls WHERE source = id) AS calls_count, (SELECT count(DISTINCT source) FROM calls WHERE target = id) AS called_by_count FROM nodes WHERE contains(id, '::') AND id NOT IN (SELECT id FROM live) ORDER BY id LIMIT 30""",
    "hot_paths": f"SELECT target AS id, count(*) AS call_sites FROM ({CALLS}) WHERE contains(target, '::') GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 15",
    "called_by": f"SELECT target AS id, count(DISTINCT source) AS n_callers, min(source) AS first_caller FROM ({CALLS}) GROUP BY 1",
    "call_depth": f"""WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM ({DAG})), core AS (SELECT * FROM e WHERE starts_with(source, 'N') OR (starts_with(source, 'C') AND starts_with(target, 'C'))
      ), reach(a, b) AS (SELECT source, target FROM core UNION SELECT a, target FROM reach JOIN core ON source = b
      ), scc AS (SELECT x.a AS id, min(x.b) AS c FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1
      ), k AS (SELECT DISTINCT coalesce(x.c, source) AS s, coalesce(y.c, target) AS t FROM e LEFT JOIN scc x ON x.id = source LEFT JOIN scc y ON y.id = target WHERE coalesce(x.c, source) <> coalesce(y.c, target)
      ), walk(n, depth) AS (SELECT DISTINCT t, 0 FROM k WHERE t NOT IN (SELECT s FROM k) UNION SELECT s, depth + 1 FROM walk JOIN k ON t = n
      ), d AS (SELECT coalesce(id, n) AS id, depth FROM (SELECT n, max(depth) AS depth FROM walk GROUP BY n) LEFT JOIN scc ON c = n)
      SELECT id, CAST(depth AS BIGINT) AS depth FROM d WHERE contains(id, '::') AND depth >= 3 ORDER BY depth DESC, id LIMIT 10""",
    "connected_components": f"""WITH RECURSIVE e AS (SELECT source, target FROM ({FN}) WHERE type <> 'calls'), u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), n AS (SELECT 'P' || p_partkey AS id FROM part
      ), walk(root, id) AS (SELECT id, id FROM n UNION SELECT root, b FROM walk JOIN u ON a = id) SELECT id, min(root) AS component FROM walk GROUP BY id""",
    "mutation_hotspots": f"{_M}, {_HOT} SELECT * FROM hot",
    "listener_pairing": f"{_M}, {_PAIR} SELECT * FROM pair",
    "notify_chains": f"SELECT name, (SELECT string_agg(name, ',' ORDER BY seq) FROM (SELECT * FROM ({COMP}) WHERE list_has_any(string_split(hooks, ','), ['initState', 'componentDidMount', 'ngOnInit', 'useEffect']) ORDER BY seq LIMIT 5)) AS listeners FROM ({CONT})",
    "lifecycle_summary": "SELECT count(*) AS total_components, " + ", ".join(f"count(*) FILTER (list_has_any(string_split(hooks, ','), string_split('{hooks}', ' '))) AS with_{k}" for k, hooks in (("update", "componentDidUpdate shouldComponentUpdate ngOnChanges didUpdateWidget"), ("init", "useEffect mounted ngOnInit initState componentDidMount"), ("state_change", "scheduleRebuild setState markNeedsBuild forceUpdate"), ("dispose", "cleanup unmounted dispose ngOnDestroy componentWillUnmount"), ("build", "view template render build"))) + f" FROM ({COMP})",
    "provider_deps": PROV,
    "behavior_summary": "",
    "ui_entry_points": f"{_J} SELECT id, name, file, confidence FROM entries",
    "event_handlers": f"""{_J} SELECT entry, root AS handler, CASE WHEN EXISTS (SELECT 1 FROM edges c WHERE c.type = 'calls' AND c.source = entry AND c.target = root) THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM pairs""",
    "journey_trace": f"""{_J.replace("SELECT root, root, 0 FROM starts UNION", "SELECT id, id, 0 FROM entries UNION")} SELECT root, id, depth, confidence FROM trace""",
    "step_classification": f"{_J} SELECT id, step_type FROM cls",
    "journey_confidence": f"{_J} SELECT entry, root, name, feature, n_steps, n_types, types, confidence, chain FROM j",
    "journey_report": f"""{_J} SELECT 'feature' AS kind, feature AS key, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'confidence', CASE WHEN confidence >= 0.8 THEN 'high (>=0.8)' WHEN confidence >= 0.5 THEN 'medium (0.5-0.8)' ELSE 'low (<0.5)' END, count(*) FROM j GROUP BY 2
      UNION ALL SELECT 'step_type', k, count(*) FROM (SELECT unnest(string_split(types, ',')) AS k FROM j) GROUP BY 2""",
    "journeys_query": f"{_J} SELECT root, name, feature, confidence FROM j WHERE contains(lower(feature), 'item1') OR contains(lower(name), 'item1') ORDER BY confidence DESC, score DESC, entry_seq, handler_seq LIMIT 20",
    "journey_steps": f"{_J} SELECT root, row_number() OVER (PARTITION BY root ORDER BY depth, seq, id) - 1 AS pos, id, name, file, line, step_type FROM trace JOIN (SELECT cls.id, cls.name, cls.seq, file, line, step_type FROM cls JOIN ent ON ent.id = cls.id) USING (id) WHERE root IN (SELECT root FROM j)",
}
ORACLE_SQL["behavior_summary"] = f"{_M}, {_HOT}, {_PAIR} SELECT 12::BIGINT AS files_analyzed, (SELECT count(*) FROM ({ORACLE_SQL['dead_code']})) AS dead_functions, (SELECT count(*) FROM ({ORACLE_SQL['hot_paths']})) AS hot_paths, (SELECT count(*) FROM m) AS total_state_mutations, (SELECT count(*) FROM pair WHERE status = 'unpaired') AS unpaired_listeners"
