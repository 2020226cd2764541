"""User journeys: entry points, handlers, traces, step classes, scores and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialize

MAX_DEPTH, DECAY, PRUNE, MIN_STEPS, MIN_CONF, SAME = 8, 0.85, 0.2, 3, 0.3, 0.7
HANDLER = r"^_?on[A-Z]\w*|^handle[A-Z]\w*|^(?i:change|click|input|press|scroll|submit|swipe|tap)\w*"
STATE = ("addlistener", "emit", "markneedsbuild", "notifylisteners", "setstate", "setstateasync", "update")
STEP_TYPES = 8


def ui_entry_points(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that begin a journey, with the best of three scores."""
    routed = edges.where("type = 'routes_to'").select(F.col("target").alias("id"), F.lit(0.8).alias("r")).distinct()
    score = F.greatest(F.when(F.col("type") == "route", 0.9).otherwise(0.0), F.when(F.col("name").rlike("(Screen|Page|View|Widget|Component)$"), 0.85).otherwise(0.0), F.coalesce("r", F.lit(0.0)))
    return entities.join(routed, "id", "left").select("id", "name", "file", "seq", score.alias("confidence")).where("confidence > 0")


def event_handlers(entries: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Handler functions in each entry's file; surer where the entry calls them. An equi-join on the file."""
    h = entities.where((F.col("type") == "function") & F.col("name").rlike(HANDLER)).select(F.col("id").alias("handler"), "file")
    calls = edges.where("type = 'calls'").select(F.col("source").alias("entry"), F.col("target").alias("handler"), F.lit(True).alias("c")).distinct()
    e = entries.select(F.col("id").alias("entry"), "file")
    return e.join(h, "file").where("entry <> handler").join(calls, ["entry", "handler"], "left").select("entry", "handler", F.when(F.col("c"), 0.8).otherwise(0.5).alias("confidence"))


def trace(starts: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """root, id, depth, confidence: what each start (id) reaches by calls and routes, breadth first. The confidence decays by hop until it is pruned."""
    known = entities.select("id")
    adj = materialize(edges.where(F.col("type").isin("calls", "routes_to")).select("source", "target").distinct().join(known.withColumnRenamed("id", "target"), "target", "left_semi"), "adjacency")
    layer = materialize(starts.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0).cast("long")), "trace")
    seen, depth, conf = layer, 0, 1.0
    while depth < MAX_DEPTH and conf * DECAY > PRUNE:
        depth, conf = depth + 1, conf * DECAY
        nxt = layer.select("root", F.col("id").alias("source")).join(adj, "source").select("root", F.col("target").alias("id")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti")
        layer = materialize(nxt.withColumn("depth", F.lit(depth).cast("long")), "trace")
        if layer.isEmpty():
            break
        seen = seen.unionByName(layer)
    return seen.withColumn("confidence", F.round(F.pow(F.lit(DECAY), F.col("depth")), 9))


def step_type(name: Column, type_: Column, file: Column, routes: Column) -> Column:
    """One ordered cascade; routes: whether the node has a routes_to edge."""
    n, f = F.lower(name), F.lower(file)
    return (
        F.when(type_ == "route", "ui_entry")
        .when(n.rlike("screen|page|view|widget|component"), "ui_entry")
        .when(name.rlike(HANDLER), "handler")
        .when(n.isin(*STATE) | n.rlike(r"set\s*state|notify\s*listeners|\.emit\("), "state_update")
        .when(n.rlike("navigate|redirect|push|pop|replace|goto|route") | routes, "navigation")
        .when(n.rlike("create|delete|fetch|find|insert|load|query|save|store|update") & f.rlike("dao|database|db|drift|firebase|model|repository|supabase|table"), "data_operation")
        .when(n.rlike("api|http|request|fetch|dio|axios|client"), "api_call")
        .otherwise("service_call")
    )


def classify(entities: DataFrame, edges: DataFrame) -> DataFrame:
    r = edges.where("type = 'routes_to'").select(F.col("source").alias("id"), F.lit(True).alias("r")).distinct()
    return entities.join(r, "id", "left").select("id", "name", "type", "file", "seq", step_type(F.col("name"), F.col("type"), F.col("file"), F.coalesce("r", F.lit(False))).alias("step_type"))


def feature_of(entry: Column, file: Column) -> Column:
    """The entry's id without its kind, else the stem of the last telling part of its path, else General."""
    kind = "(Screen|Page|View|Widget|Component)$"
    telling = F.filter(F.split(file, "/"), lambda p: ~p.isin("", "app", "apps", "lib", "packages", "src"))
    part = F.element_at(telling, -1)
    return F.when(entry.rlike(kind), F.regexp_extract(entry, f"^(.*){kind}", 1)).when(F.size(telling) > 0, F.regexp_replace(part, r"(?<=.)\.[^.]*$", "")).otherwise("General")


def journeys(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """A journey for each handler that stands in the file of an entry: entry, root (the handler), name, feature, n_steps, n_types, types, confidence, chain (nodes in order), nodes (sorted), rank.

    A handler in a file of several entries goes with the surest, then the first. Journeys
    of too few steps or too little confidence are left out. rank orders journeys: the surer
    first, then by the entry's score, the entry and the handler in order of discovery.
    """
    entries = ui_entry_points(entities, edges)
    h = event_handlers(entries, entities, edges).select("entry", F.col("handler").alias("root"))
    e = entries.select(F.col("id").alias("entry"), F.col("name").alias("entry_name"), "file", F.col("confidence").alias("score"), F.col("seq").alias("entry_seq"))
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "entry_seq", "entry"))
    h = materialize(h.join(e, "entry").withColumn("r", first).where("r = 1").drop("r"), "handlers")
    classes = classify(entities, edges).select("id", "name", "step_type", "seq")
    t = trace(h.select(F.col("root").alias("id")), entities, edges).join(classes, "id")
    g = t.groupBy("root").agg(
        F.count("*").alias("n_steps"),
        F.countDistinct("step_type").alias("n_types"),
        F.avg("confidence").alias("mean"),
        F.array_sort(F.collect_list(F.struct("depth", "seq", "id"))).alias("s"),
        F.array_join(F.array_sort(F.collect_set("step_type")), ",").alias("types"),
        F.max(F.when(F.col("depth") == 0, F.struct("name", "seq"))).alias("h"),
    )
    conf = F.least(F.lit(1.0), F.col("mean") * F.least(F.col("n_steps") / MIN_STEPS, F.lit(1.0)) + 0.15 * F.col("n_types") / STEP_TYPES)
    j = g.withColumn("confidence", F.round(conf, 6)).where((F.col("n_steps") >= MIN_STEPS) & (F.col("confidence") >= MIN_CONF)).join(h, "root")
    ids = F.transform("s", lambda x: x["id"])
    rank = F.struct((-F.col("confidence")).alias("a"), (-F.col("score")).alias("b"), F.col("entry_seq").alias("c"), F.col("h.seq").alias("d"), F.col("root").alias("e"))
    name = F.concat("entry_name", F.lit(" → "), F.col("h.name"))
    return j.select("entry", "root", name.alias("name"), feature_of(F.col("entry"), F.col("file")).alias("feature"), "file", "n_steps", "n_types", "types", "confidence", F.array_join(ids, ">").alias("chain"), F.array_sort(ids).alias("nodes"), rank.alias("rank"))


def drop_near_duplicates(j: DataFrame, same: float = SAME) -> DataFrame:
    """Greedy, in order of rank: a journey goes if one that stays is more than `same` alike by Jaccard of nodes.

    Pairs are found by their shared nodes. A journey is settled once all better ones it is
    like are settled, so a round settles every journey that has none open; the rounds are
    as many as the longest such chain.
    """
    nodes = materialize(j.select("root", "rank", F.size("nodes").alias("n"), F.explode("nodes").alias("node")), "near")
    b = nodes.select(F.col("root").alias("better"), F.col("rank").alias("rank2"), F.col("n").alias("n2"), "node")
    pairs = nodes.join(b, "node").where(F.col("rank2") < F.col("rank")).where(F.least("n", "n2") > same * F.greatest("n", "n2"))
    k = pairs.groupBy("root", "better", "n", "n2").agg(F.count("*").alias("k")).where(F.col("k") > same * (F.col("n") + F.col("n2") - F.col("k")))
    like = materialize(k.select("root", "better"), "near")
    open_ = materialize(j.select("root").distinct(), "near")
    kept = None
    while True:
        held = like.join(open_.withColumnRenamed("root", "better"), "better", "left_semi").select("root").distinct()
        new = materialize(open_.join(held, "root", "left_anti"), "near")
        if new.isEmpty():
            break
        kept = new if kept is None else kept.unionByName(new)
        gone = like.join(new.withColumnRenamed("root", "better"), "better", "left_semi").select("root").distinct()
        open_ = materialize(open_.join(new, "root", "left_anti").join(gone, "root", "left_anti"), "near")
    return j.limit(0) if kept is None else j.join(kept, "root", "left_semi")


def steps(j: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """root, pos, id, name, file, line, step_type of the steps of journeys, in order."""
    d = j.select("root", F.posexplode(F.split("chain", ">")).alias("pos", "id"))
    what = classify(entities, edges).select("id", "name", "file", "step_type").join(entities.select("id", "line"), "id")
    return d.join(what, "id").select("root", "pos", "id", "name", "file", "line", "step_type")


def report(j: DataFrame) -> DataFrame:
    """kind, key, n: journeys by feature, by type of step they contain, and by confidence."""
    bucket = F.when(F.col("confidence") >= 0.8, "high (>=0.8)").when(F.col("confidence") >= 0.5, "medium (0.5-0.8)").otherwise("low (<0.5)")
    rows = F.array_append(F.transform(F.split("types", ","), lambda t: F.struct(F.lit("step_type").alias("kind"), t.alias("key"))), F.struct(F.lit("feature").alias("kind"), F.col("feature").alias("key")))
    rows = F.array_append(rows, F.struct(F.lit("confidence").alias("kind"), bucket.alias("key")))
    return j.select(F.explode(rows).alias("x")).groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))


def find(j: DataFrame, term: str = "", n: int = 20) -> DataFrame:
    t = term.lower()
    return j.where(F.lower("feature").contains(t) | F.lower("name").contains(t)).orderBy("rank").limit(n)
