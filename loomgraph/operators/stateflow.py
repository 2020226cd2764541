"""State flow: conditional aggregations over mutations, lifecycle components and providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INIT_HOOKS = ("componentDidMount", "initState", "ngOnInit", "useEffect")
NOTIFY = ("emit", "notifyListeners", "set", "setState", "update")
#: Hooks by what they do.
HOOKS = {
    "build": "build render template view",
    "dispose": "cleanup componentWillUnmount dispose ngOnDestroy unmounted",
    "init": "componentDidMount initState mounted ngOnInit useEffect",
    "state_change": "forceUpdate markNeedsBuild scheduleRebuild setState",
    "update": "componentDidUpdate didUpdateWidget ngOnChanges shouldComponentUpdate",
}


def owner() -> Column:
    """The class, else the method, else unknown; empty counts as missing."""
    return F.coalesce(F.nullif(F.col("enclosing_class"), F.lit("")), F.nullif(F.col("enclosing_method"), F.lit("")), F.lit("unknown"))


def mutation_hotspots(mutations: DataFrame, least: int = 2) -> DataFrame:
    """owner, n, breakdown (type:count, joined), notify (mutations that notify), file (the last), risk and its reason, of owners with at least `least` mutations.

    Counted by type first, so that an owner's rows are as few as there are types.
    """
    by = mutations.groupBy(owner().alias("owner"), "type").agg(F.count("*").alias("k"), F.max(F.struct("seq", "file")).alias("last"))
    notify = F.coalesce(F.sum(F.when(F.col("type").isin(*NOTIFY), F.col("k"))), F.lit(0)).alias("notify")
    parts = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", F.col("k").cast("string")))), ",")
    g = by.groupBy("owner").agg(F.sum("k").alias("n"), parts.alias("breakdown"), notify, F.max(F.col("type") == "addListener").alias("adds"), F.max("last")["file"].alias("file")).where(F.col("n") >= least)
    risk = F.when(F.col("n") >= 10, "High").when((F.col("n") >= 5) | ((F.col("notify") >= 3) & F.col("adds")), "Medium").otherwise("Low")
    reason = F.concat(F.concat_ws(" ", F.col("n").cast("string"), F.lit("mutations")), F.when(F.col("notify") > 0, F.concat(F.lit(", "), F.col("notify").cast("string"), F.lit(" notify-style"))).otherwise(""), F.when(F.col("adds"), ", has listeners").otherwise(""))
    return g.select("owner", "n", "breakdown", "notify", "file", risk.alias("risk"), reason.alias("reason"))


def listener_pairing(mutations: DataFrame) -> DataFrame:
    """Owners that add listeners: the first one's file, how many are removed, and the contexts of the adds beyond those."""
    m = mutations.where(F.col("type").isin("addListener", "removeListener"))
    add = F.col("type") == "addListener"
    row = F.struct("seq", F.coalesce("context", F.lit("other")).alias("context"), "file")
    g = m.groupBy(owner().alias("owner")).agg(F.count_if(add).alias("adds"), F.count_if(~add).alias("removes"), F.array_sort(F.collect_list(F.when(add, row))).alias("a")).where("adds > 0")
    paired = F.least("adds", "removes")
    late = F.transform(F.slice("a", (paired + 1).cast("int"), F.greatest(F.lit(0), (F.col("adds") - paired)).cast("int")), lambda x: x["context"])
    status = F.when(F.col("adds") == paired, "paired").otherwise("unpaired")
    return g.select("owner", F.get("a", F.lit(0))["file"].alias("file"), "adds", "removes", (F.col("adds") - paired).alias("unpaired"), F.array_join(late, ",").alias("contexts"), status.alias("status"))


def _overrides(hooks) -> Column:
    return F.arrays_overlap("overrides", F.array(*map(F.lit, hooks)))


def notify_chains(containers: DataFrame, components: DataFrame, n: int = 5) -> DataFrame:
    """Each state container with the first n components that override an init hook, which are one row of at most n names."""
    first = components.where(_overrides(INIT_HOOKS)).orderBy("seq").limit(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), ",").alias("listeners"))
    return containers.select("name").join(F.broadcast(first), F.lit(True))


def lifecycle_summary(components: DataFrame) -> DataFrame:
    """Components in all, and those that override a hook of each family, in one pass."""
    return components.agg(F.count("*").alias("total_components"), *[F.count_if(_overrides(h.split())).alias(f"with_{k}") for k, h in HOOKS.items()])


def provider_deps(providers: DataFrame) -> DataFrame:
    return providers.select("type", "file", "notifier_class", "state_type", "enclosing_class")


def behavior_summary(dead: DataFrame, hot: DataFrame, mutations: DataFrame, files: int = 0) -> DataFrame:
    """One row: files analysed, dead functions and hot paths that are reported, mutations, and owners with unpaired listeners."""
    d = dead.agg(F.count("*").alias("dead_functions"))
    h = hot.agg(F.count("*").alias("hot_paths"))
    m = mutations.agg(F.count("*").alias("total_state_mutations"))
    l = listener_pairing(mutations).agg(F.count_if(F.col("status") == "unpaired").alias("unpaired_listeners"))
    return d.join(h, F.lit(True)).join(m, F.lit(True)).join(l, F.lit(True)).select(F.lit(files).cast("long").alias("files_analyzed"), "*")
