"""One object for a project: scan once, then ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import module_key
from .operators import graph as g
from .operators import instructions, journeys, prompts, runtime, startup, stateflow, traverse
from .operators.extract import build, config_entities, config_facts, is_source, project_info
from .operators.incremental import changed_files, file_hashes
from .sources import reports, sinks
from .sources.documents import read_behavior, read_graph
from .sources.files import scan
from .sources.scratch import materialize


class Engine:
    """Facts of a source tree, of a graph document, or of tables; each answer is a DataFrame."""

    def __init__(self, spark: SparkSession, entities: DataFrame, edges: DataFrame, files: DataFrame | None = None, behavior: dict[str, DataFrame] | None = None):
        self.spark, self.files, self.facts, self.info = spark, files, behavior or {}, None
        self.entities, self.edges = materialize(g.merge_entities(entities), "entities"), materialize(edges, "edges")
        self.simple = materialize(g.simple_edges(self.edges, self.entities), "simple")

    @classmethod
    def scan(cls, spark: SparkSession, root: str, behavior: str | None = None, dirs=(), ignore=()) -> Engine:
        files = materialize(scan(spark, root, ignore, dirs), "files")
        facts = materialize(config_facts(files), "configs")
        ent, edges = build(files.where(is_source(files["path"])))
        e = cls(spark, ent.unionByName(config_entities(facts)), edges, files, read_behavior(spark, behavior) if behavior else None)
        e.info = materialize(project_info(files, facts, root.rstrip("/").rsplit("/", 1)[-1]), "project")
        return e

    @classmethod
    def load(cls, spark: SparkSession, graph: str, behavior: str | None = None) -> Engine:
        return cls(spark, *read_graph(spark, graph), behavior=read_behavior(spark, behavior) if behavior else None)

    def stats(self): return g.stats(self.entities, self.edges)
    def god_nodes(self, n: int = 10): return g.hubs(self.simple, self.entities, n)
    def query(self, term: str): return g.query_entities(self.entities, self.edges, term)
    def context(self, entity: str): return g.entity_context(self.entities, self.simple, entity)
    def surprising(self, n: int = 20): return g.surprising_links(self.simple, self.entities, n)
    def layers(self): return g.layer_violations(self.edges, self.entities)
    def naming(self): return g.naming_violations(self.entities)
    def cycles(self, n: int | None = 10, max_len: int | None = None): return g.import_cycles(self.edges, n, max_len)
    def tangles(self): return g.import_tangles(self.edges)
    def query_first(self, term: str): return g.query_entities(self.entities, self.edges, term, matches=5)
    def communities(self): return traverse.label_propagation(self.simple, self.entities)
    def clusters(self): return g.file_clusters(self.entities)
    def journeys(self): return materialize(journeys.drop_near_duplicates(materialize(journeys.journeys(self.entities, self.edges), "journeys")), "journeys")
    def hashes(self): return file_hashes(self.files)
    def changed(self, before: DataFrame): return changed_files(self.hashes(), before)
    def configs(self): return config_facts(self.files)
    def entry_points(self): return runtime.entry_points(self.files)
    def startup(self): return startup.initializations(self.files)
    def env_vars(self): return runtime.env_vars(self.files)
    def coverage(self): return runtime.coverage_map(self.files)

    def paths(self, a: str, b: str, cutoff: int = 8, ends: int = 3, n: int = 3):
        """The n shortest paths between up to `ends` nodes like either term, or files of entities so called."""
        return g.paths_between(self.edges, self.entities, a, b, cutoff, ends, n).orderBy("hops", "path")

    def prompts(self, min_bytes: int = 200) -> dict[str, DataFrame]:
        """Chunks of the tree's prompt files with their redundancies, clusters and summaries."""
        chunks = materialize(prompts.chunk_files(prompts.prompt_files(self.files, min_bytes)), "chunks")
        c = materialize(instructions.classify(instructions.annotate(chunks)), "classified")
        sig, sets = materialize(instructions.signatures(c), "signatures"), instructions.keyword_sets(chunks)
        red = materialize(instructions.redundancies(sig, instructions.similar_sets(sets)), "redundancies")
        clusters = materialize(instructions.redundancy_clusters(c, sig, sets, red), "clusters")
        return {"chunks": c, "redundancies": red, "clusters": clusters, "summary": instructions.summary(c, red, clusters), "most_duplicated": instructions.most_duplicated(c), "combined": instructions.combined_summary(c, red, clusters)}

    def dead_code(self, n: int = 30): return traverse.dead_code(traverse.resolve_callees(self.facts["calls"]), self.facts["entries"].select("file"), n=n)
    def hot_paths(self): return traverse.hot_paths(self.facts["calls"])
    def hotspots(self): return stateflow.mutation_hotspots(self.facts["mutations"])
    def listeners(self): return stateflow.listener_pairing(self.facts["mutations"])

    def runtime(self) -> dict[str, DataFrame]:
        """Everything the runtime operators tell of the tree's source files."""
        f = materialize(self.files.where(is_source(self.files["path"])).withColumn("seq", F.col("path")), "sources")
        keep = lambda d: materialize(d, "runtime")
        e, cov = keep(runtime.entry_points(f)), keep(runtime.coverage_map(f))
        one = {k: keep(getattr(runtime, k)(f)) for k in ("env_vars", "secrets", "feature_flags", "constants", "api_urls", "config_files", "test_files", "file_naming", "class_naming", "import_style", "error_handling", "comment_style", "frameworks", "architecture")}
        start = {k: keep(getattr(startup, k)(f)) for k in ("initializations", "framework_inits", "initial_route")}
        return {"entry_points": e, "entry_summary": runtime.entry_summary(e), **start, **one, "coverage": cov, "coverage_summary": keep(runtime.coverage_summary(cov)), "directories": keep(runtime.directory_structure(f))}

    def behavior(self) -> dict[str, DataFrame]:
        """Everything the behavioural operators tell of the facts."""
        f, keep = self.facts, lambda d: materialize(d, "behavior")
        dead, hot = keep(self.dead_code()), keep(self.hot_paths())
        files = f["calls"].select(F.substring_index("source", "::", 1).alias("f")).distinct().count()
        return {"dead_code": dead, "hot_paths": hot, "call_depth": keep(traverse.call_depth(f["calls"])), "hotspots": keep(self.hotspots()), "listeners": keep(self.listeners()), "notify_chains": keep(stateflow.notify_chains(f["containers"], f["components"])), "lifecycle": keep(stateflow.lifecycle_summary(f["components"])), "providers": keep(stateflow.provider_deps(f["providers"])), "summary": keep(stateflow.behavior_summary(dead, hot, f["mutations"], files))}

    def report(self) -> str:
        """Markdown of the project, its counts, hubs, unexpected links, clusters, module dependencies and confidence."""
        stats, clusters = materialize(self.stats(), "stats"), materialize(self.clusters(), "clusters")
        n = {"entities": self.entities.count(), "relationships": self.edges.count(), "clusters": clusters.count()}
        parts = [reports.project_section(self.info, n)] if self.info is not None else []
        parts += [sinks.table_md(t, d, 100) for t, d in [("Counts", stats.orderBy("kind", F.desc("n"), "key")), ("Hubs", self.god_nodes()), ("Unexpected links", self.surprising(10))]]
        parts += [reports.cluster_section(clusters, self.entities.select("id", "name")), sinks.table_md("Module dependencies", g.module_dependencies(self.simple, self.entities), 100), reports.confidence_section(stats)]
        return "# Report\n\n" + "\n".join(parts)

    def html(self) -> str:
        key = self.entities.select("id", module_key(F.col("file")).alias("cluster"))
        return sinks.cluster_html("Clusters", self.clusters(), g.cluster_edges(self.simple, key))
