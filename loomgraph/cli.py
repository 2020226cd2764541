"""Command line: scan a tree once, then ask; graph, reports and diagrams go to the output folder."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

OUTPUT = ".loomgraph"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph", description="Knowledge graph, runtime, behaviour and instruction analysis of a source tree, on Spark.")
    switches = {
        "refresh": "scan again though there is a graph",
        "journeys": "user journeys",
        "analyze-prompts": "redundancies between instructions",
        "runtime-analysis": "entry points, configuration, tests and conventions",
        **{name: f"print the {name} output" for name in ("html", "json", "mermaid", "report")},
    }
    options = {
        "behavioral": ("FACTS", "dead code, hot paths and state flow of a JSON document of facts"),
        "prompt-file": ("FILE", "redundancies within one file"),
        "query": ("TERM", "entities like TERM and their relationships"),
    }
    p.add_argument("target", help="a folder in the tree", default=".", nargs="?")
    p.add_argument("--output", help=f"folder below the tree's root (default: {OUTPUT})", default=OUTPUT)
    for name, text in switches.items():
        p.add_argument(f"--{name}", help=text, action="store_true")
    for name, (value, text) in options.items():
        p.add_argument(f"--{name}", help=text, metavar=value)
    for name, text in {"ignore": "more patterns to ignore", "scan-dirs": "only these folders"}.items():
        p.add_argument(f"--{name}", help=text, nargs="*", default=[])
    p.add_argument("--path", help="shortest paths between entities", metavar=("FROM", "TO"), nargs=2)
    return p


def session() -> SparkSession:
    s = SparkSession.builder.appName("loomgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _show(df: DataFrame, line, none: str) -> int:
    rows = df.collect()
    print("\n".join(map(line, rows)) if rows else none)
    return 0 if rows else 1


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)

    from .engine import Engine
    from .operators import graph as g
    from .operators import journeys as jo
    from .sources import reports, sinks
    from .sources.files import project_root

    root = project_root(a.target)
    out = root / a.output
    graph, report = out / "graph.json", out / "REPORT.md"
    spark = session()
    ignore = [*a.ignore, a.output]

    def scanned() -> Engine:
        return Engine.scan(spark, str(root), a.behavioral, a.scan_dirs, ignore)

    def section(title: str, text: str) -> None:
        out.mkdir(parents=True, exist_ok=True)
        old = report.read_text(encoding="utf-8") if report.exists() else "# Report\n"
        report.write_text(sinks.append_section(old, title, text), encoding="utf-8")

    if a.query or a.path:
        if not graph.exists():
            print("no graph yet: scan first")
            return 1
        e = Engine.load(spark, str(graph))
        if a.path:
            return _show(e.paths(*a.path), lambda r: r.path.replace(">", " > "), "no path")
        return _show(e.query(a.query).orderBy("id", "direction", "pos"), lambda r: f"{r.id} ({r.name}) {r.direction} {r.type} {r.other}", "nothing like it")
    if a.analyze_prompts or a.prompt_file:
        e = scanned()
        if a.prompt_file:
            e.files = e.files.where(e.files["path"].endswith(Path(a.prompt_file).as_posix()))
        found = e.prompts(0 if a.prompt_file else 200)
        doc = reports.write_json(str(out / "instruction_analysis.json"), summary=found["combined"], files=found["summary"], redundancies=found["redundancies"], clusters=found["clusters"])
        section("Instruction redundancy", reports.instruction_section(found))
        print(json.dumps(doc["summary"][0]))
        return 0
    if a.runtime_analysis:
        r = scanned().runtime()
        reports.write_json(str(out / "runtime_analysis.json"), **{k: v for k, v in r.items()})
        section("Runtime comprehension", reports.runtime_section(r))
        print(f"{r['entry_points'].count()} entry points, {r['env_vars'].count()} environment variables")
        return 0
    if graph.exists() and not a.refresh and not a.behavioral:
        e = Engine.load(spark, str(graph))
        print(f"{e.entities.count()} entities, from the graph of an earlier scan")
    else:
        e = scanned()
        clusters = e.clusters()
        more = {"project": reports.rows(e.info)[0], "clusters": reports.rows(clusters), "metadata": {"god_nodes": reports.rows(e.god_nodes()), "surprising_links": reports.rows(e.surprising()), "stats": reports.rows(e.stats())}}
        sinks.graph_json(str(graph), e.entities, e.edges, **more)
        report.write_text(e.report(), encoding="utf-8")
        (out / "graph.html").write_text(e.html(), encoding="utf-8")
        (out / "graph.mermaid").write_text(sinks.mermaid(e.entities, e.edges, clusters=clusters, gods=[x["id"] for x in more["metadata"]["god_nodes"]]), encoding="utf-8")
        (out / "file_hashes.json").write_text(json.dumps({r.path: r.sha256 for r in e.hashes().collect()}, indent=2), encoding="utf-8")
        print(f"{e.entities.count()} entities, {e.edges.count()} relationships, in {out}")
    if a.behavioral:
        b = e.behavior()
        reports.write_json(str(out / "behavioral_analysis.json"), **b)
        section("Behavioural analysis", reports.behavior_section(b))
        print(json.dumps(reports.rows(b["summary"])[0]))
    if a.journeys:
        j = e.journeys()
        steps, told = jo.steps(j, e.entities, e.edges), jo.report(j)
        reports.write_json(str(out / "user_journeys.json"), journeys=j.orderBy("rank").drop("rank", "nodes"), steps=steps.orderBy("root", "pos"), summary=told)
        (out / "USER_JOURNEYS.md").write_text(reports.journeys_markdown(j, told, steps), encoding="utf-8")
        (out / "user_journeys.html").write_text(sinks.journeys_html("User journeys", j), encoding="utf-8")
        section("User journeys", reports.journey_section(j))
        print(f"{j.count()} journeys")
    for name, path in (("json", graph), ("report", report), ("html", out / "graph.html"), ("mermaid", out / "graph.mermaid")):
        if getattr(a, name):
            print(path.read_text(encoding="utf-8"))
    return 0
