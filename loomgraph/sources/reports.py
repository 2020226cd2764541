"""Markdown reports and JSON documents of an engine's answers. What is drawn is cut to the lengths named here; the JSON documents refuse what is too large rather than cut it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sinks

MAX_ROWS = 200_000


def rows(df: DataFrame, limit: int = MAX_ROWS) -> list[dict]:
    """All rows as plain values; more than limit are an error."""
    got = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"over {limit} rows; use write_tables")
    return got


def write_json(path: str, **parts) -> dict:
    """One document; DataFrames become lists of rows."""
    doc = {k: rows(v) if isinstance(v, DataFrame) else v for k, v in parts.items()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(doc, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return doc


def _bullets(pairs) -> str:
    return "\n".join(f"- **{k}**: {v}" for k, v in pairs) + "\n"


def _sub(title: str, df: DataFrame, limit: int) -> str:
    """A table below a section's heading; nothing for no rows."""
    return "" if df.isEmpty() else sinks.table_md(title, df, limit).replace("## ", "### ", 1)


def project_section(info: DataFrame, counts: dict) -> str:
    p = info.first().asDict()
    return "## Overview\n\n" + _bullets([(k.replace("_", " ").capitalize(), v) for k, v in {**p, **counts}.items() if v is not None])


def confidence_section(stats: DataFrame) -> str:
    """Relationships by how sure they are."""
    n = {r.key: r.n for r in stats.where("kind = 'confidence'").collect()}
    said = {"EXTRACTED": "stands in the source", "INFERRED": "follows from a pattern", "AMBIGUOUS": "not certain"}
    return "## Confidence\n\n| level | relationships | meaning |\n|---|---|---|\n" + "".join(f"| {k} | {n.get(k, 0)} | {m} |\n" for k, m in said.items())


def cluster_section(clusters: DataFrame, names: DataFrame, limit: int = 25) -> str:
    """The largest clusters (name, size, members joined) with the names of three members; names: id, name."""
    top = clusters.orderBy(F.desc("size"), "name").limit(limit)
    some = top.select("id", F.posexplode(F.slice(F.split("members", ","), 1, 3)).alias("k", "m")).join(names.withColumnsRenamed({"id": "m", "name": "called"}), "m", "left")
    first = some.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("called", "m").alias("n")))), lambda x: x["n"]), ", ").alias("first"))
    more = F.when(F.col("size") > 3, F.concat(F.lit(" +"), F.col("size") - 3, F.lit(" more"))).otherwise("")
    return sinks.table_md("Clusters", top.join(first, "id").orderBy(F.desc("size"), "name").select("name", "size", F.concat("first", more).alias("members")), limit)


def instruction_section(found: dict[str, DataFrame]) -> str:
    """Of Engine.prompts(): the combined summary, the severe redundancies, clusters and topics of each file."""
    c = found["combined"].first()
    out = ["## Instruction redundancy\n", _bullets([(k.replace("_", " ").capitalize(), v) for k, v in c.asDict().items()])]
    rate = found["summary"].where("kind = 'total'").groupBy("file").pivot("key", ["chunks", "redundancies", "redundancy rate"]).agg(F.first("n")).where("redundancies > 0").orderBy("file")
    severe = found["redundancies"].where("severity IN ('critical', 'high')").groupBy("file", "type", "severity").agg(F.sum("n_pairs").alias("pairs")).orderBy("file", "type")
    out += [_sub("Files", rate, 100), _sub("Severe redundancies", severe, 100), _sub("Redundancy clusters", found["clusters"].orderBy("file", "first_seq"), 100), _sub("Most duplicated topics", found["most_duplicated"].orderBy("file", F.desc("n"), "topic"), 100)]
    return "\n".join(x for x in out if x)


def runtime_section(r: dict[str, DataFrame]) -> str:
    """Of Engine.runtime(): entry points with what they set up, the configuration surface, tests and conventions."""
    first = r["initializations"].groupBy("path", "entry_line").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 5), ", ").alias("sets_up"))
    e = r["entry_points"].join(first.withColumnRenamed("entry_line", "line"), ["path", "line"], "left").orderBy("path", "line").select("path", "line", "kind", F.coalesce("sets_up", F.lit("")).alias("sets up"))
    kinds = ("env_vars", "config_files", "feature_flags", "constants", "api_urls", "secrets")
    cov, tests = r["coverage_summary"].first(), r["test_files"].agg(F.count("*").alias("files"), F.coalesce(F.sum("test_count"), F.lit(0)).alias("cases")).first()
    named = r["file_naming"].where("dominant").first()
    used = [x.framework for x in r["frameworks"].orderBy("framework").collect()]
    dirs = r["directories"].first()
    handled = [k for k, v in r["error_handling"].first().asDict().items() if v]
    told = [("File naming", named.style if named else "unknown"), ("Class naming", r["class_naming"].first().dominant), ("Architecture", r["architecture"].first().architecture), ("Frameworks", ", ".join(used) or "none"), ("Directories", dirs.pattern if dirs else "flat"), ("Error handling", ", ".join(handled) or "none")]
    out = ["## Runtime comprehension\n", _sub("Entry points", e, 10), "### Configuration surface\n\n" + _bullets([(k.replace("_", " "), r[k].count()) for k in kinds]), _sub("Environment variables", r["env_vars"].orderBy("path", "line", "name"), 10)]
    out += ["### Test coverage\n\n" + _bullets([("Test files", tests.files), ("Test cases", tests.cases), ("Source files", cov.modules), ("Covered", f"{cov.percent}%"), ("Untested at high risk", cov.high_risk_untested)])]
    out += [_sub("Untested modules", r["coverage"].where("test_path IS NULL").select("path", "risk").orderBy("path"), 10), "### Conventions\n\n" + _bullets(told)]
    return "\n".join(x for x in out if x)


def behavior_section(b: dict[str, DataFrame]) -> str:
    """Of Engine.behavior(): dead code, hot paths, deep chains, hot spots, listeners and lifecycles."""
    s, life = b["summary"].first(), b["lifecycle"].first()
    off = b["listeners"].where("status = 'unpaired'").orderBy(F.desc("unpaired"), "owner")
    paired = b["listeners"].where("status = 'paired'").count()
    out = ["## Behavioural analysis\n", f"{s.files_analyzed} files analysed.\n", _sub("Dead code", b["dead_code"].select("function", "file", "calls_count", "called_by_count").orderBy("file", "function"), 15), _sub("Hot paths", b["hot_paths"].orderBy(F.desc("call_sites"), "id"), 10)]
    out += [_sub("Deepest call chains", b["call_depth"].orderBy(F.desc("depth"), "id"), 5), _sub("State mutation hot spots", b["hotspots"].select("owner", "n", "risk", "breakdown").orderBy(F.desc("n"), "owner"), 10), _sub("Unpaired listeners", off.select("owner", "adds", "removes", "unpaired"), 1000)]
    out += [f"{paired} owners remove all the listeners that they add.\n", "### Lifecycle\n\n" + _bullets([(k.replace("_", " "), v) for k, v in life.asDict().items()])]
    return "\n".join(x for x in out if x)


def journey_section(j: DataFrame) -> str:
    features = j.groupBy("feature").agg(F.count("*").alias("journeys")).orderBy(F.desc("journeys"), "feature")
    top = j.orderBy("rank").select("name", "feature", F.col("n_steps").alias("steps"), F.round("confidence", 2).alias("confidence"))
    return "\n".join(["## User journeys\n", f"{j.count()} journeys in {features.count()} features.\n", _sub("Features", features, 100), _sub("Surest journeys", top, 15)])


def journeys_markdown(j: DataFrame, report: DataFrame, steps: DataFrame) -> str:
    """A document of all journeys: by feature, step type and confidence, and each with its steps."""
    out = ["# User journeys\n", f"{j.count()} journeys.\n"]
    for title, kind in (("By feature", "feature"), ("By step type", "step_type"), ("By confidence", "confidence")):
        out.append(sinks.table_md(title, report.where(F.col("kind") == kind).select("key", "n").orderBy(F.desc("n"), "key"), 1000))
    own: dict[str, list] = {}
    for s in rows(steps.orderBy("root", "pos")):
        own.setdefault(s["root"], []).append(s)
    out.append("## Journeys\n")
    for r in rows(j.orderBy("rank").drop("rank", "nodes")):
        out.append(f"### {r['name']}\n\nConfidence {r['confidence']:.0%}, feature {r['feature']}, {r['n_steps']} steps, from `{r['entry']}`.\n\n| # | type | name | file | line |\n|---|---|---|---|---|")
        out += [f"| {s['pos'] + 1} | {s['step_type']} | {s['name']} | {s['file']} | {s['line']} |" for s in own.get(r["root"], [])]
        out.append("")
    return "\n".join(out)
