"""Reports and files. What is drawn on the driver is capped by the callers' top-k operators or the limits here; full tables go to Parquet."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = {"class": "#4a90d9", "config": "#95a5a6", "enum": "#16a085", "function": "#7ed321", "module": "#f5a623", "route": "#d0021b"}


def write_tables(folder: str, **frames: DataFrame) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def graph_json(path: str, entities: DataFrame, edges: DataFrame, max_rows: int = 200_000, **more) -> dict:
    """One document for small graphs; larger ones belong in write_tables, and are refused rather than cut."""
    doc = dict(more)
    for name, df in (("entities", entities), ("relationships", edges)):
        rows = df.orderBy("seq").drop("seq").limit(max_rows + 1).toJSON().collect()
        if len(rows) > max_rows:
            raise ValueError(f"{name}: over {max_rows} rows; use write_tables")
        doc[name] = [json.loads(r) for r in rows]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(doc, indent=2, ensure_ascii=False), encoding="utf-8")
    return doc


def table_md(title: str, df: DataFrame, limit: int = 25) -> str:
    rows, cols = df.limit(limit).collect(), df.columns
    body = ["| " + " | ".join(str(r[c]).replace("|", "\\|") for c in cols) + " |" for r in rows]
    return "\n".join([f"## {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *body, ""])


def append_section(report: str, title: str, text: str) -> str:
    """The report with this section replaced or added; other sections stay."""
    head = f"## {title}"
    parts = [p for p in ("\n" + report).split("\n## ") if p.strip()]
    keep = [p if i == 0 and not ("\n" + report).startswith("\n## ") else "## " + p for i, p in enumerate(parts)]
    keep = [k.strip("\n") for k in keep if not k.startswith(head + "\n") and k.strip() != head]
    return "\n\n".join([*keep, text.strip("\n")]) + "\n"


def mermaid(entities: DataFrame, edges: DataFrame, max_nodes: int = 80, max_edges: int = 100, clusters: DataFrame | None = None, gods=()) -> str:
    """A flow chart of the first nodes in order and the edges among them; clusters (id, name, members joined) are boxes, gods are starred."""
    nodes = entities.orderBy("seq").limit(max_nodes)
    rows = nodes.select("id", "name", "type").collect()
    key = {r.id: f"N{i}" for i, r in enumerate(rows, 1)}
    ids = F.broadcast(nodes.select("id"))
    e = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").orderBy("seq").limit(max_edges).collect()
    clean = lambda s: str(s).replace('"', "'").replace("[", "(").replace("]", ")")
    draw = lambda r, pad: f'{pad}{key[r.id]}["{clean(r.name)}{" *" if r.id in gods else ""}"]:::{r.type}'
    box: dict[str, tuple[str, list]] = {}
    if clusters is not None:
        inside = clusters.select("id", "name", F.explode(F.split("members", ",")).alias("m")).join(ids.withColumnRenamed("id", "m"), "m", "left_semi").collect()
        own = {x.m: x for x in inside}
        for r in rows:
            if r.id in own:
                box.setdefault(own[r.id].id, (own[r.id].name, []))[1].append(r)
    boxed = {r.id for _, some in box.values() for r in some}
    out = ["graph TB"]
    for i, (name, some) in enumerate(box.values()):
        out += [f'  subgraph C{i}["{clean(name)}"]', *[draw(r, "    ") for r in some], "  end"]
    out += [draw(r, "  ") for r in rows if r.id not in boxed] + [f'  {key[x.source]} -->|"{clean(x.type)}"| {key[x.target]}' for x in e]
    return "\n".join(out + [f"  classDef {k} fill:{c}" for k, c in CLASSES.items()]) + "\n"


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif;margin:2em}}td,th{{border:1px solid #ccc;padding:2px 8px}}circle{{stroke:#333}}</style></head>
<body><h1>{title}</h1><input id="q" placeholder="filter"><svg id="g" width="900" height="620"></svg><script>
const D={data};const g=document.getElementById('g'),P={{}},n=D.nodes.length||1;
D.nodes.forEach((d,i)=>{{P[d.id]=[450+(d.level==null?280*Math.cos(6.283*i/n):-400+130*d.level),310+(d.level==null?280*Math.sin(6.283*i/n):-280+22*i)]}});
const S=(t,a)=>{{const e=document.createElementNS('http://www.w3.org/2000/svg',t);for(const k in a)e.setAttribute(k,a[k]);g.appendChild(e);return e}};
function draw(q){{g.innerHTML='';D.edges.forEach(e=>{{const a=P[e.source],b=P[e.target];if(a&&b)S('line',{{x1:a[0],y1:a[1],x2:b[0],y2:b[1],stroke:'#999','stroke-width':e.width||1}})}});
D.nodes.forEach(d=>{{if(q&&!(d.label+d.id).toLowerCase().includes(q))return;const p=P[d.id];S('circle',{{cx:p[0],cy:p[1],r:d.size||6,fill:'#4a90d9'}});S('text',{{x:p[0]+9,y:p[1]+4}}).textContent=d.label}})}}
draw('');document.getElementById('q').oninput=e=>draw(e.target.value.toLowerCase())</script></body></html>"""


def graph_html(title: str, nodes: list[dict], edges: list[dict]) -> str:
    data = json.dumps({"nodes": nodes, "edges": edges}).replace("</", "<\\/")
    return _PAGE.format(title=html.escape(title), data=data)


def cluster_html(title: str, clusters: DataFrame, links: DataFrame) -> str:
    """Overview of clusters (name, size) and their strongest links (source_cluster, target_cluster, n)."""
    nodes = [{"id": r.name, "label": f"{r.name} ({r.size})", "size": 14 + min(r.size // 20, 12)} for r in clusters.orderBy(F.desc("size"), "name").limit(80).collect()]
    return graph_html(title, nodes, [{"source": r.source_cluster, "target": r.target_cluster, "width": min(r.n // 10 + 1, 4)} for r in links.collect()])


def journeys_html(title: str, journeys: DataFrame, limit: int = 100) -> str:
    """Journeys as rows of steps from left to right; a step's key has its journey's id."""
    nodes, edges = [], []
    for r in journeys.orderBy(F.desc("confidence"), "root").limit(limit).collect():
        steps = r.chain.split(">")
        nodes += [{"id": f"{r.root}/{i}", "label": s, "level": i, "size": 6} for i, s in enumerate(steps)]
        edges += [{"source": f"{r.root}/{i}", "target": f"{r.root}/{i + 1}"} for i in range(len(steps) - 1)]
    return graph_html(title, nodes, edges)
