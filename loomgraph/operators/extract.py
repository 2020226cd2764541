"""Structural extraction: source text to entities and relationships, one Arrow-batched pass per file.

Positions, Unicode word classes and state make this Python's; everything after it is
joins. Imports leave the pass as candidate paths in order of preference, and are resolved
by a join with the table of files, not by looking at a file system.
"""

from __future__ import annotations

import json
import posixpath
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import suffix

SCHEMA = "kind string, id string, type string, name string, file string, line int, metadata string, source string, target string, confidence string, evidence string, candidates array<string>, pos int"


class _Out:
    def __init__(self, path: str, text: str):
        self.path, self.text, self.rows = path, text, []

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def _add(self, **row):
        self.rows.append({"file": self.path, "pos": len(self.rows), **row})

    def entity(self, type_: str, name: str, line: int = 0, id_: str | None = None, **metadata):
        self._add(kind="entity", id=id_ or name, type=type_, name=name, line=line, metadata=json.dumps(metadata, sort_keys=True))

    def edge(self, type_: str, source: str, target: str, line: int = 0, confidence: str = "EXTRACTED", evidence: str = ""):
        self._add(kind="edge", type=type_, source=source, target=target, line=line, confidence=confidence, evidence=evidence)

    def wish(self, candidates: list[str], line: int, evidence: str, otherwise: str | None = None):
        """An import of the first candidate that is a file; if none is, of otherwise, if that is given."""
        self._add(kind="import", type="imports", source=self.path, target=otherwise, candidates=candidates, line=line, confidence="EXTRACTED", evidence=evidence)

    def module(self, **metadata):
        self.entity("module", posixpath.basename(self.path), 1, id_=self.path, lines=self.text.count("\n") + 1, **metadata)


_PY_IMPORT = re.compile(r"\b(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))")
_PY_CLASS = re.compile(r"\bclass\s+(\w+)\s*(?:\(([^)]*)\))?\s*:")
_PY_MODEL = re.compile(r"\bclass\s+(\w+).*?(?:BaseModel|Document|Schema)")
_PY_DEF = re.compile(r"\b(?:async\s+)?def\s+(\w+)\s*\(")
_PY_ROUTE = re.compile(r"@(?:app|router)\.(delete|get|patch|post|put)\(\s*['\"]([^'\"]+)")


def python(o: _Out) -> None:
    o.module()
    for m in _PY_IMPORT.finditer(o.text):
        name = m[1] or m[2]
        parts = name.split(".")
        if parts[0]:  # relative imports don't resolve
            o.wish(["/".join(parts[:k]) + ".py" for k in range(len(parts), 0, -1)], o.line(m.start()), f"import {name}")
    models = set(_PY_MODEL.findall(o.text))
    for m in _PY_CLASS.finditer(o.text):
        bases = [b.strip() for b in (m[2] or "").split(",") if b.strip()]
        o.entity("schema" if m[1] in models else "class", m[1], o.line(m.start()), bases=bases)
        for b in bases:
            if b not in ("ABC", "Enum", "object"):
                o.edge("extends", m[1], b, o.line(m.start()), evidence=f"class {m[1]} extends {b}")
    for m in _PY_DEF.finditer(o.text):
        if m[1] == "__init__" or not m[1].startswith("_"):
            o.entity("function", m[1], o.line(m.start()))
    for m in _PY_ROUTE.finditer(o.text):
        o.entity("route", m[2], o.line(m.start()), id_=f"route:{m[2]}", method=m[1].upper())


_DART_LINK = (("import statement", re.compile(r"\b(?:export|import)\s+['\"]([^'\"]+)['\"]")), ("part directive", re.compile(r"\bpart\s+['\"]([^'\"]+)['\"]")))
_DART_CLASS = re.compile(r"(abstract\s+)?(?:final\s+|sealed\s+)?class\s+(\w+)(?:\s*<[^>{]*>)?(?:\s+extends\s+([\w.]+)(?:<[^{]*?>)?)?(?:\s+with\s+([\w, <>]+?))?(?:\s+implements\s+([\w, <>]+?))?\s*\{")
_DART_MIXIN = re.compile(r"\bmixin\s+(\w+)(?:\s+on\s+([\w\s,]+?))?\s*\{")
_DART_ENUM = re.compile(r"\benum\s+(\w+)(?:\s+with\s+[\w\s,]+?)?\s*\{")
_DART_FN = re.compile(r"(?:static\s+)?\b(?:Future|Iterable|List|Map|Set|Stream|String|bool|double|dynamic|int|void)\s*<?[\w,\s>]*>?\s+(\w+)\s*\(")
_DART_ROUTE = re.compile(r"GoRoute\s*\(\s*(?:path|name):\s*['\"]([^'\"]+)['\"]")
_DART_PROVIDER = re.compile(r"(\w+Provider)\s*=\s*(?:(?:Async)?Notifier|Future|State|Stream)Provider")
_DART_TABLE = re.compile(r"class\s+(\w+)\s+extends\s+Table\b")
_DART_TOOL = re.compile(r"class\s+(\w+)\s+extends\s+(?:Base)?Tool\b")
_DART_FROZEN = re.compile(r"@(?:Freezed\(|JsonSerializable|freezed)")
_NOT_FN = {"class", "for", "if", "import", "return", "switch", "while"}


def dart_targets(here: str, uri: str) -> tuple[list[str], str | None]:
    """Candidate files of an import, in order, and what it names if none exists; nothing for libraries of the language."""
    if uri.startswith("package:") and uri.count("/") >= 2:
        _, package, rest = uri.split("/", 2)
        return [f"packages/{package}/lib/{rest}", f"lib/{rest}"], f"{package}/{rest}"
    if uri.startswith(("./", "../")):
        return [], posixpath.normpath(posixpath.join(here, uri))
    return [], None


def _names(text: str | None) -> list[str]:
    return re.findall(r"\w+(?=\s*(?:<[^>]*>)?\s*(?:,|$))", text or "")


def dart(o: _Out) -> None:
    o.module(ext=".dart")
    for what, rx in _DART_LINK:
        for m in rx.finditer(o.text):
            found, other = dart_targets(posixpath.dirname(o.path), m[1])
            if found or other:
                o.wish(found, o.line(m.start()), f"{what}: {m[1]}", other)
    frozen, tools, names = bool(_DART_FROZEN.search(o.text)), set(_DART_TOOL.findall(o.text)), []
    for m in _DART_CLASS.finditer(o.text):
        at = o.line(m.start())
        more = {"source": "freezed"} if frozen else {}
        more |= {"kind": "tool"} if m[2] in tools else {}
        o.entity("class", m[2], at, abstract=bool(m[1]), immutable="@immutable" in o.text[max(0, m.start() - 200) : m.start()], **more)
        names.append(m[2])
        if m[3]:
            o.edge("extends", m[2], m[3], at, evidence=f"class {m[2]} extends {m[3]}")
        for word, some in (("with", m[4]), ("implements", m[5])):
            for x in _names(some):
                o.edge("implements", m[2], x, at, evidence=f"class {m[2]} {word} {x}")
    for m in _DART_MIXIN.finditer(o.text):
        o.entity("mixin", m[1], o.line(m.start()))
        for x in _names(m[2]):
            o.edge("implements", m[1], x, o.line(m.start()), evidence=f"mixin {m[1]} on {x}")
    for m in _DART_ENUM.finditer(o.text):
        o.entity("enum", m[1], o.line(m.start()))
    for m in _DART_FN.finditer(o.text):
        if m[1] not in _NOT_FN:
            o.entity("function", m[1], o.line(m.start()))
            names.append(m[1])
    for m in _DART_ROUTE.finditer(o.text):
        o.entity("route", m[1], o.line(m.start()), id_=f"route:{m[1]}")
    for m in _DART_PROVIDER.finditer(o.text):
        o.entity("config", m[1], o.line(m.start()), kind="riverpod_provider")
    for m in _DART_TABLE.finditer(o.text):
        o.entity("schema", m[1], o.line(m.start()), kind="drift_table")
    # definitions count as calls of themselves
    for n in dict.fromkeys(names):
        for m in re.finditer(rf"\b{re.escape(n)}\s*\(", o.text):
            o.edge("calls", o.path, n, o.line(m.start()), "INFERRED", f"{n}() called in {o.path}")


_JS_IMPORT = re.compile(r"import\s+.*?from\s+['\"](\.[^'\"]*)['\"]|require\s*\(\s*['\"](\.[^'\"]*)['\"]\s*\)")
_JS_CLASS = re.compile(r"class\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w\s,]+?))?\s*\{")
_JS_IFACE = re.compile(r"interface\s+(\w+)(?:\s+extends\s+([\w\s,]+?))?\s*\{")
_JS_TYPE = re.compile(r"\btype\s+(\w+)")
_JS_FN = re.compile(r"(?:async\s+)?function\s+(\w+)")
_JS_CONST = re.compile(r"const\s+(\w+)\s*=\s*(?:async\s+)?\(")
_JS_ROUTE = re.compile(r"(?:app|router)\.(delete|get|patch|post|put|route)\s*\(['\"]([^'\"]+)")


def script(o: _Out) -> None:
    o.module()
    here = posixpath.dirname(o.path)
    for m in _JS_IMPORT.finditer(o.text):
        base = posixpath.normpath(posixpath.join(here, m[1] or m[2]))
        o.wish([base + e for e in ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")], o.line(m.start()), m[1] or m[2])
    for rx, meta in ((_JS_CLASS, {}), (_JS_IFACE, {"kind": "interface"})):
        for m in rx.finditer(o.text):
            o.entity("class", m[1], o.line(m.start()), **meta)
            if m[2]:
                for b in m[2].split(","):
                    o.edge("extends", m[1], b.strip(), o.line(m.start()))
            if rx is _JS_CLASS and m[3]:
                for b in m[3].split(","):
                    o.edge("implements", m[1], b.strip(), o.line(m.start()))
    for m in _JS_TYPE.finditer(o.text):
        o.entity("schema", m[1], o.line(m.start(1)))
    for m in _JS_FN.finditer(o.text):
        o.entity("function", m[1], o.line(m.start()))
    for m in _JS_CONST.finditer(o.text):
        if m[1][0].isupper():
            o.entity("class", m[1], o.line(m.start()), kind="component")
        else:
            o.entity("function", m[1], o.line(m.start()))
    for m in _JS_ROUTE.finditer(o.text):
        o.entity("route", m[2], o.line(m.start()), id_=f"route:{m[2]}", method=m[1].upper())


_ANY_TYPE = re.compile(r"\b(?:class|interface|record|struct|trait|type)\s+(\w+)")
_ANY_FN = re.compile(r"\b(?:def|fn|func|function|method|procedure|sub)\s+(\w+)")


def generic(o: _Out) -> None:
    o.module(ext=posixpath.splitext(o.path)[1])
    for m in _ANY_TYPE.finditer(o.text):
        o.entity("class", m[1])
    for m in _ANY_FN.finditer(o.text):
        if len(m[1]) > 2:
            o.entity("function", m[1])


#: By lower-case suffix; others are generic. Register a function of _Out here to add a language.
EXTRACTORS = {".dart": dart, ".py": python, ".js": script, ".jsx": script, ".ts": script, ".tsx": script}


def extract_one(path: str, text: str) -> list[dict]:
    """Rows of one file; an empty file gives none."""
    o = _Out(path, text or "")
    if o.text:
        EXTRACTORS.get(posixpath.splitext(path)[1].lower(), generic)(o)
    return o.rows


def extract(files: DataFrame) -> DataFrame:
    """All rows of all files (path, content)."""
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) for r in extract_one(p, t)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw entities, edges) of files, with seq, the pair of path and place, which orders them; imports resolved to the first candidate that is a file."""
    rows = extract(files).withColumn("seq", F.struct("file", "pos"))
    ent = rows.where("kind = 'entity'").select("id", "type", "name", "file", "line", "metadata", "seq")
    cols = ["source", "target", "type", "confidence", "evidence", "line", "seq"]
    edges = rows.where("kind = 'edge'").select(*cols)
    asked = rows.where("kind = 'import'")
    wish = asked.select("seq", F.posexplode("candidates").alias("k", "found"))
    hit = wish.join(files.select(F.col("path").alias("found")).distinct(), "found", "left_semi").groupBy("seq").agg(F.min_by("found", "k").alias("found"))
    linked = asked.join(hit, "seq", "left").withColumn("target", F.coalesce("found", "target")).where("target IS NOT NULL")
    return ent, edges.unionByName(linked.select(*cols))


def config_facts(files: DataFrame) -> DataFrame:
    """path, kind, name, dependencies, dev_dependencies, scripts (sorted, joined) of package.json, pyproject.toml and pubspec.yaml; a file that can't be read is left out."""
    name = F.substring_index("path", "/", -1)
    js = F.from_json("content", "name string, dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>")
    keys = lambda c: F.array_join(F.array_sort(F.coalesce(F.map_keys(js[c]), F.array().cast("array<string>"))), ",")
    whole = F.coalesce(js["name"], F.lit("unknown"))
    a = files.where((name == "package.json") & F.get_json_object("content", "$").isNotNull()).select("path", F.lit("node_package").alias("kind"), whole.alias("name"), keys("dependencies").alias("dependencies"), keys("devDependencies").alias("dev_dependencies"), keys("scripts").alias("scripts"))
    told = F.regexp_extract("content", r"(?m)^\s*name[^=\n]*=\s*['\"]*([^'\"\n]*?)['\"]*\s*$", 1)
    none = F.lit("")
    b = files.where(name == "pyproject.toml").select("path", F.lit("python_package").alias("kind"), F.when(told != "", told).otherwise("unknown").alias("name"), none.alias("dependencies"), none.alias("dev_dependencies"), none.alias("scripts"))

    def pubspec(batches):
        import yaml

        for d in batches:
            out = []
            for p, t in zip(d["path"], d["content"]):
                try:
                    y = yaml.safe_load(t)
                except yaml.YAMLError:
                    continue
                if not y or not isinstance(y, dict):
                    continue
                deps, dev = (sorted(y.get(k) or {}) for k in ("dependencies", "dev_dependencies"))
                out.append((p, "flutter_package" if "flutter" in deps else "dart_package", y.get("name", "unknown"), ",".join(deps), ",".join(dev), ""))
            yield pd.DataFrame(out, columns=["path", "kind", "name", "dependencies", "dev_dependencies", "scripts"])

    schema = "path string, kind string, name string, dependencies string, dev_dependencies string, scripts string"
    c = files.where(name == "pubspec.yaml").select("path", "content").mapInPandas(pubspec, schema)
    return a.unionByName(b).unionByName(c)


def config_entities(facts: DataFrame) -> DataFrame:
    """Raw entities of the configuration files in the root, each called as its project."""
    root = facts.where(~F.col("path").contains("/"))
    meta = F.to_json(F.struct("kind", "dependencies", "dev_dependencies", "scripts"))
    seq = F.struct(F.lit("\U0010ffff").alias("file"), F.row_number().over(Window.orderBy("path")).alias("pos"))  # after all files; at most three rows
    return root.select(F.col("path").alias("id"), F.lit("config").alias("type"), "name", F.col("path").alias("file"), F.lit(0).alias("line"), meta.alias("metadata"), seq.alias("seq"))


def project_info(files: DataFrame, facts: DataFrame, root_name: str) -> DataFrame:
    """One row: name, language, framework, type, files_analyzed. Of several configuration files in the root the last of the order here tells; a pubspec.yaml may also stand in a package below apps or packages."""
    f = facts.select("path", "kind", F.col("name").alias("told"))
    below = F.col("path").rlike(r"^(apps|packages)/[^/]+/pubspec\.yaml$")
    p = files.where(F.col("path").isin("pubspec.yaml", "package.json", "pyproject.toml", "Cargo.toml", "go.mod") | below).select("path").join(f, "path", "left")
    flutter = F.when(F.col("kind") == "flutter_package", "Flutter").otherwise("Dart")
    row = lambda rank, language, framework, kind: F.struct(F.lit(rank).alias("rank"), F.lit(language).alias("language"), framework.alias("framework"), kind.alias("type"))
    fixed = lambda rank, language, framework, kind: row(rank, language, F.lit(framework), F.lit(kind))
    x = F.when(F.col("path").endswith("pubspec.yaml") & F.col("kind").isNotNull(), F.when(below, row(1, "Dart", flutter, F.col("kind"))).otherwise(row(2, "Dart", flutter, F.col("kind"))))
    x = x.when((F.col("path") == "package.json") & F.col("kind").isNotNull(), fixed(3, "JavaScript/TypeScript", "Node.js", "node_package"))
    x = x.when(F.col("path") == "pyproject.toml", fixed(4, "Python", "Python", "python_package"))
    x = x.when(F.col("path") == "Cargo.toml", fixed(5, "Rust", "Rust", "rust_package")).when(F.col("path") == "go.mod", fixed(6, "Go", "Go", "go_module"))
    d = p.select(x.alias("x"), "told").where("x IS NOT NULL")
    one = d.agg(F.max("x").alias("x"), F.max(F.when(F.col("told").isNotNull() & (F.col("x.rank") > 1), F.struct("x.rank", "told")))["told"].alias("told"))
    n = files.where(is_source(F.col("path"))).agg(F.count("*").alias("files_analyzed"))
    unknown = lambda c: F.coalesce(F.col("x")[c], F.lit("Unknown")).alias(c)
    return one.join(n, F.lit(True)).select(F.coalesce("told", F.lit(root_name)).alias("name"), unknown("language"), unknown("framework"), F.col("x.type").alias("type"), "files_analyzed")


def is_source(path):
    """Files worth extracting, as a column."""
    return suffix(path).isin(*".bash .clj .cs .dart .ex .exs .go .java .js .jsx .kt .php .py .rb .rs .scala .sh .sql .swift .ts .tsx .zsh".split())
