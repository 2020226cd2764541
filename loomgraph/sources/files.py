"""Source trees as a DataFrame of files."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKERS = (".git", "Cargo.toml", "build.gradle", "go.mod", "package.json", "pom.xml", "pubspec.yaml", "pyproject.toml")
IGNORED = (".dart_tool", ".git", ".gradle", ".idea", ".venv", "__pycache__", "build", "dist", "node_modules", "target", "venv", "*.freezed.dart", "*.g.dart", "*.gr.dart", "*.mocks.dart")


def project_root(start: str) -> Path:
    """The nearest ancestor with a marker file, or start itself."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if any((p / m).exists() for m in MARKERS)), here)


def ignored(path: Column, patterns=IGNORED) -> Column:
    """*suffix patterns by their end, others by a path segment or the path's begin."""
    seg = F.split(path, "/")
    return reduce(lambda a, b: a | b, [path.endswith(p[1:]) if p.startswith("*") else F.array_contains(seg, p) | path.startswith(p) for p in patterns])


def scan(spark: SparkSession, root: str, patterns=(), dirs=(), keep=None, min_bytes: int = 0, files_per_task: int = 500) -> DataFrame:
    """path (relative), content, length of the files below root, a folder or URI, or below its dirs; patterns are ignored beside IGNORED.

    Names and sizes are listed once, as any file index does; contents are read by the
    executors, after the filters on path and length. Spark's own file sources skip names
    that begin with an underscore, and with them every __init__.py.
    """
    uri = root if "://" in root else Path(root).resolve().as_uri()
    store, base = fs.FileSystem.from_uri(uri)
    listed = [(f.path[len(base) :].lstrip("/"), f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
    if dirs:
        listed = [x for x in listed if any(x[0].startswith(d.strip("/") + "/") for d in dirs)]
    d = spark.createDataFrame(listed, "path string, length long").where(~ignored(F.col("path"), [*IGNORED, *patterns]) & (F.col("length") >= min_bytes))
    if keep is not None:
        d = d.where(keep(F.col("path")))

    def read(batches):
        store, base = fs.FileSystem.from_uri(uri)
        for b in batches:
            for p, n in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                with store.open_input_stream(f"{base}/{p}") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([text.replace("\r\n", "\n").replace("\r", "\n")]), pa.array([n])], ["path", "content", "length"])

    return d.repartition(max(1, -(-len(listed) // files_per_task)), "path").mapInArrow(read, "path string, content string, length long")
