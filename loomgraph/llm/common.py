"""Word rules, scratch tables in the cluster's shared folder, and small helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
_scratch: list[tuple[object, str]] = []


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that every engine agrees on every alphabet."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: spark.checkpoint.dir. Where it is unset, a local session gets one of our own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
        _remember(spark, found)
    return found.rstrip("/")


def _remember(spark: SparkSession, path: str) -> None:
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before the interpreter did
            pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _remember(spark, path)
    return path


class Table:
    """A table written to the shared folder: lineage ends here and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Only for tables that no returned DataFrame reads."""
        _delete(self.spark, self.path)


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A side of so many bigint ids is broadcast: some 100 MB as a hash table.
BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs' rows whose key is none of the ids (one bigint column; null is an id like any other), with all their columns.

    The ids are written and counted; up to BROADCAST_IDS they go to the rows, so that no
    text is shuffled. More are joined by their hash.
    """
    name = ids.columns[0]
    gone = Table(ids.select(F.col(name).alias("_gone")).distinct(), "gone").df
    some = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(some, docs[key].eqNullSafe(some["_gone"]), "left_anti")


def kth_largest(table: Callable[[], DataFrame], col: str, k: int) -> int:
    """The k-th largest value of a bigint column, by radix selection: four passes that each bring at most 65,536 counts to the driver.

    k must lie in 1..number of non-null rows.
    """
    lo, bits = -(1 << 63), 64
    left = k
    while bits:
        bits -= 16
        # the arithmetic stays inside bigint: compare on the top bits first, then bin
        hi = lo + ((1 << (bits + 16)) - 1)
        d = table().where(F.col(col).between(F.lit(lo), F.lit(hi)))
        counts = d.groupBy(F.shiftright(F.col(col), bits).alias("b")).count().collect()
        for b, n in sorted(((r["b"], r["count"]) for r in counts), reverse=True):
            if left <= n:
                lo = b << bits
                break
            left -= n
    return lo
