"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``cap``. Among all rates that bring every
source's words to its target, those nearest to 1 in relative entropy are
``min(cap, exp(lambda_s * x))``, x being the document's size over its source's mean:
the target's words are tilted exponentially, one multiplier a constraint. The convex
dual is solved by Newton steps kept inside a bracket. A step is one distributed
aggregation over the histogram of (source, size), whose sums are exact decimals, so
that reruns agree to the bit. The rates are then rounded into whole copies, each
document handing its rounding error to the next smaller one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, n_words

MAX_STEPS = 80
GROUP_ROWS = 50_000
_D = "decimal(38,6)"


def water_levels(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap times its size; the excess goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        w = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if left * weights[i] / w > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in sorted(full):
            out[i] = cap * sizes[i]
        left = total - math.fsum(out[i] for i in range(len(sizes)) if i not in open_ or i in full)
        open_ -= full
    return out


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def _solve(hist: Table, sources: list[dict], cap: float) -> None:
    """Sets lam of each source; sources has source, size, docs, least (size above 0), target."""
    spark = hist.spark
    live = []
    for s in sources:
        s["lam"], s["mean"] = 0.0, max(s["size"], 1) / max(s["docs"], 1)
        if not s["size"]:
            continue
        if s["target"] >= cap * s["size"]:
            s["lam"] = 2 * math.log(cap) * s["mean"] / s["least"]  # every document at the cap
        elif s["target"] <= 0:
            s["lam"] = -800 * s["mean"] / s["least"]
        else:
            s["lo"], s["hi"] = -50 * s["mean"] / s["least"], math.log(cap) * s["mean"] / s["least"]
            s["lam"] = min(max(math.log(s["target"] / s["size"]), s["lo"]), s["hi"])
            live.append(s)
    for _ in range(MAX_STEPS):
        if not live:
            return
        at = spark.createDataFrame([(s["sid"], s["lam"], s["mean"]) for s in live], "sid int, lam double, mean double")
        x = F.col("size") / F.col("mean")
        rate, free = _rate(F.col("lam"), x, cap), F.col("lam") * x < math.log(cap)
        mass = F.col("n") * F.col("size") * rate
        sums = hist.df.join(at, "sid").groupBy("sid").agg(F.sum(mass.cast(_D)).alias("f"), F.sum(F.when(free, mass * x).otherwise(0.0).cast(_D)).alias("g")).collect()
        by = {s["sid"]: s for s in live}
        for r in sums:
            s, f, g = by[r.sid], float(r.f), float(r.g)
            gap = f - s["target"]
            s["done"] = abs(gap) <= 1e-9 * s["target"] + 1e-4 or s["hi"] - s["lo"] < 1e-13 * max(1.0, abs(s["lam"]))
            if s["done"]:
                continue
            s["hi" if gap > 0 else "lo"] = s["lam"]
            # Newton on log f, whose curvature is small on the side below the cap
            new = s["lam"] - math.log(f / s["target"]) * f / g if g > 0 and f > 0 else math.inf
            s["lam"] = new if s["lo"] < new < s["hi"] else (s["lo"] + s["hi"]) / 2
        live = [s for s in live if not s.get("done")]


def _round_group(pdf):
    """Copies of one group's documents, largest first: each rounds its words plus what is owed so far."""
    pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    owed, out = 0.0, []
    cap = int(pdf["cap"].iloc[0]) if len(pdf) else 0
    for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist()):
        if size == 0:
            out.append(1)
            continue
        owed += rate * size * n
        c = min(cap, max(0, math.floor(owed / (size * n) + 0.5)))
        owed -= c * size * n
        out.append(c)
    return pdf.assign(copies=out)[["doc_id", "sid", "size", "rate", "copies"]]


def mixing_plan(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: int = 2) -> tuple[DataFrame, DataFrame]:
    """(copies, sources): copies by (doc_id, sid, size), and sid, source, source_size, target, lam by source.

    docs: needs doc_id, text, source; others are not read. Size is the number of words,
    0 for null or empty texts, whose documents keep one copy. Null is a source of its own
    and comes last; a null doc_id is a key like any other. Rows that agree in all three
    keys share their number of copies. The driver holds one row a source (a catalogue of
    names), never documents. A source's documents are rounded in groups of about
    GROUP_ROWS, made by a hash of doc_id, so a hot source is many tasks. Within a group
    the words taken miss the sum of rates by at most half the size of a small document,
    unless all rates are at the cap. An empty table gives empty results.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    units = Table(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-units")
    spark = docs.sparkSession
    rows = units.df.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect()
    # Python compares strings by code point
    sources = [r.asDict() for r in sorted(rows, key=lambda r: (r.source is None, r.source or ""))]
    wish = [float(weights[i % len(weights)]) for i in range(len(sources))]
    for i, (s, t) in enumerate(zip(sources, water_levels([s["size"] for s in sources], wish, share * sum(s["size"] for s in sources), cap))):
        s |= {"sid": i, "target": float(t)}
    names = spark.createDataFrame([(s["sid"], s["source"]) for s in sources], "sid int, source string")
    u = units.df
    hist = Table(u.join(names, u["source"].eqNullSafe(names["source"])).groupBy("sid", "size").agg(F.sum("n").alias("n")), "mix-hist")
    _solve(hist, sources, cap)
    found = spark.createDataFrame([(s["sid"], s["source"], s["size"], s["target"], s["lam"], s["mean"], max(1, -(-s["docs"] // GROUP_ROWS))) for s in sources], "sid int, source string, source_size long, target double, lam double, mean double, parts long")
    rated = u.join(found, u["source"].eqNullSafe(found["source"])).select("doc_id", "sid", "size", "n", F.lit(cap).alias("cap"), _rate(F.col("lam"), F.col("size") / F.col("mean"), cap).alias("rate"), F.pmod(F.xxhash64("doc_id"), "parts").alias("part"))
    copies = rated.groupBy("sid", "part").applyInPandas(_round_group, "doc_id long, sid int, size long, rate double, copies int")
    return copies, found.select("sid", "source", "source_size", "target", "lam")


def mixed(docs: DataFrame, **params) -> DataFrame:
    """row (a struct of docs' columns), doc_id, size, source_size, target, rate, copies of every row of docs.

    The caller's columns stay inside the struct, so that none can clash with another.
    """
    copies, found = mixing_plan(docs, **params)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"))
    own = copies.join(found, "sid").select(F.col("doc_id").alias("k_doc_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size"), "source_size", "target", "rate", "copies")
    same = d["doc_id"].eqNullSafe(own["k_doc_id"]) & d["source"].eqNullSafe(own["k_source"]) & (d["size"] == own["k_size"])
    return d.join(own, same).select("row", "doc_id", "size", "source_size", "target", "rate", "copies")


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: docs' rows, each repeated by its number of copies."""
    m = mixed(docs, **params).where("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("k")).select("row.*")
