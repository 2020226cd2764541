"""Near-duplicates: MinHash bands propose pairs, odd sketches estimate them, full sets confirm them.

Documents with equal shingle sets are one class, stood for by its smallest doc_id. For
each class K minimum values are taken and folded twice: into BANDS band keys, and into
an odd sketch, a bitmap in which each sample (position, value) flips one bit. The XOR of
two sketches counts the samples in which they differ: with p of N bits set, the
symmetric difference is about -N/2 ln(1 - 2p/N), which is most precise where similarity
is high. A pair of a band is confirmed on the full sets only if that estimate leaves it
a chance: the margin is five standard deviations of estimate and sampling together
(0.048 at a similarity of 0.6, less above).

Documents that bands connect, directly or over others, are a group that no link leaves.
The texts of a group go to one task, once, and there each band's pairs are compared, but
for those that links connect already: a row of numpy at a time, first by sizes and
sketches, then by the full sets. A group that is too large for a task is taken band by
band instead. There each member is compared with its band's smallest one first; what
then is left are bands whose members are in several components, and of these the pairs
with at least one member outside the largest one, in blocks of a bounded size. No link
between documents that share a band is lost to this; with 32 bands of 4 a pair at the
threshold shares none with a probability below 1e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, release, without_ids
from .components import components
from .shingles import mix, pair_hashes, pair_sets, slices, word_hashes

BANDS, ROWS, BITS = 32, 4, 1024
K = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_I = np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Of a group that is verified in one task: members, and shingles of all of them.
CHUNK, CHUNK_SHINGLES = 64, 2_000_000
MARGIN = 5 * 0.048
#: Classes of so many rows and more are joined by broadcast; there are at most rows / HOT_ROWS of them.
HOT_ROWS = 10_000
#: Of a unit that is compared in one task, on either side: bytes of text and rows; and bytes of text of the units that go to a task together.
UNIT_BYTES, UNIT_ROWS, BUCKET_BYTES = 4_000_000, 8192, 2_000_000
BROADCAST_ROWS = 200_000
FEATURES = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"


def min_values(s: np.ndarray) -> np.ndarray:
    out = np.full(K, ~np.uint64(0))
    for i in range(0, len(s), 256):
        np.minimum(out, (s[i : i + 256, None] * _A + _B).min(axis=0), out=out)
    return out


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(documents, BITS / 64) int64 parity bitmaps of (documents, K) samples."""
    bit = (mix(mins ^ _I) % np.uint64(BITS)).astype(np.int64) + np.arange(len(mins))[:, None] * BITS
    parity = np.bincount(bit.ravel(), minlength=len(mins) * BITS).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view(np.int64).reshape(len(mins), BITS // 64)


def _features(batches):
    for b in batches:
        keys = b.column("doc_id")
        for at, texts in slices(b.column("text")):
            s, bounds = pair_hashes(*word_hashes(texts))
            n, s1, s2, mins = [], [], [], np.full((len(texts), K), 0, np.uint64)
            for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
                u = np.unique(s[x:y])
                n.append(len(u))
                s1.append(mix(u).sum(dtype=np.uint64))
                s2.append(mix(u * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)).sum(dtype=np.uint64))
                if len(u):
                    mins[i] = min_values(u)
            band = np.zeros((len(texts), BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band * np.uint64(0x9FB21C651E98DF25) + mins[:, r::ROWS])
            band = mix(band + _I[:BANDS])
            sketch = odd_sketches(mins)
            m = len(texts)
            lists = lambda a, w: pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(a).view(np.int64).ravel()))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            columns = [keys.slice(at, m), pa.array(n, pa.int64()), longs(s1), longs(s2), lists(band, BANDS), lists(sketch, BITS // 64)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])
    release()


def _verify(group: pa.Table) -> pa.Table:
    """Intersection and union of each member's set with the leader's; ids with several texts count by their closest."""
    ids, lead = group.column("c").to_pylist(), group.column("lead").to_pylist()
    sets: list = []
    for _, texts in slices(group.column("text").combine_chunks()):
        sets += pair_sets(texts)
    leaders = [s for s, x in zip(sets, lead) if x]
    best: dict = {}
    for c, s, x in zip(ids, sets, lead):
        if x or not len(s):
            continue
        for t in leaders:
            if len(t):
                inter = len(np.intersect1d(s, t, assume_unique=True))
                union = len(s) + len(t) - inter
                if c not in best or inter * best[c][1] > best[c][0] * union:
                    best[c] = (inter, union)
    l = group.column("l")[0].as_py()
    return pa.table({"l": pa.array([l] * len(best), pa.int64()), "c": pa.array(list(best), pa.int64()), "inter": pa.array([v[0] for v in best.values()], pa.int64()), "uni": pa.array([v[1] for v in best.values()], pa.int64())})


class _Sets:
    """Shingle sets of some rows, and what of them is linked."""

    def __init__(self, rows: pa.Table, percent: int):
        sets: list = []
        for _, texts in slices(rows.column("text").combine_chunks()):
            sets += pair_sets(texts)
        self.percent = percent
        self.n = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.n) - self.n
        distinct, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int64)
        column = lambda name: rows.column(name).combine_chunks()
        self.c, self.lab = (column(x).to_numpy() for x in ("c", "lab"))
        self.left, self.right, self.other = (column(x).to_numpy(zero_copy_only=False) for x in ("left", "right", "other"))
        self.keys = column("keys")
        sketch = column("sketch")
        self.known = sketch.is_valid().to_numpy(zero_copy_only=False)
        self.sketch = np.zeros((len(self.n), BITS // 64), np.uint64)
        self.sketch[self.known] = sketch.drop_null().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        #: bits in which the sketches of a pair may differ that has a chance
        self.bits = BITS / 2 * (1 - np.exp(-4 * K * (1 - percent / 100 + MARGIN) / BITS))

    def linked_to(self, x: int, y: np.ndarray) -> np.ndarray:
        """Which of the rows y are linked to row x; sets that are empty are in neither."""
        n = self.n
        y = y[100 * np.minimum(n[x], n[y]) >= self.percent * np.maximum(n[x], n[y])]
        if self.known[x] and len(y):
            y = y[(np.bitwise_count(self.sketch[y] ^ self.sketch[x]).sum(axis=1) <= self.bits) | ~self.known[y]]
        if not len(y):
            return y
        k = n[y]
        ends = np.cumsum(k)
        own = self.codes[self.start[x] : self.start[x] + n[x]]
        self.mark[own] = 1
        inter = np.add.reduceat(self.mark[self.codes[np.repeat(self.start[y] - (ends - k), k) + np.arange(ends[-1])]], ends - k)
        self.mark[own] = 0
        return y[100 * inter >= self.percent * (n[x] + k - inter)]

    def unit(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """(label, smallest label linked to it) of those labels of the rows a to z - 1 that aren't the smallest themselves."""
        labels, root = np.unique(self.lab[a:z], return_inverse=True)
        keys = self.keys.slice(a, z - a)
        row = np.repeat(np.arange(a, z), keys.value_lengths().to_numpy())
        key = keys.flatten().to_numpy()
        order = np.lexsort((row, key))
        row, key = row[order], key[order]
        seen = set()
        for band in np.split(row, np.flatnonzero(key[1:] != key[:-1]) + 1):
            if (same := band.tobytes()) in seen:
                continue
            seen.add(same)
            band = band[self.n[band] > 0]
            to = band[self.right[band]]
            for x in band[self.left[band]]:
                y = to[root[to - a] != root[x - a]]
                if not len(y):
                    if (root[band - a] == root[x - a]).all():
                        break
                    continue
                hit = self.linked_to(x, y[~self.other[y] | (self.c[y] > self.c[x])])
                if len(hit):
                    new = np.unique(np.append(root[hit - a], root[x - a]))
                    root[np.isin(root, new)] = new[0]
        best = np.zeros(len(labels), np.int64)
        best[np.searchsorted(labels, self.lab[a:z])] = root
        moved = best != np.arange(len(labels))
        return labels[moved], labels[best[moved]]


def _link(group: pa.Table, percent: int) -> pa.Table:
    """u, v, wide: the links of units, as label and smallest label; a unit is what agrees in key, i and j."""
    group = group.sort_by([(x, "ascending") for x in ("key", "i", "j", "c")]).combine_chunks()
    key = np.stack([group.column(x).to_numpy() for x in ("key", "i", "j")])
    bounds = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [group.num_rows]])
    cum = np.concatenate([[0], np.cumsum(np.array(pc.fill_null(pc.binary_length(group.column("text")), 0), np.int64))])[bounds]
    u, v, wide, at = [], [], [], 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + UNIT_BYTES, side="right")) - 1)
        sets = _Sets(group.slice(bounds[at], bounds[to] - bounds[at]), percent)
        for a, z in zip(bounds[at:to], bounds[at + 1 : to + 1]):
            x, y = sets.unit(a - bounds[at], z - bounds[at])
            u.append(x)
            v.append(y)
            wide.append(np.full(len(x), key[1, a] >= 0))
        at = to
        del sets
    del group
    release()
    return pa.table({"u": np.concatenate(u), "v": np.concatenate(v), "wide": np.concatenate(wide)})


def _load():
    """Units that rows' texts fill."""
    return F.greatest(F.sum("bytes") / UNIT_BYTES, F.sum("rows") / UNIT_ROWS)


class _Job:
    def __init__(self, docs: DataFrame, percent: int):
        self.percent = percent
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        features = Table(keyed.mapInArrow(_features, FEATURES), "features")
        f = features.df.where("n_shingles > 0 AND doc_id IS NOT NULL")
        # summed up before the shuffle, so that copies without end are a row a task
        one = F.min_by(F.struct("n_shingles", "bands", "sketch"), "doc_id").alias("x")
        self.classes = Table(f.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows"), one).select("s1", "s2", "rep", "n_rows", "x.*"), "classes")
        self.keys = Table(features.df.select("doc_id", "n_shingles", "s1", "s2"), "keys")
        features.drop()
        rep = self.classes.df.select(F.col("rep").alias("c"), "n_shingles", "bands", "sketch")
        band = rep.select("c", F.explode("bands").alias("key"))
        many = band.groupBy("key").agg(F.min("c").alias("l"), F.max("c").alias("z")).where("l < z").drop("z")
        self.first = Table(band.join(many, "key").distinct(), "bands")
        self.nodes = Table(self.first.df.select("c").distinct(), "nodes")
        near = self.nodes.df
        if near.count() <= BROADCAST_ROWS:
            near = F.broadcast(near)
        self.texts = Table(keyed.join(near, F.col("doc_id") == F.col("c")).select("c", "text"), "texts")
        self.sketches = Table(rep.join(near, "c", "left_semi").select("c", "n_shingles", "sketch"), "sketches")

    def estimate(self, pairs: DataFrame, percent: int) -> DataFrame:
        """l, c, n (shingles of c) of the pairs (l, c) that may have a similarity of percent, by the sizes of their sets and by their sketches."""
        a = self.sketches.df.select(F.col("c").alias("l"), F.col("n_shingles").alias("nl"), F.col("sketch").alias("sl"))
        b = self.sketches.df.select("c", "n_shingles", F.col("sketch").alias("sc"))
        p = F.aggregate(F.zip_with("sl", "sc", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        differ = -BITS / 2 * F.ln(F.greatest(F.lit(1e-3), 1 - 2 * p / F.lit(float(BITS))))
        likely = 1 - differ / (2 * K) >= percent / 100 - MARGIN
        possible = 100 * F.least("nl", "n_shingles") >= percent * F.greatest("nl", "n_shingles")
        return pairs.join(a, "l").join(b, "c").where(possible & likely).groupBy("l", "c").agg(F.max("n_shingles").alias("n"))

    def verify(self, pairs: DataFrame, percent: int) -> Table:
        """l, c, inter, uni of the pairs that may have a similarity of percent, in groups of a leader and a bounded part of its members."""
        p = Table(self.estimate(pairs, percent), "pairs")
        size = F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)
        parts = p.df.groupBy("l").agg(F.ceil(size).alias("parts"))
        p2 = p.df.join(parts, "l").select("l", "c", F.pmod(F.xxhash64("c"), "parts").alias("part"))
        members = p2.join(self.texts.df, "c").select("l", "part", "c", F.lit(False).alias("lead"), "text")
        lead = self.texts.df.withColumnRenamed("c", "l")
        heads = p2.select("l", "part").distinct().join(lead, "l").select("l", "part", F.col("l").alias("c"), F.lit(True).alias("lead"), "text")
        return Table(members.unionByName(heads).groupBy("l", "part").applyInArrow(_verify, "l long, c long, inter long, uni long"), "verified")

    def linked(self, d: DataFrame) -> DataFrame:
        return d.where(100 * F.col("inter") >= self.percent * F.col("uni"))

    def wide(self, rows: DataFrame) -> tuple[DataFrame, Table]:
        """Units of the bands of groups that are too large for a task, and the components of the links of bands' smallest members. rows: key, l, c, bytes, rows."""
        star = self.linked(self.verify(rows.where("c <> l").select("l", "c").distinct(), self.percent).df)
        cc = components(star.select(F.col("c").alias("u"), F.col("l").alias("v")))
        label = cc.df.select(F.col("u").alias("c"), F.col("v").alias("lab"))
        d = Table(rows.join(label, "c", "left").select("key", "c", "bytes", "rows", F.coalesce("lab", "c").alias("lab")), "wide")
        most = d.df.groupBy("key", "lab").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "lab")).alias("m"), F.count("*").alias("labs"))
        most = most.where("labs > 1").select("key", F.col("m.lab").alias("most"))
        # bands of the same members are one
        same = d.df.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("h1"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("h2"))
        one = same.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key")
        d = Table(d.df.join(most, "key").join(one, "key").withColumn("other", F.col("lab") != F.col("most")).drop("most"), "open")
        p = d.df.groupBy("key").agg(F.ceil(_load()).cast("int").alias("p"))
        q = d.df.where("other").groupBy("key").agg(F.ceil(_load()).cast("int").alias("q"))
        d = d.df.join(p, "key").join(q, "key")
        part = lambda of: F.pmod(F.xxhash64("c"), F.greatest(of, F.lit(1))).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.greatest(F.col(of), F.lit(1)) - 1))
        sides = [("other", part("q").alias("i"), each("p").alias("j"), True), ("true", each("q").alias("i"), part("p").alias("j"), False)]
        one, two = (d.where(who).select("key", i, j, "c", "lab", F.array("key").alias("keys"), F.lit(left).alias("left"), F.lit(not left).alias("right"), "other", "bytes") for who, i, j, left in sides)
        return one.unionByName(two), cc

    def links(self) -> DataFrame:
        """u, v: v is the smallest class of u's component, for each u that isn't itself the smallest."""
        groups = components(self.first.df.where("c <> l").select(F.col("c").alias("u"), F.col("l").alias("v")))
        label = groups.df.select(F.col("u").alias("c"), F.col("v").alias("g"))
        weight = self.texts.df.groupBy("c").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows"))
        members = Table(weight.join(label, "c", "left").select("c", F.coalesce("g", "c").alias("g"), "bytes", "rows"), "members")
        load = Table(members.df.groupBy("g").agg(_load().alias("load")), "groups")
        keys = self.first.df.groupBy("c").agg(F.collect_list("key").alias("keys"))
        yes, none = F.lit(True), F.lit(-1)
        units = members.df.join(load.df.where("load <= 1"), "g").join(keys, "c")
        units = units.select(F.col("g").alias("key"), none.alias("i"), none.alias("j"), "c", F.col("c").alias("lab"), "keys", yes.alias("left"), yes.alias("right"), yes.alias("other"), "bytes")
        large = load.df.where("load > 1")
        cc = None
        if not large.isEmpty():
            rows = Table(self.first.df.join(members.df.join(large, "g").select("c", "bytes", "rows"), "c"), "large")
            wide, cc = self.wide(rows.df)
            units = units.unionByName(wide)
        units = Table(units, "units")
        n = -(-(units.df.agg(F.sum("bytes")).first()[0] or 1) // BUCKET_BYTES)
        # an id with several texts has no sketch of its own: its pairs go to the full sets
        sketch = self.sketches.df.groupBy("c").agg(F.when(F.count("*") == 1, F.max("sketch")).alias("sketch"))
        bucket = F.pmod(F.xxhash64("key", "i", "j"), F.lit(n))
        percent = self.percent
        found = units.df.drop("bytes").join(sketch, "c").join(self.texts.df, "c").groupBy(bucket.alias("bucket")).applyInArrow(lambda group: _link(group, percent), "u long, v long, wide boolean")
        found = Table(found, "links").df
        if cc is None:
            return found.select("u", "v")
        return components(found.where("wide").select("u", "v").unionByName(cc.df)).df.unionByName(found.where("NOT wide").select("u", "v"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    docs: doc_id and text; other columns are not read. A document's set holds its distinct
    2-word shingles, A-Z lower-cased (one word: that word). Null, empty and blank texts
    have an empty set, are linked with nothing and kept. Rows of one doc_id are one
    document: it links by any of its texts. Rows with a null doc_id link to nothing, have
    a null component and are kept. An empty table gives no rows.
    """
    job = _Job(docs, percent)
    cc = job.links().select(F.col("u").alias("rep"), F.col("v").alias("lab"))
    label = job.classes.df.join(cc, "rep", "left").select("s1", "s2", "n_rows", F.coalesce("lab", "rep").alias("component_id"))
    label = Table(label, "labels").df
    rows = job.keys.df
    # a class that holds a large part of the rows is no hot key of a shuffle
    least = max(HOT_ROWS, -(-rows.count() // BROADCAST_ROWS))
    hot = F.broadcast(label.where(F.col("n_rows") >= least).drop("n_rows"))
    large = rows.join(hot, ["s1", "s2"])
    small = rows.join(hot, ["s1", "s2"], "left_anti").join(label.where(F.col("n_rows") < least).drop("n_rows"), ["s1", "s2"], "left")
    d = large.unionByName(small)
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    d = d.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return d.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs' rows without those that are not their component's smallest doc_id; rows with a null doc_id stay."""
    return without_ids(docs, near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id"))
