"""Pairs of word sets with a Jaccard similarity of at least some percent, exactly, in Arrow.

Sets of a file are cut by size into blocks of about BLOCK words, and each pair of blocks
whose sizes are near enough is one task's. A task orders words by their rarity: a set of n
shares one of its first n - ceil(n * percent / 100) + 1 words with any set alike enough. What
these words pair is sifted by sizes, by the words' places and by parities of hashed words,
which differ in no more bits than the sets do in words, and then counted on the whole sets.
Nothing but the pairs found leaves the task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words in a block, and pairs looked at at a time.
BLOCK, SLICE = 4_000_000, 400_000
#: Bits of parities, and of those of sets above LARGE words.
BITS, LARGE, LARGE_BITS = 1024, 400, 8192


def _spans(counts, most):
    """Slices of consecutive items with counts of about `most` in all, one item at least."""
    import numpy as np

    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _expand(first, counts):
    """first[k], first[k] + 1, ... counts[k] of them for each k, with k itself."""
    import numpy as np

    k = np.repeat(np.arange(len(counts)), counts)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)


def _parities(tokens, starts, n, bits):
    import numpy as np

    h = ((tokens.astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % bits
    out, step = np.empty((len(n), bits // 64), np.uint64), max(1, (1 << 21) // bits)
    for a in range(0, len(n), step):
        b = min(len(n), a + step)
        k, at = _expand(starts[a:b], n[a:b])
        odd = np.bincount(k * bits + h[at], minlength=(b - a) * bits) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8).reshape(b - a, bits), axis=1).view(np.uint64)
    return out


def alike(table, percent: int, cross: bool = False):
    """Indexes of rows, shared words and those of either, of all pairs alike enough, if cross of different sides. table: side, w (distinct words between spaces)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    w = pc.split_pattern(table["w"].combine_chunks(), " ")
    n = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.argsort(n, kind="stable")
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    codes = pc.list_flatten(w)
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    often = np.bincount(codes)
    rarest = np.argsort(often, kind="stable")
    rank = np.empty_like(rarest)
    rank[rarest] = np.arange(len(rarest))
    often, words = often[rarest], len(rarest)
    key = np.repeat(place, n) * words + rank[codes]  # sets by size, words by rarity
    key.sort()
    del codes
    n, side = n[by], table["side"].to_numpy()[by]
    starts = np.cumsum(n) - n
    tokens = (key % words).astype(np.int32)
    del key
    own, at = _expand(starts, n - -(-percent * n // 100) + 1)
    some = often[tokens[at]] > 1
    own, at = own[some], at[some]
    o = np.argsort(tokens[at], kind="stable")
    own, at = own[o], at[o]
    left = n[own] - (at - starts[own])  # words from here to the set's end
    bucket = tokens[at].astype(np.int64) * (int(n.max(initial=0)) + 1)
    sized = bucket + n[own]
    partners = np.searchsorted(sized, bucket + np.minimum(n.max(initial=0), n[own] * 100 // percent), "right") - np.arange(len(own)) - 1
    small = _parities(tokens, starts, n, BITS)
    first_large = int(np.searchsorted(n, LARGE, "right"))
    large = _parities(tokens, starts[first_large:], n[first_large:], LARGE_BITS)
    found, held = [], 0
    for s, e in _spans(partners, SLICE):
        k, y = _expand(np.arange(s, e) + 1, partners[s:e])
        x = k + s
        a, b = own[x], own[y]
        both = n[a] + n[b]
        least = -(-percent * both // (100 + percent))
        keep = np.minimum(left[x], left[y]) >= least
        if cross:
            keep &= side[a] != side[b]
        a, b, spare = a[keep], b[keep], (both - 2 * least)[keep]
        keep = np.bitwise_count(small[a] ^ small[b]).sum(axis=1, dtype=np.int64) <= spare
        a, b, spare = a[keep], b[keep], spare[keep]
        big = np.flatnonzero(a >= first_large)  # a is the smaller one
        keep = np.ones(len(a), bool)
        for c in range(0, len(big), SLICE // 8):
            i = big[c : c + SLICE // 8]
            keep[i] = np.bitwise_count(large[a[i] - first_large] ^ large[b[i] - first_large]).sum(axis=1, dtype=np.int64) <= spare[i]
        found.append(np.unique(a[keep] * len(n) + b[keep]))
        held += len(found[-1])
        if held > 4 * SLICE:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0]) // 2
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    a, b = (pairs // len(n), pairs % len(n)) if len(pairs) else (pairs, pairs)
    shared = np.zeros(len(pairs), np.int64)
    for s, e in _spans(n[a] + n[b], 4 * SLICE):
        ka, pa_ = _expand(starts[a[s:e]], n[a[s:e]])
        kb, pb_ = _expand(starts[b[s:e]], n[b[s:e]])
        z = np.concatenate([ka * words + tokens[pa_], kb * words + tokens[pb_]])
        z.sort()
        shared[s:e] = np.bincount(z[1:][z[1:] == z[:-1]] // words, minlength=e - s)
    keep = shared * 100 >= percent * (n[a] + n[b] - shared)
    a, b, shared = a[keep], b[keep], shared[keep]
    return by[a], by[b], shared, n[a] + n[b] - shared


def similar_pairs(sets: DataFrame, percent: int, block: int | None = None) -> DataFrame:
    """file, a, b, n_a, n_b, shared, united of pairs alike enough, a < b. sets: file, w (distinct words between spaces), id (unique in a file), members."""
    sets, size, block = sets.where("file IS NOT NULL"), F.size(F.split("w", " ")), block or BLOCK
    hist = sets.groupBy("file", size.cast("long").alias("n")).agg(F.sum(size).alias("words"))
    start = F.sum("words").over(Window.partitionBy("file").orderBy("n")) - F.col("words")
    hist = hist.withColumn("start", start).select("file", "n", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("words") - 1) / block))).alias("b"))
    blocks = hist.groupBy("file", "b").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # only files of more than a block, one row each
    blocks = blocks.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("b", "lo", "hi"))).alias("blocks")).where(F.size("blocks") > 1)
    d = sets.join(F.broadcast(blocks), "file", "left")
    mine = F.filter("blocks", lambda x: (x["lo"] <= size) & (size <= x["hi"]))
    d = d.withColumn("own", F.get(mine, F.pmod(F.hash("id"), F.greatest(F.size(mine), F.lit(1)))))
    own = F.col("own")
    near = F.filter("blocks", lambda x: (percent * F.greatest(x["lo"], own["lo"]) <= 100 * F.least(x["hi"], own["hi"])))
    both = F.transform(near, lambda x: F.struct(F.least(x["b"], own["b"]).alias("i"), F.greatest(x["b"], own["b"]).alias("j")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    d = d.select("file", "id", "members", "w", F.coalesce("own.b", F.lit(0).cast("long")).alias("b"), F.explode(F.coalesce(both, alone)).alias("p"))
    d = d.select("file", "p.i", "p.j", (F.col("b") != F.col("p.i")).cast("int").alias("side"), "id", "members", "w")

    def run(table):
        import numpy as np
        import pyarrow as pa

        first, second, shared, united = alike(table, percent, table["i"][0] != table["j"][0])
        ids = table["id"].to_numpy()
        swap = ids[first] > ids[second]
        a, b = np.where(swap, second, first), np.where(swap, first, second)
        members = table["members"].to_numpy()
        return pa.table({"file": pa.repeat(table["file"][0], len(a)), "a": ids[a], "b": ids[b], "n_a": members[a], "n_b": members[b], "shared": shared, "united": united})

    return d.groupBy("file", "i", "j").applyInArrow(run, "file string, a long, b long, n_a long, n_b long, shared long, united long")
