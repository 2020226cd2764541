import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import near_dedup
from loomgraph.llm import shingles as shingles_module
from loomgraph.llm.near_dedup import BITS, K, min_values, near_duplicates, odd_sketches, one_of_each
from loomgraph.llm.shingles import pair_sets, word_hashes


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w)} if len(w) == 1 else {tuple(w[i : i + 2]) for i in range(len(w) - 1)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    inv = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inv[x].append(d)
    shared = defaultdict(int)
    for ds in inv.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_words_and_sets():
    texts = ["a b\tA  b", "", "Été été\x0b.", " x", "x", "a", "ab"]
    h, b = word_hashes(pa.array(texts, pa.large_string()))
    assert np.diff(b).tolist() == [4, 0, 3, 1, 1, 1, 1]
    assert h[0] == h[2] and h[1] == h[3] and h[4] != h[5] and h[7] == h[8]
    assert [len(s) for s in pair_sets(pa.array(texts, pa.large_string()))] == [len(shingles(t)) for t in texts]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    for share in (1.0, 0.9, 0.8):
        est = []
        for _ in range(20):
            other = np.concatenate([base[: int(2000 * share)], rng.integers(0, 1 << 63, 2000 - int(2000 * share)).astype(np.uint64)])
            s = odd_sketches(np.stack([min_values(base), min_values(other)]))
            p = int(np.unpackbits((s[0] ^ s[1]).view(np.uint8)).sum())
            est.append(1 + BITS / 2 * np.log(1 - 2 * p / BITS) / (2 * K))
        assert abs(np.mean(est) - share / (2 - share)) < 0.03


def test_brute_force_on_drifting_copies(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, n = [], 0
    for size in (1, 2, 5, 12, 40, 120):
        for _ in range(6):
            text = [word() for _ in range(size)]
            for _ in range(r.choice([1, 2, 15])):
                rows.append((n, " ".join(text)))
                n += 1
                text = [word() if r.random() < r.choice([0, 0.03, 0.08]) else w for w in text]
    rows += [(n + i, t) for i, t in enumerate(["", None, " \n", "Same", "same", "same same", "x y"])]
    r.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set(map(tuple, got)) == brute(rows) and len(got) == len(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table_equals_brute_force(spark, sf):
    """Every link of an inverted index, and no other: a recall of 1."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert set(map(tuple, near_duplicates(docs).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 0), (2, "A b c d e f", 0), (3, None, 0), (4, "z " * 30000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 5, 1, True), (1, 5, 1, True), (None, 5, None, True), (2, 5, 1, False), (3, 0, 3, True), (4, 1, 4, True)], key=str)
    assert one_of_each(docs).count() == 5
    assert near_duplicates(docs.limit(0)).count() == 0


def test_words_across_blocks(monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choice("abc d\n") for _ in range(r.randrange(60))) for _ in range(40)] + ["x" * 50, "x" * 50 + "y", "", " "]
    whole = word_hashes(pa.array(texts, pa.large_string()))
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(shingles_module, "_BLOCK", block)
        h, b = word_hashes(pa.array(texts, pa.large_string()))
        assert h.tolist() == whole[0].tolist() and b.tolist() == whole[1].tolist()


def test_hot_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 3)
    rows = [(i, "one two three four") for i in range(9)] + [(20, "x y"), (21, "x y"), (22, None), (None, "one two three four")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(i, 0) for i in range(9)] + [(20, 20), (21, 20), (22, 22)]
    assert len(got) == len(rows)


def _boilerplate(seed, n):
    """Short texts of a few shared lines, with a word changed here and there: one large group, in which few are linked."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    lines = [" ".join(word() for _ in range(9)) for _ in range(3)]
    rows = []
    for i in range(n):
        own = [" ".join(word() for _ in range(r.choice([0, 2, 4, 9]))) for _ in range(r.choice([0, 1, 1]))]
        text = " \n".join(r.sample(lines, r.choice([2, 3])) + own).split(" ")
        rows.append((i, " ".join(word() if r.random() < 0.02 else w for w in text)))
    return rows


@pytest.mark.parametrize("limits", [(200, 5, 300), (2000, 8192, 2000), (4_000_000, 30, 2_000_000)])
def test_large_groups_in_parts(spark, monkeypatch, limits):
    """Groups beyond a task's bounds are compared band by band in blocks, and lose no link."""
    for name, value in zip(("UNIT_BYTES", "UNIT_ROWS", "BUCKET_BYTES"), limits):
        monkeypatch.setattr(near_dedup, name, value)
    rows = _boilerplate(9, 160) + [(200, None), (201, ""), (None, "x y")]
    got = set(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got - {(None, 1, None, True)} == brute([r for r in rows if r[0] is not None])


def test_texts_are_read_once_a_group(spark, monkeypatch):
    """What is sent to be compared grows as the group, not as its pairs."""
    sent = []

    class Kept(near_dedup.Table):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name in ("units", "pairs"):
                sent.append(self.df.count())

    monkeypatch.setattr(near_dedup, "Table", Kept)
    docs = spark.createDataFrame(_boilerplate(4, 300), "doc_id long, text string")
    near_duplicates(docs)
    assert sum(sent) <= 300


def test_an_id_with_several_texts_links_by_any(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    a, b = ([word() for _ in range(60)] for _ in range(2))
    other = lambda t: " ".join([*t[:-1], "zz"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, other(a)), (3, other(b)), (4, " ".join(word() for _ in range(60)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
