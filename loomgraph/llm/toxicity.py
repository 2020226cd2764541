"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Strings are compared by their common subsequences of four letters, each weighed by
DECAY ** length of the stretch it spans, with up to MAX_GAP - 1 letters skipped between
two of them; characters that are no letters never match and only widen a stretch. So
"l.o.s.e.r", "loxser" and "losers" stay near "loser". The kernel is divided by what the
two strings would have if all their subsequences differed. Words begin and end with a
mark that matches like a letter.

Learning: whole labelled documents give the strings. Words that stand in many different
contexts in toxic texts and hardly in others are positive; words of other texts are
negative, and those that a first machine scores highest are added for the next. The
strings are mapped to the span of landmark strings (Nystroem), and a squared-hinge
linear machine is trained there. As its score is linear in the kernel with the
landmarks, it folds into one weight for each four letters: scoring a word costs
MAX_GAP ** 3 look-ups a letter. A document's probability is a logistic function of its
words' highest score and of how many words score above zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release
from .shingles import slices

A = 64
MARK = 63
MAX_GAP = 2
#: Weights are kept under hashed indices of the four letters.
SIZE = 1 << 20
DECAY = 0.6
_CODES = np.zeros(1 << 16, np.int32)
for _c in range(1 << 16):
    if chr(_c).isalpha():
        _CODES[_c] = _c - 96 if 97 <= _c <= 122 else 27 + (_c * 40503 >> 4) % 36


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words with marks around each, bounds); 0: no letter."""
    raw = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    n = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(n + 2)])
    codes = np.full(int(bounds[-1]), MARK, np.int32)
    inside = np.ones(len(codes), bool)
    inside[bounds[:-1]] = False
    inside[bounds[1:] - 1] = False
    codes[inside] = np.where(raw < 1 << 16, _CODES[np.minimum(raw, (1 << 16) - 1)], 27 + raw % 36)
    return codes, bounds


def _runs(codes: np.ndarray, bounds: np.ndarray):
    """Yields (place of the first letter, hashed index of the four letters, weight) for each choice of gaps."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(codes))
    for gaps in product(range(1, MAX_GAP + 1), repeat=3):
        span = sum(gaps)
        i = at[: max(0, len(codes) - span)]
        i = i[(i + span < end[i]) & (codes[i] > 0)]
        key, ok, j = codes[i].astype(np.int64), np.ones(len(i), bool), i
        for g in gaps:
            j = j + g
            ok &= codes[j] > 0
            key = key * A + codes[j]
        yield i[ok], (key[ok] * 0x9E3779B1 >> 11) % SIZE, DECAY ** (span + 1)


def score_words(words: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's score of each word."""
    if not len(words):
        return np.zeros(0)
    codes, bounds = _letters(words)
    total, norm = np.zeros(len(codes)), np.zeros(len(codes))
    for i, k, w in _runs(codes, bounds):
        total[i] += weights[k] * w
        norm[i] += w * w
    s, n = (np.add.reduceat(x, bounds[:-1]) for x in (total, norm))
    return np.where(n > 0, s / np.sqrt(np.maximum(n, 1e-12)), 0.0) + bias


def _sparse(words: pa.Array) -> list[dict[int, float]]:
    codes, bounds = _letters(words)
    out: list[dict[int, float]] = [{} for _ in range(len(words))]
    owner = np.repeat(np.arange(len(words)), np.diff(bounds))
    norm = np.zeros(len(words))
    for i, k, w in _runs(codes, bounds):
        np.add.at(norm, owner[i], w * w)
        for o, key in zip(owner[i].tolist(), k.tolist()):
            out[o][key] = out[o].get(key, 0.0) + w
    return [{k: v / np.sqrt(m) for k, v in d.items()} for d, m in zip(out, norm)]


def _gram(a: list[dict], b: list[dict]) -> np.ndarray:
    """Kernel between sparse strings, by an inverted list of b."""
    post: dict[int, list] = {}
    for j, d in enumerate(b):
        for k, v in d.items():
            post.setdefault(k, []).append((j, v))
    index = {k: (np.array([j for j, _ in p]), np.array([v for _, v in p])) for k, p in post.items()}
    out = np.zeros((len(a), len(b)))
    for i, d in enumerate(a):
        for k, v in d.items():
            if k in index:
                j, w = index[k]
                out[i, j] += v * w
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 3.0, steps: int = 60) -> np.ndarray:
    """Squared-hinge linear machine (last weight: bias) by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    reg = np.eye(x1.shape[1])
    reg[-1, -1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        on = y * (x1 @ w) < 1
        xa, wa = x1[on], weight[on]
        new = np.linalg.solve(reg + 2 * c * (xa * wa[:, None]).T @ xa, 2 * c * xa.T @ (wa * y[on]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = w + 0.7 * (new - w)
    return w


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + 0.05 * np.eye(x1.shape[1])
        w = w - np.linalg.solve(h, x1.T @ (p - y) + 0.05 * w)
    return w


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each token, text of each token); a run of four or more one-letter words is one more token."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
    keep = size > 0
    flat, parent, size = flat.filter(pa.array(keep)), parent[keep], size[keep]
    one = np.concatenate([[False], size == 1, [False]])
    edge = np.flatnonzero(one[1:] != one[:-1])
    runs, where = [], []
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= 4:
            for p in np.unique(parent[a:b]):
                own = a + np.flatnonzero(parent[a:b] == p)
                if len(own) >= 4:
                    runs.append("".join(flat.slice(own[0], len(own)).to_pylist()))
                    where.append(p)
    coded = pc.dictionary_encode(pa.concat_arrays([flat, pa.array(runs, flat.type)]))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([parent, np.array(where, parent.dtype)]).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    doc: np.ndarray

    def features(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), 2))
        out[:, 0] = -2.0
        words, code, parent = _tokens(texts)
        if len(code):
            s = score_words(words, self.weights, self.bias)[code]
            np.maximum.at(out[:, 0], parent, np.clip(s, -2, 2))
            out[:, 1] = np.log1p(np.bincount(parent, s > 0, len(texts)))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text."""
        out = np.zeros(len(texts))
        for at, part in slices(texts, 2_000_000):
            x = self.features(part)
            z = x @ self.doc[:-1] + self.doc[-1]
            out[at : at + len(part)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _telling(plain: np.ndarray, toxic: np.ndarray, false: float = 0.01) -> np.ndarray:
    """Words of toxic texts that plain ones hardly have.

    If a word with t contexts stood in either kind of text by chance, all t would be toxic
    with probability share ** t. A count t is taken if the words expected so are at most a
    few of those found, and so for all higher counts.
    """
    share = min(0.9, 1.25 * toxic.sum() / max(1, plain.sum() + toxic.sum()))
    total = plain + toxic
    top = int(toxic.max(initial=0))
    found = np.bincount(toxic[plain == 0], minlength=top + 1)
    chance = np.bincount(np.minimum(total, top), minlength=top + 1) * share ** np.arange(top + 1)
    least = top + 1
    while least > 2 and (chance[least - 1] <= false * found[least - 1] or not found[least - 1]):
        least -= 1
    mostly = (toxic >= 20) & (plain * 30 <= toxic)
    return np.flatnonzero(((plain == 0) & (toxic >= least)) | mostly)


def fit(texts: list[str], toxic: list[int], landmarks: int = 320, positives: int = 600, negatives: int = 2000, seed: int = 7) -> Model:
    """A model of labelled texts: two in three, drawn by seed, give the strings, the others the documents' logistic function.

    Without toxic texts, or without words of their own in them, every text scores the share of toxic ones.
    """
    rng = np.random.default_rng(seed)
    y = np.array(toxic, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    none = Model(np.zeros(SIZE, np.float32), -1.0, np.array([0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    mine = rng.random(len(y)) < 2 / 3
    if not y[mine].any() or y[mine].all():
        return none
    arr = pc.fill_null(pa.array(texts, pa.large_string()), "")
    words, code, parent = _tokens(arr.filter(pa.array(mine)))
    label = y[mine][parent]
    before, after = np.roll(code, 1), np.roll(code, -1)
    context = (before * 1_000_003 + code) * 1_000_003 + after
    _, first = np.unique(np.stack([context, label]), axis=1, return_index=True)
    seen = [np.bincount(code[first][label[first] == k], minlength=len(words)) for k in (0, 1)]
    pos = _telling(seen[0], seen[1])
    pos = pos[pc.utf8_length(words).to_numpy(zero_copy_only=False)[pos] >= 2]
    if not len(pos):
        return none
    pos = pos[np.argsort(-seen[1][pos], kind="stable")][:positives]
    other = np.flatnonzero(seen[0] > 0)
    often = other[np.argsort(-seen[0][other], kind="stable")][:500]
    neg = np.unique(np.concatenate([often, rng.choice(other, min(negatives, len(other)), replace=False)]))
    weights, bias = none.weights, 0.0
    hard = rng.random(len(neg))
    for _ in range(3):
        rows = np.concatenate([pos, neg])
        sign = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        heavy = np.concatenate([np.sqrt(seen[1][pos]), np.log1p(seen[0][neg])])
        heavy[: len(pos)] *= heavy[len(pos) :].sum() / heavy[: len(pos)].sum()
        sparse = _sparse(words.take(pa.array(rows)))
        mark = np.concatenate([np.arange(min(len(pos), landmarks // 2)), len(pos) + np.argsort(hard, kind="stable")[: landmarks // 2]])
        z = [sparse[i] for i in mark]
        value, vector = np.linalg.eigh(_gram(z, z))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        w = _svm(_gram(sparse, z) @ root, sign, heavy)
        beta, bias = root @ w[:-1], float(w[-1])
        weights = np.zeros(SIZE, np.float32)
        for b, d in zip(beta, z):
            weights[list(d)] += np.fromiter(d.values(), float, len(d)) * b
        s = score_words(words.take(pa.array(other)), weights, bias)
        neg = np.unique(np.concatenate([neg, other[np.argsort(-s, kind="stable")][:400]]))
        # half of the next negative landmarks are the words nearest to the wrong side, half any
        hard = np.where(rng.random(len(neg)) < 0.5, -s[np.searchsorted(other, neg)], -5 + 10 * rng.random(len(neg)))
    model = Model(weights, bias, none.doc)
    rest = ~mine if y[~mine].any() and not y[~mine].all() else np.ones(len(y), bool)
    x = np.vstack([model.features(p) for _, p in slices(arr.filter(pa.array(rest)))])
    model.doc = _logistic(x, y[rest])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows of the fold that learning never sees; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_chars: int = 100_000) -> Model:
    """Fits on at most max_docs documents of either label outside the held-out fold.

    The documents are those whose ids' hashes come first; texts above max_chars are not
    learnt from, and of several texts of one id only the first in order, so that the sample
    is bounded by rows. A doc_id labelled twice is toxic if any label says so; null labels
    don't count. This bounded sample of labelled rows is fitted in one task.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("k"))).groupBy("k").agg(F.max("t").alias("t"))
    pick = [told.where(F.col("t") == v).orderBy(F.xxhash64("k"), "k").limit(max_docs) for v in (0, 1)]
    few = pick[0].unionByName(pick[1])
    d = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars)
    sample = d.join(F.broadcast(few), "k").groupBy("k", "t").agg(F.min("text").alias("text"))

    def run(batches):
        rows = sorted((((k * 2654435761) % (1 << 32), k, x, t) for b in batches for k, x, t in zip(*(b.column(c).to_pylist() for c in ("k", "text", "t")))))
        m = fit([r[2] for r in rows], [r[3] for r in rows])
        on = np.flatnonzero(m.weights)
        yield pa.RecordBatch.from_arrays([pa.array([on.tolist()]), pa.array([m.weights[on].astype(float).tolist()]), pa.array([m.bias]), pa.array([m.doc.tolist()])], ["on", "weights", "bias", "doc"])

    # one task, as the sample is bounded; the driver only gets the weights
    r = sample.repartition(1).mapInArrow(run, "on array<long>, weights array<double>, bias double, doc array<double>").first()
    if r is None:
        return fit([], [])
    weights = np.zeros(SIZE, np.float32)
    weights[r.on] = r.weights
    return Model(weights, r.bias, np.array(r.doc))


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; only texts are looked at. Null and empty texts get the score of no word."""

    def run(batches):
        for b in batches:
            s = model.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        release()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs' rows whose text scores under 0.5, with all their columns; nothing is shuffled."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(b.column("text")) < 0.5))
        release()

    return docs.mapInArrow(run, docs.schema)
