"""Hashed words and shingle sets of whole texts, on Arrow buffers with numpy."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = np.uint64(pow(_P, -1, 1 << 64))
_P = np.uint64(_P)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = 4_000_000):
    """Pieces of a string array of about limit bytes; null is empty. A longer text is a piece of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    cum = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + limit, side="right")) - 1)
        yield at, pa.concat_arrays([texts.slice(at, to - at)])
        at = to


_BLOCK = 1 << 20


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for p in (_P, _P_INV):
        x = np.full(_BLOCK, p, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x, out=x))
    return tuple(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, A-Z lower-cased; first word of each text and the end) of a large_string array.

    The bytes are gone through in blocks of a fixed size, so that what is held besides the
    hashes doesn't grow with a text; a word across blocks is put together from its parts.
    """
    texts = pc.ascii_lower(texts)
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    if off[-1] == off[0]:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    power, inverse = _powers()
    raws, sizes, firsts, open_ = [], [], [], False
    for at in range(0, len(data), _BLOCK):
        d = data[at : at + _BLOCK]
        word = ~_BLANK[d]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cut = off[np.searchsorted(off, at) : np.searchsorted(off, at + len(d))] - at
        begins[cut] = word[cut]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | begins[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        # a word's polynomial modulo 2**64: difference of prefix sums over the power at its begin
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum((d.astype(np.uint64) + np.uint64(1)) * power[: len(d)], out=sums[1:])
        raw, size = (sums[last] - sums[first]) * inverse[first], (last - first).astype(np.uint64)
        if open_ and word[0] and not (len(cut) and cut[0] == 0):
            shift = np.uint64(pow(int(_P), int(sizes[-1][-1]), 1 << 64))
            raws[-1][-1:] += shift * raw[:1]
            sizes[-1][-1:] += size[:1]
            raw, size, first = raw[1:], size[1:], first[1:]
        open_ = bool(word[-1])
        if len(raw):
            raws.append(raw)
            sizes.append(size)
            firsts.append(first + at)
    if not raws:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    return mix(np.concatenate(raws) + np.concatenate(sizes)), np.searchsorted(np.concatenate(firsts), off)


def pair_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 2-word shingles, or of the only word; bounds) of each text."""
    n = np.diff(bounds)
    size = np.where(n >= 2, n - 1, n)
    out_bounds = np.concatenate([[0], np.cumsum(size)])
    if not len(h):
        return h, out_bounds
    pair = np.empty_like(h)
    pair[:-1] = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    keep = np.ones(len(h), bool)
    last = bounds[1:][n >= 1] - 1
    keep[last] = False
    lone = bounds[:-1][n == 1]
    pair[lone] = mix(h[lone] ^ np.uint64(0xA5A5A5A55A5A5A5A))
    keep[lone] = True
    return pair[keep], out_bounds


def pair_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    s, b = pair_hashes(*word_hashes(texts))
    return [np.unique(s[x:y]) for x, y in zip(b[:-1], b[1:])]
