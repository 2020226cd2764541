"""Token ids on disk: one id array per shard, document boundaries in Elias-Fano form.

A shard is one file:

    magic "LGEF1" + 3 zero bytes
    int64 x 6: documents, tokens, null ids, bytes of id codes, least doc_id, bytes of a token
    Elias-Fano of the cumulated lengths (documents + 1 values, first 0), with its select structure
    Elias-Fano of the sorted doc_ids less the least one
    the token ids, flat, as little-endian uint16 or uint32

An Elias-Fano block of n non-decreasing values below u keeps, for each value, its
low l = floor(log2(u / n)) bits packed, and its high part in unary in a bitmap of
n + (u >> l) bits: about 2 + log2(u / n) bits a value. select(i), the place of the
i-th one in the bitmap, gives value i. Its structure is stored with the block: the
place of one 1 in 256 (a quarter of a bit a value); from there population counts of
bytes find the rest. Reading selects where a run of documents begins and goes on from
there, a bounded number of documents at a time, so no table with 64 bits a document
exists, on disk or in memory.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, release, scratch_path

MAGIC = b"LGEF1\0\0\0"
SAMPLE = 256
#: Bytes of text that are encoded at a time.
SLICE = 3_000_000
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Other white space: texts with it are encoded whole, as a cut beside it could change a piece.
_WIDE_BLANK = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True


class EliasFano:
    """n non-decreasing integers from 0 up, in near-minimal space, with random access."""

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.l, self.low, self.high = n, l, low, high
        #: bit place of the ones 0, SAMPLE, 2 * SAMPLE, ...
        self.places = places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int64))
        l = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if l:
            bits = (v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros(-(-(int(ones[-1]) + 1) // 8) * 8, np.uint8)
        high[ones] = 1
        return cls(n, l, low, np.packbits(high, bitorder="little"), ones[::SAMPLE])

    def _ones(self, i: int, n: int) -> np.ndarray:
        """Places of the ones i to i + n - 1: from the sampled one before, over as many bytes as hold them."""
        place, skip = int(self.places[i // SAMPLE]), i % SAMPLE
        first, found, at = place // 8, [], place // 8
        need, lead = skip + n, place % 8
        have = 0
        while have < need:
            block = np.unpackbits(self.high[at : at + max(64, (need - have) // 2)], bitorder="little")
            if at == first:
                block[:lead] = 0
            ones = np.flatnonzero(block)
            found.append(ones + at * 8)
            have += len(ones)
            at += len(block) // 8
        return np.concatenate(found)[skip:need]

    def select(self, i: int) -> int:
        """Place of the i-th set bit (from 0) of the high bitmap."""
        place, left = int(self.places[i // SAMPLE]), i % SAMPLE
        at, byte = place // 8, int(self.high[place // 8]) >> place % 8 << place % 8
        while (n := byte.bit_count()) <= left:
            left -= n
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        return at * 8 + (byte & -byte).bit_length() - 1

    def _low(self, i: int, n: int) -> np.ndarray:
        if not self.l:
            return np.zeros(n, np.int64)
        at = i * self.l
        bits = np.unpackbits(self.low[at // 8 : (at + n * self.l + 7) // 8], bitorder="little")[at % 8 : at % 8 + n * self.l]
        return (bits.reshape(n, self.l).astype(np.int64) << np.arange(self.l)).sum(axis=1)

    def __getitem__(self, i: int) -> int:
        return ((self.select(i) - i) << self.l) | int(self._low(i, 1)[0])

    def run(self, i: int, n: int) -> np.ndarray:
        """Values i to i + n - 1."""
        return ((self._ones(i, n) - np.arange(i, i + n)) << self.l) | self._low(i, n)

    def dump(self) -> bytes:
        head = struct.pack("<4q", self.n, self.l, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.places.astype("<i8").tobytes()

    @classmethod
    def load(cls, raw) -> EliasFano:
        n, l, a, b = struct.unpack("<4q", raw.read(32))
        low, high = np.frombuffer(raw.read(a), np.uint8), np.frombuffer(raw.read(b), np.uint8)
        return cls(n, l, low, high, np.frombuffer(raw.read(8 * -(-n // SAMPLE)), "<i8"))


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _uncut(tokenizer) -> str:
    """Pattern of texts that are encoded whole: with other white space, or an added token that a cut could change.

    An added token is found wherever its string stands in a text, before the text is
    split. Cuts don't matter to those that hold no cut's place and look at nothing beside them.
    """
    found = [_WIDE_BLANK]
    for t in tokenizer.get_added_tokens_decoder().values():
        if t.single_word or t.lstrip or t.rstrip or re.search(r"[\x20\x09-\x0D]|[A-Za-z][.,]", t.content):
            found.append(re.escape(t.content))
    return "|".join(found)


class SegmentCoder:
    """A tokenizer with the ids of segments seen before, up to a number of segments kept in Arrow arrays."""

    CHUNK = 8192

    def __init__(self, tokenizer, keep: int = 600_000):
        self.tokenizer, self.keep, self.uncut = tokenizer, keep, _uncut(tokenizer)
        self._forget()

    def _forget(self):
        self.known = pa.array([], pa.large_string())
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, first, length) of distinct segments."""
        at = pc.index_in(segments, value_set=self.known)
        new = segments.filter(pc.is_null(at))
        if len(new):
            flat, n = [], []
            for i in range(0, len(new), self.CHUNK):  # the library's results are large; only a chunk of them exists at a time
                found = [e.ids for e in self.tokenizer.encode_batch_fast(new.slice(i, self.CHUNK).to_pylist(), add_special_tokens=False)]
                n.append(np.fromiter(map(len, found), np.int64, len(found)))
                flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(n[-1].sum())))
            self.known = pa.concat_arrays([self.known, new])
            self.flat = np.concatenate([self.flat, *flat])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(n))])
            at = pc.index_in(segments, value_set=self.known)
        k = at.to_numpy(zero_copy_only=False).astype(np.int64)
        out = self.flat, self.bounds[k], self.bounds[k + 1] - self.bounds[k]
        if len(self.known) > self.keep:
            self._forget()
        return out


_coders: dict[str, SegmentCoder] = {}


def coder(path: str) -> SegmentCoder:
    """One for each Python worker, which serves many tasks. A task has a core: the library's threads, as many as the machine's cores in each worker, are off."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _coders[path] = SegmentCoder(load_tokenizer(path))
    return _coders[path]


def encode_texts(segments: SegmentCoder, texts: pa.Array, slice_bytes: int = SLICE):
    """Yields (ids of all the slice's texts, their lengths) for slices of a string array; null counts as empty.

    Texts are cut before each run of ASCII blanks, and between an ASCII letter and a stop
    or comma: there the byte-level pattern always begins a new piece. Each different
    segment of a slice is encoded at most once.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    cum = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + slice_bytes, side="right")) - 1)
        yield _encode_slice(segments, pa.concat_arrays([texts.slice(at, to - at)]))
        at = to


def _encode_slice(coder_: SegmentCoder, texts: pa.Array):
    n = len(texts)
    wide = pc.match_substring_regex(texts, coder_.uncut).to_numpy(zero_copy_only=False)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: off[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    blank = _BLANK[data]
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    for i in np.flatnonzero(wide):
        begins[off[i] : off[i + 1]] = False
    begins[: off[0]] = False
    full = np.flatnonzero(off[1:] > off[:-1])
    begins[off[full]] = True
    cuts = np.append(np.flatnonzero(begins), off[-1]).astype(np.int64)
    segments = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), texts.buffers()[2])
    coded = pc.dictionary_encode(segments)
    flat, first, lengths = coder_.ids(coded.dictionary)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    per_segment = lengths[codes]
    ends = np.cumsum(per_segment)
    ids = flat[np.repeat(first[codes] - (ends - per_segment), per_segment) + np.arange(int(ends[-1]) if len(ends) else 0)]
    upto = np.concatenate([[0], ends])[np.searchsorted(cuts, off)]
    return ids, np.diff(upto)


def _shard_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ef_len = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).dump()
    ef_ids = EliasFano.of((known.astype(object) - least).astype(np.uint64) if len(known) else known).dump()
    head = struct.pack("<6q", len(doc_ids), int(lengths.sum()), len(doc_ids) - len(known), len(ef_ids), least, width)
    return MAGIC + head + ef_len + ef_ids + ids.astype("<u2" if width == 2 else "<u4").tobytes()


class Shard:
    """A shard file in memory: random access by document place."""

    def __init__(self, raw: bytes):
        f = io.BytesIO(raw)
        if f.read(8) != MAGIC:
            raise ValueError("not a token shard")
        self.n_docs, self.n_tokens, self.n_null, _, self.least, self.width = struct.unpack("<6q", f.read(48))
        self.bounds, self._ids = EliasFano.load(f), EliasFano.load(f)
        self.tokens = np.frombuffer(raw, "<u2" if self.width == 2 else "<u4", self.n_tokens, f.tell())

    def doc(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.tokens[self.bounds[i] : self.bounds[i + 1]]

    def runs(self, n: int = 4096):
        """(doc_ids, bounds) of n documents after n; bounds has one value more. Each run begins with a select."""
        for at in range(0, self.n_docs, n):
            k = min(n, self.n_docs - at)
            null = max(0, min(k, self.n_null - at))
            ids = [None] * null
            if k > null:
                ids += [int(x) + self.least for x in self._ids.run(at + null - self.n_null, k - null).astype(np.uint64)]
            yield ids, self.bounds.run(at, k + 1)


def range_partitions(docs: DataFrame, partition_bytes: int) -> int:
    """spark.sql.shuffle.partitions, or as many as give each about partition_bytes of text where that is more."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // partition_bytes))


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, partition_bytes: int = 256_000_000, shard_bytes: int = 64_000_000) -> DataFrame:
    """Encodes each text, appends end_id, writes shards in ascending doc_id order; returns the manifest (part, k, path, n_docs, n_tokens).

    docs: needs doc_id (bigint) and text; other columns are not read. A null text is
    empty (it gets its end id alone), a null doc_id comes first, equal doc_ids are
    ordered by their texts, repeated rows stay. The string of an added token in a text
    becomes that token, as in the library's own encode. Rows are range-partitioned by
    (doc_id, hash of the text), so no key can make a partition hot, into as many parts as
    the texts' bytes ask for. A task buffers one shard's ids (2 or 4 bytes each); a range
    with more ids than shard_bytes gives several files. A file is written under a name of
    its own attempt and the manifest, one row a file in the order (part, k), names the
    files of the attempt that succeeded; a rerun task leaves at most an unnamed file. An
    empty table gives no file.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    n = range_partitions(docs, partition_bytes)
    parts = d.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.asc("h"))
    parts = parts.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("text")).drop("h")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        segments = coder(tokenizer_path)
        width = 2 if max(segments.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        doc_ids: list = []
        lens: list = []
        pieces: list = []
        held = k = 0

        def flush():
            lengths = np.concatenate(lens)
            name = posixpath.join(root, f"{part:06d}-{k:05d}-{uuid.uuid4().hex[:8]}.lgef")
            with store.open_output_stream(name) as f:
                f.write(_shard_bytes(doc_ids, lengths, np.concatenate(pieces), width))
            row = {"part": [part], "k": [k], "path": [folder.rstrip("/") + "/" + posixpath.basename(name)], "n_docs": [len(doc_ids)], "n_tokens": [int(lengths.sum())]}
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            keys = b.column("doc_id").to_pylist()
            at = 0
            for ids, lengths in encode_texts(segments, b.column("text"), min(SLICE, shard_bytes)):
                out = np.full(len(ids) + len(lengths), end_id, np.uint16 if width == 2 else np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(lengths + 1) - 1] = False
                out[keep] = ids
                doc_ids += keys[at : at + len(lengths)]
                at += len(lengths)
                lens.append(lengths + 1)
                pieces.append(out)
                held += out.nbytes
                if held >= shard_bytes:
                    yield flush()
                    doc_ids, lens, pieces, held, k = [], [], [], 0, k + 1
        if doc_ids:
            yield flush()
        doc_ids, lens, pieces = [], [], []
        release()

    return parts.mapInArrow(run, "part long, k long, path string, n_docs long, n_tokens long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 of all documents of a written manifest, from its files.

    start counts the ids of all documents before, over all files. It is summed in two
    steps, over the parts and within a part, of rows that each stand for tens of MB of
    ids; nothing is collected. A file's documents are read in runs, by select.
    """
    whole = manifest.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.select(F.col("part").alias("_p"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.join(whole, manifest["part"] == whole["_p"]).select("path", (F.col("base") + F.coalesce(inside, F.lit(0))).alias("first"))

    def run(batches):
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as f:
                    s = Shard(f.read())
                for ids, bounds in s.runs():
                    crc = [zlib.crc32(s.tokens[a:z].astype("<u4")) for a, z in zip(bounds[:-1], bounds[1:])]
                    columns = [pa.array(ids, pa.int64()), pa.array(bounds[:-1] + first), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes docs' tokens to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_tokens(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer_path, end_id)
    return read_tokens(Table(manifest, "manifest").df)  # the writing runs once
