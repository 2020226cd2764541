import io
import os
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from loomgraph.llm.q_tokens import op4_token_file, tokenizer_path
from loomgraph.llm.token_file import EliasFano, SegmentCoder, encode_texts, load_tokenizer, read_tokens, token_table, write_tokens
from loomgraph.llm.common import Table, scratch_path


def mixed(parts, n):
    return st.lists(st.sampled_from(parts), max_size=n).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_round_trip(values):
    v = np.sort(np.array(values, np.int64))
    ef = EliasFano.of(v)
    ef = EliasFano.load(io.BytesIO(ef.dump()))
    assert all(ef[i] == v[i] for i in range(len(v)))
    for at in range(0, len(v), 97):
        n = min(300, len(v) - at)
        assert ef.run(at, n).tolist() == v[at : at + n].tolist()


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(EliasFano.of(v).dump()) * 8 / len(v) < 2.5 + np.log2(v[-1] / len(v)) + 1


#: the library's own, with nothing set
TOKENIZER = Tokenizer.from_file(tokenizer_path())
CODER = SegmentCoder(TOKENIZER, keep=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), mixed([*"ab'sé 1\n\t\r\x0b\x85\xa0  .<|>", "<|endoftext|>"], 40)), max_size=6), st.integers(1, 60))
def test_segments_equal_whole_encoding(texts, slice_bytes):
    got = []
    for ids, n in encode_texts(CODER, pa.array(texts, pa.string()), slice_bytes):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []
    assert got == [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]


def brute(rows):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_token_file(spark, sf_dir).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(3, "x " * 5000, "s"), (None, "null id", "s"), (-5, None, None), (3, "", "s"), (3, "", "s"), (9, "<|endoftext|> a", "s")]
    got = sorted(map(tuple, token_table(spark.createDataFrame(rows, "doc_id long, text string, start string"), tokenizer_path()).collect()), key=lambda r: r[1])
    assert [(r[0], r[2]) for r in got][:2] == [(None, 3), (-5, 1)]
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] or 0, r[2], r[3]) for r in brute([r[:2] for r in rows]))
    assert got[-1][1] + got[-1][2] == sum(r[2] for r in got)
    assert token_table(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_added_tokens_in_a_text(spark):
    t = load_tokenizer(tokenizer_path())
    assert t.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    docs = spark.createDataFrame([(1, "<|endoftext|>"), (2, "a.<|endoftext|>,b <|endoftext|>  c")], "doc_id long, text string")
    assert sorted(map(tuple, token_table(docs, tokenizer_path()).collect())) == brute([(1, "<|endoftext|>"), (2, "a.<|endoftext|>,b <|endoftext|>  c")])


@settings(max_examples=80, deadline=None)
@given(st.lists(mixed(["a", " ", ".", "<x. y>", "<w>", "<s>"], 20), max_size=4))
def test_added_tokens_that_cuts_could_change(texts):
    t = Tokenizer.from_file(tokenizer_path())
    t.add_tokens([AddedToken("<x. y>"), AddedToken("<w>", single_word=True), AddedToken("<s>", lstrip=True, rstrip=True)])
    got = []
    for ids, n in encode_texts(SegmentCoder(t), pa.array(texts, pa.string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_many_files_a_part(spark, sf_dir):
    """More files than parts, and more parts than partitions: the order is still that of doc_ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    m = Table(write_tokens(docs, scratch_path(spark, "t"), tokenizer_path(), 2, partition_bytes=50_000, shard_bytes=3000), "manifest").df
    assert m.groupBy("part").count().count() > 4 and m.count() > m.select("part").distinct().count()
    assert sorted(map(tuple, read_tokens(m).collect())) == brute(rows)


def test_a_task_encodes_in_its_own_thread():
    """Each worker has a core; the library would start as many threads as the machine has."""
    run = """
import os, pyarrow as pa
from loomgraph.llm.q_tokens import tokenizer_path
from loomgraph.llm.token_file import coder
c = coder(tokenizer_path())
before = len(os.listdir("/proc/self/task"))
c.ids(pa.array([f"segment {i}" for i in range(20_000)], pa.large_string()))
print(before, len(os.listdir("/proc/self/task")))
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    out = subprocess.run([sys.executable, "-c", run], env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out[0] == out[1]
