from collections import Counter

from loomgraph.llm.common import scratch_path
from loomgraph.llm.q_tokens import tokenizer_path
from loomgraph.llm.toxicity import learn, score_table

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_sql import odd_tables
from tests.llm.test_tokens import brute as token_rows


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    model = learn(docs, labels)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        ids = Counter(r.doc_id for r in after.collect())
        if name == "toxicity":
            assert set(ids) == {r.doc_id for r in score_table(docs, model).where("predicted = 0").collect()}
        elif name == "near_dedup":
            assert set(ids) == {r[0] for r in groups(before) if r[3]}
        elif name == "decontaminate":
            assert set(ids) == {d for d, _ in before} - {r[0] for r in leaks(before, items)}
        elif name == "mixing":
            assert set(ids) <= {d for d, _ in before} and max(ids.values()) <= 2
        else:
            assert tokenizer_path() and sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after.collect()) == sorted((d, n, c) for d, _, n, c in token_rows(before))
        if name != "tokens":
            assert after.columns == columns and after.count() > 0
        docs = after
        seen.append(name)
    assert seen == ["toxicity", "near_dedup", "decontaminate", "mixing", "tokens"]
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_odd_and_empty_input(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows and columns with the operators' own names, through every stage; then no rows at all."""
    folder = str(tmp_path_factory.mktemp("odd"))
    odd_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id > 150 OR doc_id IS NULL")
    docs = docs.unionByName(spark.createDataFrame([(None, "no id", None, None, 5), (None, None, None, None, 0)], docs.schema))
    for c in ("kept", "n_shingles", "rate", "copies", "size", "row", "_gone", "score", "held_out", "k", "l", "_t", "_th", "h", "part"):
        docs = docs.withColumn(c, docs.n_chars)
    words = lambda t: len((t or "").split())
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = scratch_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        out = spark.read.parquet(path)
        after = out.collect()
        if name == "tokens":
            assert len(after) == len(before) and sum(r.n_tokens == 1 for r in after) == sum(not r.text for r in before)
            break
        assert out.columns == docs.columns and after
        assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        # texts without words are nobody's copy and hold nothing
        assert sum(not words(r.text) for r in after) == sum(not words(r.text) for r in before)
        if name == "near_dedup":
            assert sum(r.doc_id == 1000 for r in after) == sum(r.doc_id == 1000 for r in before) > 1
        if name == "decontaminate":
            assert 3003 in {r.doc_id for r in before} and 3003 not in {r.doc_id for r in after}
        docs = out
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
