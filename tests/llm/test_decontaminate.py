import re

import pytest

from loomgraph.llm import decontaminate
from loomgraph.llm.decontaminate import clean, contained


def brute(docs, items, k=4, threshold=0.5):
    norm = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7F]+", (t or "").lower())
    out = set()
    for i, t in items:
        w = norm(t)
        m = min(k, len(w))
        if not m:
            continue
        own = {tuple(w[x : x + m]) for x in range(len(w) - m + 1)}
        for d, text in docs:
            v = norm(text)
            n = len(own & {tuple(v[x : x + m]) for x in range(len(v) - m + 1)})
            if n >= threshold * len(own):
                out.add((d, i, n, len(own)))
    return out


ITEM = "Ten old ships sailed west at dawn, and none came back before the winter storms."
DOCS = [(1, "xx " * 3000 + ITEM.upper() + " yy" * 3000), (2, None), (3, ""), (4, ITEM.replace("west", "east")), (5, "ten old ships"), (6, "Short one here."), (6, "Short one here."), (None, ITEM)]
ITEMS = [(10, ITEM), (11, None), (12, " ,"), (13, "short ONE"), (None, "yy yy yy yy yy")]


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_brute_force_and_odd_rows(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id long, text string, n_item int, h int")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    got = contained(docs, items).collect()
    assert len(got) == len(set(got))
    assert {tuple(r)[:4] for r in got} == brute(DOCS, ITEMS)
    assert {r.doc_id for r in clean(docs, items).collect()} == {2, 3, 5}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contained(docs.limit(0), items).count() == 0
    assert contained(docs, items.limit(0)).count() == 0
    assert clean(docs, items.limit(0)).count() == len(DOCS)


def test_sample_of_the_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r)[:4] for r in got.collect()} == brute(docs, items)
