"""The operators' SQL in DuckDB against their queries: over the smallest tables, and over odd rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from loomgraph.llm.queries import ORACLE_SQL, QUERIES

MENU = "home contact terms of use and so on until the end"
LICENSE = "Licensed under the Apache License, Version 2.0."


def odd_tables(spark, folder):
    """Nulls, empty and long texts, repeated rows, one text under two sources, hosts below suffixes of several labels."""
    item = "Ten old ships sailed west at dawn, and none came back before the winter storms."
    docs = [(i, f"own words of document {'q ' * (i % 9)}{i}\n{MENU}\nRead more\n{LICENSE if i % 7 == 0 else 'x'}", "en", f"s{i % 3}" if i % 5 else None) for i in range(1, 200)]
    docs += [(1000, MENU, "en", "s1"), (1000, MENU, "en", "s9"), (1000, MENU, "en", "s9")]
    docs += [(2000, "the only line that one document repeats in so many rows", "en", "s8")] * 120
    docs += [(3000, None, None, None), (3001, "", "en", "s1"), (3002, "\n \n", "en", None), (3003, "w " * 2000 + item, "en", "s2"), (3003, "w " * 2000 + item, "en", "s2")]
    docs = [(d, t, l, s, len(t or "")) for d, t, l, s in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    items = [(1, item), (2, None), (3, "ships sailed"), (4, "..")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    hosts = ["a.co.uk", "b.co.uk", "x.b.co.uk", "a.com.cn", "z.gov.uk", "u.github.io", "v.github.io", "co.uk", "com", "q.net", "w.q.net", "EXAMPLE.org", "de.com"]
    pages = [(i, f"https://{h}/{p}{i}?q", "<p>") for i, (h, p) in enumerate([(h, p) for h in hosts for p in ("", "de/", "fr/", "es/", "en/1", "en/") for _ in range(3)], 1)]
    pages += [(900, None, None), (901, "", ""), (902, "no scheme/1", ""), (902, "no scheme/1", ""), (903, "http://" + "y" * 50_000 + ".com/1", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    labels = [(i, int(i % 4 > 0), int(i % 11 == 0)) for i in range(1, 240)] + [(5, 0, None), (6, None, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    odd_tables(spark, folder)
    return folder


def plain(v):
    return round(v, 5) if isinstance(v, float) and math.isfinite(v) else v


def both(spark, folder, name):
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if Path(path).is_dir() else path}')")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    return got, Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_small_tables(spark, sf_dir, name):
    got, want = both(spark, sf_dir, name)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_tables(spark, odd, name):
    got, want = both(spark, odd, name)
    assert got == want and got
