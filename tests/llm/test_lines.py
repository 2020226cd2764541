import random

import pytest

from loomgraph.llm import line_dedup
from loomgraph.llm.line_dedup import remove_boilerplate
from loomgraph.llm.quality_rules import judge

R = random.Random(4)
LINES = [f"this is shared line number {'abcdefghij'[i]} of the site" for i in range(10)]
ROWS = [(i, "\n".join(R.sample(LINES, R.randint(0, 5)) + [f"own words {''.join(R.choices('abcdefg', k=12))}"]), f"s{R.randrange(12)}") for i in range(150)]
ODD = [(None, LINES[0], None), (500, None, "s1"), (501, "", "s1"), (502, "\n \n", None), (503, "w " * 40000 + "\n" + LINES[1], "s2"), (503, "w " * 40000 + "\n" + LINES[1], "s2")]


def brute(rows, min_sites):
    sites = {}
    for _, t, s in rows:
        for l in (t or "").split("\n"):
            sites.setdefault(" ".join(l.lower().split()), set()).add(s)
    out = []
    for d, t, _ in rows:
        raw = t.split("\n") if t else []
        keep = [l for l in raw if not l.split() or len(sites[" ".join(l.lower().split())]) < min_sites]
        out.append((d, "\n".join(keep), len(raw), len(raw) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [3, 11])
@pytest.mark.parametrize("lg_k", [4, 10])
def test_brute_force(spark, monkeypatch, min_sites, lg_k):
    monkeypatch.setattr(line_dedup, "LG_K", lg_k)
    rows = ROWS + ODD
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, k string")
    got = sorted(map(tuple, remove_boilerplate(docs, min_sites=min_sites).collect()), key=str)
    assert got == brute(rows, min_sites)


def test_short_lines(spark):
    """Shared lines are removed whatever their length; lines without a word and lines of fewer sites stay."""
    rows = [(i, f"Read more\n\nx\n \nLog in {i}\nown line of document {'abcdefgh'[i]}\n" + ("rare" if i < 5 else "none"), f"s{i}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in remove_boilerplate(docs).collect()}
    assert len(got) == 8
    for i, r in got.items():
        assert r.clean_text == f"\n \nown line of document {'abcdefgh'[i]}\n" + ("rare" if i < 5 else "none")
        assert (r.n_lines, r.n_removed) == (7, 3)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert remove_boilerplate(docs).count() == 0 and judge(docs).count() == 0


def test_line_rules_on_odd_rows(spark):
    rows = [(i, f"own words {i * 'q '} here now\n" + "menu one two three four five six seven eight nine\n" * 2, "h") for i in range(1, 9)]
    rows += [(20, "menu one two three four five six seven eight nine ten", "h"), (21, "menu one two three four five six seven eight nine", "h"), (21, "menu one two three four five six seven eight nine", "h")]
    rows += [(None, None, None), (30, "", "h"), (31, "a b c d e a b c d e # $", "h")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, n_words int")
    got = judge(docs, min_line_docs=4, line_share=0.1).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[21].removed_words == 10 and not by[21].kept and not by[21].base_failed
    assert by[20].removed_words == 0 and by[20].kept
    assert by[3].n_dup_lines == 1 and by[3].removed_words == 10
    assert by[31].n_repeat_words == 10 and by[31].n_symbols == 2 and by[31].base_failed and by[31].word_chars == 12
    assert by[None].base_failed and by[30].base_failed and by[30].n_words == 0


def test_hosts_and_repeated_rows(spark):
    """One text under two hosts is judged by each host's lines; a document counts once, however many rows it has."""
    menu, own = "menu one two three four five six seven eight nine", "a line that one document says over and over again here"
    rows = [(i, f"own words of page {'q ' * i} and more\n{menu}", "a") for i in range(1, 9)] + [(50, menu, "a"), (50, menu, "b")] + [(60, own, "b")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = judge(docs.withColumn("_hh", docs.doc_id), min_line_docs=4, line_share=0.1).collect()
    assert len(got) == len(rows)
    assert sorted((r.removed_words, r.kept) for r in got if r.doc_id == 50) == [(0, True), (10, False)]
    assert all(r.removed_words == 0 and r.kept for r in got if r.doc_id == 60)
