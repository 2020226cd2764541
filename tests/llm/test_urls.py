import math
import re

from pyspark.sql import functions as F

from loomgraph.llm.q_urls import RULES, op3_host_reputation
from loomgraph.llm.url_filter import beta_cdf, domain_of, filter_urls, reputation, suffix_of

URLS = [
    (1, "https://A.Example.ORG/es/9?x", 1), (2, "http://example.org", 2), (3, "x://com/de/", None), (4, "nocolon/a", 3), (5, None, 4), (6, "", 5),
    (7, "http://b.com/fr/1#t", 6), (8, "http://notcom/fr/1", 7), (9, "http://bad.net/1", 8), (10, "http://bad.net/" + "z" * 100_000, 9), (10, "http://bad.net/2", 9),
    (None, "a://b://c/d", 10), (11, "http://q.example.org/en/12", 11), (12, "http://q.example.org/en/2", 12), (13, "http://x?http://y/z", 13),
]


def rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return (host, path, *(max(fits)[2:] if fits else (None, None)))


def frames(spark):
    pages = spark.createDataFrame([(*u, "v") for u in URLS] + [(100 + i, "http://bad.net/p", 100 + i, "v") for i in range(40)] + [(200 + i, f"http://ok{i % 5}.net/p", 200 + i, "v") for i in range(60)], "page_id long, url string, item long, verdict string")
    out = spark.createDataFrame([(100 + i, True) for i in range(40)] + [(200 + i, i % 20 == 0) for i in range(60)] + [(None, True), (1, None), (100, False)], "item long, bad boolean")
    return pages, out


def test_rules_and_reputation(spark):
    pages, out = frames(spark)
    got = filter_urls(pages, out, RULES).collect()
    assert len(got) == len(URLS) + 100
    want = {(p, *rule(u)[:3]) for p, u, _ in URLS}
    assert {(r.page_id, r.host, r.path, r.rule) for r in got if r.page_id is None or r.page_id < 100} == want
    for r in got:
        given = dict(RULES).get(r.rule)
        assert r.verdict == (given or ("block" if r.host == "bad.net" else "allow"))


def test_shrinkage(spark):
    pages, out = frames(spark)
    rep = {r.host: r for r in reputation(pages, out).collect()}
    assert rep["bad.net"].n == 40 and rep["bad.net"].x == 40 and rep["bad.net"].sure > 0.999
    assert 0 < rep["ok1.net"].mean < 0.3 and rep["ok1.net"].sure < 0.1
    assert rep["b.com"].n == 0 and 0 < rep["b.com"].mean < 1


def test_empty(spark, sf_dir):
    pages, out = frames(spark)
    assert filter_urls(pages.limit(0), out, RULES).count() == 0
    assert filter_urls(pages, out.limit(0), []).where("rule IS NULL").count() == len(URLS) + 100
    assert op3_host_reputation(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def fraction(x, a, b):
    """The incomplete beta function by its continued fraction."""
    if x > (a + 1) / (a + b + 2):
        return 1 - fraction(1 - x, b, a)
    f, c, d = 1.0, 1.0, 0.0
    for i in range(5000):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + term * d), 1 + term / c
        f *= c * d
    return math.exp(a * math.log(x) + b * math.log(1 - x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a * (f - 1)


def test_beta_posterior(spark):
    ab = [(a, b) for a in (0.05, 0.7, 3.0, 40.0, 900.0) for b in (0.04, 1.5, 20.0, 2100.0)]
    got = spark.createDataFrame(ab, "a double, b double").select("a", "b", beta_cdf(0.3, F.col("a"), F.col("b")).alias("p")).collect()
    assert len(got) == 20
    for r in got:
        assert abs(r.p - fraction(0.3, r.a, r.b)) < (4e-3 if min(r.a, r.b) < 2 else 3e-4), r


def test_suffixes(spark):
    hosts = {"x.b.co.uk": ("b.co.uk", "co.uk"), "a.com.cn": ("a.com.cn", "com.cn"), "z.gov.uk": ("z.gov.uk", "gov.uk"), "w.u.github.io": ("u.github.io", "github.io"), "q.w.net": ("w.net", "net"),
             "co.uk": ("co.uk", "co.uk"), "com": ("com", "com"), "": ("", ""), "a.b.blogspot.co.uk": ("b.blogspot.co.uk", "blogspot.co.uk")}
    d = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain_of(F.col("h")), suffix_of(F.col("h")))
    assert {r[0]: (r[1], r[2]) for r in d.collect()} == hosts
    one = spark.createDataFrame([("a.b.c.d",)], "h string").select(domain_of(F.col("h"), ["c.d"]), suffix_of(F.col("h"), ["b.c.d"])).first()
    assert tuple(one) == ("b.c.d", "b.c.d")
