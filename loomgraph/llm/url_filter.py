"""URL filters: path rules, and host reputation by empirical Bayes.

A host's share of bad pages has a beta posterior, shrunk towards its registered domain,
that towards its suffix, and that towards all. A host is blocked if the posterior's lower
bound is above a limit, which is: if the posterior gives less than 1 - level to shares up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, ascii_lower
from .suffixes import SUFFIXES

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SALTS = 16


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _last(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The longest suffix of two or three labels that the host ends with, else its last label."""
    three, two = ([x for x in suffixes if x.count(".") == n] or [""] for n in (2, 1))
    return F.when(_last(host, 3).isin(*three), _last(host, 3)).when(_last(host, 2).isin(*two), _last(host, 2)).otherwise(_last(host, 1))


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The suffix and one label more, or the host itself where there is none."""
    three, two = ([x for x in suffixes if x.count(".") == n] or [""] for n in (2, 1))
    return F.when(_last(host, 3).isin(*three), _last(host, 4)).when(_last(host, 2).isin(*two), _last(host, 3)).otherwise(_last(host, 2))


def log_gamma(x: Column) -> Column:
    """By Stirling's series eight above x."""
    y, low = x + 8, F.lit(1.0)
    for i in range(8):
        low = low * (x + i)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.ln(low)


def normal_cdf(z: Column) -> Column:
    """By a polynomial, within 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-z * z / 2) * 0.3989422804014327
    return F.when(z > 0, 1 - tail).otherwise(tail)


def beta_cdf(x: float, a: Column, b: Column) -> Column:
    """P(share <= x) of a beta distribution, by Peizer and Pratt's normal form one above a and b, and exact steps down from there."""
    s, t, n, p = b + 0.5, a + 0.5, a + b + 1, 1 - x
    ratio = lambda r: F.when(F.abs(1 - r) < 1e-3, (1 - r) / 3 + (1 - r) * (1 - r) / 6).otherwise((1 - r * r + 2 * r * F.ln(r)) / ((1 - r) * (1 - r)))
    d = s + 1 / 6 - (n + 1 / 3) * p + 0.02 * (x / (s + 0.5) - p / (t + 0.5) + (x - 0.5) / (n + 1))
    z = d * F.sqrt((1 + x * ratio(s / (n * p)) + p * ratio(t / (n * x))) / ((n + 1 / 6) * (p * x)))
    # powers of x and 1 - x over the beta function of a and b
    e = F.exp(a * F.ln(F.lit(x)) + b * F.ln(F.lit(p)) - log_gamma(a) - log_gamma(b) + log_gamma(a + b))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), normal_cdf(z) + e / a - e * x * (a + b) / (a * b)))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; equal lengths: the longer host, then the text.

    rules: (rule, "allow" or "block"), a rule being host/path. The list is a parameter in
    the plan, of up to some hundreds; it never comes from the data.
    """
    split = [(r, v, r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1]) for r, v in rules]
    rule = verdict = None
    for r, v, h, p in sorted(split, key=lambda x: (-len(x[0]), -len(x[2]), x[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _strength(children: DataFrame, parent: list[str]) -> float:
    """Beta prior strength between children of the same parent, by moments (one row comes back)."""
    seen = children.where("n > 0")
    by = seen.groupBy(*parent).agg(F.sum("n").cast("double").alias("N"), F.sum("x").cast("double").alias("X"), F.sum(F.col("x") * F.col("x") / F.col("n")).alias("XX"), F.sum(F.col("n").cast("double") * F.col("n")).alias("NN"), F.count("*").alias("k"))
    m = F.col("X") / F.col("N")
    v = m * (1 - m)
    r = by.agg(F.sum(F.col("XX") - m * F.col("X") - v * (F.col("k") - 1)).alias("a"), F.sum(v * (F.col("N") - F.col("NN") / F.col("N") - (F.col("k") - 1))).alias("b")).first()
    g = min(0.99, max(1e-4, r.a / r.b)) if r.a is not None and r.b and r.b > 0 else 1 / 11
    return 1 / g - 1


def reputation(pages: DataFrame, outcomes: DataFrame, limit: float = 0.3, suffixes=SUFFIXES) -> DataFrame:
    """Per host: n labelled pages, x bad ones, mean of the posterior share of bad pages, and sure, its probability to be above limit.

    pages: url and item (bigint key into outcomes, null for none); outcomes: item, bad
    (boolean). A host's share is shrunk towards its registered domain's, that towards its
    suffix's, and that towards the corpus's; the strengths of the three beta priors are
    estimated from the spread between hosts, domains and suffixes. Outcomes that are null
    are left out; an item that is labelled twice is bad if any label says so. Hosts
    without labelled pages get their domain's posterior. Only counts per host are
    shuffled after the join with outcomes, which is by page, so that hot hosts are many
    keys.
    """
    told = outcomes.where("item IS NOT NULL AND bad IS NOT NULL").groupBy("item").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    p = pages.select(host_of(F.col("url")).alias("host"), F.col("item"))
    counts = p.join(told, "item", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    host = F.col("host")
    hosts = Table(counts.select("host", domain_of(host, suffixes).alias("domain"), suffix_of(host, suffixes).alias("suffix"), "n", "x"), "hosts")
    domains = hosts.df.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixed = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    total = suffixed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x")).first()
    m0 = (total.x + 0.5) / (total.n + 1.0)
    k0, k1, k2 = _strength(suffixed.withColumn("all", F.lit(1)), ["all"]), _strength(domains, ["suffix"]), _strength(hosts.df, ["domain"])
    s = suffixed.select("suffix", ((F.col("x") + k0 * m0) / (F.col("n") + k0)).alias("ms"))
    d = domains.join(s, "suffix").select("domain", ((F.col("x") + k1 * F.col("ms")) / (F.col("n") + k1)).alias("md"))
    h = hosts.df.join(d, "domain").select("host", "n", "x", (F.col("x") + k2 * F.col("md")).alias("a"), (F.col("n") - F.col("x") + k2 * (1 - F.col("md"))).alias("b"))
    return h.select("host", "n", "x", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), (1 - beta_cdf(limit, F.col("a"), F.col("b"))).alias("sure"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = 0.3, level: float = 0.95, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled and bad_sure of every page.

    pages: page_id, url and item, see reputation(). The rule decides where one fits;
    otherwise a host is blocked if its share of bad pages is above limit with a posterior
    probability above level. Null urls have an empty host. The join with hosts is salted,
    as one host may have a third of all pages. Repeated rows stay; an empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt"))
    known = reputation(pages, outcomes, limit, suffixes)
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("sure") > level, F.lit("block")).otherwise(F.lit("allow"))
    out = p.join(known, ["host", "salt"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n", "sure")
    return out.select("page_id", "host", "path", "rule", "verdict", F.col("n").alias("n_labelled"), F.round("sure", 5).alias("bad_sure"))
