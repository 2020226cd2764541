"""Similar keyword sets and word rules against brute force."""

import random
import re

from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import instructions as ins
from loomgraph.operators.similar import similar_pairs


def test_similar_sets_by_blocks(spark):
    """Files of one block and of many give the pairs that comparing all with all gives."""
    R = random.Random(5)
    base = [sorted({f"w{R.randint(0, 60)}" for _ in range(R.randint(1, 25))}) for _ in range(9)] + [[f"x{i}" for i in range(900)], [f"x{i}" for i in range(880)] + [f"y{i}" for i in range(40)]]
    sets = list(dict.fromkeys(tuple(sorted((set(R.choice(base)) | {f"w{R.randint(0, 200)}"}) - {f"w{R.randint(0, 60)}"})) for _ in range(150)))
    rows = [(f, i, w) for f in ("a", "b") for i, w in enumerate(sets) if w and (f == "a" or i % 9 == 0)]
    want = set()
    for f, i, w in rows:
        for g, j, v in rows:
            both = len(set(w) & set(v))
            if f == g and i < j and 100 * both >= 65 * len(set(w) | set(v)):
                want.add((f, i, j, both, len(set(w) | set(v))))
    d = spark.createDataFrame([(f, " ".join(w), i, 1) for f, i, w in rows], "file string, w string, id long, members long")
    assert len(want) > 20
    for block in (40, 1000, 1_000_000):
        got = [(r.file, r.a, r.b, r.shared, r.united) for r in similar_pairs(d, 65, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_pair_leaves_its_task(spark):
    """What is shuffled is the sets, not the candidates."""
    k = spark.range(600).select(F.lit("f").alias("file"), F.col("id").alias("seq"), F.array(F.lit("common"), F.concat(F.lit("w"), "id")).alias("w"))
    df = ins.similar_sets(k)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 0 and "Join Inner" not in plan


def test_word_rules_of_odd_texts(spark):
    """Rules that words decide agree with their patterns tried one by one."""
    plain = [p for r in (rules.TOPICS, rules.SCOPES) for ws in r.values() for p in ws.split()] + [x for ps in rules.INTENTS.values() for p in ps for x in ([p] if "(" in p else p.split("|"))]
    plain = list(dict.fromkeys([*plain, *rules.STRICT, *rules.FIRM]))
    bits = [re.sub(r"\\s[*+]|\.\*|\.", " ", re.sub(r"\(.*", "", p.strip("~"))).replace("\\d", "1").replace("\\", "") for p in plain]
    bits += ["for\tplanning", "if the user", "when  status", "ask 'x", "don't", "dont", "dond", "must\nnot", "éask", "ask_", "认证", "ask-user", "e.g.x", "?", " ? ", "before we move", "types:", "\x01 \x02"]
    R = random.Random(3)
    texts = [R.choice(["", " ", "\n", "x", "_"]).join(R.choice(bits) for _ in range(R.randint(1, 6))) for _ in range(1500)]
    d = spark.createDataFrame([(t and t.lower(),) for t in [*texts, "", None]], "t string").select("t", rules.words(F.col("t")).alias("w"))
    bad = [F.count_if(~F.col("t").rlike(rules.java(p)).eqNullSafe(rules.has(F.col("t"), p, F.col("w")))) for p in plain]
    hit = [F.count_if(F.col("t").rlike(rules.java(p))) for p in plain]
    r = d.agg(*[c.alias(f"b{i}") for i, c in enumerate(bad)], *[c.alias(f"h{i}") for i, c in enumerate(hit)]).first()
    assert [(p, r[f"b{i}"]) for i, p in enumerate(plain) if r[f"b{i}"]] == []
    assert sum(r[f"h{i}"] > 0 for i in range(len(plain))) > 0.9 * len(plain)
