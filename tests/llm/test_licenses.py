import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm.decontaminate import TERM
from loomgraph.llm.licenses import SENTENCE_END, TEMPLATES, THRESHOLD, anchors, scan, vectors

UNIT, IDF, RARE = vectors()
ANCHORS = set(anchors(UNIT, THRESHOLD))


def cosines(line):
    c = Counter(re.findall(TERM, line.lower()))
    norm = math.sqrt(sum((n * IDF.get(t, RARE)) ** 2 for t, n in c.items()))
    return [sum(n * IDF.get(t, RARE) * v.get(t, 0) for t, n in c.items()) / norm if norm else 0.0 for v in UNIT]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*sorted(IDF), "xx", "yy"]), max_size=12))
def test_no_anchor_no_match(words):
    if max(cosines(" ".join(words)), default=0) >= THRESHOLD:
        assert ANCHORS & set(words)


ROWS = [
    ("COPYING", "All rights reserved."),
    ("a/LICENSE.md", "Permission is hereby granted,\nfree of charge, to any person obtaining\na copy of this software and its documentation"),
    ("a/b/c/x.py", "import y"),
    ("a/b/z.py", "# Licensed under the Apache License, Version 2.0.\nx"),
    ("ab/x.py", None),
    ("top.py", ""),
    (None, "Licensed under CC BY-NC 4.0."),
    (None, None),
    ("d/LICENSE", "nothing of note here"),
    ("d/long.txt", "w " * 40000),
    ("d/long.txt", "w " * 40000),
    ("e/LICENSE", "Released under the MIT License."),
    ("e/COPYING", "All rights reserved."),
    ("e/f.py", "pass"),
]


def test_inheritance_and_odd_rows(spark):
    files = spark.createDataFrame([(*r, "z") for r in ROWS], "path string, text string, license string")
    got = scan(files).collect()
    assert len(got) == len(ROWS)
    by = {r.path: r for r in got if r.path}
    assert by["a/LICENSE.md"].own_license == "MIT"
    assert (by["a/b/c/x.py"].license, by["a/b/c/x.py"].origin, by["a/b/c/x.py"].licence_file) == ("MIT", "inherited", "a/LICENSE.md")
    assert (by["a/b/z.py"].license, by["a/b/z.py"].origin) == ("Apache-2.0", "own")
    assert by["ab/x.py"].licence_file == by["top.py"].licence_file == by["d/long.txt"].licence_file == "COPYING"
    assert by["d/LICENSE"].origin == "inherited"
    assert by["e/f.py"].license == "Proprietary"  # equal cosines: the last name
    assert sorted((r.license or "", r.origin) for r in got if r.path is None) == [("", "none"), ("CC-BY-NC-4.0", "own")]
    for r in got:
        text = dict(ROWS).get(r.path)
        if r.path and r.own_license and "LICENSE" not in r.path:
            best = max((round(x, 9), n) for line in text.split("\n") for x, (n, _) in zip(cosines(line), TEMPLATES))
            assert (r.own_score, r.own_license) == best
    assert scan(files.limit(0)).count() == 0


WITHIN = [
    ("GPL-3.0", "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation */"),
    ("Apache-2.0", "x\nCopyright 2024 Example Corp. Licensed under the Apache License, Version 2.0. See LICENSE for details."),
    ("Proprietary", "// Copyright (c) 2024 Jane Doe. All rights reserved."),
    ("MIT", "word " * 300 + "released under\nthe MIT License " + "word " * 300),
    ("MIT", "released\nunder the\nMIT"),
    (None, "the terms of the rights to use and modify the software, all of it, " * 20),
    (None, "this is free and the public is granted a license by any person " * 5),
]


def brute(text):
    w = re.findall(TERM, text.lower())
    units = [(cosines(u), range(len(TEMPLATES))) for u in [*text.split("\n"), *re.split(SENTENCE_END, text)]]
    for j, (_, t) in enumerate(TEMPLATES):
        n = len(re.findall(TERM, t.lower()))
        units += [(cosines(" ".join(w[s : s + n])), [j]) for s in range(len(w))]
    score, name = max((round(c[j], 9), TEMPLATES[j][0]) for c, js in units for j in js)
    return (name, score) if score >= THRESHOLD else (None, None)


def test_statements_within_longer_text(spark):
    r = random.Random(7)
    words = sorted(IDF) + ["xx", "yy"]
    rows = list(WITHIN)
    for _ in range(120):
        part = r.choice(TEMPLATES)[1].split()
        part = [r.choice(words) if r.random() < 0.2 else x for x in part]
        text = [r.choice(words) for _ in range(r.randint(0, 25))] + part + [r.choice(words) for _ in range(r.randint(0, 25))]
        rows.append(("?", "".join(x + r.choice([" ", " ", " ", "\n", ". "]) for x in text)))
    files = spark.createDataFrame([(f"d/{i}.py", t) for i, (_, t) in enumerate(rows)], "path string, text string")
    got = {x.path: (x.own_license, x.own_score) for x in scan(files).collect()}
    for i, (name, text) in enumerate(rows):
        assert name in ("?", got[f"d/{i}.py"][0]), text
        want, have = brute(text), got[f"d/{i}.py"]
        # equal cosines may differ in their last bits
        assert have == want or abs((have[1] or 0) - (want[1] or 0)) <= 2e-9, (text, have, want)
