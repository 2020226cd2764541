"""License scan: TF-IDF cosine of lines, sentences, word windows and licence files to templates, and inheritance from the nearest ancestor directory.

The vectors are sparse: terms are runs of letters and digits in lower case, a term's
weight is its count times its inverse frequency among the templates; a term of none has
the weight of the rarest. By the prefix principle a text can only reach the threshold
against a template if it has one of the template's anchors, terms without which what
is left of the template is too short a vector; and the terms they share must make up
enough of the template's vector. Texts, lines and sentences that can't reach it are
skipped, which loses nothing; the rest are scored by one aggregation. Windows, which find
statements that are wrapped or stand within longer lines, are scored within their rows,
each against the template whose length it has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table
from .decontaminate import TERM, terms

TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License"),
    ("ISC", "Permission to use, copy, modify, or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Names of licence files, in lower case, without extension.
FILE_NAMES = ("license", "licence", "copying", "unlicense", "notice")
THRESHOLD = 0.7
SENTENCE_END = r"(?<=[.!?])[\x20\x09-\x0D]+"
COMMON = frozenset("a an and any by can for from in into is it its of on or that the this to under was with without 0 1 2 3 4".split())
SALTS = 8


def vectors(templates=None) -> tuple[list[dict[str, float]], dict[str, float], float]:
    """(unit vector of each template, inverse frequency of each term, that of unknown terms)."""
    counts = [Counter(re.findall(TERM, t.lower())) for _, t in templates or TEMPLATES]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for c in counts:
        v = {t: n * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out, idf, math.log(1 + len(counts)) + 1


def anchors(unit: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a text must have one to reach the threshold against any template.

    Any terms do whose absence leaves too short a vector; words that are common in all
    prose are taken last.
    """
    found = set()
    for v in unit:
        left = 1.0
        for t, x in sorted(v.items(), key=lambda p: (p[0] in COMMON, -p[1], p[0])):
            if left < (threshold - 1e-9) ** 2:
                break
            found.add(t)
            left -= x * x
    return sorted(found)


def alike(ts: Column, unit: list[dict[str, float]], threshold: float) -> Column:
    """Numbers of the templates that no part of an array of terms is too far from: the shared terms' part of the template's vector has at least the threshold's length."""
    part = lambda h, v: reduce(lambda a, b: a + b, [F.when(F.array_contains(h, t), x * x).otherwise(0.0) for t, x in v.items()])
    numbers = lambda h: F.array_compact(F.array(*[F.when(part(h, v) >= (threshold - 1e-9) ** 2, F.lit(j)) for j, v in enumerate(unit)]))
    # a lambda's variable is computed once
    return F.get(F.transform(F.array(F.array_intersect(ts, F.array(*[F.lit(t) for t in sorted({t for v in unit for t in v})]))), numbers), F.lit(0))


def window_licenses(some: DataFrame, threshold: float) -> DataFrame:
    """path, _th, b (score, license) of every run of a template's number of words, across lines, that reaches the threshold against it.

    A run at the end of a text may be shorter. A run that matches has an anchor, so runs
    are taken around anchors only, each with its first one.
    """
    unit, idf, rare = vectors()
    need = F.array(*[F.lit(a) for a in anchors(unit, threshold)])
    n = [len(re.findall(TERM, t.lower())) for _, t in TEMPLATES]
    most = max(n)

    def around(w, at):
        def one(p, k):
            first = F.greatest(F.coalesce(F.get(at, k - 1), F.lit(-1)) + 1, p - (most - 1))
            return F.struct((p - first).alias("o"), F.slice(w, first + 1, p + most - first).alias("w"))

        return F.transform(at, one)

    places = lambda w: F.array_compact(F.transform(w, lambda t, i: F.when(F.array_contains(need, t), i)))
    near = F.flatten(F.transform(F.array(terms(F.col("_t"))), lambda w: F.flatten(F.transform(F.array(places(w)), lambda at: around(w, at)))))
    c = some.select("path", "_th", F.explode(near).alias("c")).select("path", "_th", "c.o", "c.w")
    c = c.select("*", F.explode(alike(F.col("w"), unit, threshold)).alias("j"))
    table = [(j, TEMPLATES[j][0], n[j], {t: x * idf[t] for t, x in v.items()}, idf) for j, v in enumerate(unit)]
    c = c.join(F.broadcast(some.sparkSession.createDataFrame(table, "j int, license string, n int, v map<string,double>, idf map<string,double>")), "j")
    u = c.select("path", "_th", "license", "v", "idf", F.explode(F.transform(F.sequence(F.greatest(F.lit(0), F.col("o") - F.col("n") + 1), F.col("o")), lambda s: F.slice("w", s + 1, F.col("n")))).alias("u"))
    dot = F.aggregate("u", F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at("v", t), F.lit(0.0)))
    # a term that occurs k times is met k times
    norm = F.aggregate("u", F.lit(0.0), lambda a, t: a + F.pow(F.coalesce(F.try_element_at("idf", t), F.lit(rare)), F.lit(2)) * F.size(F.filter("u", lambda x: x == t)))
    return u.select("path", "_th", F.struct(F.round(dot / F.sqrt(norm), 9).alias("score"), "license").alias("b")).where(F.col("b.score") >= threshold)


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """path, _th, license, score (9 decimals) of files that state a license; files: path, _t (text), _th (its hash)."""
    unit, idf, rare = vectors()
    need = F.array(*[F.lit(a) for a in anchors(unit, threshold)])
    spark = files.sparkSession
    # as many rows as the templates have terms
    vocabulary = F.broadcast(spark.createDataFrame([(t, idf[t], [v.get(t, 0.0) for v in unit]) for t in sorted(idf)], "term string, idf double, w array<double>"))
    # read twice; repeated rows only scale a unit's counts, which no cosine sees
    some = Table(files.where(F.size(alike(terms(F.col("_t")), unit, threshold)) > 0), "license-texts").df
    base = F.lower(F.substring_index(F.substring_index("path", "/", -1), ".", 1))
    parts = F.array_distinct(F.concat(F.split("_t", "\n"), F.split("_t", SENTENCE_END)))
    units = F.when(base.isin(*FILE_NAMES), F.array_append(parts, F.col("_t"))).otherwise(parts)
    lines = some.select("path", "_th", F.posexplode(units).alias("i", "line"))
    words = lines.select("path", "_th", "i", terms(F.col("line")).alias("ts")).where(F.arrays_overlap("ts", need)).select("path", "_th", "i", F.explode_outer("ts").alias("term"))
    tf = words.groupBy("path", "_th", "i", "term").agg(F.count("*").alias("tf")).join(vocabulary, "term", "left")
    weight = F.col("tf") * F.coalesce("idf", F.lit(rare))
    sums = tf.groupBy("path", "_th", "i").agg(F.sqrt(F.sum(weight * weight)).alias("norm"), *[F.sum(F.coalesce(weight * F.col("w")[j], F.lit(0.0))).alias(f"d{j}") for j in range(len(unit))])
    cosines = F.array(*[F.struct(F.round(F.col(f"d{j}") / F.col("norm"), 9).alias("score"), F.lit(name).alias("license")) for j, (name, _) in enumerate(TEMPLATES)])
    best = sums.select("path", "_th", F.array_max(cosines).alias("b")).where(F.col("b.score") >= threshold)
    best = best.unionByName(window_licenses(some, threshold))
    return best.groupBy("path", "_th").agg(F.max("b").alias("b")).select("path", "_th", "b.license", "b.score")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """path, own_license, own_score, license, origin (own, inherited or none), licence_file of each row.

    files: path (with /) and text; other columns are not read. A line, a sentence, a run of
    as many words as a template has, or the whole text of a file with a licence file's
    name, whose cosine to a template (the run's: to that one) reaches the threshold states
    its license; sentences and runs go on over line ends; the highest cosine wins, then the last name in order. A file
    without a statement inherits from the licence file in its own directory or the nearest
    ancestor's that has a recognised one (several in one directory: highest cosine, then
    last license, then last path). Null and empty texts state nothing; a null path is in no
    directory and inherits nothing; rows that agree in path and text get one result each.
    Ancestors are joined for distinct directories, then files to their directory under
    SALTS keys, so that neither the root nor a large directory is a hot key.
    """
    f = files.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")).withColumn("_th", F.xxhash64("_t"))
    own = Table(own_licenses(f, threshold), "own-licenses").df.withColumnsRenamed({"path": "_p", "_th": "_h", "license": "own_license", "score": "own_score"})
    k = f.select("path", "_th")
    k = k.join(own, k["path"].eqNullSafe(own["_p"]) & (k["_th"] == own["_h"]), "left").drop("_p", "_h")
    # the directory of "a/b/c" is "a/b", of "c" it is ""; as segments from the root
    k = k.withColumn("_dir", F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", "")))
    base = F.lower(F.substring_index(F.substring_index("path", "/", -1), ".", 1))
    sources = k.where(base.isin(*FILE_NAMES) & F.col("own_license").isNotNull()).groupBy(F.col("_dir").alias("_a")).agg(F.max(F.struct("own_score", "own_license", "path")).alias("src"))
    sources = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dirs = k.where("_dir IS NOT NULL").select("_dir").distinct()
    seg = F.split("_dir", "/")
    up = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(seg))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(seg, F.lit(1), n), "/").alias("a")))).alias("x"))
    up = up.select("_dir", F.col("x.n").alias("n"), F.col("x.a").alias("_a"), F.pmod(F.xxhash64("_dir"), F.lit(SALTS)).cast("int").alias("salt"))
    near = up.join(sources, ["_a", "salt"]).groupBy("_dir").agg(F.max_by("src", "n").alias("src")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = k.withColumn("salt", F.pmod("_th", F.lit(SALTS)).cast("int")).join(near, ["_dir", "salt"], "left")
    has = F.col("own_license").isNotNull()
    return d.select(
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "src.own_license").alias("license"),
        F.when(has, "own").when(F.col("src").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("src.path")).alias("licence_file"),
    )
