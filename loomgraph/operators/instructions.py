"""Instruction text: topics, scopes, intents, severity, and redundancy between chunks.

chunks: file, seq, text. Redundancy is found between classes of chunks, not chunks: all
chunks of a file with the same primary intent, topics and scopes are one class, all with
the same keywords another, kept by its first chunk and its size. A pair of classes stands
for all pairs of their members, so a file with millions of alike chunks gives one row and
no quadratic output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import FIRM, INTENTS, SCOPES, STOP, STRICT, TOPICS, has, hits, labels, words
from ..sources.scratch import materialize
from .similar import similar_pairs
from .traverse import components


def _once(text: Column, fields) -> Column:
    """A struct of fields, made from the text in lower case and its words, which are computed once for all of them."""
    both = F.transform(F.array(F.lower(text)), lambda t: F.struct(t.alias("text"), words(t).alias("words")))
    return F.get(F.transform(both, lambda x: F.struct(*[c.alias(k) for k, c in fields(x["text"], x["words"]).items()])), F.lit(0))


def annotate(chunks: DataFrame) -> DataFrame:
    """Adds topics, scopes, question_ids (sorted arrays) and word_count."""
    t = F.col("text")
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(q_[a-z][a-z0-9_]*)\b"), F.lit(1))))
    found = _once(t, lambda x, w: {"topics": labels(x, TOPICS, w), "scopes": labels(x, SCOPES, w)})
    d = chunks.select("*", found.alias("_a")).select("*", "_a.topics", "_a.scopes").drop("_a")
    return d.select("*", ids.alias("question_ids"), F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("word_count"))


def classify(chunks: DataFrame) -> DataFrame:
    """Adds score_<family>, intents, primary_intent (most hits, first family on ties), confidence (its share of all hits) and severity."""

    def fields(x, w):
        return {f"score_{k}": hits(x, p, w) for k, p in INTENTS.items()} | {"strict": has(x, "|".join(STRICT), w), "firm": has(x, "|".join(FIRM), w)}

    names = list(INTENTS)
    d = chunks.select("*", _once(F.col("text"), fields).alias("_a")).select("*", *[F.col(f"_a.score_{k}") for k in names], "_a.strict", "_a.firm").drop("_a")
    score = [F.col(f"score_{k}") for k in names]
    top, total = F.greatest(*score), sum(score[1:], score[0])
    primary = F.when(top == 0, "unknown")
    for k, s in zip(names, score):
        primary = primary.when(s == top, k)
    intents = F.array_compact(F.array(*[F.when(s > 0, F.lit(k)) for k, s in zip(names, score)]))
    d = d.select("*", intents.alias("intents"), primary.alias("primary_intent"), F.when(total == 0, 0.0).otherwise(F.round(top / total, 6)).alias("confidence"))
    return d.withColumn("severity", severity(F.col("intents"), F.col("primary_intent"), F.col("strict"), F.col("firm"))).drop("strict", "firm")


def severity(intents: Column, primary: Column, strict: Column, firm: Column) -> Column:
    both = F.array_contains(intents, "constraint") & F.array_contains(intents, "mandate")
    return (
        F.when(both, "critical")
        .when(primary == "constraint", F.when(strict, "high").otherwise("medium"))
        .when(primary == "mandate", F.when(firm, "high").otherwise("medium"))
        .when(primary.isin("definition", "example"), "low")
        .otherwise("medium")
    )


def _joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def signatures(classified: DataFrame) -> DataFrame:
    """file, intent, topics, scopes (comma-joined), first_seq, n of all chunks with a topic."""
    g = classified.groupBy("file", F.col("primary_intent").alias("intent"), _joined("topics"), _joined("scopes")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    return g.where("topics <> ''")  # after the groups, so that no topic is looked for twice


def _strict(sig: DataFrame) -> DataFrame:
    return sig.where(F.col("intent").isin("constraint", "mandate"))


def _collision_severity(intent: Column, topics: Column) -> Column:
    t = F.split(topics, ",")
    high = (intent == "mandate") | (topics == "inquiry") | (F.array_contains(t, "inquiry") & F.array_contains(t, "education"))
    return F.when(high, "high").otherwise("medium")


def topic_collisions(sig: DataFrame) -> DataFrame:
    """Chunks of a file with the same constraint or mandate intent on the same topics: n of them, n_pairs between them."""
    g = _strict(sig).groupBy("file", "intent", "topics").agg(F.min("first_seq").alias("first_seq"), F.sum("n").alias("n")).where("n > 1")
    return g.select("file", "intent", "topics", "first_seq", "n", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"), _collision_severity(F.col("intent"), F.col("topics")).alias("severity"))


def _sides(sig: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    cols = ("intent", "topics", "scopes", "first_seq", "n")
    return tuple(sig.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in cols]) for side in "ab")


def _pairs(sig: DataFrame) -> DataFrame:
    """Different signatures of a file that share a topic, each pair once: at the least topic that they share."""
    a, b = _sides(sig.withColumn("topic", F.explode(F.split("topics", ","))), "file", "topic")
    least = F.array_min(F.array_intersect(F.split("a_topics", ","), F.split("b_topics", ",")))
    return a.join(b, ["file", "topic"]).where("a_first_seq < b_first_seq").where(F.col("topic") == least).drop("topic")


def _disjoint(a: Column, b: Column, ignore: tuple[str, ...] = ()) -> Column:
    own = lambda c: F.filter(F.split(c, ","), lambda x: (x != "") & ~x.isin("-", *ignore))
    return (F.size(own(a)) > 0) & (F.size(own(b)) > 0) & ~F.arrays_overlap(own(a), own(b))


def _out(p: DataFrame, sev: str) -> DataFrame:
    return p.select("file", F.col("a_first_seq").alias("a"), F.col("b_first_seq").alias("b"), (F.col("a_n") * F.col("b_n")).alias("n_pairs"), F.lit(sev).alias("severity"))


def _apart(pairs: DataFrame) -> DataFrame:
    return _out(pairs.where(_disjoint(F.col("a_scopes"), F.col("b_scopes"))), "medium")


def _contrary(pairs: DataFrame) -> DataFrame:
    mandates = pairs.where("a_intent = 'mandate' AND b_intent = 'mandate'")
    return _out(mandates.where(_disjoint(F.col("a_scopes"), F.col("b_scopes"), ("global", "turn_specific"))), "high")


def scope_conflicts(sig: DataFrame) -> DataFrame:
    """Constraints and mandates that share a topic and have scopes, none in common."""
    return _apart(_pairs(_strict(sig)))


def contradictions(sig: DataFrame) -> DataFrame:
    """Mandates that share a topic and whose scopes, but for the general ones, are disjoint."""
    return _contrary(_pairs(sig.where("intent = 'mandate'")))


def keywords(text: Column) -> Column:
    """Distinct words of three and more letters a-z, without stop words; sorted."""
    w = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[a-z]{3,}$")))
    return F.array_sort(F.array_except(w, F.array(*map(F.lit, STOP))))


def keyword_sets(chunks: DataFrame) -> DataFrame:
    """file, seq, w (keywords) of chunks that have some, written once."""
    return materialize(chunks.select("file", "seq", keywords(F.col("text")).alias("w")).where(F.size("w") > 0), "keywords")


def similar_sets(k: DataFrame, least: float = 0.65, high: float = 0.8) -> DataFrame:
    """Pairs of keyword sets of one file with a Jaccard similarity of at least `least`: file, a, b (first chunks), n_a, n_b (chunks with that set), n_pairs, shared, similarity, severity.

    Chunks with equal sets are one class, and if they are several, one row with a = b.
    Pairs are found as in `similar`, none of them leaving its task before it is counted.
    """
    sets = materialize(k.groupBy("file", F.array_join("w", " ").alias("w")).agg(F.min("seq").alias("id"), F.count("*").alias("members")), "sets")
    v = similar_pairs(sets, round(100 * least))
    v = v.select("file", "a", "b", "n_a", "n_b", (F.col("n_a") * F.col("n_b")).alias("n_pairs"), "shared", F.round(F.col("shared") / F.col("united"), 6).alias("similarity"))
    m = F.col("members")
    own = sets.where("members > 1").select("file", F.col("id").alias("a"), F.col("id").alias("b"), m.alias("n_a"), m.alias("n_b"), (m * (m - 1) / 2).cast("long").alias("n_pairs"), F.size(F.split("w", " ")).cast("long").alias("shared"), F.lit(1.0).alias("similarity"))
    return v.unionByName(own).withColumn("severity", F.when(F.col("similarity") >= high, "high").otherwise("medium"))


def semantic_duplicates(chunks: DataFrame, least: float = 0.65, high: float = 0.8) -> DataFrame:
    return similar_sets(keyword_sets(chunks), least, high)


def redundancies(sig: DataFrame, similar: DataFrame) -> DataFrame:
    """file, type, a, b, n_pairs, severity, similarity of each pair of classes: topic collisions, scope conflicts, semantic duplicates, contradictions.

    a and b are the first chunks of classes of signatures, for semantic duplicates of
    keyword sets; equal ones stand for the pairs within a class. A pair of chunks may be
    redundant in several ways, in each once.
    """
    strict = _strict(sig)
    a, b = _sides(strict, "file")
    c = a.join(b.withColumnsRenamed({"b_intent": "a_intent", "b_topics": "a_topics"}), ["file", "a_intent", "a_topics"]).where("a_first_seq <= b_first_seq")
    n = F.when(F.col("a_first_seq") == F.col("b_first_seq"), F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n"))
    c = c.select("file", F.col("a_first_seq").alias("a"), F.col("b_first_seq").alias("b"), n.cast("long").alias("n_pairs"), _collision_severity(F.col("a_intent"), F.col("a_topics")).alias("severity"))
    pairs = materialize(_pairs(strict), "pairs")
    parts = {"topic_collision": c.where("n_pairs > 0"), "scope_conflict": _apart(pairs), "contradiction": _contrary(pairs)}
    out = similar.select("file", F.lit("semantic_duplicate").alias("type"), "a", "b", "n_pairs", "severity", "similarity")
    for kind, d in parts.items():
        out = out.unionByName(d.select("file", F.lit(kind).alias("type"), "a", "b", "n_pairs", "severity", F.lit(None).cast("double").alias("similarity")))
    return out


def redundancy_counts(red: DataFrame) -> DataFrame:
    """file, type, severity, n_pairs: redundant pairs of chunks."""
    return red.groupBy("file", "type", "severity").agg(F.sum("n_pairs").alias("n_pairs"))


def redundancy_clusters(classified: DataFrame, sig: DataFrame, sets: DataFrame, red: DataFrame) -> DataFrame:
    """file, first_seq, size, topic, avg_similarity, severity of each connected group of redundant chunks.

    classified, with sig and sets (keyword_sets) of the same chunks. Nodes are the classes
    that red names; a chunk that is in one of either kind links the two. topic is the one
    that most chunks have (ties: by name), avg_similarity the mean over semantic
    duplicates, severity the highest of a pair.
    """
    name = lambda kind, c: F.concat_ws("|", kind, "file", F.col(c).cast("string"))
    kind = F.when(F.col("type") == "semantic_duplicate", "K").otherwise("S")
    r = materialize(red.select(name(kind, "a").alias("source"), name(kind, "b").alias("target"), "n_pairs", "severity", "similarity"), "redundant")
    nodes = r.select(F.col("source").alias("id")).unionByName(r.select(F.col("target").alias("id"))).distinct()
    chunks = classified.select("file", "seq", F.col("primary_intent").alias("intent"), "topics", _joined("scopes"))
    chunks = materialize(chunks, "chunks")
    own = chunks.withColumn("topics", F.array_join("topics", ",")).join(sig, ["file", "intent", "topics", "scopes"])
    own = own.select("file", "seq", name(F.lit("S"), "first_seq").alias("id"))
    sets = sets.select("file", "seq", F.array_join("w", " ").alias("w"))
    words = sets.join(sets.groupBy("file", "w").agg(F.min("seq").alias("first")), ["file", "w"]).select("file", "seq", name(F.lit("K"), "first").alias("id"))
    at = materialize(own.unionByName(words).join(nodes, "id", "left_semi"), "members")
    both = at.groupBy("file", "seq").agg(F.min("id").alias("source"), F.max("id").alias("target")).where("source <> target").select("source", "target")
    comp = materialize(components(r.select("source", "target").unionByName(both.distinct()), nodes), "clusters")
    member = materialize(at.join(comp, "id").select("component", "file", "seq").distinct(), "members")
    size = member.groupBy("component").agg(F.min("file").alias("file"), F.min("seq").alias("first_seq"), F.count("*").alias("size"))
    n = member.join(chunks.select("file", "seq", "topics"), ["file", "seq"]).select("component", F.explode("topics").alias("topic")).groupBy("component", "topic").agg(F.count("*").alias("n"))
    topic = n.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "topic"))["topic"].alias("topic"))
    inside = r.join(comp.withColumnRenamed("id", "source"), "source").groupBy("component")
    weight = F.when(F.col("similarity").isNotNull(), F.col("n_pairs"))
    worst = inside.agg(F.max(F.col("severity") == "high").alias("high"), (F.sum(F.col("similarity") * weight) / F.sum(weight)).alias("mean"))
    d = size.join(worst, "component").join(topic, "component", "left").where("size > 1")
    return d.select("file", "first_seq", "size", F.coalesce("topic", F.lit("unknown")).alias("topic"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("avg_similarity"), F.when(F.col("high"), "high").otherwise("medium").alias("severity"))


def _facts(d: DataFrame, kind: str, key, n) -> DataFrame:
    return d.select("file", F.lit(kind).alias("kind"), (key if isinstance(key, Column) else F.lit(key)).alias("key"), n.cast("double").alias("n"))


def summary(classified: DataFrame, red: DataFrame, clusters: DataFrame) -> DataFrame:
    """file, kind, key, n: totals, chunks by intent (each that they have), severity, topic and scope, redundant pairs by type and severity, and their rate, in percent of the chunks."""
    pairs = lambda name: F.transform(name, lambda t: F.struct(F.lit(name[:-1]).alias("kind"), t.alias("key")))
    x = F.concat(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("key"))), pairs("intents"), pairs("topics"), pairs("scopes"))
    by = classified.select("file", F.explode(x).alias("x")).groupBy("file", "x.kind", "x.key").agg(F.count("*").cast("double").alias("n"))
    t = classified.groupBy("file").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"))
    r = red.groupBy("file").agg(F.sum("n_pairs").alias("pairs"))
    t = t.join(r, "file", "left").join(clusters.groupBy("file").agg(F.count("*").alias("clusters")), "file", "left").fillna(0)
    totals = {"chunks": F.col("chunks"), "words": F.col("words"), "words a chunk": F.floor(F.col("words") / F.col("chunks")), "redundancies": F.col("pairs"), "clusters": F.col("clusters"), "redundancy rate": F.round(100 * F.col("pairs") / F.col("chunks"), 1)}
    rows = F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(k).alias("key"), v.cast("double").alias("n")) for k, v in totals.items()])
    out = by.unionByName(t.select("file", F.explode(rows).alias("x")).select("file", "x.*"))
    for kind, col in (("redundancy type", "type"), ("redundancy severity", "severity")):
        g = red.groupBy("file", F.col(col).alias("key")).agg(F.sum("n_pairs").alias("n"))
        out = out.unionByName(_facts(g, kind, F.col("key"), F.col("n")))
    return out


def most_duplicated(classified: DataFrame, n: int = 5) -> DataFrame:
    """file, topic, n of the n topics that most chunks of a file have; ties by name."""
    g = classified.select("file", F.explode("topics").alias("topic")).groupBy("file", "topic").agg(F.count("*").alias("n"))
    w = Window.partitionBy("file").orderBy(F.desc("n"), "topic")
    return g.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def combined_summary(classified: DataFrame, red: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row over the files that have redundancies: files, chunks, redundant pairs, clusters, and critical and high pairs."""
    files = red.select("file").distinct()
    chunks = classified.join(files, "file", "left_semi").agg(F.count("*").alias("total_chunks"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n_pairs"))), F.lit(0)).alias(f"{s}_count")
    r = red.agg(F.countDistinct("file").alias("files_analyzed"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("total_redundancies"), of("critical"), of("high"))
    return r.join(chunks, F.lit(True)).join(clusters.agg(F.count("*").alias("total_clusters")), F.lit(True))
