"""Word rules as data, and their tests as Spark expressions on text in lower case.

A pattern stands between word ends unless it begins or ends with ~. Each is tried only
where the words are that it needs whole, which are looked up, or else where a run of
letters that it can't do without is in the text, which is a plain search.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOPICS = {
    "archetype": r"archetype builder dreamer paper.chaser planner survivor",
    "career": "career employer employment experience job occupation profession seniority work",
    "citizenship": "citizen national naturaliz passport",
    "document": "assessment certificate document evaluation paperwork transcript 认证",
    "education": "academic credential degree diploma education enrollment graduation school university",
    "family": "children dependents family household marital parent partner spouse",
    "financial": "afford budget cost financial funds income money revenue salary savings wealth",
    "inquiry": "always.*ask ask assume don.t.*assume inquir never.*skip probe question",
    "language": "english fluent ielts language linguistic native proficiency pte toefl",
    "pathway": "category eligibility pathway program qualification route stream",
    "risk": "barrier criminal danger denial impossib inadmiss refusal risk",
    "settlement": "adapt community diaspora integrat network settl social",
    "sovereignty": "autonomy diversif independence self.sufficient sovereignty",
    "timeline": "deadline duration processing schedule timeframe timeline wait",
    "visa": "border entry immigration migrant overstay passport permit status visa",
}
_WORD = r"[\p{L}\p{N}_]"
SCOPES = {
    "global": "always critical mandatory never required universal",
    "in_process": "application applied in.process waiting",
    "post_immigration": "citizen living.abroad permanent.resident post.immigration settled",
    "pre_immigration": "exploring planning pre.immigration ready",
    "turn_specific": rf"turn\s*\d turn\s*\d+[-+](?={_WORD})~",
}
#: Families in order of precedence.
INTENTS = {
    "constraint": ["avoid", "do not", "don'?t", "must not", "never", "never assume", "never repeat", "never skip", "not.*allowed", "prohibited", "shall not", "skip"],
    "mandate": ["always", "always ask", "always include", "critical", "hard rule", "important", "mandatory", "must", "need to", "never.*skip", "required", "shall"],
    "workflow": [r"after.*(?:answer|reply|response)~", r"before.*(?:continue|move|proceed)~", "finally", "firs(?:tly|t)", "flow", "followed by", "next", "order", r"phase\s*\d~", "sequence", r"step\s*\d~", "then", r"turn\s*\d+[-+]~", r"turn\s*\d~"],
    "definition": ["consists of", "enum", "field", "has the following", "includes", "is defined as", "means", "model", "refers to", "schema", r"types?:?\s*$~", "value", "~```dart~", "~```json~"],
    "example": [r"bad:\s~", rf"e\.g\.(?={_WORD})~", "example", "for instance", r"good:\s~", "instead of", "such as", "violation", "~```~"],
    "scope": ["adapt to lifecycle", "context-aware|contextual|lifecycle-based", r"for\s+(?:exploring|in|planning|post|pre|ready|settled)", r"if\s+(?:the\s+)?(?:lifecycle|pathway|user)~", "in-process|post-immigration|pre-immigration|settled", "in_process|post_immigration|pre_immigration|settled_pr", r"when\s+(?:the\s+)?(?:lifecycle|status|user)~"],
    "question": [r"~^\s*\?\s*$~", r"ask\s+['\"]~", "inquire", "probe", "question"],
}
#: Words that make a constraint or a mandate severe.
STRICT, FIRM = ["always ask", "never assume", "never skip"], ["mandatory", "must ask", "required"]
STOP = """
about above after again all already also and are because been before being below between both but can could did does down during each ever every few for from further get going got had has have here how into its
just know let like make may might mine more most must need nor not off once only other our ours out over own same see shall should some still such sure take than that the their theirs then there these they think
this those through too under use very want was were what when where which while who whom whose why will with would yet you your yours
""".split()  # fmt: skip


def java(pattern: str) -> str:
    left, right = pattern.startswith("~"), pattern.endswith("~")
    return "(?md)" + ("" if left else f"(?<!{_WORD})") + "(?:" + pattern.strip("~") + ")" + ("" if right else f"(?!{_WORD})")


def _plain(pattern: str) -> str:
    """A pattern with what isn't plain characters as zeros."""
    p = re.sub(r"\(\?[^()]*(?:\([^()]*\)[^()]*)*\)\??", "\0", pattern.strip("~"))
    p = re.sub(r"\\([.?])(?![?*+])", lambda m: {".": "\1", "?": "\2"}[m[1]], p)
    p = re.sub(r"\[[^\]]*\][+*?]?|\\?.[?*]|\\.\+?|[\^$+.|]", "\0", p)
    return p.replace("\1", ".").replace("\2", "?")


def needle(pattern: str) -> str:
    """The longest run of plain characters that every match has; empty if none is found."""
    return max(_plain(pattern).split("\0"), key=len)


def needed(pattern: str) -> list[str]:
    """Words that every text with a match has, as whole ones: between spaces, or between a space and an end that is a word's."""
    if "|" in re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "", pattern):
        return []
    left, right = pattern.startswith("~"), pattern.endswith("~")
    p = _plain(re.sub(r"\\s\+", " ", pattern))
    return re.findall(r"(?<![^ ])[a-z]+(?![^ ])", "\0" * left + p + "\0" * right)


#: A pattern of word characters only, which is one whole word of a text.
PLAIN = re.compile(r"\w+")


def words(text: Column) -> Column:
    """The words of a text in lower case, each once, as far as a rule names them whole."""
    named = {p for r in (TOPICS, SCOPES) for ws in r.values() for p in ws.split()} | {p for ps in INTENTS.values() for p in ps}
    named = {x for w in named for v in ([w] if "(" in w else w.split("|")) for x in _spelt(v)} | {*STRICT, *FIRM}
    named = sorted({p for p in named if PLAIN.fullmatch(p)} | {w for p in named for w in needed(p)})
    return F.array_intersect(F.array(*map(F.lit, named)), F.split(text, r"[^\p{L}\p{N}_]+"))


def _one(text: Column, pattern: str, found: Column | None = None) -> Column:
    if found is not None and PLAIN.fullmatch(pattern):
        return F.array_contains(found, pattern)
    hit, n, own = text.rlike(java(pattern)), needle(pattern), needed(pattern) if found is not None else []
    if own:
        return reduce(lambda a, b: a & b, [F.array_contains(found, w) for w in own]) & hit
    return text.rlike(re.escape(n)) & hit if n else hit  # for plain characters a pattern is faster than contains


def _spelt(pattern: str) -> list[str]:
    """A word with a character that may be missing, without and with it."""
    m = re.fullmatch(r"([a-z]+)([a-z'])\?([a-z]+)", pattern)
    return [m[1] + m[3], m[1] + m[2] + m[3]] if m else [pattern]


def has(text: Column, pattern: str, found: Column | None = None) -> Column:
    """Whether a text in lower case matches; alternatives outside of groups are tried one by one. found: its words, so that plain ones are looked for once."""
    parts = [pattern] if "(" in pattern else pattern.split("|")
    parts = [x for p in parts for x in _spelt(p)]
    return reduce(lambda a, b: a | b, [_one(text, p, found) for p in parts])


def labels(text: Column, rules: dict[str, str], found: Column | None = None) -> Column:
    """Names of the rules of which a word hits a text in lower case, in order, as an array."""
    # plain words first, as they cost least
    ordered = lambda ws: sorted(ws.split(), key=lambda w: not PLAIN.fullmatch(w))
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [_one(text, w, found) for w in ordered(ws)]), F.lit(k)) for k, ws in rules.items()]))


def hits(text: Column, patterns: list[str], found: Column | None = None) -> Column:
    return reduce(lambda a, b: a + b, [has(text, p, found).cast("int") for p in patterns])


def polarity(text: Column) -> Column:
    """negative, positive or neutral; what forbids goes first."""
    t = F.lower(text)
    return F.when(has(t, "avoid|do not|must not|never|skip"), "negative").when(has(t, "always|ask|include|mandatory|must|required"), "positive").otherwise("neutral")


def action_phrase(text: Column) -> Column:
    """What an instruction is about: the words after the first modal, else after the first verb of asking; empty if there is none."""
    end = r"\s+([\p{L}\p{N}_\s]{3,30}?)(?:\.|,|for|when|if|$)"
    first = [F.trim(F.lower(F.regexp_extract(text, f"(?is)(?:{words}){end}", 1)), F.lit(" \t\n\r\f\x0b")) for words in ("never|always|must|must not|do not|skip", "ask|skip|assume|include|avoid")]
    return F.when(first[0] != "", first[0]).otherwise(first[1])


def negates(a: Column, b: Column) -> Column:
    """Whether two instructions are about one action with opposite polarity."""
    return (action_phrase(a) != "") & (action_phrase(a) == action_phrase(b)) & (polarity(a) != polarity(b))
