"""Instruction and runtime queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import action_phrase, negates, polarity
from ..operators import incremental as inc
from ..operators import instructions as ins
from ..operators import runtime as rt
from ..operators import startup as su
from ..sources.adapters import CHUNK, CODE, view
from ..sources.scratch import materialize

def _spread(d):
    return d.repartition(d.sparkSession.sparkContext.defaultParallelism)


def _chunks(spark, sf):
    return _spread(view(spark, sf, CHUNK))


def _classified(spark, sf):
    return ins.classify(ins.annotate(_chunks(spark, sf)))


def _sig(spark, sf):
    return materialize(ins.signatures(_classified(spark, sf)), "signatures")


def chunk_topics(spark, sf):
    d = ins.annotate(_chunks(spark, sf))
    return d.select("file", "seq", F.array_join("topics", ",").alias("topics"), F.array_join("question_ids", ",").alias("question_ids"), "word_count")


def chunk_scopes(spark, sf):
    return ins.annotate(_chunks(spark, sf)).select(F.explode("scopes").alias("scope")).groupBy("scope").agg(F.count("*").alias("n"))


def intent_classify(spark, sf):
    return _classified(spark, sf).select("file", "seq", F.array_join("intents", ",").alias("intents"), "primary_intent", "confidence")


def severity(spark, sf):
    return _classified(spark, sf).select("file", "seq", "severity")


def topic_collisions(spark, sf):
    return ins.topic_collisions(_sig(spark, sf))


def scope_conflicts(spark, sf):
    return ins.scope_conflicts(_sig(spark, sf))


def contradictions(spark, sf):
    return ins.contradictions(_sig(spark, sf))


def semantic_duplicates(spark, sf):
    return ins.semantic_duplicates(_chunks(spark, sf))


def chunk_polarity(spark, sf):
    """Each chunk's sentence: its polarity and what it is about."""
    t = F.element_at(F.split("text", r"\.\s"), -1)
    return _chunks(spark, sf).select("file", "seq", polarity(t).alias("polarity"), (action_phrase(t) != "").alias("has_action"), negates(t, F.concat(F.lit("Never "), t)).alias("negated"))


def _detected(spark, sf):
    c = materialize(_classified(spark, sf).drop("text"), "classified")
    sig, sets = materialize(ins.signatures(c), "signatures"), ins.keyword_sets(_chunks(spark, sf))
    return c, sig, sets, materialize(ins.redundancies(sig, ins.similar_sets(sets)), "redundancies")


def redundancy_dedupe(spark, sf):
    return ins.redundancy_counts(_detected(spark, sf)[3])


def redundancy_clusters(spark, sf):
    return ins.redundancy_clusters(*_detected(spark, sf))


def instruction_summary(spark, sf):
    c, sig, sets, red = _detected(spark, sf)
    return ins.summary(c, red, ins.redundancy_clusters(c, sig, sets, red))


def most_duplicated(spark, sf):
    return ins.most_duplicated(_classified(spark, sf))


def combined_summary(spark, sf):
    c, sig, sets, red = _detected(spark, sf)
    return ins.combined_summary(c, red, ins.redundancy_clusters(c, sig, sets, red))


def _code(spark, sf):
    """The files as a table of their own, as a scan gives them, in as many parts as there are cores."""
    return materialize(_spread(view(spark, sf, CODE)), "code")


def changed_files(spark, sf):
    now = inc.file_hashes(_code(spark, sf))
    old = _code(spark, sf).where("seq % 9 <> 0").withColumn("content", F.when(F.col("seq") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return inc.changed_files(now, inc.file_hashes(old).unionByName(spark.createDataFrame([("gone.py", "0")], "path string, sha256 string")))


def file_hash(spark, sf):
    return inc.file_hashes(_code(spark, sf))


def coverage_summary(spark, sf):
    return rt.coverage_summary(rt.coverage_map(_code(spark, sf)))


def test_split(spark, sf):
    return rt.test_files(_code(spark, sf)).drop("seq")


def _on_code(f):
    return lambda spark, sf: f(_code(spark, sf))


QUERIES = {f.__name__: f for f in (chunk_topics, chunk_scopes, intent_classify, severity, topic_collisions, scope_conflicts, contradictions, semantic_duplicates, redundancy_dedupe, redundancy_clusters, instruction_summary, most_duplicated, combined_summary, chunk_polarity, changed_files, file_hash, coverage_summary, test_split)}
QUERIES |= {k: _on_code(f) for k, f in {"entry_points": rt.entry_points, "env_vars": rt.env_vars, "feature_flags": rt.feature_flags, "constants": rt.constants, "api_urls": rt.api_urls, "secrets": rt.secrets, "test_coverage_map": rt.coverage_map, "risk_assess": rt.risk_assess, "file_naming": rt.file_naming, "class_naming": rt.class_naming, "import_style": rt.import_style, "error_handling": rt.error_handling, "frameworks": rt.frameworks, "directory_structure": rt.directory_structure, "architecture": rt.architecture, "config_files": rt.config_files, "comment_style": rt.comment_style, "initializations": su.initializations, "framework_inits": su.framework_inits, "initial_route": su.initial_route, "entry_summary": lambda f: rt.entry_summary(rt.entry_points(f))}.items()}

_W = r"[^\p{L}\p{N}_]"


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


#: A pattern between word ends, each written as RE2 reads it; ( ) at an end leaves it open.
_TOPICS = {
    "archetype": "paper.chaser|builder|survivor|planner|dreamer|archetype", "career": "experience|seniority|occupation|employer|work|profession|job|employment|career", "citizenship": "national|passport|naturaliz|citizen",
    "document": "认证|evaluation|assessment|transcript|certificate|paperwork|document", "education": "graduation|enrollment|credential|academic|school|university|diploma|degree|education",
    "family": "household|marital|parent|dependents|children|partner|spouse|family", "financial": "afford|wealth|money|funds|cost|budget|revenue|salary|income|savings|financial",
    "inquiry": "don.t.*assume|always.*ask|never.*skip|probe|question|inquir|assume|ask", "language": "fluent|native|linguistic|proficiency|pte|toefl|ielts|english|language",
    "pathway": "qualification|eligibility|category|program|stream|route|pathway", "risk": "inadmiss|criminal|denial|refusal|impossib|barrier|danger|risk", "settlement": "diaspora|network|social|community|adapt|integrat|settl",
    "sovereignty": "diversif|self.sufficient|autonomy|independence|sovereignty", "timeline": "schedule|timeframe|duration|wait|processing|deadline|timeline", "visa": "overstay|entry|border|passport|migrant|immigration|status|permit|visa",
}
_SCOPES = {"global": "always|never|critical|mandatory|required|universal", "in_process": "in.process|applied|waiting|application", "post_immigration": "post.immigration|settled|permanent.resident|citizen|living.abroad", "pre_immigration": "pre.immigration|exploring|planning|ready", "turn_specific": r"turn\s*\d"}
_INTENTS = {
    "constraint": r"never;do not;must not;shall not;avoid;skip;prohibited;don'?t;not.*allowed;never skip;never repeat;never assume",
    "mandate": "always;must;required;mandatory;shall;need to;important;critical;always ask;always include;hard rule;never.*skip",
    "workflow": r"turn\s*\d( );turn\s*\d+[-+]( );step\s*\d( );phase\s*\d( );then;followed by;after.*(answer|response|reply)( );before.*(proceed|continue|move)( );flow;sequence;order;first|firstly;next;finally",
    "definition": "is defined as;means;refers to;consists of;includes;has the following;types?:?\\s*$( );model;schema;field;enum;value;( )```json( );( )```dart( )",
    "example": r"example;good:\s( );bad:\s( );violation;instead of;e\.g\.[\p{L}\p{N}_]( );such as;for instance;( )```( )",
    "scope": r"for\s+(pre|post|in|settled|exploring|planning|ready);when\s+(the\s+)?(user|lifecycle|status)( );if\s+(the\s+)?(user|lifecycle|pathway)( );pre-immigration|in-process|post-immigration|settled;pre_immigration|in_process|post_immigration|settled_pr;adapt to lifecycle;lifecycle-based|context-aware|contextual",
    "question": r"( )^\s*\?\s*$( );ask\s+['\"]( );question;inquire;probe",
}
_STOP = "yours,your,you,yet,would,with,will,why,whose,whom,who,while,which,where,when,what,were,was,want,very,use,under,too,through,those,this,think,they,these,there,then,theirs,their,the,that,than,take,sure,such,still,some,should,shall,see,same,own,over,out,ours,our,other,only,once,off,not,nor,need,must,most,more,mine,might,may,make,like,let,know,just,its,into,how,here,have,has,had,got,going,get,further,from,for,few,every,ever,each,during,down,does,did,could,can,but,both,between,below,being,before,been,because,are,and,also,already,all,again,after,above,about"


def _hit(p):
    left, right = p.startswith("( )"), p.endswith("( )")
    return "regexp_matches(text, " + _lit("(?im)" + ("" if left else f"(^|{_W})") + "(" + p.replace("( )", "") + ")" + ("" if right else f"($|{_W})")) + ")"


def _action(text):
    part = lambda words: rf"trim(lower(regexp_extract({text}, '(?is)(?:{words})\s+([\p{{L}}\p{{N}}_\s]{{3,30}}?)(?:\.|,|for|when|if|$)', 1)), ' ' || chr(9) || chr(10))"
    return f"coalesce(nullif({part('never|always|must|must not|do not|skip')}, ''), {part('ask|skip|assume|include|avoid')})"


def _labels(rules):
    return "list_filter([" + ", ".join(f"CASE WHEN {_hit(w)} THEN '{k}' END" for k, w in rules.items()) + "], lambda x: x IS NOT NULL)"


_TURNS = r"regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])turn\s*\d+[-+][\p{L}\p{N}_]')"
_SCOPE = _labels(_SCOPES).replace(f"CASE WHEN {_hit(_SCOPES['turn_specific'])}", f"CASE WHEN {_hit(_SCOPES['turn_specific'])} OR {_TURNS}")
_A = f"a AS (SELECT file, seq, text, {_labels(_TOPICS)} AS topics, {_SCOPE} AS scopes FROM ({CHUNK}))"
_SC = "sc AS (SELECT *, " + ", ".join("(" + " + ".join(f"CAST({_hit(p)} AS INT)" for p in ps.split(";")) + f") AS s_{k}" for k, ps in _INTENTS.items()) + " FROM a)"
_TOP = "greatest(" + ", ".join(f"s_{k}" for k in _INTENTS) + ")"
_TOTAL = "(" + " + ".join(f"s_{k}" for k in _INTENTS) + ")"
_C = f"""c AS (SELECT file, seq, text, topics, scopes, list_filter([{', '.join(f"CASE WHEN s_{k} > 0 THEN '{k}' END" for k in _INTENTS)}], lambda x: x IS NOT NULL) AS intents,
  CASE WHEN {_TOP} = 0 THEN 'unknown' {' '.join(f"WHEN s_{k} = {_TOP} THEN '{k}'" for k in _INTENTS)} END AS primary_intent,
  CASE WHEN {_TOTAL} = 0 THEN 0.0::DOUBLE ELSE round({_TOP}::DOUBLE / {_TOTAL}, 6) END AS confidence FROM sc)"""
_S = f"""s AS MATERIALIZED (SELECT *, CASE WHEN list_contains(intents, 'constraint') AND list_contains(intents, 'mandate') THEN 'critical'
  WHEN primary_intent = 'constraint' THEN CASE WHEN {_hit('never skip|always ask|never assume')} THEN 'high' ELSE 'medium' END
  WHEN primary_intent = 'mandate' THEN CASE WHEN {_hit('required|must ask|mandatory')} THEN 'high' ELSE 'medium' END
  WHEN primary_intent IN ('definition', 'example') THEN 'low' ELSE 'medium' END AS severity FROM c)"""
_CL = f"WITH RECURSIVE {_A}, {_SC}, {_C}, {_S}"
_SIG = _CL + """, sig AS (SELECT file, primary_intent AS intent, array_to_string(topics, ',') AS topics, array_to_string(scopes, ',') AS scopes, min(seq) AS first_seq, count(*) AS n FROM s WHERE len(topics) > 0 GROUP BY 1, 2, 3, 4
), col AS (SELECT file, intent, topics, min(first_seq) AS first_seq, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) * (sum(n) - 1) / 2 AS BIGINT) AS n_pairs,
    CASE WHEN intent = 'mandate' OR topics = 'inquiry' OR (list_contains(string_split(topics, ','), 'inquiry') AND list_contains(string_split(topics, ','), 'education')) THEN 'high' ELSE 'medium' END AS severity
  FROM sig WHERE intent IN ('constraint', 'mandate') GROUP BY 1, 2, 3 HAVING sum(n) > 1
), pr AS (SELECT x.file, x.first_seq AS a, y.first_seq AS b, x.n * y.n AS n_pairs, x.intent AS ia, y.intent AS ib, list_filter(string_split(x.scopes, ','), lambda v: v <> '') AS sa, list_filter(string_split(y.scopes, ','), lambda v: v <> '') AS sb
  FROM sig x JOIN sig y ON x.file = y.file AND x.first_seq < y.first_seq AND list_has_any(string_split(x.topics, ','), string_split(y.topics, ','))
), scp AS (SELECT file, a, b, n_pairs, 'medium' AS severity FROM pr WHERE ia IN ('constraint', 'mandate') AND ib IN ('constraint', 'mandate') AND len(sa) > 0 AND len(sb) > 0 AND NOT list_has_any(sa, sb)
), con AS (SELECT file, a, b, n_pairs, 'high' AS severity FROM (SELECT file, a, b, n_pairs, ia, ib, list_filter(sa, lambda v: v NOT IN ('global', 'turn_specific')) AS sa, list_filter(sb, lambda v: v NOT IN ('global', 'turn_specific')) AS sb FROM pr)
  WHERE ia = 'mandate' AND ib = 'mandate' AND len(sa) > 0 AND len(sb) > 0 AND NOT list_has_any(sa, sb))"""
_KW = f"list_sort(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains(string_split('{_STOP}', ','), x)))"
#: Pairs of chunks, one by one, by the definitions of the four kinds.
_RED = _CL + f""", k AS MATERIALIZED (SELECT *, {_KW} AS w, primary_intent IN ('constraint', 'mandate') AS strict, list_filter(scopes, lambda v: v NOT IN ('global', 'turn_specific')) AS narrow FROM s
), t AS (SELECT file, seq, unnest(w) AS t FROM k
), sh AS (SELECT x.file, x.seq AS a, y.seq AS b, count(*) AS n FROM t x JOIN t y ON x.file = y.file AND x.t = y.t AND x.seq < y.seq GROUP BY 1, 2, 3
), p AS (SELECT x.file, x.seq AS a, y.seq AS b, x.strict AND y.strict AS strict, x.primary_intent AS ia, y.primary_intent AS ib, x.topics AS ta, y.topics AS tb, list_has_any(x.topics, y.topics) AS same,
    len(x.scopes) > 0 AND len(y.scopes) > 0 AND NOT list_has_any(x.scopes, y.scopes) AS apart, len(x.narrow) > 0 AND len(y.narrow) > 0 AND NOT list_has_any(x.narrow, y.narrow) AS contrary
  FROM k x JOIN k y ON x.file = y.file AND x.seq < y.seq
), red AS MATERIALIZED (
  SELECT file, a, b, 'topic_collision' AS type, CASE WHEN ia = 'mandate' OR ta = ['inquiry'] OR list_has_all(ta, ['inquiry', 'education']) THEN 'high' ELSE 'medium' END AS severity, NULL::DOUBLE AS similarity FROM p WHERE strict AND ia = ib AND ta = tb AND len(ta) > 0
  UNION ALL SELECT file, a, b, 'scope_conflict', 'medium', NULL FROM p WHERE strict AND same AND apart
  UNION ALL SELECT file, a, b, 'contradiction', 'high', NULL FROM p WHERE ia = 'mandate' AND ib = 'mandate' AND same AND contrary
  UNION ALL SELECT file, a, b, 'semantic_duplicate', CASE WHEN j >= 0.8 THEN 'high' ELSE 'medium' END, j FROM (
    SELECT sh.file, a, b, round(n / (len(x.w) + len(y.w) - n), 6) AS j FROM sh JOIN k x ON x.file = sh.file AND x.seq = a JOIN k y ON y.file = sh.file AND y.seq = b WHERE 100 * n >= 65 * (len(x.w) + len(y.w) - n))
), u AS (SELECT file, a, b FROM red UNION SELECT file, b, a FROM red
), walk(file, root, id) AS (SELECT DISTINCT file, a, a FROM u UNION SELECT walk.file, root, b FROM walk JOIN u ON u.file = walk.file AND u.a = id
), g AS MATERIALIZED (SELECT file, id, min(root) AS first_seq FROM walk GROUP BY file, id
), tn AS (SELECT g.file, first_seq, topic, row_number() OVER (PARTITION BY g.file, first_seq ORDER BY count(*) DESC, topic) AS r FROM g JOIN (SELECT file, seq, unnest(topics) AS topic FROM s) s ON s.file = g.file AND s.seq = g.id GROUP BY 1, 2, 3
), cl AS (SELECT g.file, g.first_seq, count(*) AS size, coalesce(any_value(topic), 'unknown') AS topic, any_value(avg_similarity) AS avg_similarity, any_value(severity) AS severity FROM g
  JOIN (SELECT g.file, first_seq, round(coalesce(avg(similarity), 0), 6) AS avg_similarity, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity FROM red JOIN g ON g.file = red.file AND g.id = red.a GROUP BY 1, 2) v ON v.file = g.file AND v.first_seq = g.first_seq
  LEFT JOIN tn ON tn.file = g.file AND tn.first_seq = g.first_seq AND r = 1 GROUP BY 1, 2)"""
_NAME = "regexp_extract(path, '[^/]*$')"
_EXT = "lower(regexp_extract(path, '\\.[^./]*$'))"
_LANG = f"CASE {_EXT} WHEN '.dart' THEN 'dart' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.rb' THEN 'ruby' WHEN '.php' THEN 'php' END"
_CODE = f"WITH f AS (SELECT *, {_LANG} AS lang FROM ({CODE})), s AS (SELECT * FROM f WHERE lang IS NOT NULL)"
_LINES = _CODE + ", l AS (SELECT path, lang, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM s)"
_Q = "[''\"]"


def _case(rules, column="text"):
    """CASE of (condition on lang, pattern, result) in order."""
    return "CASE " + " ".join(f"WHEN lang IN ({langs}) AND regexp_matches({column}, '{rx}') THEN {out}" for langs, rx, out in rules) + " END"


_KIND = _case([
    ("'python'", f"if\\s+__name__\\s*==\\s*{_Q}__main__{_Q}", "'main'"), ("'python'", "app\\s*=\\s*(Flask|FastAPI|Django)\\s*\\(", "'server'"), ("'python'", "def\\s+main\\s*\\(", "'main'"), ("'python'", "(?i)manage\\.py", "'cli'"),
    ("'javascript', 'typescript'", "app\\.listen\\s*\\(|createServer\\s*\\(|express\\s*\\(|next\\s*\\(", "'server'"), ("'javascript', 'typescript'", "export\\s+default\\s+function", "'export'"),
    ("'dart'", "void\\s+main\\s*\\(\\s*\\)|runApp\\s*\\(|GetMaterialApp\\s*\\(|MaterialApp\\s*\\(|CupertinoApp\\s*\\(", "'app'"), ("'java'", "public\\s+static\\s+void\\s+main\\s*\\(", "'main'"), ("'java'", "@SpringBootApplication", "'server'"),
    ("'go'", "func\\s+main\\s*\\(", "'main'"), ("'go'", "package\\s+main", "'package'"), ("'go'", "http\\.ListenAndServe\\s*\\(|gin\\.Default\\s*\\(\\)|echo\\.New\\s*\\(\\)", "'server'"),
    ("'rust'", "fn\\s+main\\s*\\(", "'main'"), ("'rust'", "#\\[tokio::main\\]", "'async_main'"), ("'rust'", "actix_web|axum|warp", "'server'"), ("'ruby'", "Rails\\.application\\.run|Sinatra::Application", "'server'"), ("'ruby'", "if\\s+__FILE__\\s*==\\s*__FILE__", "'main'"),
    ("'php'", "public\\s+function\\s+index\\s*\\(", "'controller'"), ("'php'", "Route::|->get\\(|->post\\(", "'route'"), ("'php'", "Laravel|Symfony", "'framework'"),
])
_STARTS = "CASE lang " + " ".join(f"WHEN '{k}' THEN lower({_NAME}) IN ({', '.join(map(_lit, v.split()))})" for k, v in {"dart": "main.dart app.dart", "python": "main.py app.py manage.py __main__.py wsgi.py asgi.py", "javascript": "index.js server.js app.js main.js", "typescript": "index.ts server.ts app.ts main.ts", "java": "main.java application.java app.java", "go": "main.go", "rust": "main.rs lib.rs", "ruby": "config.ru application.rb", "php": "index.php"}.items()) + " END"
_EP = _LINES + f", ep AS (SELECT * FROM (SELECT path, lang, line, {_KIND} AS kind, {_STARTS} AS entry_file FROM l) WHERE kind IS NOT NULL)"
_G = "regexp_extract_all(text, '{0}', 1)"
_ENVS = "CASE lang " + " ".join("WHEN '" + k + "' THEN " + " || ".join(_G.format(rx) for rx in v) for k, v in {
    "python": [f"os\\.environ\\s*\\[{_Q}(\\w+){_Q}\\]", f"os\\.environ\\.get\\s*\\({_Q}(\\w+){_Q}", f"os\\.getenv\\s*\\({_Q}(\\w+){_Q}"], "javascript": ["process\\.env\\.(\\w+)", f"process\\.env\\s*\\[{_Q}(\\w+){_Q}\\]"], "typescript": ["process\\.env\\.(\\w+)", f"process\\.env\\s*\\[{_Q}(\\w+){_Q}\\]"],
    "dart": [f"Platform\\.environment\\s*\\[{_Q}(\\w+){_Q}\\]", f"String\\.fromEnvironment\\s*\\({_Q}(\\w+){_Q}\\)", f"bool\\.fromEnvironment\\s*\\({_Q}(\\w+){_Q}\\)"], "java": [f"System\\.getenv\\s*\\({_Q}(\\w+){_Q}\\)", f"System\\.getProperty\\s*\\({_Q}(\\w+){_Q}\\)"],
    "go": [f"os\\.Getenv\\s*\\({_Q}(\\w+){_Q}\\)", f"os\\.LookupEnv\\s*\\({_Q}(\\w+){_Q}\\)"], "rust": [f"std::env::var\\s*\\({_Q}(\\w+){_Q}\\)", f"env!\\s*\\({_Q}(\\w+){_Q}\\)"], "ruby": [f"ENV\\s*\\[{_Q}(\\w+){_Q}\\]"], "php": [f"getenv\\s*\\({_Q}(\\w+){_Q}\\)", f"\\$_ENV\\s*\\[{_Q}(\\w+){_Q}\\]"],
}.items()) + " END"
_ENV = _LINES + f""", e AS (SELECT path, line, name, regexp_matches(name, '(?i)api_?key|secret|password|token|credential|auth|private_?key|access_?key') AS secret,
  lang = 'rust' AND NOT list_contains({_G.format(f"std::env::var\\s*\\({_Q}(\\w+){_Q}\\)")}, name) AS compile_time FROM (SELECT path, lang, line, text, unnest(list_distinct({_ENVS})) AS name FROM l))"""
_NONE = "CAST(NULL AS VARCHAR)"


def _x(rx, group=1):
    return f"CASE WHEN regexp_matches(text, '{rx}') THEN regexp_extract(text, '{rx}', {group}) END"


def _items(rules, more=""):
    """Items of a line by kind; of equal names the first."""
    all_ = " UNION ALL ".join(f"SELECT path, line, {name} AS name, '{k}' AS type, {i} AS r{more} FROM l" for i, (k, name) in enumerate(rules))
    return _LINES + f", i AS ({all_}) SELECT * EXCLUDE (r, k) FROM (SELECT *, row_number() OVER (PARTITION BY path, line, name ORDER BY r) AS k FROM i WHERE name IS NOT NULL) WHERE k = 1"


_TESTS_ = [("'dart'", "_test\\.dart$", "true"), ("'python'", "(test_\\w+\\.py|_test\\.py)$", "true"), ("'javascript'", "(\\.test\\.|\\.spec\\.)(js|jsx|ts|tsx)$", "true"), ("'typescript'", "(\\.test\\.|\\.spec\\.)(ts|tsx)$", "true"), ("'java'", "(Test\\.java|Tests\\.java)$", "true"), ("'go'", "_test\\.go$", "true"), ("'rust'", "(_test\\.rs$|tests/)", "true"), ("'ruby'", "_test\\.rb$|_spec\\.rb$", "true"), ("'php'", "Test\\.php$", "true")]
_TEST = f"coalesce({_case(_TESTS_, _NAME)}, false)"
_STEM = f"replace(regexp_replace({_NAME}, '\\.[^.]*$', ''), '_', '')"
_RISK = f"CASE WHEN regexp_matches(lower({_NAME}), 'auth|user|payment|security|database|repository|service|orchestrator|engine') THEN 'high' WHEN regexp_matches(lower({_NAME}), 'provider|controller|bloc|screen|page') THEN 'medium' ELSE 'low' END"
_FW = _case([
    ("'dart'", f"import\\s+{_Q}package:flutter_test", "'flutter_test'"), ("'dart'", f"import\\s+{_Q}package:mockito", "'mockito'"), ("'dart'", f"import\\s+{_Q}package:mocktail", "'mocktail'"), ("'dart'", f"import\\s+{_Q}package:bloc_test", "'bloc_test'"),
    ("'python'", "import\\s+pytest|@pytest\\.|def\\s+test_", "'pytest'"), ("'python'", "import\\s+unittest|class\\s+\\w+\\(unittest\\.TestCase", "'unittest'"), ("'javascript', 'typescript'", "describe|it|test|expect|jest\\.", "'jest'"),
    ("'javascript'", "describe|it|expect|assert", "'mocha'"), ("'javascript', 'typescript'", "describe|it|test|expect|vi\\.", "'vitest'"), ("'javascript'", "cy\\.|describe|it|expect", "'cypress'"), ("'java'", "@Test|@Before|@After|import\\s+org\\.junit", "'junit4'"),
    ("'java'", "mock\\(|when\\(|verify\\(", "'mockito'"), ("'go'", "import\\s+\"testing\"", "'testing'"), ("'go'", "assert\\.|require\\.", "'testify'"), ("'rust'", "#\\[test\\]", "'built_in'"), ("'rust'", "#\\[rstest\\]", "'rstest'"),
    ("'ruby'", "class\\s+\\w+<\\s*Test::Unit|def\\s+test_", "'minitest'"), ("'ruby'", "describe|context|it|expect", "'rspec'"), ("'php'", "class\\s+\\w+Tests?\\s+extends|function\\s+test", "'phpunit'"),
], "content")
_NT = "CASE lang " + " ".join(f"WHEN '{k}' THEN len(regexp_extract_all(content, '{rx}'))" for k, rx in {"dart": "test\\s*\\([\"'']|testWidgets\\s*\\([\"'']", "python": "def\\s+test_\\w+|def\\s+test\\s*\\(", "javascript": "(?:it|test)\\s*\\([\"'']", "typescript": "(?:it|test)\\s*\\([\"'']", "java": "@Test", "go": "func\\s+Test\\w+", "rust": "#\\[test\\]", "ruby": "def\\s+test_\\w+|it\\s+[''\"]", "php": "function\\s+test\\w+"}.items()) + " END"
_FAM = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, '{rx}') THEN '{k}' END" for k, rx in {"assertions": "expect|assert|assertEquals|assertThat|assertThrows|require\\.\\w+", "fixtures": "fixture|setUp|setUpAll|tearDown|beforeEach|afterEach|@Before|@After", "mocking": "mock|Mock|mock\\(|when\\(|verify\\(|@Mock|@InjectMocks|@Spy", "snapshot": "toMatchSnapshot|toMatchInlineSnapshot|expectLater"}.items()) + "], lambda x: x IS NOT NULL), ',')"
_IMP = "array_to_string(CASE lang " + " ".join(f"WHEN '{k}' THEN list_filter(regexp_extract_all(content, '{rx}', 1), lambda x: NOT regexp_matches(x, '^({std})'))" for k, rx, std in (
    ("dart", f"import\\s+{_Q}([^''\"]+){_Q}", "dart:|package:flutter/|package:collection/|package:meta/"), ("python", "(?:from|import)\\s+([\\w.]+)", "os|sys|re|json|typing|pathlib|collections|unittest|pytest"), ("javascript", f"(?:import|require)\\s*\\(?{_Q}([^''\"]+){_Q}", "node:|fs|path|http|https|crypto"),
    ("typescript", f"(?:import|require)\\s*\\(?{_Q}([^''\"]+){_Q}", "node:|fs|path|http|https|crypto"), ("java", "import\\s+([\\w.]+)", "java\\.|javax\\.|org\\.junit"), ("go", f"import\\s+{_Q}([^''\"]+){_Q}", "fmt|os|io|net|strings|testing"), ("rust", "use\\s+([\\w:]+)", "std::|core::|alloc::"),
    ("ruby", f"require{_Q}([^''\"]+){_Q}", "ruby|test/unit"), ("php", f"(?:use|require|include)\\s+{_Q}([^''\"]+){_Q}", "PHP|PHPUnit"))) + " END, ',')"
_TESTS = _CODE + f""", t AS (SELECT path, seq, {_STEM} AS k, coalesce({_FW}, 'unknown') AS framework, CAST({_NT} AS BIGINT) AS test_count, {_FAM} AS families, {_IMP} AS imports FROM s WHERE {_TEST}
), m AS (SELECT path, {_RISK} AS untested, (SELECT {{'p': t.path, 'n': t.test_count}} FROM t WHERE contains(t.k, {_STEM.replace('path', 's.path')}) ORDER BY t.seq, t.path LIMIT 1) AS b FROM s WHERE NOT {_TEST}
), cov AS (SELECT path, b.p AS test_path, coalesce(b.n, 0) AS test_count, CASE WHEN coalesce(b.n, 0) = 0 THEN 'none' WHEN b.n <= 2 THEN 'low' WHEN b.n <= 5 THEN 'medium' WHEN b.n <= 10 THEN 'high' ELSE 'full' END AS estimate,
    CASE WHEN b IS NULL THEN untested WHEN b.n > 5 THEN 'low' ELSE 'medium' END AS risk FROM m)"""
_STYLES = [("snake_case", "^[a-z][a-z0-9]*(_[a-z0-9]+)*\\.\\w+$"), ("camelCase", "^[a-z][a-zA-Z0-9]*\\.\\w+$"), ("PascalCase", "^[A-Z][a-zA-Z0-9]*\\.\\w+$"), ("kebab-case", "^[a-z][a-z0-9]*(-[a-z0-9]+)*\\.\\w+$"), ("SCREAMING_SNAKE", "^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*\\.\\w+$")]
_STYLE = "CASE " + " ".join(f"WHEN regexp_matches({_NAME}, '{rx}') THEN '{k}'" for k, rx in _STYLES) + " ELSE 'other' END"
_CLASSES = {"PascalCase": "(?:class|struct|enum|interface|type|typedef)\\s+([A-Z][a-zA-Z0-9]*)", "snake_case": "(?:class|struct|enum|interface|type|typedef)\\s+([a-z][a-z0-9_]*)", "I_Prefix": "(?:class|interface|type)\\s+(I[A-Z][a-zA-Z0-9]*)", "_Prefix": "(?:class|struct)\\s+(_[A-Z][a-zA-Z0-9]*)"}


def _counts(rules):
    return _CODE + " SELECT " + ", ".join(f"count(*) FILTER ({rx if rx.startswith('(') and 'lang' in rx else f'regexp_matches(content, {chr(39)}{rx}{chr(39)})'}) AS {k}" for k, rx in rules.items()) + " FROM s"


def _lang_hit(rules):
    return "(" + " OR ".join(f"(lang IN ({langs}) AND regexp_matches(content, '{rx}'))" for langs, rx in rules) + ")"


_JT = "'javascript', 'typescript'"
_IMPORTS = {
    "absolute": _lang_hit([("'dart'", f"import\\s+{_Q}(package:|/)"), ("'python'", "(from|import)\\s+[^.]"), (_JT, f"from\\s+{_Q}(@|/)"), ("'java'", "import\\s+(com\\.|org\\.|net\\.|java\\.|javax\\.)"), ("'go'", f"import\\s+{_Q}[^. ]")]),
    "barrel": _lang_hit([("'dart'", f"import\\s+{_Q}(.+/)?(index| barrel){_Q}"), ("'typescript'", f"from\\s+{_Q}(.+/)?(index| barrel){_Q}")]),
    "relative": _lang_hit([("'dart'", f"import\\s+{_Q}(\\.\\./|\\./)"), ("'python'", "from\\s+\\."), (_JT, f"from\\s+{_Q}(\\.\\./|\\./)"), ("'go'", f"import\\s+{_Q}\\.\\.?/")]),
}
_FRAMES = {
    "flutter": f"import\\s+{_Q}package:flutter/|Flutter|runApp\\s*\\(", "react": f"import\\s+React|from\\s+{_Q}react{_Q}|jsx|JSX", "nextjs": f"import\\s+{_Q}next/|getServerSideProps|getStaticProps", "vue": f"import\\s+Vue|from\\s+{_Q}vue{_Q}|\\.vue$", "angular": f"@Component|@Injectable|@NgModule|from\\s+{_Q}@angular",
    "django": "from\\s+django|import\\s+django|urlpatterns", "flask": "from\\s+flask|import\\s+Flask", "fastapi": "from\\s+fastapi|import\\s+FastAPI", "spring": "@SpringBootApplication|@RestController|@Service", "rails": "Rails\\.application|ActiveRecord|ActiveController",
    "express": f"require\\({_Q}express{_Q}|from\\s+{_Q}express", "gin": "gin\\.Default|gin\\.New", "actix": "actix_web|#[actix_web:main]", "laravel": "Laravel|Illuminate|Route::",
}
_USED = ", x AS (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, '{rx}') THEN '{k}' END" for k, rx in _FRAMES.items()) + "], lambda v: v IS NOT NULL)) AS framework FROM s)"
_DIRS = ", p AS (SELECT string_split(path, '/') AS p FROM f), d AS (SELECT dir, level, count(*) AS n FROM (SELECT p[1] AS dir, 1 AS level FROM p WHERE len(p) > 1 UNION ALL SELECT p[1] || '/' || p[2], 2 FROM p WHERE len(p) > 2) GROUP BY 1, 2)"
_ARCH = {"layered": ("controllers services repositories models views", "controller service repository model view"), "clean_architecture": ("domain data presentation core", "entities use_cases interface_adapters frameworks domain data presentation"), "feature_based": ("features modules screens", "auth profile settings home diagnostic"),
         "mvc": ("models views controllers", "model view controller"), "mvvm": ("models views viewmodels", "model view viewmodel"), "microservices": ("services api gateway deploy", "service api gateway docker k8s")}
_SUMS = ", ".join(" + ".join(f"CAST(contains(dirs, '{w}') AS INT)" for w in ds.split()) + f" AS {k}_dirs, " + " + ".join(f"CAST(contains(names, '{w}') AS INT)" for w in ws.split()) + f" AS {k}_names" for k, (ds, ws) in _ARCH.items())
_INITS = {
    "database": "(Supabase|Firebase|MongoDB|PostgreSQL|MySQL|SQLite)\\s*\\.?\\s*(initialize|init|configure|client)", "local_storage": "(Drift|Hive|SharedPreferences|GetStorage)\\s*\\.?\\s*(open|init)", "auth": "(Auth|Authentication|Login|Session)\\s*\\.?\\s*(initialize|init|configure)",
    "state_management": "ProviderScope|MultiProvider|BlocProvider|GetBuilder|ChangeNotifierProvider", "router": "(GoRouter|GoRoute|AutoRoute|Navigator|Router)\\s*\\(", "router ": "(routes|router)\\s*[:=]", "logger": "(Logger|Log|logging)\\s*\\.?\\s*(init|configure|setup)", "cache": "(Cache|CacheManager|Redis)\\s*\\.?\\s*(init|configure)",
    "api": "(api|API|baseUrl|base_url)\\s*[:=]", "http_client": "HttpClient|Dio|axios|fetch|http\\.Client", "websocket": "WebSocket|Socket|socket\\.io", "background": "(Background|Worker|Job|Queue)\\s*\\.?\\s*(start|init)",
}
_SETS = [("flutter", "flutter_binding", "WidgetsFlutterBinding\\s*\\.?\\s*ensureInitialized"), ("flutter", "system_ui", "SystemChrome\\s*\\."), ("flutter", "error_handler", "FlutterError\\s*\\.?\\s*onError"), ("react", "react_root", "ReactDOM\\s*\\.?\\s*render|createRoot"), ("react", "strict_mode", "StrictMode"), ("django", "django_setup", "django\\.setup\\s*\\("), ("django", "wsgi", "WSGI_APPLICATION|ASGI_APPLICATION"), ("spring", "spring_boot", "@SpringBootApplication|@EnableAutoConfiguration"), ("spring", "spring_run", "SpringApplication\\s*\\.?\\s*run")]
_NEAR = _EP + ", near AS (SELECT l.path, ep.line AS entry_line, l.line, text FROM l JOIN ep ON ep.path = l.path AND l.line BETWEEN ep.line AND ep.line + {0})"
_N = "nullif(regexp_extract(text, '{0}', 1), '')"
_PATH = f"path\\s*=\\s*{_Q}([^''\"]+){_Q}"
ORACLE_SQL = {
    "chunk_topics": f"WITH {_A} SELECT file, seq, array_to_string(topics, ',') AS topics, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(q_[a-z][a-z0-9_]*)\\b', 1))), ',') AS question_ids, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS word_count FROM a",
    "chunk_scopes": f"WITH {_A} SELECT scope, count(*) AS n FROM (SELECT unnest(scopes) AS scope FROM a) GROUP BY scope",
    "intent_classify": _CL + " SELECT file, seq, array_to_string(intents, ',') AS intents, primary_intent, confidence FROM s",
    "severity": _CL + " SELECT file, seq, severity FROM s",
    "topic_collisions": _SIG + " SELECT * FROM col",
    "scope_conflicts": _SIG + " SELECT * FROM scp",
    "contradictions": _SIG + " SELECT * FROM con",
    "semantic_duplicates": f"""WITH k AS (SELECT file, seq, {_KW} AS w FROM ({CHUNK})
      ), c AS (SELECT file, w, min(seq) AS id, count(*) AS members FROM k WHERE len(w) > 0 GROUP BY file, w
      ), t AS (SELECT file, id, unnest(w) AS t FROM c
      ), p AS (SELECT x.file, x.id AS a, y.id AS b, count(*) AS shared FROM t x JOIN t y ON x.file = y.file AND x.t = y.t AND x.id <= y.id GROUP BY 1, 2, 3)
      SELECT *, CASE WHEN similarity >= 0.8 THEN 'high' ELSE 'medium' END AS severity FROM (
        SELECT p.file, a, b, x.members AS n_a, y.members AS n_b, CAST(CASE WHEN a = b THEN x.members * (x.members - 1) // 2 ELSE x.members * y.members END AS BIGINT) AS n_pairs, shared, round(shared / (len(x.w) + len(y.w) - shared), 6) AS similarity
        FROM p JOIN c x ON x.file = p.file AND x.id = a JOIN c y ON y.file = p.file AND y.id = b WHERE 100 * shared >= 65 * (len(x.w) + len(y.w) - shared)) WHERE n_pairs > 0""",
    "redundancy_dedupe": _RED + " SELECT file, type, severity, count(*) AS n_pairs FROM red GROUP BY 1, 2, 3",
    "redundancy_clusters": _RED + " SELECT * FROM cl",
    "most_duplicated": _CL + " SELECT file, topic, n FROM (SELECT file, topic, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, topic) AS r FROM (SELECT file, unnest(topics) AS topic FROM s) GROUP BY 1, 2) WHERE r <= 5",
    "combined_summary": _RED + """ SELECT count(DISTINCT file) AS files_analyzed, count(*) AS total_redundancies, count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
      (SELECT count(*) FROM s WHERE file IN (SELECT file FROM red)) AS total_chunks, (SELECT count(*) FROM cl) AS total_clusters FROM red""",
    "instruction_summary": _RED + r""", n AS (SELECT file, count(*) AS c, sum(len(regexp_extract_all(text, '\S+'))) AS w, (SELECT count(*) FROM red WHERE red.file = s.file) AS r, (SELECT count(*) FROM cl WHERE cl.file = s.file) AS k FROM s GROUP BY file)
      SELECT file, kind, key, n::DOUBLE AS n FROM (SELECT file, kind, key, count(*)::DOUBLE AS n FROM (SELECT file, 'intent' AS kind, unnest(intents) AS key FROM s UNION ALL SELECT file, 'severity', severity FROM s UNION ALL SELECT file, 'topic', unnest(topics) FROM s UNION ALL SELECT file, 'scope', unnest(scopes) FROM s
        UNION ALL SELECT file, 'redundancy type', type FROM red UNION ALL SELECT file, 'redundancy severity', severity FROM red) GROUP BY file, kind, key
      UNION ALL SELECT file, 'total', unnest(['chunks', 'words', 'words a chunk', 'redundancies', 'clusters', 'redundancy rate']), unnest([c::DOUBLE, w::DOUBLE, floor(w / c)::DOUBLE, r::DOUBLE, k::DOUBLE, round(100 * r / c, 1)::DOUBLE]) FROM n)""",
    "chunk_polarity": f"""WITH t AS (SELECT file, seq, string_split_regex(text, '\\.\\s')[-1] AS text FROM ({CHUNK})
      ), x AS (SELECT *, CASE WHEN {_hit('never|do not|must not|skip|avoid')} THEN 'negative' WHEN {_hit('always|must|required|mandatory|include|ask')} THEN 'positive' ELSE 'neutral' END AS polarity, {_action('text')} AS action, {_action("'Never ' || text")} AS other FROM t)
      SELECT file, seq, polarity, action <> '' AS has_action, action <> '' AND action = other AND polarity <> 'negative' AS negated FROM x""",
    "changed_files": _CODE + " SELECT path, 'added' AS change FROM f WHERE seq % 9 = 0 UNION ALL SELECT path, 'modified' FROM f WHERE seq % 9 <> 0 AND seq % 7 = 0 UNION ALL SELECT 'gone.py', 'deleted'",
    "file_hash": _CODE + " SELECT path, sha256(content) AS sha256 FROM f",
    "entry_points": _EP + " SELECT * FROM ep",
    "entry_summary": _EP + " SELECT 'total' AS kind, 'entry_points' AS key, count(*) AS n FROM ep UNION ALL SELECT 'type', kind, count(*) FROM ep GROUP BY kind UNION ALL SELECT 'language', lang, count(*) FROM ep GROUP BY lang",
    "initializations": _NEAR.replace("{0}", "50") + f""" SELECT path, entry_line, line, trim(k) AS type, coalesce({_N.format('(\\w+)\\s*\\.?\\s*(?:initialize|init|configure|setup)')}, {_N.format('(?:var|final|const|let)\\s+(\\w+)\\s*=')}, {_N.format('(\\w+)\\s*\\(')}, trim(k)) AS name,
      array_to_string(regexp_extract_all(text, '(?:Platform\\.environment|process\\.env|os\\.environ)\\[{_Q}(\\w+){_Q}\\]', 1) || regexp_extract_all(text, '(?:config|Config|CONFIG)\\s*\\.?\\s*(\\w+)', 1), ',') AS config_refs, contains(text, 'async') OR contains(text, 'await') AS is_async
      FROM near, (VALUES {', '.join(f"('{k}', '{rx}')" for k, rx in _INITS.items())}) v(k, rx) WHERE regexp_matches(text, rx)""",
    "framework_inits": _NEAR.replace("{0}", "30") + f" SELECT path, entry_line, line, framework, name FROM near, (VALUES {', '.join(f"('{f}', '{n}', '{rx}')" for f, n, rx in _SETS)}) v(framework, name, rx) WHERE regexp_matches(text, rx)",
    "initial_route": _NEAR.replace("{0}", "40") + f""", r AS (SELECT *, {_N.format(f"initialRoute\\s*:\\s*{_Q}([^''\"]+){_Q}")} AS a, {_N.format('home\\s*:\\s*(\\w+)\\s*\\(')} AS b, CASE WHEN {_N.format(_PATH)} = '/' THEN {_N.format('element\\s*=\\s*\\{{?<(\\w+)').replace('{{', '{')} END AS c FROM near
      ) SELECT path, entry_line, route, screen FROM (SELECT path, entry_line, CASE WHEN a IS NOT NULL THEN a WHEN b IS NULL THEN '/' END AS route, CASE WHEN a IS NULL THEN coalesce(b, c) END AS screen, row_number() OVER (PARTITION BY path, entry_line ORDER BY line) AS k FROM r WHERE coalesce(a, b, c) IS NOT NULL) WHERE k = 1""",
    "env_vars": _ENV + " SELECT * FROM e",
    "secrets": _ENV + " SELECT name, count(*) AS n, min(path) AS first_path FROM e WHERE secret GROUP BY name",
    "feature_flags": _items([("bool", _x("(?i)(?:const|final|static|let|var)\\s+(?:bool\\s+)?(ENABLE_\\w+|DISABLE_\\w+|DEBUG_\\w+|FEATURE_\\w+|IS_\\w+_ENABLED)\\s*=\\s*(?:true|false)")),
      ("class", "CASE WHEN regexp_matches(text, '(FeatureFlags?|FeatureToggles?|FeatureSwitches?)\\s*[.{]') THEN 'feature_flag_' || line END"), ("check", "CASE WHEN regexp_matches(text, 'if\\s*\\(?\\s*(isEnabled|isFeatureEnabled|hasFeature|featureEnabled)\\s*\\(') THEN 'feature_flag_' || line END")],
      ", nullif(lower(regexp_extract(text, '(?i)=\\s*(true|false)', 1)), '') AS \"default\""),
    "constants": _items([(k, f"CASE WHEN NOT {_x(rx)} IN ('OK', 'ERROR', 'NULL', 'TRUE', 'FALSE', 'DEBUG') THEN {_x(rx)} END".replace("NOT CASE", "(CASE").replace("END IN", "END) NOT IN")) for k, rx in (("string", f"(?:const|final|static)\\s+(?:String|int|double|num)\\s+([A-Z][A-Z0-9_]{{2,}})\\s*=\\s*{_Q}"), ("numeric", "(?:const|final|static)\\s+(?:int|double|num)\\s+([A-Z][A-Z0-9_]{2,})\\s*=\\s*\\d+"))],
      ", " + _x(f"=\\s*{_Q}?([^''\"]+?){_Q}?\\s*;") + " AS value"),
    "api_urls": _items([("url", f"substring({_x(f'(?:base[_]?[Uu]rl|api[_]?[Uu]rl|endpoint|BASE_URL|API_URL)\\s*[:=]\\s*{_Q}?(https?://[^{chr(39) * 2}\"\\s]+)')}, 1, 50)"), ("path", _x(f"{_Q}/(api|v1|v2|graphql|rest)/[^''\"]*{_Q}"))]),
    "test_split": _TESTS + " SELECT path, framework, test_count, families, imports FROM t",
    "test_coverage_map": _TESTS + " SELECT * FROM cov",
    "coverage_summary": _TESTS + " SELECT count(*) AS modules, count(test_path) AS tested, round_even(100.0 * count(test_path) / greatest(count(*), 1), 1)::DOUBLE AS percent, count(*) FILTER (test_path IS NULL AND risk = 'high') AS high_risk_untested FROM cov",
    "risk_assess": _CODE + f" SELECT {_RISK} AS risk, count(*) AS n FROM s WHERE NOT {_TEST} GROUP BY 1",
    "file_naming": _CODE + f""", y AS (SELECT {_STYLE} AS style, {_NAME} AS name, row_number() OVER (PARTITION BY {_STYLE} ORDER BY seq) AS r FROM f), c AS (SELECT style, count(*) AS n, coalesce(string_agg(name, ',' ORDER BY r) FILTER (r <= 3 AND style <> 'other'), '') AS examples FROM y GROUP BY style)
      SELECT *, row_number() OVER (ORDER BY n DESC, list_position(['snake_case', 'camelCase', 'PascalCase', 'kebab-case', 'SCREAMING_SNAKE', 'other'], style)) = 1 AS dominant FROM c""",
    "class_naming": _CODE + ", c AS (SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(content, '{rx}'))) AS BIGINT) AS {k}" for k, rx in _CLASSES.items()) + " FROM s) SELECT *, CASE greatest(" + ", ".join(_CLASSES) + ") WHEN 0 THEN 'unknown' " + " ".join(f"WHEN {k} THEN '{k}'" for k in _CLASSES) + " END AS dominant FROM c",
    "import_style": _counts(_IMPORTS),
    "error_handling": _counts({"error_boundary": "ErrorBoundary|ErrorWidget|componentDidCatch", "error_callback": "onError|error_handler|errorHandler", "option_type": "None|Some|Nothing|Unit", "result_type": "Result|Either|Option|Maybe|Optional", "try_catch": "try|catch|finally|throw|except|raise|panic"}),
    "comment_style": _counts({"block_comments": "(?s)/\\*.*?\\*/", "dartdoc": "///", "docstrings": "(?s)\"\"\".*?\"\"\"|" + 6 * "'" + ".*?" + 6 * "'", "jsdoc": "(?s)/\\*\\*.*?\\*/", "line_comments": "(?://|#|--|%|;)\\s*\\w", "todo_fixme": "TODO|FIXME|HACK|XXX|OPTIMIZE"}),
    "frameworks": _CODE + _USED + " SELECT framework, count(*) AS n_files FROM x GROUP BY 1",
    "directory_structure": _CODE + _DIRS + """ SELECT *, (SELECT CASE WHEN bool_or(lower(dir) IN ('services', 'api', 'gateway', 'deploy')) THEN 'microservices' WHEN bool_or(lower(dir) IN ('features', 'modules', 'screens', 'pages')) THEN 'feature_based' WHEN bool_or(lower(dir) IN ('lib', 'src', 'app')) THEN 'layered' ELSE 'flat' END FROM d WHERE level = 1) AS pattern FROM d""",
    "architecture": _CODE + _USED + _DIRS + f""", o AS (SELECT (SELECT lower(string_agg(dir, ' ')) FROM d) AS dirs, (SELECT lower(string_agg(n, ' ')) FROM (SELECT unnest({' || '.join(f"regexp_extract_all(content, '{rx}', 1)" for rx in _CLASSES.values())}) AS n FROM s)) AS names), n AS (SELECT {_SUMS} FROM o)
      SELECT CASE {' '.join(f"WHEN {k}_dirs >= 2 OR {k}_names >= 2 THEN '{k}'" for k in _ARCH)} WHEN 'flutter' IN (FROM x) THEN 'feature_based' WHEN 'django' IN (FROM x) THEN 'mvc' WHEN 'spring' IN (FROM x) THEN 'layered' ELSE 'unknown' END AS architecture, * FROM n""",
    "config_files": _CODE + f" SELECT path FROM f WHERE regexp_matches(lower({_NAME}), '\\.env$|\\.env\\.\\w+$|config\\.\\w+$|settings\\.\\w+$|appsettings\\.\\w+$|configuration\\.\\w+$|properties$|\\.ini$|\\.toml$|\\.yaml$|\\.yml$|\\.json$')",
}
