"""Runtime comprehension of source files: entry points, configuration surface, tests, conventions. files: path, content, seq."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import file_name, stem, suffix

LANGUAGES = {".dart": "dart", ".go": "go", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".php": "php", ".py": "python", ".rb": "ruby", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript"}
_Q = "['\"]"
_SERVER_JS = [("server", r"app\.listen\s*\(|(?:createServer|express|next)\s*\("), ("export", r"export\s+default\s+function")]
ENTRY = {
    "python": [("main", rf"if\s+__name__\s*==\s*{_Q}__main__{_Q}"), ("server", r"app\s*=\s*(?:Django|FastAPI|Flask)\s*\("), ("main", r"def\s+main\s*\("), ("cli", r"(?i)manage\.py")],
    "typescript": _SERVER_JS,
    "javascript": _SERVER_JS,
    "dart": [("app", r"void\s+main\s*\(\s*\)|runApp\s*\(|(?:Cupertino|GetMaterial|Material)App\s*\(")],
    "java": [("main", r"public\s+static\s+void\s+main\s*\("), ("server", "@SpringBootApplication")],
    "go": [("main", r"func\s+main\s*\("), ("package", r"package\s+main"), ("server", r"http\.ListenAndServe\s*\(|echo\.New\s*\(\)|gin\.Default\s*\(\)")],
    "rust": [("main", r"fn\s+main\s*\("), ("async_main", r"#\[tokio::main\]"), ("server", "actix_web|axum|warp")],
    "ruby": [("server", r"Rails\.application\.run|Sinatra::Application"), ("main", r"if\s+__FILE__\s*==\s*__FILE__")],
    "php": [("controller", r"public\s+function\s+index\s*\("), ("route", r"Route::|->(?:get|post)\("), ("framework", "Laravel|Symfony")],
}
ENTRY_FILES = {
    "dart": "app.dart main.dart", "go": "main.go", "java": "app.java application.java main.java", "javascript": "app.js index.js main.js server.js", "php": "index.php",
    "python": "__main__.py app.py asgi.py main.py manage.py wsgi.py", "ruby": "application.rb config.ru", "rust": "lib.rs main.rs", "typescript": "app.ts index.ts main.ts server.ts",
}
_JS_ENV = [r"process\.env\.(\w+)", rf"process\.env\s*\[{_Q}(\w+){_Q}\]"]
ENV = {
    "python": [rf"os\.environ\s*\[{_Q}(\w+){_Q}\]", rf"os\.(?:environ\.get|getenv)\s*\({_Q}(\w+){_Q}"],
    "typescript": _JS_ENV,
    "javascript": _JS_ENV,
    "dart": [rf"Platform\.environment\s*\[{_Q}(\w+){_Q}\]", rf"(?:String|bool)\.fromEnvironment\s*\({_Q}(\w+){_Q}\)"],
    "java": [rf"System\.get(?:Property|env)\s*\({_Q}(\w+){_Q}\)"],
    "go": [rf"os\.(?:Getenv|LookupEnv)\s*\({_Q}(\w+){_Q}\)"],
    "rust": [rf"std::env::var\s*\({_Q}(\w+){_Q}\)", rf"env!\s*\({_Q}(\w+){_Q}\)"],
    "ruby": [rf"ENV\s*\[{_Q}(\w+){_Q}\]"],
    "php": [rf"getenv\s*\({_Q}(\w+){_Q}\)", rf"\$_ENV\s*\[{_Q}(\w+){_Q}\]"],
}
#: Read when the program is built, not when it runs.
COMPILE_TIME = rf"env!\s*\({_Q}(\w+){_Q}\)"
FLAG = r"(?i)(?:const|final|let|static|var)\s+(?:bool\s+)?((?:DEBUG|DISABLE|ENABLE|FEATURE)_\w+|IS_\w+_ENABLED)\s*=\s*(?:true|false)"
FLAG_CLASS = r"Feature(?:Flag|Switche|Toggle)s?\s*[.{]"
FLAG_CHECK = r"if\s*\(?\s*(?:featureEnabled|hasFeature|isEnabled|isFeatureEnabled)\s*\("
TEXT_CONSTANT = rf"(?:const|final|static)\s+(?:String|double|int|num)\s+([A-Z][A-Z0-9_]{{2,}})\s*=\s*{_Q}"
NUMBER_CONSTANT = r"(?:const|final|static)\s+(?:double|int|num)\s+([A-Z][A-Z0-9_]{2,})\s*=\s*\d+"
NOISE = ("DEBUG", "ERROR", "FALSE", "NULL", "OK", "TRUE")
URL = rf"(?:API_URL|BASE_URL|(?:api|base)_?[Uu]rl|endpoint)\s*[:=]\s*{_Q}?(https?://[^'\"\s]+)"
URL_PATH = rf"{_Q}/(api|graphql|rest|v1|v2)/[^'\"]*{_Q}"
SECRET = r"(?i)(?:access|api|private)_?key|auth|credential|password|secret|token"
CONFIG_FILE = r"\.env(?:\.\w+)?$|(?:config|configuration|settings)\.\w+$|properties$|\.(?:ini|json|toml|ya?ml)$"
RISK_HIGH = "auth|database|engine|orchestrator|payment|repository|security|service|user"
RISK_MEDIUM = "bloc|controller|page|provider|screen"
TEST_FILE = {"dart": r"_test\.dart$", "go": r"_test\.go$", "java": r"Tests?\.java$", "javascript": r"\.(?:spec|test)\.jsx?$", "php": r"Test\.php$", "python": r"test_\w+\.py$|_test\.py$", "ruby": r"_(?:spec|test)\.rb$", "rust": r"_test\.rs$", "typescript": r"\.(?:spec|test)\.tsx?$"}
#: By language, in the order in which they are tried.
TEST_FRAMEWORKS = {
    "dart": [(f, rf"import\s+{_Q}package:{f}") for f in ("flutter_test", "mockito", "mocktail", "bloc_test")],
    "python": [("pytest", r"@pytest\.|def\s+test_|import\s+pytest"), ("unittest", r"class\s+\w+\(unittest\.TestCase|import\s+unittest")],
    "javascript": [("jest", r"describe|expect|it|jest\.|test"), ("mocha", "assert"), ("vitest", r"vi\."), ("cypress", r"cy\.")],
    "typescript": [("jest", r"describe|expect|it|jest\.|test"), ("vitest", r"vi\.")],
    "java": [("junit4", r"@(?:After|Before|Test)|import\s+org\.junit"), ("mockito", r"(?:mock|verify|when)\(")],
    "go": [("testing", r'import\s+"testing"'), ("testify", r"(?:assert|require)\.")],
    "rust": [("built_in", r"#\[test\]"), ("rstest", r"#\[rstest\]")],
    "ruby": [("minitest", r"class\s+\w+<\s*Test::Unit|def\s+test_"), ("rspec", "context|describe|expect|it")],
    "php": [("phpunit", r"class\s+\w+Tests?\s+extends|function\s+test")],
}
TEST_CASE = {"dart": rf"test(?:Widgets)?\s*\({_Q}", "go": r"func\s+Test\w+", "java": "@Test", "javascript": rf"(?:it|test)\s*\({_Q}", "php": r"function\s+test\w+", "python": r"def\s+test_\w+|def\s+test\s*\(", "ruby": rf"def\s+test_\w+|it\s+{_Q}", "rust": r"#\[test\]", "typescript": rf"(?:it|test)\s*\({_Q}"}
TEST_FAMILIES = {"assertions": r"assert|expect|require\.\w+", "fixtures": "@After|@Before|afterEach|beforeEach|fixture|setUp|tearDown", "mocking": r"@InjectMocks|@Spy|[Mm]ock|(?:verify|when)\(", "snapshot": "expectLater|toMatchInlineSnapshot|toMatchSnapshot"}
TEST_IMPORT = {"dart": rf"import\s+{_Q}([^'\"]+){_Q}", "go": rf"import\s+{_Q}([^'\"]+){_Q}", "java": r"import\s+([\w.]+)", "javascript": rf"(?:import|require)\s*\(?{_Q}([^'\"]+){_Q}", "php": rf"(?:include|require|use)\s+{_Q}([^'\"]+){_Q}", "python": r"(?:from|import)\s+([\w.]+)", "ruby": rf"require{_Q}([^'\"]+){_Q}", "rust": r"use\s+([\w:]+)", "typescript": rf"(?:import|require)\s*\(?{_Q}([^'\"]+){_Q}"}
_NODE = "crypto|fs|http|node:|path"
STANDARD = {"dart": "dart:|package:(?:collection|flutter|meta)/", "go": "fmt|io|net|os|strings|testing", "java": r"java\.|javax\.|org\.junit", "javascript": _NODE, "php": "PHP", "python": "collections|json|os|pathlib|pytest|re|sys|typing|unittest", "ruby": "ruby|test/unit", "rust": "alloc::|core::|std::", "typescript": _NODE}
FILE_NAMING = (("snake_case", r"^[a-z][a-z0-9]*(_[a-z0-9]+)*\.\w+$"), ("camelCase", r"^[a-z][a-zA-Z0-9]*\.\w+$"), ("PascalCase", r"^[A-Z][a-zA-Z0-9]*\.\w+$"), ("kebab-case", r"^[a-z][a-z0-9]*(-[a-z0-9]+)*\.\w+$"), ("SCREAMING_SNAKE", r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*\.\w+$"))
_KIND = "(?:class|enum|interface|struct|type|typedef)"
CLASS_NAMING = {"PascalCase": _KIND + r"\s+([A-Z][a-zA-Z0-9]*)", "snake_case": _KIND + r"\s+([a-z][a-z0-9_]*)", "I_Prefix": r"(?:class|interface|type)\s+(I[A-Z][a-zA-Z0-9]*)", "_Prefix": r"(?:class|struct)\s+(_[A-Z][a-zA-Z0-9]*)"}
_FROM_REL, _FROM_ABS = rf"from\s+{_Q}\.\.?/", rf"from\s+{_Q}[/@]"
IMPORTS = {
    "absolute": {"dart": rf"import\s+{_Q}(?:/|package:)", "go": rf"import\s+{_Q}[^ .]", "java": r"import\s+(?:com|java|javax|net|org)\.", "javascript": _FROM_ABS, "python": r"(?:from|import)\s+[^.]", "typescript": _FROM_ABS},
    "barrel": {"dart": rf"import\s+{_Q}(?:.+/)?(?: barrel|index){_Q}", "typescript": rf"from\s+{_Q}(?:.+/)?(?: barrel|index){_Q}"},
    "relative": {"dart": rf"import\s+{_Q}\.\.?/", "go": rf"import\s+{_Q}\.\.?/", "javascript": _FROM_REL, "python": r"from\s+\.", "typescript": _FROM_REL},
}
ERRORS = {"error_boundary": "ErrorBoundary|ErrorWidget|componentDidCatch", "error_callback": "errorHandler|error_handler|onError", "option_type": "None|Nothing|Some|Unit", "result_type": "Either|Maybe|Option|Optional|Result", "try_catch": "catch|except|finally|panic|raise|throw|try"}
COMMENTS = {"block_comments": r"(?s)/\*.*?\*/", "dartdoc": "///", "docstrings": r"(?s)\"\"\".*?\"\"\"|'''.*?'''", "jsdoc": r"(?s)/\*\*.*?\*/", "line_comments": r"(?://|#|--|%|;)\s*\w", "todo_fixme": "FIXME|HACK|OPTIMIZE|TODO|XXX"}
FRAMEWORKS = {
    "actix": r"actix_web|#[actix_web::main]", "angular": rf"@(?:Component|Injectable|NgModule)|from\s+{_Q}@angular", "django": r"(?:from|import)\s+django|urlpatterns", "express": rf"require\({_Q}express{_Q}|from\s+{_Q}express",
    "fastapi": r"from\s+fastapi|import\s+FastAPI", "flask": r"from\s+flask|import\s+Flask", "flutter": rf"import\s+{_Q}package:flutter/|Flutter|runApp\s*\(", "gin": r"gin\.(?:Default|New)", "laravel": "Illuminate|Laravel|Route::",
    "nextjs": rf"import\s+{_Q}next/|getServerSideProps|getStaticProps", "rails": r"Active(?:Controller|Record)|Rails\.application", "react": rf"import\s+React|from\s+{_Q}react{_Q}|jsx|JSX", "spring": "@(?:RestController|Service|SpringBootApplication)",
    "vue": rf"import\s+Vue|from\s+{_Q}vue{_Q}|\.vue$",
}
#: name, parts of directory names, parts of class names; two of either kind tell.
ARCHITECTURES = (
    ("layered", "controllers models repositories services views", "controller model repository service view"),
    ("clean_architecture", "core data domain presentation", "data domain entities frameworks interface_adapters presentation use_cases"),
    ("feature_based", "features modules screens", "auth diagnostic home profile settings"),
    ("mvc", "controllers models views", "controller model view"),
    ("mvvm", "models viewmodels views", "model view viewmodel"),
    ("microservices", "api deploy gateway services", "api docker gateway k8s service"),
)
BY_FRAMEWORK = {"flutter": "feature_based", "django": "mvc", "spring": "layered"}


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix(path))


def known(files: DataFrame) -> DataFrame:
    """Files in a known language, which lang names."""
    return files.withColumn("lang", F.coalesce(language(F.col("path")), F.lit(""))).where("lang <> ''")


def _by_lang(rules: dict, make) -> Column:
    """make(rule) of the rule of a row's language; null where it has none."""
    out = None
    for lang, rule in rules.items():
        hit = F.col("lang") == lang
        out = F.when(hit, make(rule)) if out is None else out.when(hit, make(rule))
    return out


def _first(rules, test) -> Column:
    out = None
    for k, rule in rules:
        out = F.when(test(rule), k) if out is None else out.when(test(rule), k)
    return out


def lines(files: DataFrame) -> DataFrame:
    """path, lang, line (from 1), text of files in a known language."""
    d = known(files).select("path", "lang", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return d.select("path", "lang", (F.col("i") + 1).cast("long").alias("line"), "text")


def is_entry_file(path: Column, lang: Column) -> Column:
    n = F.lower(file_name(path))
    return reduce(lambda a, b: a | b, [(lang == k) & n.isin(*names.split()) for k, names in ENTRY_FILES.items()])


def entry_points(files: DataFrame) -> DataFrame:
    """Lines that match an entry pattern of their language: the first one's kind, and whether the file's name is one of an entry."""
    kind = _by_lang(ENTRY, lambda rules: _first(rules, lambda rx: F.col("text").rlike(rx)))
    d = lines(files).select("path", "lang", "line", kind.alias("kind"), is_entry_file(F.col("path"), F.col("lang")).alias("entry_file"))
    return d.where("kind IS NOT NULL")


def entry_summary(entries: DataFrame) -> DataFrame:
    """kind, key, n: entry points in all, by type and by language."""
    s = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("key"))
    x = F.array(s("total", F.lit("entry_points")), s("type", F.col("kind")), s("language", F.col("lang")))
    return entries.select(F.explode(x).alias("x")).groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))


def env_vars(files: DataFrame) -> DataFrame:
    """path, line, name, secret, compile_time of environment variables, a name once a line."""
    grab = lambda rx: F.regexp_extract_all("text", F.lit(rx), F.lit(1))
    found = _by_lang(ENV, lambda rules: F.array_distinct(F.concat(*[grab(rx) for rx in rules])))
    early = F.array_contains(grab(COMPILE_TIME), F.col("name")) & (F.col("lang") == "rust")
    late = F.array_contains(grab(ENV["rust"][0]), F.col("name"))
    d = lines(files).select("path", "lang", "line", "text", F.explode_outer(found).alias("name")).where("name IS NOT NULL")
    return d.select("path", "line", "name", F.col("name").rlike(SECRET).alias("secret"), (early & ~late).alias("compile_time"))


def secrets(files: DataFrame) -> DataFrame:
    return env_vars(files).where("secret").groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def _found(rx: str) -> Column:
    """The first group's text of a line's first match; null without one."""
    return F.when(F.col("text").rlike(rx), F.regexp_extract("text", rx, 1))


def _items(files: DataFrame, rules: list, **more: Column) -> DataFrame:
    """path, line, name, type and more of each rule (type, name or null) that a line meets; of equal names in a line the first."""
    x = F.array_compact(F.array(*[F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(k).alias("type"))) for k, name in rules]))
    d = lines(files).select("path", "line", *[c.alias(k) for k, c in more.items()], x.alias("x")).where(F.size("x") > 0)
    own = F.filter("x", lambda a, i: ~F.exists(F.slice("x", F.lit(1), i), lambda b: b["name"] == a["name"]))
    return d.select("path", "line", *more, F.explode(own).alias("x")).select("path", "line", "x.name", "x.type", *more)


def feature_flags(files: DataFrame) -> DataFrame:
    """path, line, name, type (bool, class or check) and default of feature flags; nameless ones are called by their line."""
    numbered = F.concat(F.lit("feature_flag_"), F.col("line"))
    given = F.lower(F.regexp_extract("text", r"(?i)=\s*(true|false)", 1))
    rules = [("bool", _found(FLAG)), ("class", F.when(F.col("text").rlike(FLAG_CLASS), numbered)), ("check", F.when(F.col("text").rlike(FLAG_CHECK), numbered))]
    return _items(files, rules, default=F.nullif(given, F.lit("")))


def constants(files: DataFrame) -> DataFrame:
    """path, line, name, type (string or numeric) and value of constants in capitals; the value only where a semicolon ends it."""
    some = lambda rx: F.when(~_found(rx).isin(*NOISE), _found(rx))
    value = rf"=\s*{_Q}?([^'\"]+?){_Q}?\s*;"
    return _items(files, [("string", some(TEXT_CONSTANT)), ("numeric", some(NUMBER_CONSTANT))], value=_found(value))


def api_urls(files: DataFrame) -> DataFrame:
    """path, line, name, type: addresses, up to 50 characters of them, and the first parts of paths of interfaces."""
    return _items(files, [("url", F.substring(_found(URL), 1, 50)), ("path", _found(URL_PATH))])


def is_test(path: Column) -> Column:
    """Whether a name is a test's in its language."""
    n, own = file_name(path), suffix(path)
    return reduce(lambda a, b: a | b, [own.isin(*[s for s, l in LANGUAGES.items() if l == lang]) & n.rlike(rx) for lang, rx in TEST_FILE.items()])


def test_files(files: DataFrame) -> DataFrame:
    """path, framework, test_count, families (of patterns, joined) and imports (not of the standard library, joined) of test files."""
    t = known(files).where(is_test(F.col("path")))
    c = F.col("content")
    framework = F.coalesce(_by_lang(TEST_FRAMEWORKS, lambda rules: _first(rules, lambda rx: c.rlike(rx))), F.lit("unknown"))
    count = _by_lang(TEST_CASE, lambda rx: F.regexp_count(c, F.lit(rx)))
    families = F.array_join(F.array_compact(F.array(*[F.when(c.rlike(rx), F.lit(k)) for k, rx in TEST_FAMILIES.items()])), ",")
    imports = _by_lang({k: (rx, STANDARD[k]) for k, rx in TEST_IMPORT.items()}, lambda r: F.filter(F.regexp_extract_all(c, F.lit(r[0]), F.lit(1)), lambda x: ~x.rlike(f"^(?:{r[1]})")))
    return t.select("path", framework.alias("framework"), count.cast("long").alias("test_count"), families.alias("families"), F.array_join(imports, ",").alias("imports"), "seq")


#: Length of the stems' beginnings by which pieces of tests are chosen.
GRAM = 6


def coverage_map(files: DataFrame) -> DataFrame:
    """Each source file with the first test whose stem holds its stem, underscores left out in both.

    No pairs are compared. A test's stem is cut at the places where a source's stem may
    begin, by its first GRAM letters (all of a shorter one), to the lengths that such stems
    have; of equal pieces the first test's is kept, and joined with the sources by the whole stem.
    """
    bare = lambda c: F.replace(stem(c), F.lit("_"), F.lit(""))
    tests = test_files(files).select(F.struct(F.col("seq").alias("tseq"), F.col("path").alias("test_path"), "test_count").alias("t"), bare(F.col("path")).alias("tkey"))
    tests = tests.groupBy("tkey").agg(F.min("t").alias("t"))
    src = known(files).where(~is_test(F.col("path"))).select("path", "seq", bare(F.col("path")).alias("skey"))
    n = F.length("skey")
    short = [r.n for r in src.where(n < GRAM).select(n.alias("n")).distinct().collect()]
    lengths = src.groupBy(F.substring("skey", 1, GRAM).alias("gram")).agg(F.collect_set(n).alias("lengths"))
    at = F.sequence(F.lit(1), F.greatest(F.length("tkey"), F.lit(1)))
    pieces = lambda n: F.transform(at, lambda i: F.substring(F.col("tkey"), i, n))
    grams = F.array_distinct(F.concat(*[pieces(F.lit(k)) for k in sorted({*short, GRAM})]))
    cut = tests.withColumn("gram", F.explode(grams)).join(lengths, "gram").withColumn("n", F.explode("lengths"))
    cut = cut.withColumn("skey", F.explode(F.array_distinct(F.filter(pieces(F.col("n")), lambda x: (F.length(x) == F.col("n")) & F.startswith(x, F.col("gram"))))))
    best = cut.groupBy("skey").agg(F.min("t").alias("t"))
    n = F.coalesce("t.test_count", F.lit(0))
    est = F.when(n == 0, "none").when(n <= 2, "low").when(n <= 5, "medium").when(n <= 10, "high").otherwise("full")
    risk = F.when(F.col("t").isNull(), untested_risk(F.col("path"))).when(n > 5, "low").otherwise("medium")
    return src.join(best, "skey", "left").select("path", F.col("t.test_path").alias("test_path"), n.alias("test_count"), est.alias("estimate"), risk.alias("risk"))


def untested_risk(path: Column) -> Column:
    n = F.lower(file_name(path))
    return F.when(n.rlike(RISK_HIGH), "high").when(n.rlike(RISK_MEDIUM), "medium").otherwise("low")


def risk_assess(files: DataFrame) -> DataFrame:
    return known(files).where(~is_test(F.col("path"))).groupBy(untested_risk(F.col("path")).alias("risk")).agg(F.count("*").alias("n"))


def coverage_summary(cov: DataFrame) -> DataFrame:
    tested = F.count("test_path")
    return cov.agg(F.count("*").alias("modules"), tested.alias("tested"), F.bround(100.0 * tested / F.greatest(F.count("*"), F.lit(1)), 1).alias("percent"), F.count_if(F.col("test_path").isNull() & (F.col("risk") == "high")).alias("high_risk_untested"))


def file_naming(files: DataFrame) -> DataFrame:
    """Files by naming style, with up to three examples in order, but none of other names; the commonest style is marked (ties: the first tried)."""
    n = file_name(F.col("path"))
    style = _first(FILE_NAMING, lambda rx: n.rlike(rx)).otherwise("other")
    d = files.select(style.alias("style"), n.alias("name"), "seq")
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("style").orderBy("seq")))
    some = F.array_sort(F.collect_list(F.when((F.col("r") <= 3) & (F.col("style") != "other"), F.struct("r", "name"))))
    g = d.groupBy("style").agg(F.count("*").alias("n"), F.array_join(F.transform(some, lambda x: x["name"]), ",").alias("examples"))
    place = F.array_position(F.array(*[F.lit(k) for k, _ in FILE_NAMING], F.lit("other")), F.col("style"))
    best = g.agg(F.min(F.struct((-F.col("n")).alias("n"), place.alias("p"), "style"))["style"].alias("best"))
    return g.join(best, F.lit(True)).select("style", "n", "examples", (F.col("style") == F.col("best")).alias("dominant"))


def class_names(content: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(content, F.lit(rx), F.lit(1)) for rx in CLASS_NAMING.values()])


def class_naming(files: DataFrame) -> DataFrame:
    """Class names by style, each counted for itself, and the commonest: one row."""
    d = known(files).agg(*[F.coalesce(F.sum(F.regexp_count("content", F.lit(rx))), F.lit(0)).alias(k) for k, rx in CLASS_NAMING.items()])
    top = F.greatest(*[F.col(k) for k in CLASS_NAMING])
    return d.withColumn("dominant", F.when(top == 0, "unknown").otherwise(_first([(k, k) for k in CLASS_NAMING], lambda k: F.col(k) == top)))


def _count_files(files: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return known(files).agg(*[F.count_if(hit).alias(k) for k, hit in rules.items()])


def import_style(files: DataFrame) -> DataFrame:
    """Files with relative, absolute and barrel imports: one row."""
    return _count_files(files, {k: F.coalesce(_by_lang(rules, lambda rx: F.col("content").rlike(rx)), F.lit(False)) for k, rules in IMPORTS.items()})


def error_handling(files: DataFrame) -> DataFrame:
    return _count_files(files, {k: F.col("content").rlike(rx) for k, rx in ERRORS.items()})


def comment_style(files: DataFrame) -> DataFrame:
    return _count_files(files, {k: F.col("content").rlike(rx) for k, rx in COMMENTS.items()})


def frameworks(files: DataFrame) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(F.col("content").rlike(rx), F.lit(k)) for k, rx in FRAMEWORKS.items()]))
    return known(files).select(F.explode(names).alias("framework")).groupBy("framework").agg(F.count("*").alias("n_files"))


def directories(files: DataFrame) -> DataFrame:
    """dir, level, n: files below each first directory, and below each second."""
    seg = F.split("path", "/")
    one = F.when(F.size(seg) > 1, F.struct(F.get(seg, F.lit(0)).alias("dir"), F.lit(1).alias("level")))
    two = F.when(F.size(seg) > 2, F.struct(F.concat_ws("/", F.get(seg, F.lit(0)), F.get(seg, F.lit(1))).alias("dir"), F.lit(2).alias("level")))
    return files.select(F.explode(F.array_compact(F.array(one, two))).alias("x")).groupBy("x.dir", "x.level").agg(F.count("*").alias("n"))


def directory_structure(files: DataFrame) -> DataFrame:
    """directories(), and the pattern that the first ones' names tell: the last that fits."""
    d = directories(files)
    has = lambda *names: F.max((F.col("level") == 1) & F.lower("dir").isin(*names))
    told = d.agg(has("app", "lib", "src").alias("layered"), has("features", "modules", "pages", "screens").alias("features"), has("api", "deploy", "gateway", "services").alias("services"))
    pattern = F.when(F.col("services"), "microservices").when(F.col("features"), "feature_based").when(F.col("layered"), "layered").otherwise("flat")
    return d.join(told.select(pattern.alias("pattern")), F.lit(True))


def architecture(files: DataFrame) -> DataFrame:
    """The first architecture of which two parts of directory names or of class names occur, else the one that goes with a framework: one row."""
    occurs = lambda c, prefix, words: [F.coalesce(F.max(F.lower(c).contains(w)), F.lit(False)).cast("int").alias(f"{prefix}_{w}") for w in sorted(set(" ".join(words).split()))]
    in_dirs = directories(files).agg(*occurs("dir", "d", [ds for _, ds, _ in ARCHITECTURES]))
    names = known(files).select(F.explode(class_names(F.col("content"))).alias("name"))
    in_names = names.agg(*occurs("name", "c", [ws for _, _, ws in ARCHITECTURES]))
    used = frameworks(files).agg(*[F.coalesce(F.max(F.col("framework") == k), F.lit(False)).alias(f"f_{k}") for k in BY_FRAMEWORK])
    total = lambda prefix, ws: reduce(lambda a, b: a + b, [F.col(f"{prefix}_{w}") for w in ws.split()])
    c = None
    for k, ds, ws in ARCHITECTURES:
        hit = (total("d", ds) >= 2) | (total("c", ws) >= 2)
        c = F.when(hit, k) if c is None else c.when(hit, k)
    for k, a in BY_FRAMEWORK.items():
        c = c.when(F.col(f"f_{k}"), a)
    one = in_dirs.join(in_names, F.lit(True)).join(used, F.lit(True))
    return one.select(c.otherwise("unknown").alias("architecture"), *[total("d", ds).alias(f"{k}_dirs") for k, ds, _ in ARCHITECTURES], *[total("c", ws).alias(f"{k}_names") for k, _, ws in ARCHITECTURES])


def config_files(files: DataFrame) -> DataFrame:
    return files.where(F.lower(file_name(F.col("path"))).rlike(CONFIG_FILE)).select("path")
