"""What happens after an entry point: initialisations, frameworks set up, the first route. A range join of entries with the lines that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import entry_points, lines

_Q = "['\"]"
INIT = {
    "api": r"(?:API|api|baseUrl|base_url)\s*[:=]",
    "auth": r"(?:Auth|Authentication|Login|Session)\s*\.?\s*(?:configure|init)",
    "background": r"(?:Background|Job|Queue|Worker)\s*\.?\s*(?:init|start)",
    "cache": r"(?:Cache|CacheManager|Redis)\s*\.?\s*(?:configure|init)",
    "database": r"(?:Firebase|MongoDB|MySQL|PostgreSQL|SQLite|Supabase)\s*\.?\s*(?:client|configure|init)",
    "http_client": r"Dio|HttpClient|axios|fetch|http\.Client",
    "local_storage": r"(?:Drift|GetStorage|Hive|SharedPreferences)\s*\.?\s*(?:init|open)",
    "logger": r"(?:Log|Logger|logging)\s*\.?\s*(?:configure|init|setup)",
    "router": r"(?:AutoRoute|GoRoute|GoRouter|Navigator|Router)\s*\(",
    "router_table": r"(?:router|routes)\s*[:=]",
    "state_management": "BlocProvider|ChangeNotifierProvider|GetBuilder|MultiProvider|ProviderScope",
    "websocket": r"Socket|socket\.io",
}
FRAMEWORK = {
    "django": {"django_setup": r"django\.setup\s*\(", "wsgi": "[AW]SGI_APPLICATION"},
    "flutter": {"error_handler": r"FlutterError\s*\.?\s*onError", "flutter_binding": r"WidgetsFlutterBinding\s*\.?\s*ensureInitialized", "system_ui": r"SystemChrome\s*\."},
    "react": {"react_root": r"ReactDOM\s*\.?\s*render|createRoot", "strict_mode": "StrictMode"},
    "spring": {"spring_boot": "@(?:EnableAutoConfiguration|SpringBootApplication)", "spring_run": r"SpringApplication\s*\.?\s*run"},
}
NAMES = (r"(\w+)\s*\.?\s*(?:init|configure|setup)", r"(?:const|final|let|var)\s+(\w+)\s*=", r"(\w+)\s*\(")
ENV_REF, CONFIG_REF = rf"(?:Platform\.environment|os\.environ|process\.env)\[{_Q}(\w+){_Q}\]", r"(?:CONFIG|Config|config)\s*\.?\s*(\w+)"
ROUTE, HOME, PATH, ELEMENT = rf"initialRoute\s*:\s*{_Q}([^'\"]+){_Q}", r"home\s*:\s*(\w+)\s*\(", rf"path\s*=\s*{_Q}([^'\"]+){_Q}", r"element\s*=\s*\{?<(\w+)"


def after_entries(files: DataFrame, reach: int = 50) -> DataFrame:
    """path, entry_line, line, text of the lines from each entry up to reach after it.

    A line can only belong to entries of its file in its own block of reach lines or the
    one before: entries are sent to both blocks, so the range join is an equi-join.
    """
    e = entry_points(files).select("path", F.col("line").alias("entry_line"))
    e = e.withColumn("block", F.explode(F.array(F.floor(F.col("entry_line") / reach), F.floor(F.col("entry_line") / reach) + 1)))
    l = lines(files).withColumn("block", F.floor(F.col("line") / reach))
    return l.join(e, ["path", "block"]).where((F.col("line") >= F.col("entry_line")) & (F.col("line") <= F.col("entry_line") + reach)).select("path", "entry_line", "line", "text")


def initializations(files: DataFrame, reach: int = 50) -> DataFrame:
    """path, entry_line, line, type, name, config_refs (joined), is_async of what is set up after an entry; a line counts for each type that it fits."""
    t = F.col("text")
    kinds = F.array_compact(F.array(*[F.when(t.rlike(rx), F.lit(k)) for k, rx in INIT.items()]))
    name = F.coalesce(*[F.nullif(F.regexp_extract("text", rx, 1), F.lit("")) for rx in NAMES])
    refs = F.concat(*[F.regexp_extract_all("text", F.lit(rx), F.lit(1)) for rx in (ENV_REF, CONFIG_REF)])
    d = after_entries(files, reach).select("*", F.explode(kinds).alias("k"))
    kind = F.when(F.col("k") == "router_table", "router").otherwise(F.col("k"))
    return d.select("path", "entry_line", "line", kind.alias("type"), F.coalesce(name, kind).alias("name"), F.array_join(refs, ",").alias("config_refs"), (t.contains("async") | t.contains("await")).alias("is_async"))


def framework_inits(files: DataFrame, reach: int = 30) -> DataFrame:
    """path, entry_line, line, framework, name of what frameworks set up after an entry."""
    found = [F.when(F.col("text").rlike(rx), F.struct(F.lit(f).alias("framework"), F.lit(n).alias("name"))) for f, rules in FRAMEWORK.items() for n, rx in rules.items()]
    return after_entries(files, reach).select("path", "entry_line", "line", F.explode(F.array_compact(F.array(*found))).alias("x")).select("path", "entry_line", "line", "x.*")


def initial_route(files: DataFrame, reach: int = 40) -> DataFrame:
    """path, entry_line, route, screen: the first of either after an entry."""
    some = lambda rx: F.nullif(F.regexp_extract("text", rx, 1), F.lit(""))
    root = (some(PATH) == "/") & some(ELEMENT).isNotNull()
    x = F.when(some(ROUTE).isNotNull(), F.struct(some(ROUTE).alias("route"), F.lit(None).cast("string").alias("screen")))
    x = x.when(some(HOME).isNotNull(), F.struct(F.lit(None).cast("string").alias("route"), some(HOME).alias("screen")))
    x = x.when(root, F.struct(F.lit("/").alias("route"), some(ELEMENT).alias("screen")))
    d = after_entries(files, reach).select("path", "entry_line", "line", x.alias("x")).where("x IS NOT NULL")
    return d.groupBy("path", "entry_line").agg(F.min_by("x", "line").alias("x")).select("path", "entry_line", "x.*")
