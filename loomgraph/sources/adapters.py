"""Views of the driver's tables as engine inputs, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Parts as code entities, eight to a file; the last tenth is emitted a second time, as a module, to be merged.
ENT_RAW = """
SELECT 'P' || p AS id, CASE WHEN p % 8 IN (1, 4, 5, 6, 7) THEN 'function' WHEN p % 16 = 0 THEN 'route' ELSE 'class' END AS type,
  CASE p % 8 WHEN 0 THEN 'Item' || p || 'Screen' WHEN 1 THEN 'onPressed' || p WHEN 2 THEN 'Order' || p || 'Service' WHEN 3 THEN 'user' || p || 'Repository' WHEN 4 THEN 'setState' WHEN 5 THEN 'goToItem' || p
    WHEN 6 THEN CASE p % 40 WHEN 6 THEN 'handleTap' || p WHEN 14 THEN 'SwipeItem' || p WHEN 22 THEN '_onEdit' || p WHEN 30 THEN 'onward' || p ELSE 'FetchUsers' || p END ELSE 'processOrder' || p END AS name,
  'packages/b' || (g % 25) || CASE WHEN g % 7 = 3 THEN '/test/' WHEN g % 5 = 2 THEN '/lib/_internal/' ELSE '/lib/' END
    || CASE g % 6 WHEN 0 THEN 'list_screen' WHEN 1 THEN 'order_service' WHEN 2 THEN 'user_dao' WHEN 3 THEN 'drift_db' WHEN 4 THEN 'helper' ELSE 'plain_model' END || g || '.dart' AS file,
  CAST(p_size AS BIGINT) AS line, p * 10 AS seq FROM (SELECT p_partkey AS p, p_size, CAST(floor(p_partkey / 8) AS BIGINT) AS g FROM part)
UNION ALL
SELECT 'P' || p_partkey, 'module', 'again' || p_partkey, 'packages/late/lib/x.dart', CAST(0 AS BIGINT), p_partkey * 10 + 5 FROM part WHERE p_partkey % 10 = 9
"""
ENT = f"""
SELECT id, coalesce(max_by(CASE WHEN type <> 'module' THEN type END, CASE WHEN type <> 'module' THEN seq END), 'module') AS type,
  min_by(name, seq) AS name, min_by(file, seq) AS file, min_by(line, seq) AS line, min(seq) AS seq
FROM ({ENT_RAW}) GROUP BY id
"""
#: Calls, imports and inheritance between parts.
FN = """
SELECT 'P' || p AS source, 'P' || t AS target, type, CASE WHEN p % 3 = 1 THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, p * 10 + k AS seq FROM (
  SELECT p_partkey AS p, (p_partkey * 7 + p_size) % n AS t, CASE WHEN p_partkey % 16 = 8 THEN 'routes_to' ELSE 'calls' END AS type, 1 AS k FROM part, (SELECT count(*) AS n FROM part) WHERE p_partkey % 4 <> 0 OR p_partkey % 16 = 8
  UNION ALL SELECT p_partkey, (p_partkey * 13 + p_size * 5) % n, 'imports', 2 FROM part, (SELECT count(*) AS n FROM part) WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, (p_partkey * 31 + p_size) % n, 'extends', 3 FROM part, (SELECT count(*) AS n FROM part) WHERE p_partkey % 5 = 0
  UNION ALL SELECT (p_partkey * 7 + p_size) % n, p_partkey, 'imports', 4 FROM part, (SELECT count(*) AS n FROM part) WHERE p_partkey % 11 = 1)
"""
#: A multigraph with many parallel edges: parts to suppliers by line items.
DEP = """
SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target,
  CASE l_returnflag WHEN 'A' THEN 'imports' WHEN 'N' THEN 'calls' ELSE 'extends' END AS type,
  CASE l_linestatus WHEN 'O' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence,
  (l_orderkey * 10 + l_linenumber) * 100 + CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 30 END + CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS seq
FROM lineitem
"""
DEP_ENT = """
SELECT 'P' || p_partkey AS id, 'class' AS type, p_name AS name, 'packages/' || lower(replace(p_brand, '#', '')) || '/lib/' || replace(p_name, ' ', '_') || '.dart' AS file, CAST(p_size AS BIGINT) AS line, p_partkey AS seq FROM part
UNION ALL SELECT 'S' || s_suppkey, 'module', s_name, 'vendor/n' || s_nationkey || '/' || s_name, CAST(0 AS BIGINT), 1000000000 + s_suppkey FROM supplier
"""
#: order -> customer -> nation -> region, with customers and nations that call each other in circles.
DAG = """
SELECT 'O' || o_orderkey || '::place' AS source, 'C' || o_custkey || '::pay' AS target, CAST(1 AS BIGINT) AS line FROM orders
UNION ALL SELECT 'C' || c_custkey || '::pay', 'N' || c_nationkey || '::tax', CAST(2 AS BIGINT) FROM customer
UNION ALL SELECT 'N' || n_nationkey || '::tax', 'R' || n_regionkey, CAST(3 AS BIGINT) FROM nation
UNION ALL SELECT 'N' || n_nationkey || '::tax', 'N' || CASE n_nationkey WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 3 ELSE 4 END || '::tax', CAST(4 AS BIGINT) FROM nation WHERE n_nationkey IN (3, 4, 5, 9)
UNION ALL SELECT 'C' || c_custkey || '::pay', 'C' || CASE c_custkey % 2 WHEN 0 THEN c_custkey - 1 ELSE c_custkey + 1 END || '::pay', CAST(5 AS BIGINT) FROM customer WHERE c_custkey <= 10
"""
#: State mutations, lifecycle components and such from events.
MUT = """
SELECT CASE event_type WHEN 'signup' THEN 'addListener' WHEN 'error' THEN 'removeListener' WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'setState' WHEN 1 THEN 'emit' WHEN 2 THEN 'update' ELSE 'set' END
    WHEN 'purchase' THEN 'notifyListeners' ELSE CASE event_id % 2 WHEN 0 THEN 'setValue' ELSE 'updates' END END AS type,
  'lib/u' || (user_id % 50) || '.dart' AS file, event_id % 400 AS line, 'm' || (event_id % 7) AS enclosing_method,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE 'User' || (user_id % 60) || '_' || (event_id % 20) END AS enclosing_class,
  CASE event_id % 4 WHEN 0 THEN 'init' WHEN 1 THEN 'dispose' WHEN 2 THEN 'build' END AS context, event_id AS seq FROM events
"""
_SENTENCES = """
You must always ask about education and degree before you proceed.|Never assume the visa status of a spouse.|Do not skip the budget question for exploring users.
It is mandatory to ask about english at turn 2 when planning.|Step 1 then step 2, followed by the next review.|A pathway is defined as a program and consists of streams.
For example, such as a settled migrant.|You must ask about family when waiting for the application.|A certificate is required for settled people, see q_docs_list.
Avoid the risk of refusal; this is not allowed.|The user is required to show savings while exploring, q_funds and q_income2.|Plain prose about a community.
You shall not repeat; never repeat, never skip.|Don't go: prohibited, must not.|Dont ask "why" and inquire, probe 12 or turn 12-a.|Neverland, skipping and donut are near misses.
Always include the hard rule; it is critical and important, you need to.|You never ever skip it and shall go on.|An always ask rule.|Mustard, needle and callings miss.
After your answer, first move, firstly then finally the flow.|Before you continue, phase 3 in order and sequence.|Turn 4+ comes next, step9.|Reorder the overflow of thenceforth firsts.
It means a value that refers to a field.|The enum includes a schema and a model.|It has the following types:|Other type
Meanings, fields and valued remodels.|A ```json block.|A ```dart block.|Typescript and prototype lines.
GOOD: yes, BAD: no.|Instead of a violation, e.g.this, for instance.|Take e.g. this counterexample, goodness.|Bad:x and suchlike examples.
For settled people when the lifecycle changes.|If the pathway fits, adapt to lifecycle, context-aware.|In-process and pre_immigration, settled_pr.|For preparing, whenever users come, lifecycle based.
What about it ~ ? ~ asked.|Ask "who" and question it.|Inquiries and probes of questions.|Ask me nothing about self sufficient paper chasers.
You must decide about a job for planning people.|You must decide about a job for settled people.|You must never ask about a school while applied or permanent resident.|Nothing at all.
"""
#: Text chunks with an instruction sentence each, chosen by number; ~ is a line end.
CHUNK = f"""
SELECT source AS file, doc_id AS seq, text || ' ' || replace(CASE doc_id % 52 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SENTENCES.strip().replace("'", "''").replace(chr(10), "|").split("|")))} ELSE 'Plain.' END, '~', chr(10)) AS text
FROM documents WHERE text IS NOT NULL
"""
_SNIPPETS = """
if __name__ == "__main__":|    app = FastAPI(x)|def main():|run manage.py now|    __name__ == __main__|app.listen(80)|createServer (1)|export default function f() {}|void main() {|  runApp(X());|  return GetMaterialApp(|CupertinoAppX(
public static void main(String[] a) {|@SpringBootApplication|func main() {|package main|http.ListenAndServe(":80")|r = gin.Default()|gin.Defaults()|fn main() {|#[tokio::main]|use axum::Router|Rails.application.run|if __FILE__ == __FILE__
public function index() {|Route::get("/x")|use Symfony|x = os.environ["API_KEY_A"]|y = os.getenv("HOME_A", os.environ.get("HOME_A"))|z = process.env.SECRET_B + process.env["PATH_B"]|process.environment.NO|Platform.environment["TOKEN_C"]|bool.fromEnvironment("IS_C")
System.getenv("JAVA_D") + System.getProperty("auth_d")|os.LookupEnv("GO_E")|std::env::var("RUST_F") env!("BUILD_F")|env!("ONLY_F") and env!("BOTH_F") std::env::var("BOTH_F")|ENV["RUBY_G"]|getenv("PHP_H") $_ENV["PRIVATE_KEY_H"]|getenv(PHP_I)
const ENABLE_A = true|final bool IS_B_ENABLED = False|let feature_c = TRUE|const ENABLED_D = true|FeatureFlags.of(x)|FeatureSwitch.of(x)|if (isEnabled("x") = true) FeatureToggle {|if hasFeature("y")|final int MAX_A = 42;|const String NAME_B = "abc";|static num OK = 1;|const MAX_C = 3;|const int ERROR_D = 7|final String AB = "x"
base_url = "https://api.example.com/v1"|endpoint: http://x.example.org/abc/defghijklmnopqrstuvwxyz/abcdefghijklmnopqrstuvwxyz|baseurls = "https://no.example"|call("/api/users") + get("/v2/x")|call("/apis/users")|from django.db import models|from flask import Flask|import Flasks|import "package:flutter/material.dart"
import React from "react"|import Vue from "vue"|import "next/link"|import { X } from "@angular/core"|class ActiveRecordX:|Illuminate|const e = require("express")|@RestController|from "../a" import x|from .base import Thing|import "./b.dart"|from "@/c"|from "./lib/index"|import "lib/index"|import java.util.List
class Item extends Base {|class item_lower {|interface IThing {|class _Hidden {|struct Point {|class UserService {|class HomeController {|class ViewModelX {|enum Color { Red }|throw new Error()|ErrorBoundary|Optional<X>|onError(e)|nothing to see|# TODO later|/** doc */ x|/* block */|/// dart doc|-- sql|import pytest~def test_a():~def test_b():
import unittest|def test_x():~def test(y):~mock(z)|it("does") expect(1)~test("b")|describe x|assert y~vi.mock|testWidgets("w")~test("v")~setUp()|import "package:mocktail/m.dart"|@Test~@Before|#[test]|func TestA() {~func TestB() {|def test_r~it "x"|function testP() {|class AbTests extends X|toMatchSnapshot()|require.x~import "testing"
await Firebase.initializeApp(config.key)|Hive.openBox(x)|AuthSetup.x Auth.configure()|runApp(ProviderScope(child: X))|final router = GoRouter(|routes: {}|Logger.setup(a)|Redis.init()|apiUrl = 1~api = 2|fetch(a)|WebSocket(x)|Queue.start()|WidgetsFlutterBinding.ensureInitialized()|SystemChrome.x|createRoot(a) StrictMode|django.setup()|SpringApplication.run(x)
initialRoute: "/home",|home: HomeScreen(),|path="/" element={<Home />}|path="/x" element={<X />}
"""
_S = _SNIPPETS.strip().replace("'", "''").replace("\n", "|").split("|")


def _pick(number: str) -> str:
    return f"CASE ({number}) % {len(_S)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_S)) + " END"


#: Source files of ten languages, written from parts; three of the lines above each.
CODE = f"""
SELECT CASE p % 6 WHEN 0 THEN 'src/services/' WHEN 1 THEN 'lib/models/' WHEN 2 THEN 'api/Views/' WHEN 3 THEN 'tests/' WHEN 4 THEN 'core/' ELSE '' END
    || CASE WHEN p % 40 IN (5, 6, 7, 8) THEN 'd' || p || '/' || CASE p % 40 WHEN 5 THEN 'main' WHEN 6 THEN 'app_config' WHEN 7 THEN 'Settings' ELSE 'index' END || ext
      WHEN p % 50 = 10 THEN 'contest_' || n || '.py'
      WHEN p % 5 = 3 THEN CASE ext WHEN '.py' THEN 'test_' || t || n || '.py' WHEN '.dart' THEN t || n || '_test.dart' WHEN '.go' THEN t || n || '_test.go' WHEN '.rs' THEN t || n || '_test.rs'
        WHEN '.rb' THEN t || n || '_spec.rb' WHEN '.java' THEN t || n || 'Test.java' WHEN '.php' THEN t || n || 'Test.php' ELSE t || n || '.spec' || ext END
      ELSE CASE p % 5 WHEN 0 THEN 'auth_svc' || n WHEN 1 THEN 'cartModel' || n WHEN 2 THEN 'Page' || n ELSE CASE p % 3 WHEN 0 THEN 'a-b' || n WHEN 1 THEN 'MAX_SIZE' || n ELSE '0x' || n END END || ext END AS path,
  p AS seq, replace('import os~' || {_pick("p")} || '~' || {_pick("p * 7 + 3")} || '~' || {_pick(f"CASE WHEN p % 3 = 0 THEN {len(_S) - 1} - (p * 13 + p_size) % 30 ELSE p * 13 + p_size END")} || '~end', '~', chr(10)) AS content
FROM (SELECT p_partkey AS p, p_size, CAST(floor(p_partkey / 5) AS BIGINT) AS n, CASE CAST(floor(p_partkey / 5) AS BIGINT) % 4 WHEN 0 THEN 'auth_svc' WHEN 1 THEN 'cartModel' WHEN 2 THEN 'Page' ELSE 'none' END AS t,
  CASE p_partkey % 11 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.dart' WHEN 3 THEN '.js' WHEN 4 THEN '.java' WHEN 5 THEN '.go' WHEN 6 THEN '.rs' WHEN 7 THEN '.rb' WHEN 8 THEN '.php' WHEN 9 THEN '.tsx' ELSE '.txt' END AS ext FROM part)
"""


def tables_of(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)]


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the Parquet tables of sf_dir, which it names as they are."""
    for t in tables_of(sql):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
