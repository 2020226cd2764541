import datetime as dt
import json

from loomgraph.engine import Engine
from loomgraph.operators.prompts import chunks_of, prompt_text
from loomgraph.operators.startup import framework_inits, initial_route, initializations
from loomgraph.sources.sinks import append_section, graph_json, mermaid
from loomgraph.streaming.rescan import changes_per_window, file_stream, merge_hashes
from tests.test_extract import PROJECT, write


def test_scan_query_report(spark, tmp_path):
    write(tmp_path, {**PROJECT, "README.md": "# A\nYou must always ask about education.\n" + "word " * 60 + "\n## B\nNever skip it.\n"})
    e = Engine.scan(spark, str(tmp_path))
    assert {r.id for r in e.query("helper").collect()} <= {"helper", "test_helper"}
    assert [r.path for r in e.paths("test_utils.py", "src/utils.py").collect()] == ["tests/test_utils.py>src/utils.py"]
    text = e.report()
    assert "## Hubs" in text and "src/utils.py" in text
    assert "<svg" in e.html()
    doc = graph_json(str(tmp_path / "out/graph.json"), e.entities, e.edges)
    assert json.loads((tmp_path / "out/graph.json").read_text()) == doc
    back = Engine.load(spark, str(tmp_path / "out/graph.json"))
    assert back.entities.count() == e.entities.count()
    assert mermaid(e.entities, e.edges).startswith("graph TB")
    assert {r.kind for r in e.entry_points().collect()} == {"main"}
    assert e.changed(e.hashes()).count() == 0


def test_sections_stay():
    r = append_section("# R\n\n## A\nx\n\n## B\ny\n", "A", "## A\nnew")
    assert "## B\ny" in r and "x" not in r.split("## B")[0].split("# R")[1].replace("## A", "")
    assert r.endswith("## A\nnew\n")


def test_prompts():
    assert prompt_text("a.json", json.dumps({"x": ["s", "t" * 60]})) == "t" * 60
    assert prompt_text("a.py", 'x = """' + "p " * 40 + '"""') == ("p " * 40).strip()
    assert prompt_text("a.yaml", "k: |\n  " + "long text " * 8 + "\nz: 1\n") == ("long text " * 8).strip()
    c = chunks_of("# A\none\n## B\ntwo\n# C\nthree")
    assert [(t, a, b, h, l) for t, a, b, h, l in c] == [("# A\none\n## B\ntwo", 1, 4, "A", 1), ("## B\ntwo", 3, 4, "B", 2), ("# C\nthree", 5, 6, "C", 1)]
    assert chunks_of("plain")[0][3] == "(root)"


def test_startup(spark):
    text = "void main() async {\n  await Firebase.initializeApp(config.key);\n  WidgetsFlutterBinding.ensureInitialized();\n  home: HomeScreen(),\n" + "x\n" * 60 + "Redis.init()\n"
    f = spark.createDataFrame([("main.dart", text, 1)], "path string, content string, seq long")
    assert [(r.line, r.type, r.name, r.config_refs, r.is_async) for r in initializations(f).collect()] == [(2, "database", "Firebase", "key", True)]
    assert [tuple(r) for r in framework_inits(f).collect()] == [("main.dart", 1, 3, "flutter", "flutter_binding")]
    assert [tuple(r) for r in initial_route(f).collect()] == [("main.dart", 1, None, "HomeScreen")]


def test_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    put = lambda k, rows: spark.createDataFrame(rows, "path string, content string, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    put(0, [("a", "1", t), ("b", "1", t), ("a", "2", t + dt.timedelta(minutes=1))])
    run = lambda: merge_hashes(file_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    run()
    put(1, [("b", "9", t), ("c", "1", t)])
    run()
    assert {(r.path, r.change) for r in spark.read.parquet(str(tmp_path / "log/1")).collect()} == {("b", "modified"), ("c", "added")}
    assert spark.read.parquet(str(tmp_path / "t/1")).count() == 3
    q = changes_per_window(file_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.versions, r.chars) for r in spark.table("w").collect()] == [(5, 5)]
