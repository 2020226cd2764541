import json

import pytest

from loomgraph.cli import main
from loomgraph.engine import Engine
from loomgraph.operators.extract import extract_one
from tests.test_extract import PROJECT, write

APP = {
    "pubspec.yaml": "name: shop\ndependencies:\n  flutter:\n    sdk: flutter\n",
    "lib/main.dart": "import './checkout.dart';\nvoid main() {\n  runApp(App());\n}\n",
    "lib/checkout.dart": "class CheckoutScreen extends Base {\n  void onSubmit() {}\n}\n",
    "docs/AGENTS.md": "# A\nYou must always ask about education.\n" + "word " * 60 + "\n## B\nYou must always ask about education.\n" + "word " * 60 + "\n",
}
FACTS = {"call_graph": {"lib/main.dart::main": {"calls": [{"target": "lib/a.dart::b", "line": 1}]}, "lib/z.dart::old": {"calls": [{"target": "lib/z.dart::older", "line": 2}]}}, "state_mutations": [{"type": "addListener", "file": "a", "line": 1, "enclosing_class": "A"}] * 2, "widget_lifecycle": [{"widget": "W", "overrides": ["initState"]}], "change_notifiers": [{"class": "N"}]}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shop")
    write(folder, {**PROJECT, **APP})
    (folder / "pyproject.toml").unlink()
    (folder / "package.json").unlink()
    (folder / "facts.json").write_text(json.dumps(FACTS))
    return folder


def test_help(capsys):
    with pytest.raises(SystemExit) as done:
        main(["--help"])
    assert done.value.code == 0 and "usage:" in capsys.readouterr().out.lower()


def test_scan_writes_all_outputs(root, capsys):
    assert main([str(root), "--journeys", "--behavioral", str(root / "facts.json")]) == 0
    out = root / ".loomgraph"
    doc = json.loads((out / "graph.json").read_text())
    assert doc["project"]["name"] == "shop" and doc["project"]["framework"] == "Flutter" and doc["project"]["files_analyzed"] > 5
    assert {e["id"]: e["type"] for e in doc["entities"]}["pubspec.yaml"] == "config"
    assert {(r["source"], r["target"]) for r in doc["relationships"] if r["type"] == "imports"} >= {("lib/main.dart", "lib/checkout.dart")}
    text = (out / "REPORT.md").read_text()
    assert all(f"## {x}" in text for x in ("Overview", "Hubs", "Clusters", "Confidence", "Behavioural analysis", "User journeys"))
    assert "subgraph" in (out / "graph.mermaid").read_text() and "<svg" in (out / "graph.html").read_text()
    assert (out / "USER_JOURNEYS.md").read_text().startswith("# User journeys") and "summary" in json.loads((out / "user_journeys.json").read_text())
    b = json.loads((out / "behavioral_analysis.json").read_text())
    assert {d["function"] for d in b["dead_code"]} == {"old", "older"} and b["summary"][0]["unpaired_listeners"] == 1
    assert "src/utils.py" in json.loads((out / "file_hashes.json").read_text())
    # a second run takes the graph that is there
    capsys.readouterr()
    assert main([str(root), "--mermaid"]) == 0
    assert "earlier scan" in (said := capsys.readouterr().out) and "graph TB" in said


def test_query_and_path(root, capsys):
    assert main([str(root), "--query", "CheckoutScreen"]) == 0
    assert "extends Base" in capsys.readouterr().out
    assert main([str(root), "--path", "lib/main", "checkout.dart"]) == 0
    assert "lib/main.dart > lib/checkout.dart" in capsys.readouterr().out
    assert main([str(root), "--query", "no such thing"]) == 1


def test_prompts_and_runtime(root, capsys):
    assert main([str(root), "--analyze-prompts"]) == 0
    doc = json.loads((root / ".loomgraph/instruction_analysis.json").read_text())
    assert doc["summary"][0]["total_redundancies"] >= 1 and {r["type"] for r in doc["redundancies"]} >= {"topic_collision", "semantic_duplicate"}
    assert main([str(root), "--runtime-analysis"]) == 0
    r = json.loads((root / ".loomgraph/runtime_analysis.json").read_text())
    assert {e["path"] for e in r["entry_points"]} >= {"src/main.py", "lib/main.dart"} and "flutter" in {f["framework"] for f in r["frameworks"]}
    text = (root / ".loomgraph/REPORT.md").read_text()
    assert all(f"## {x}" in text for x in ("Overview", "Instruction redundancy", "Runtime comprehension"))


@pytest.mark.parametrize(("files", "want"), [({"package.json": '{"name": "w"}', "pubspec.yaml": "name: p"}, ("w", "JavaScript/TypeScript")), ({"apps/a/pubspec.yaml": "name: sub", "x.py": "1"}, ("r", "Dart")), ({"go.mod": "module x", "pyproject.toml": '[project]\nname = "py"'}, ("py", "Go")), ({"x.py": "1"}, ("r", "Unknown"))])
def test_project_info(spark, tmp_path, files, want):
    write(tmp_path / "r", {"x.py": "", **files})
    p = Engine.scan(spark, str(tmp_path / "r")).info.first()
    assert (p["name"], p["language"]) == want


def test_dart_and_python_details():
    text = "@freezed\nimport 'package:a/b/c.dart';\nimport 'dart:io';\npart './p.dart';\nclass T extends Table {}\nclass X extends BaseTool with M, N {}\nmixin Q on A, B {}\nfinal fooProvider = StateProvider<int>((ref) => 1);\nGoRoute(name: 'n')\nWidget build() {}\n"
    rows = extract_one("lib/x.dart", text)
    assert [(r["candidates"], r["target"]) for r in rows if r["kind"] == "import"] == [(["packages/b/lib/c.dart", "lib/c.dart"], "b/c.dart"), ([], "lib/p.dart")]
    kinds = [(r["type"], r["name"]) for r in rows if r["kind"] == "entity"]
    assert ("class", "T") in kinds and ("schema", "T") in kinds and ("config", "fooProvider") in kinds and ("route", "n") in kinds and ("function", "build") not in kinds
    assert {(r["source"], r["target"]) for r in rows if r["kind"] == "edge" and r["type"] == "implements"} == {("X", "M"), ("X", "N"), ("Q", "A"), ("Q", "B")}
    py = extract_one("m.py", "class A(BaseModel):\n    class Config:\n        x = 1\n    async def run(self): ...\n    def _no(self): ...\n")
    assert [(r["type"], r["name"]) for r in py if r["kind"] == "entity"][1:] == [("schema", "A"), ("class", "Config"), ("function", "run")]
