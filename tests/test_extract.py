from pathlib import Path

from loomgraph.operators import graph as g
from loomgraph.operators.extract import build, config_facts, extract_one, is_source
from loomgraph.sources.files import project_root, scan


def write(root: Path, files: dict):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


PROJECT = {
    "src/__init__.py": '"""Package."""\n',
    "src/main.py": '"""Main."""\nfrom src.utils import helper\n\n\ndef main():\n    helper()\n\n\nif __name__ == "__main__":\n    main()\n',
    "src/utils.py": "def helper():\n    return 1\n\n\ndef unused():\n    return 2\n",
    "tests/__init__.py": "",
    "tests/test_utils.py": "from src.utils import helper\n\n\ndef test_helper():\n    assert helper()\n",
    "node_modules/x/index.js": "function no() {}",
    "web/a.ts": "import { b } from './b';\nexport class A extends B implements C, D {}\nexport const Panel = () => 1;\nconst run = async (x) => x;\n",
    "web/b.ts": "export interface B {}\n",
    "pyproject.toml": '[project]\nname = "demo"\n',
    "package.json": '{"name": "web", "dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}',
}


def test_scan_and_build(spark, tmp_path):
    write(tmp_path, PROJECT)
    assert project_root(str(tmp_path / "src")) == tmp_path.resolve()
    all_ = scan(spark, str(tmp_path)).cache()
    assert "node_modules/x/index.js" not in {r.path for r in all_.collect()}
    ent, edges = build(all_.where(is_source(all_.path)))
    rows = ent.collect()
    assert {r.id for r in rows if r.type == "module"} == {"src/__init__.py", "src/main.py", "src/utils.py", "tests/test_utils.py", "web/a.ts", "web/b.ts"}
    assert {("main", 5), ("helper", 1), ("unused", 5), ("test_helper", 4), ("run", 4)} == {(r.name, r.line) for r in rows if r.type == "function"}
    assert {("src/main.py", "src/utils.py"), ("tests/test_utils.py", "src/utils.py"), ("web/a.ts", "web/b.ts")} == {(e.source, e.target) for e in edges.where("type = 'imports'").collect()}
    assert {("A", "B", "extends"), ("A", "C", "implements"), ("A", "D", "implements")} == {(e.source, e.target, e.type) for e in edges.where("type <> 'imports'").collect()}
    merged = g.merge_entities(ent)
    top = g.hubs(g.simple_edges(edges, merged), merged).first()
    assert (top.id, top.connections) == ("src/utils.py", 2) or top.id == "A"
    facts = {r.path: r for r in config_facts(all_).collect()}
    assert facts["pyproject.toml"].name == "demo" and (facts["package.json"].dependencies, facts["package.json"].dev_dependencies) == ("react", "jest")


def test_dart():
    text = "import 'package:app/src/x.dart';\nvoid main() {\n  increment();\n}\nabstract class My extends Base with M implements I {\n  int get count => 1;\n  void increment() {}\n}\nenum E { a }\n"
    rows = extract_one("lib/main.dart", text)
    assert [(r["type"], r["name"]) for r in rows if r["kind"] == "entity"] == [("module", "main.dart"), ("class", "My"), ("enum", "E"), ("function", "main"), ("function", "increment")]
    assert [(r["source"], r["target"]) for r in rows if r["kind"] == "edge" and r["type"] != "calls"] == [("My", "Base"), ("My", "M"), ("My", "I")]
    assert {(r["target"], r["line"]) for r in rows if r["kind"] == "edge" and r["type"] == "calls"} == {("main", 2), ("increment", 3), ("increment", 7)}


def test_generic_and_empty():
    assert extract_one("x.go", "") == []
    assert [r["name"] for r in extract_one("x.go", "type Foo struct {}\nfunc Run() {}\nfunc ab() {}\n")] == ["x.go", "Foo", "Run"]
