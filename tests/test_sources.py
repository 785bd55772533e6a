"""Source readers, files, sinks and workspaces."""

import json

import pytest
from graphs import hot

from latticework.sources import files, go_source, python_source, script_source, sinks


def symbols(rows):
    return {(r["name"], r["kind"], r["parent"]) for r in rows if r["what"] == "symbol"}


def edges(rows):
    return {(r["source"], r["target"], r["relation"]) for r in rows if r["what"] == "edge"}


PY = '''"""Doc."""
import os
from a.b import c

class Base: ...

class Tool(Base):
    """A tool."""
    def run(self, x: int, *rest, flag=False, **more):
        """Run it."""
        helper(x)
        subprocess.run(["git", "status"])

async def helper(y):
    def inner():
        print(y)
    return inner()
'''


def test_python():
    rows = python_source.extract("m.py", PY)
    assert symbols(rows) == {("Base", "class", None), ("Tool", "class", None), ("run", "function", "Tool"), ("helper", "function", None), ("inner", "function", None)}
    found = edges(rows)
    assert {("m.py", "os", "imports"), ("m.py", "a.b.c", "imports"), ("m.py::Tool", "Base", "inherits"), ("m.py::Tool.run", "helper", "calls"), ("m.py::Tool.run", "git", "subprocess"), ("m.py::helper", "print", "calls"), ("m.py::inner", "print", "calls")} <= found
    run = next(r for r in rows if r.get("name") == "run")
    assert run["signature"] == "def run(self, x: int, *rest, flag, **more)" and run["docstring"] == "Run it."


GO = """package main
import (
  "fmt"
  "net/http"
)
type Server struct {
  http.Handler
  port int
}
type Runner interface { Run() }
func (s *Server) Start(port int) error {
  fmt.Println("x")
  return helper(port)
}
func helper(n int) error { return nil }
"""


def test_go():
    rows = go_source.extract("m.go", GO)
    assert symbols(rows) == {("Server", "struct", None), ("Runner", "interface", None), ("Start", "method", "Server"), ("helper", "function", None)}
    assert {("m.go", "fmt", "imports"), ("m.go", "net/http", "imports"), ("m.go::Server", "http.Handler", "inherits"), ("m.go::Server.Start", "fmt.Println", "calls"), ("m.go::Server.Start", "helper", "calls")} <= edges(rows)
    assert next(r for r in rows if r.get("name") == "Start")["signature"] == "func (*Server) Start (port int) error"


TS = """import React, { useState as state } from 'react';
export interface Props { title: string }
export class Panel extends Base {
  render() { return draw(this.props); }
}
export const Card = (p: Props) => { const [a] = useState(0); return <Button onClick={go} />; };
export default function HomePage() { return <Card />; }
const limit = 5;
"""


def test_typescript():
    rows = script_source.extract("p.tsx", TS)
    assert symbols(rows) == {("Props", "interface", None), ("Panel", "class", None), ("render", "function", "Panel"), ("Card", "function", None), ("HomePage", "function", None), ("limit", "variable", None)}
    assert {("p.tsx", "react", "imports"), ("p.tsx", "react::state", "imports"), ("p.tsx::Panel", "Base", "inherits"), ("p.tsx::Panel.render", "draw", "calls"), ("p.tsx::Card", "useState", "calls"), ("p.tsx::Card", "Button", "calls"), ("p.tsx::HomePage", "Card", "calls"), ("p.tsx", "HomePage", "exports"), ("p.tsx", "default", "exports")} <= edges(rows)


def test_by_line(spark):
    df = spark.createDataFrame([("p.ts", "import { x } from 'mod';\nexport class A {\n  go() { if (b(1)) {} }\n}\nexport function f() {}\nconst g = (q) => <Box/>;")], "filepath string, text string")
    found = {(r["line"], r["what"], r["name"]) for r in script_source.by_line(df).collect()}
    assert {(1, "imports", "mod"), (2, "class", "A"), (2, "exports", "A"), (3, "calls", "go"), (3, "calls", "b"), (5, "function", "f"), (5, "exports", "f"), (6, "function", "g"), (6, "calls", "Box")} <= found
    assert not any(n == "if" for _, w, n in found if w == "calls")


def test_dispatch():
    assert files.reader_of("a/B.PY") is python_source.extract and files.reader_of("x.rb") is None
    with pytest.raises(ValueError):
        files.parse_text("x.rb", "")


@pytest.fixture
def tree(tmp_path):
    repo = tmp_path / "tool"
    (repo / "node_modules").mkdir(parents=True)
    (repo / ".hidden").mkdir()
    (repo / "m.py").write_text(PY)
    (repo / "m.go").write_text(GO)
    (repo / "p.tsx").write_text(TS)
    (repo / "broken.py").write_text("def (")
    (repo / "node_modules" / "x.py").write_text("def no(): ...")
    (repo / ".hidden" / "y.py").write_text("def no(): ...")
    (repo / "pyproject.toml").write_text("")
    return tmp_path


def test_tree_and_workspace(spark, tree):
    g = files.read_tree(spark, str(tree / "tool"), "tool")
    names = [r["name"] for r in g.nodes.orderBy("ord").collect()]
    assert names[:5] == ["Base", "Tool", "run", "helper", "inner"] and "no" not in names and "Start" in names and "HomePage" in names
    assert g.nodes.where("repo <> 'tool'").count() == 0
    assert files.find_repos(str(tree)) == [str(tree / "tool")]
    (tree / "tool" / "use.py").write_text("import os, otherlib\nos.system('deploy now')\n")
    w = files.read_workspace(spark, files.find_repos(str(tree)), {"deploy": "deployer", "git": "git-tools"}, {"otherlib": "other"})
    between = {(r["target"], r["relation"]) for r in w.edges.where("relation like 'cross%'").collect()}
    assert between == {("deployer", "cross_repo_call"), ("git-tools", "cross_repo_call"), ("other", "cross_repo_import")}
    assert {r["id"] for r in w.nodes.where("kind = 'repo'").collect()} == {"deployer", "git-tools", "other"}


def test_round_trips_and_pages(spark, tmp_path):
    g = hot(spark)
    sinks.write_json(g, str(tmp_path / "j"))
    back = files.read_json(spark, str(tmp_path / "j"))
    assert [r["id"] for r in back.nodes.orderBy("ord").collect()] == ["n1", "n2", "n3", "n4", "n5"] and back.edges.count() == 5
    sinks.write_parquet(g, str(tmp_path / "p"), ("language",))
    assert files.read_parquet(spark, str(tmp_path / "p")).edges.count() == 5
    (tmp_path / "old.json").write_text(json.dumps({"nodes": [{"id": "a", "name": "x"}, {"id": "a", "name": "y"}], "edges": [{"source": "a", "target": "b"}], "communities": {}}))
    old = files.read_json(spark, str(tmp_path / "old.json"))
    row = old.nodes.collect()
    assert len(row) == 1 and row[0]["name"] == "y" and row[0]["language"] == "python"
    sinks.write_page(g, str(tmp_path / "g.html"))
    page = (tmp_path / "g.html").read_text()
    assert "parse_json" in page and "<svg" in page
    sinks.write_dashboard(g, str(tmp_path / "d.html"))
    assert "Repositories" in (tmp_path / "d.html").read_text()
    sinks.usage_report(g, str(tmp_path / "u"))
    assert "nodes(" in sinks.schema_document()
