"""The command line and the query server over a small tree."""

import json
import threading
import urllib.request

from latticework import __main__ as cli
from latticework.sources import files, sinks
from latticework.streaming import serve
from latticework.streaming.watch import LiveGraph

MAIN = '''"""Entry."""
from helpers import used


def main():
    """Start the harbour clock."""
    used()
    used()


def forgotten():
    return 1
'''
HELPERS = "def used():\n    return inner()\n\n\ndef inner():\n    return inner2() + inner2()\n\n\ndef inner2():\n    return 2\n"


def tree(folder):
    (folder / "app").mkdir(parents=True)
    (folder / "app" / "main.py").write_text(MAIN)
    (folder / "app" / "helpers.py").write_text(HELPERS)
    return str(folder / "app")


def rows(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_commands(spark, tmp_path, capsys):
    root = tree(tmp_path)
    run = lambda *argv: cli.run(list(argv), spark)
    for form, options in (("parquet", ()), ("lines", ("--json",))):
        assert run("index", root, "-o", str(tmp_path / form), *options) == 0
        assert rows(capsys)[0]["nodes"] == 5
        assert run("query", str(tmp_path / form), "--kind", "function") == 0
        assert {r["name"] for r in rows(capsys)} == {"main", "forgotten", "used", "inner", "inner2"}
    stored = str(tmp_path / "parquet")
    assert run("dead-code", stored) == 1 and {(r["name"], r["status"]) for r in rows(capsys)} == {("forgotten", "dead"), ("main", "entry")}
    assert run("dead-code", stored, "--entry", f"{root}/main.py::forgotten") == 0
    rows(capsys)
    assert run("dead-code", stored, "--entry", f"{root}/main.py::forgotten", "--threshold", "1.0", "--output", str(tmp_path / "report")) == 0
    rows(capsys)
    assert run("search", root, "harbour clock", "-n", "3") == 0 and rows(capsys)[0]["name"] == "main"
    assert run("hot-paths", root, "-n", "2") == 0 and len(rows(capsys)) == 2
    assert run("similar", root, "used", "-n", "1") == 0 and len(rows(capsys)) == 1
    assert run("stats", root) == 0 and run("communities", root) == 0 and run("cross-repo", root) == 0
    for name in ("dashboard", "page"):
        assert run(name, root, "-o", str(tmp_path / f"{name}.html")) == 0 and "</html>" in (tmp_path / f"{name}.html").read_text()
    assert run("adr", root, "-o", str(tmp_path / "adr")) == 0 and list((tmp_path / "adr").glob("adr-*.md"))
    assert run("index", str(tmp_path / "nowhere"), "-o", str(tmp_path / "x")) == 1 and run("schema") == 0


def test_server(spark, tmp_path):
    live = LiveGraph(spark, str(tmp_path / "g"))
    change = lambda name, event, text: spark.createDataFrame([(name, event, "2024-01-01 00:00:00", text)], "filepath string, event string, seen string, text string").selectExpr("filepath", "event", "cast(seen as timestamp) as seen", "text")
    live.apply(change("a.py", "created", HELPERS), 0)
    with serve.server(live) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()

        def get(path):
            with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{path}") as r:
                return json.load(r)

        try:
            assert {r["name"] for r in get("/nodes?kind=function")} == {"used", "inner", "inner2"} and len(get("/nodes?limit=1")) == 1
            assert get("/node?id=a.py::used")[0]["name"] == "used" and get("/node?id=none") == []
            assert get("/search?q=inner&top=1") and get("/stats")[0]["node_count"] == 3 and len(get("/hot?top=2")) == 2
            assert {r["batch"] for r in get("/feed?topic=node_changed")} == {0}
            live.apply(change("a.py", "deleted", None), 1)
            assert {r["change"] for r in get("/feed?topic=node_changed&since=0&wait=5")} == {"removed"} and get("/nodes") == []
            try:
                get("/nothing")
                raise AssertionError
            except urllib.error.HTTPError as e:
                assert e.code == 404
        finally:
            http.shutdown()


def test_a_file_whose_tokens_cannot_be_scanned(monkeypatch):
    """Line by line instead, with the same rows as the table operator gives."""
    text = 'import { x } from "lib"\nexport const go = (a) => run(a)\nclass A {}\nif (x) return <Page />'
    from latticework.sources import script_source

    def broken(self):
        raise IndexError

    monkeypatch.setattr(script_source._Scan, "run", broken)
    found = files.parse_text("a.ts", text)
    assert {(r["what"], r.get("name") or r.get("target")) for r in found} == {("edge", "lib"), ("symbol", "go"), ("symbol", "A"), ("edge", "const"), ("edge", "run"), ("edge", "Page")} or {r.get("name") or r.get("target") for r in found} >= {"lib", "go", "A", "run", "Page"}
    assert sinks.schema_document().count("(") == 2
