"""Command line: python -m latticework COMMAND ...

A graph is a source tree, a JSON file or folder, or a folder that `index` wrote.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph
from .operators import communities, filters, ranking, records, relations, search, similarity, stats, usage
from .sources import files, sinks
from .streaming import serve, watch


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("latticework").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, path: str) -> Graph:
    """The graph at a path; FileNotFoundError if there is none."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"no such path: {path}")
    if p.is_file():
        return files.read_json(spark, path)
    if (p / "nodes").is_dir() and (p / "edges").is_dir():
        parquet = any((p / "nodes").rglob("*.parquet"))
        return files.read_parquet(spark, path) if parquet else files.read_json(spark, path)
    return files.read_tree(spark, path)


def _show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))


def _dead_code(g: Graph, a: argparse.Namespace) -> int:
    report = usage.classified(g, tuple(a.entry))
    wanted = ["dead", "entry", *(["suspicious"] if a.include_suspicious else [])]
    shown = report.where(F.col("status").isin(wanted)).select("id", "name", "filepath", "line", "incoming", "status")
    if a.output:
        sinks.usage_report(g, a.output, tuple(a.entry), a.include_suspicious)
    _show(shown.orderBy("status", "id"))
    total = usage.summary(g, tuple(a.entry), a.threshold).first()
    print(f"{total['dead_count']} dead, {total['entry_point_count']} entry points, {total['suspicious_count']} suspicious, coverage {total['coverage']:.2%}", file=sys.stderr)
    return 1 if total["has_dead"] or a.threshold > 0 and not total["meets_threshold"] else 0


def _index(g: Graph, a: argparse.Namespace) -> int:
    (sinks.write_json if a.json else sinks.write_parquet)(g, a.output)
    _show(stats.index_summary(g))
    return 0


def _watch(spark: SparkSession, a: argparse.Namespace) -> int:
    live = watch.LiveGraph(spark, a.folder)
    query = live.follow(watch.change_stream(spark, a.changes), f"{a.folder}/checkpoint", quiet_ms=a.quiet)
    if a.port is None:
        query.awaitTermination()
        return 0
    with serve.server(live, a.port) as http:
        print(f"http://127.0.0.1:{http.server_port}", flush=True)
        http.serve_forever()
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="latticework", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, graph: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=help_)
        if graph:
            c.add_argument("graph")
        return c

    c = add("index", "read a graph and write it as Parquet or JSON")
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--json", action="store_true")
    c = add("query", "nodes by language, kind and repo")
    for option in ("language", "kind", "repo"):
        c.add_argument(f"--{option}")
    c.add_argument("--limit", type=int, default=100)
    add("stats", "counts of the graph and of its repositories")
    add("cross-repo", "edges between repositories")
    c = add("communities", "directories that belong together")
    c.add_argument("--mixed", action="store_true", help="across languages")
    c = add("dead-code", "unused symbols; exit code 1 if there are any, or coverage is below the threshold")
    c.add_argument("--threshold", type=float, default=0.0)
    c.add_argument("--entry", action="append", default=[])
    c.add_argument("--include-suspicious", action="store_true")
    c.add_argument("--output", "-o")
    c = add("hot-paths", "most central nodes")
    c.add_argument("--top", "-n", type=int, default=20)
    c.add_argument("--weight", "-w", choices=ranking.WEIGHTS, default="in_degree")
    c = add("search", "BM25, or with --alpha its mean with similarity to the best hit")
    c.add_argument("text")
    c.add_argument("--top", "-n", type=int, default=10)
    c.add_argument("--alpha", type=float)
    c = add("similar", "nodes like one, given by id or name")
    c.add_argument("node")
    c.add_argument("--top", "-n", type=int, default=10)
    c.add_argument("--method", choices=similarity.METHODS, default="ast")
    c = add("adr", "decision records as Markdown files")
    c.add_argument("--output", "-o", required=True)
    for name, help_ in (("dashboard", "tables of the whole workspace on one page"), ("page", "the graph as a drawing")):
        add(name, help_).add_argument("--output", "-o", required=True)
    add("schema", "the tables' schemas", graph=False)
    c = add("watch", "apply a folder's changes as they come, and serve the graph", graph=False)
    c.add_argument("changes")
    c.add_argument("folder")
    c.add_argument("--quiet", type=int, default=500, help="milliseconds without a change before a file is read")
    c.add_argument("--port", type=int)
    return top


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    """Exit code of a command line."""
    a = parser().parse_args(argv)
    if a.command == "schema":
        print(sinks.schema_document())
        return 0
    spark = spark or _session()
    if a.command == "watch":
        return _watch(spark, a)
    try:
        g = load(spark, a.graph)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    if a.command == "index":
        return _index(g, a)
    if a.command == "dead-code":
        return _dead_code(g, a)
    if a.command == "query":
        _show(filters.api_nodes(filters.nodes(g, a.language, a.kind, a.repo, a.limit)))
    elif a.command == "stats":
        _show(stats.graph_stats(g))
        _show(stats.repo_stats(g))
    elif a.command == "cross-repo":
        _show(relations.cross_repo_edges(g).orderBy("ord"))
    elif a.command == "communities":
        _show(communities.overview(g, a.mixed).orderBy("number"))
    elif a.command == "hot-paths":
        _show(ranking.hot_paths(g, a.top, a.weight).select("rank", "id", "name", "filepath", "score", "in_degree", "out_degree").orderBy("rank"))
    elif a.command == "search":
        _show(search.search(g, a.text, a.top) if a.alpha is None else search.hybrid_search(g, a.text, a.top, a.alpha))
    elif a.command == "similar":
        _show(similarity.find_similar_by_name(g, a.node, a.top, a.method))
    elif a.command == "adr":
        print("\n".join(sinks.write_records(records.decision_records(g), a.output)))
    else:
        (sinks.write_dashboard if a.command == "dashboard" else sinks.write_page)(g, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
