"""Readers: source trees, graph JSON, workspaces."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from ..operators.relations import with_repo_nodes
from . import go_source, python_source, script_source
from .records import EXTRACTED

#: Reader of each suffix, in the order in which its files are numbered.
READERS: dict[str, Callable[[str, str], list[dict]]] = {".py": python_source.extract, ".go": go_source.extract, **dict.fromkeys((".ts", ".tsx", ".js", ".jsx"), script_source.extract)}
SKIPPED = ("venv", ".venv", "__pycache__", "node_modules", "vendor", "dist", "build", ".next")
MARKERS = (".git", "pyproject.toml", "setup.py", "go.mod", "package.json")


def reader_of(path: str) -> Callable | None:
    return READERS.get(Path(path).suffix.lower())


def parse_text(path: str, text: str) -> list[dict]:
    """Rows of one file; ValueError if no reader knows its suffix."""
    reader = reader_of(path)
    if reader is None:
        raise ValueError(f"no reader for {path}")
    return reader(path, text)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(filepath, suffix, text) of the readable files under a folder; hidden and SKIPPED folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(s[1:] for s in READERS) + "}").load(root)
    local = F.regexp_replace("path", r"^file:/*", "/")
    base = "/" + str(Path(root.removeprefix("file:"))).lstrip("/")
    inner = F.split(F.substring(F.col("filepath"), F.lit(len(base) + 2), F.length("filepath")), "/")
    wrong = F.exists(inner, lambda p: F.startswith(p, F.lit(".")) | p.isin(*SKIPPED))
    found = files.select(local.alias("filepath"), F.col("content").cast("string").alias("text")).where(~wrong)
    return found.select("filepath", F.concat(F.lit("."), F.element_at(F.split(F.lower("filepath"), r"\."), -1)).alias("suffix"), "text")


def extract(files: DataFrame) -> DataFrame:
    """Symbols and edges of (filepath, text) rows, one table; a file that can't be read gives a row with `error`."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in EXTRACTED.split(", ")]
        for batch in batches:
            rows = []
            for path, text in zip(batch["filepath"], batch["text"]):
                try:
                    rows += [{**r, "filepath": path, "place": k} for k, r in enumerate(parse_text(path, text))]
                except Exception as e:  # a broken file must not stop the others
                    rows.append({"filepath": path, "place": -1, "what": "error", "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names).astype({"line": "Int32", "place": "Int32"}).astype(object).where(lambda d: d.notna(), None)

    return files.select("filepath", "text").mapInPandas(run, EXTRACTED)


def read_tree(spark: SparkSession, root: str, repo: str | None = None) -> Graph:
    """Graph of a source tree, in order of suffix, path and place; `repo` names it, else repo stays empty."""
    return graph_of(extract(source_files(spark, root)), repo)


def graph_of(rows: DataFrame, repo: str | None = None) -> Graph:
    """Graph of the table that `extract` makes."""
    suffix = F.concat(F.lit("."), F.element_at(F.split(F.lower("filepath"), r"\."), -1))
    rank = F.coalesce(*[F.when(suffix == s, F.lit(k)) for k, s in enumerate(READERS)], F.lit(99))
    # Files are numbered first: the sort has a row per file, not per symbol.
    files = rows.select("filepath").distinct().withColumn("file_no", F.row_number().over(Window.orderBy(rank, "filepath")))
    placed = rows.join(files, "filepath").withColumn("ord", F.col("file_no").cast("long") * (1 << 24) + F.col("place"))
    placed = placed.withColumn("repo", F.lit(repo or ""))
    nodes = placed.where("what = 'symbol'").select([f.name for f in NODE_SCHEMA])
    edges = placed.where("what = 'edge'").select([f.name for f in EDGE_SCHEMA])
    return Graph.of(nodes, edges)


def read_json(spark: SparkSession, path: str) -> Graph:
    """Graph of a JSON file {nodes, edges}, or of a folder of JSON lines nodes and edges as `write_json` makes it.

    Absent keys take defaults, a repeated id its last value, stored communities are ignored.
    """
    parts = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    if parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(parts):
        return Graph.of(spark.read.schema(NODE_SCHEMA).json(f"{path}/nodes"), spark.read.schema(EDGE_SCHEMA).json(f"{path}/edges"))
    node = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in NODE_SCHEMA if f.name != "ord")
    edge = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in EDGE_SCHEMA if f.name != "ord")
    whole = spark.read.schema(f"nodes array<struct<{node}>>, edges array<struct<{edge}>>").json(path, multiLine=True)
    part = lambda c: whole.select(F.posexplode(c).alias("ord", "x")).select(F.col("ord").cast("long").alias("ord"), "x.*")
    return Graph.of(part("nodes"), part("edges"))


def read_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def find_repos(root: str) -> list[str]:
    """Folders directly below `root` that look like repositories, sorted."""
    return sorted(str(p) for p in Path(root).iterdir() if p.is_dir() and any((p / m).exists() for m in MARKERS))


def repo_level_edges(files: DataFrame, programs: dict[str, str], packages: dict[str, str]) -> DataFrame:
    """Edges of Python files (filepath, text) to the repos whose programs they start or whose packages they import."""
    spark = files.sparkSession

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(p, k, *f) for p, t in zip(batch["filepath"], batch["text"]) for k, f in enumerate(python_source.programs_and_packages(t))]
            yield pd.DataFrame(rows, columns=["source", "place", "what", "name", "line"])

    used = files.where(F.endswith("filepath", F.lit(".py"))).select("filepath", "text").mapInPandas(run, "source string, place int, what string, name string, line int")
    # The maps are configuration, a few names each.
    known = [("program", k, v, "cross_repo_call") for k, v in programs.items()] + [("package", k, v, "cross_repo_import") for k, v in packages.items()]
    table = F.broadcast(spark.createDataFrame(known, "what string, name string, target string, relation string"))
    return used.join(table, ["what", "name"]).select("place", "source", "target", "relation", "line")


def read_workspace(spark: SparkSession, roots: list[str], programs: dict[str, str] | None = None, packages: dict[str, str] | None = None, name_repos: bool = False) -> Graph:
    """Graph of several repositories with the edges between them and a node for each repo that an edge leads to."""
    whole, shift = Graph.empty(spark), 1 << 40
    between = []
    for k, root in enumerate(r for r in roots if Path(r).exists()):
        files = source_files(spark, root)
        g = graph_of(extract(files), Path(root).name if name_repos else None)
        move = lambda df: df.withColumn("ord", F.col("ord") + F.lit(k * shift))  # noqa: B023, E731
        whole = whole.union(Graph(move(g.nodes), move(g.edges)))
        between.append(repo_level_edges(files, programs or {}, packages or {}))
    for more in between:
        placed = more.withColumn("kind_no", F.when(F.col("relation") == "cross_repo_call", 0).otherwise(1))
        placed = placed.withColumn("ord", F.lit(len(roots) * shift) + F.row_number().over(Window.orderBy("kind_no", "source", "place")))
        whole = whole.add(edges=placed.select("ord", "source", "target", "relation", "line"))
    return with_repo_nodes(whole)
