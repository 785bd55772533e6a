"""Projections, filters and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import Graph


def _conditions(df: DataFrame, wanted: dict) -> DataFrame:
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def nodes(g: Graph, language: str | None = None, kind: str | None = None, repo: str | None = None, limit: int | None = 100) -> DataFrame:
    """Nodes that meet all given equalities (an empty value asks for none), the first `limit` in insertion order."""
    found = _conditions(g.nodes, {"language": language, "kind": kind, "repo": repo})
    return found if limit is None else found.orderBy("ord").limit(limit)


def node(g: Graph, id: str) -> DataFrame:
    return g.nodes.where(F.col("id") == id)


def edges(g: Graph, source: str | None = None, target: str | None = None, relation: str | None = None, repo: str | None = None) -> DataFrame:
    return _conditions(g.edges, {"source": source, "target": target, "relation": relation, "repo": repo})


def api_nodes(nodes: DataFrame) -> DataFrame:
    """Field names of the query API; columns that no analysis supplies have the API's defaults."""
    have = set(nodes.columns)
    optional = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    return nodes.select(
        "id", "name", F.col("kind").alias("type"), "language", F.col("filepath").alias("file_path"), F.col("line").alias("line_start"),
        (F.coalesce(F.col("line_end"), F.col("line")) if "line_end" in have else F.col("line")).alias("line_end"),
        "docstring", "signature", "parent", "repo", optional("in_degree", 0).alias("in_degree"), optional("out_degree", 0).alias("out_degree"),
        optional("is_hot", False).alias("is_hot"), optional("is_dead", False).alias("is_dead"), optional("is_entry_point", False).alias("is_entry_point"),
    )


def api_edges(edges: DataFrame) -> DataFrame:
    have = set(edges.columns)
    return edges.select(
        (F.coalesce(F.col("id"), F.lit("")) if "id" in have else F.lit("")).alias("id"), "source", "target", F.col("relation").alias("type"), "line",
        (F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in have else F.lit(1.0)).alias("weight"), "repo",
    )


def lookup(g: Graph, column: str, value: str) -> DataFrame:
    """All nodes of a repo, language, kind or file; Parquet partitioned or bucketed by the column makes it an index."""
    if column not in ("repo", "language", "kind", "filepath"):
        raise ValueError(f"no index on {column}")
    return g.nodes.where(F.col(column) == value)


def index_size(g: Graph) -> DataFrame:
    """Postings of the four indices: every node is in each."""
    return g.nodes.agg((4 * F.count(F.lit(1))).alias("index_size"))


def postings(g: Graph) -> DataFrame:
    """(index, value, n_nodes) of the four indices, in one pass over the nodes."""
    pairs = F.array(*[F.struct(F.lit(c).alias("index"), F.col(c).alias("value")) for c in ("repo", "language", "kind", "filepath")])
    return g.nodes.select(F.explode(pairs).alias("p")).groupBy("p.index", "p.value").agg(F.count(F.lit(1)).alias("n_nodes"))


def repo_subgraph(g: Graph, repo: str) -> Graph:
    """Nodes of a repo and its edges between them."""
    kept = g.nodes.where(F.col("repo") == repo)
    return Graph(kept, Graph(kept, g.edges.where(F.col("repo") == repo)).inner_edges())


def repos(g: Graph) -> DataFrame:
    """Sorted distinct repos of nodes and edges, without the empty one."""
    return g.nodes.select("repo").union(g.edges.select("repo")).where("repo <> ''").distinct().orderBy("repo")


def pattern_search(g: Graph, pattern: str, top_k: int = 10) -> DataFrame:
    """Nodes whose whole name matches a shell pattern, longest names first."""
    hits = g.nodes.where(F.col("name").rlike(text.glob_regex(pattern)))
    ranked = hits.orderBy(F.length("name").desc(), "ord").limit(top_k)
    return ranked.select("id", "name", F.lit(1.0).alias("score"), F.array(F.lit(pattern)).alias("matched"), text.snippet().alias("snippet"), "ord")


def find_symbol(g: Graph, query: str) -> DataFrame:
    """Nodes with the query in name (10, functions 5 more), docstring (3) or signature (2), best first."""
    q = F.lower(F.lit(query))
    held = lambda c: F.contains(F.lower(c), q)
    points = F.when(held("name"), 10).otherwise(0) + F.when(held("docstring"), 3).otherwise(0) + F.when(held("signature"), 2).otherwise(0)
    points = points + F.when(held("name") & (F.col("kind") == "function"), 5).otherwise(0)
    return g.nodes.withColumn("score", points).where("score > 0").orderBy(F.col("score").desc(), "ord")


def client_search(g: Graph, query: str, top_k: int = 10) -> DataFrame:
    scored = g.nodes.withColumn("score", text.client_score(query, F.col("name"), F.col("docstring"), F.col("filepath")))
    return scored.where("score > 0").orderBy(F.col("score").desc(), "ord").limit(top_k)
