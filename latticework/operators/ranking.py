"""Degrees and hot paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Graph
from ..storage import maybe_broadcast
from . import iterative

WEIGHTS = ("in_degree", "out_degree", "betweenness", "pagerank")


def resolve_names(g: Graph) -> Graph:
    """Edges to names led to the nodes of that name; for graphs fresh from parsers, whose call targets are names."""
    from .relations import resolved_targets

    return Graph(g.nodes, resolved_targets(g).withColumn("target", F.col("node")).select(g.edges.columns))


def degrees(g: Graph) -> DataFrame:
    """(id, in_degree, out_degree) of every node, over distinct edges between nodes."""
    links = g.links()
    ends = F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counted = links.select(F.inline(ends)).groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return g.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def hot_paths(g: Graph, top_n: int = 20, weight: str = "in_degree", pagerank_rounds: int | None = None) -> DataFrame:
    """The `top_n` nodes by a centrality, ties in insertion order: node columns, score, rank, in_degree, out_degree."""
    if weight not in WEIGHTS and not g.nodes.isEmpty():
        raise ValueError(f"unknown weight {weight}: one of {', '.join(WEIGHTS)}")
    found = degrees(g)
    if weight == "betweenness":
        found = found.join(iterative.betweenness(g), "id")
    elif weight == "pagerank":
        found = found.join(iterative.pagerank(g, fixed=pagerank_rounds), "id")
    else:
        found = found.withColumn("score", F.col(weight if weight in WEIGHTS else "in_degree").cast("double"))
    # Sums whose last bits differ tie.
    best = [F.round("score", 12).desc(), F.col("ord")]
    top = g.nodes.select("ord", "id").join(found, "id").orderBy(*best).limit(top_n)
    # The window follows the limit: its one partition holds top_n rows.
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*best))).drop("ord")
    return g.nodes.join(maybe_broadcast(top, top_n, 100), "id")


def hot_paths_per_repo(g: Graph, top: int = 5) -> DataFrame:
    """Up to `top` nodes of each repo among the 3 * top of the whole graph with the most incoming edges."""
    hot = hot_paths(g, 3 * top).withColumn("repo", F.when(F.col("repo") == "", "default").otherwise(F.col("repo")))
    ranked = hot.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("rank"))).where(F.col("place") <= top)
    return ranked.select("repo", "place", "id", "name", F.col("filepath").alias("file"), F.bround("score", 3).alias("score"), "in_degree")
