"""Counts and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from .relations import cross_repo_edges


def named_repo(repo: Column) -> Column:
    return F.when(F.coalesce(repo, F.lit("")) == "", F.lit("default")).otherwise(repo)


def _histogram(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column), F.col("n")))))
    return counts.groupBy(*keys).agg(entries.alias(name)) if keys else counts.agg(entries.alias(name))


def graph_stats(g: Graph) -> DataFrame:
    """One row: nodes, edges, languages, kinds, communities, dead, entry points, coverage."""
    from . import communities, usage

    counts = g.nodes.agg(F.count(F.lit(1)).alias("node_count"))
    edges = g.edges.agg(F.count(F.lit(1)).alias("edge_count"))
    groups = communities.labels(g).agg(F.count_distinct("community").alias("community_count"))
    usage_counts = usage.summary(g).select("dead_count", "entry_point_count", "coverage")
    out = counts
    for one in (edges, _histogram(g.nodes, [], "language", "languages"), _histogram(g.nodes, [], "kind", "types"), groups, usage_counts):
        out = out.crossJoin(one)
    return out


def index_summary(g: Graph) -> DataFrame:
    """One row: nodes, edges, cross-repo edges, communities."""
    from . import communities

    out = g.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges")))
    out = out.crossJoin(cross_repo_edges(g).agg(F.count(F.lit(1)).alias("cross_repo_edges")))
    return out.crossJoin(communities.labels(g).agg(F.count_distinct("community").alias("communities")))


def repo_stats(g: Graph) -> DataFrame:
    """Per repo: node_count, edge_count (by the source's repo), languages, types, entry_points."""
    nodes = g.nodes.withColumn("repo", named_repo(F.col("repo")))
    entry = (F.col("kind") == "function") & (F.col("name").isin("main", "__init__") | (F.coalesce("parent", F.lit("")) == ""))
    per = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("node_count"), F.count_if(entry).alias("entry_points"))
    per = per.join(_histogram(nodes, ["repo"], "language", "languages"), "repo").join(_histogram(nodes, ["repo"], "kind", "types"), "repo")
    # Edges are counted per source before they meet the nodes.
    sources = g.edges.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    edges = sources.join(nodes.select(F.col("id").alias("source"), "repo"), "source", "left").groupBy(named_repo(F.col("repo")).alias("repo")).agg(F.sum("n").alias("edge_count"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<long>"))
    return per.join(edges, "repo", "full").select(
        "repo", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
        F.coalesce("languages", none).alias("languages"), F.coalesce("types", none).alias("types"), F.coalesce("entry_points", F.lit(0)).alias("entry_points"),
    ).orderBy("repo")


def cross_repo_matrix(g: Graph) -> DataFrame:
    """(source_repo, target_repo, n_edges) of the pairs that have edges."""
    return cross_repo_edges(g).groupBy("source_repo", "target_repo").agg(F.count(F.lit(1)).alias("n_edges"))


def min_max(df: DataFrame, column: str, name: str, equal: float = 1.0) -> DataFrame:
    """`df` with its column scaled to 0..1 as `name`; all `equal` where the values are equal."""
    low, high = F.min(column).alias("_low"), F.max(column).alias("_high")
    scaled = F.when(F.col("_high") == F.col("_low"), F.lit(equal)).otherwise((F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return df.crossJoin(F.broadcast(df.agg(low, high))).withColumn(name, scaled).drop("_low", "_high")
