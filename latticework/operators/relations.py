"""Joins of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..model import Graph


def _ends(g: Graph, *columns: str) -> DataFrame:
    s = g.nodes.select(F.col("id").alias("source"), *[F.col(c).alias(f"source_{c}") for c in columns])
    t = g.nodes.select(F.col("id").alias("target"), *[F.col(c).alias(f"target_{c}") for c in columns])
    return g.edges.join(s, "source").join(t, "target")


def cross_repo_edges(g: Graph) -> DataFrame:
    """Edges between nodes of different, named repos."""
    joined = _ends(g, "repo").where("source_repo <> '' and target_repo <> '' and source_repo <> target_repo")
    return joined.select(*g.edges.columns, "source_repo", "target_repo")


def resolved_targets(g: Graph) -> DataFrame:
    """Edges with `node`: the id that a target names, else every node of that name.

    Two equi-joins instead of one join on either condition, which Spark could
    only run as a nested loop.
    """
    ids = g.nodes.select(F.col("id").alias("target"))
    exact = g.edges.join(ids, "target", "left_semi").withColumn("node", F.col("target"))
    named = g.edges.join(ids, "target", "left_anti").join(g.nodes.select(F.col("name").alias("target"), F.col("id").alias("node")), "target")
    columns = [*g.edges.columns, "node"]
    return exact.select(columns).unionByName(named.select(columns))


def incoming(g: Graph) -> DataFrame:
    """(id, incoming) of every node."""
    # Counting per target first keeps the join with names small.
    per = g.edges.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    ids = g.nodes.select(F.col("id").alias("target"))
    exact = per.join(ids, "target", "left_semi").select(F.col("target").alias("id"), "n")
    named = per.join(ids, "target", "left_anti").join(g.nodes.select(F.col("name").alias("target"), "id"), "target").select("id", "n")
    counts = exact.unionByName(named).groupBy("id").agg(F.sum("n").alias("incoming"))
    return g.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("incoming", F.lit(0)).alias("incoming"))


def call_names(g: Graph) -> DataFrame:
    """(id, calls): names of the nodes that a node calls, as a sorted set; nodes that call none have no row."""
    calls = g.edges.where("relation = 'calls'").select("source", "target").distinct()
    names = g.nodes.select(F.col("id").alias("target"), F.col("name").alias("callee"))
    return calls.join(names, "target").groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("callee")).alias("calls"))


def resolve_cross_language(g: Graph, languages: tuple[str, ...] = ("go", "typescript", "javascript"), entries: tuple[str, ...] = ("main", "default", "start", "index")) -> Graph:
    """Replace edges to a binary by edges to the nodes of the file with that stem, or of an entry point with that name.

    A node whose stem is its name is reached twice; replaced edges lose their repo.
    """
    other = g.nodes.where(F.col("language").isin(*languages))
    stems = other.select(paths.file_stem(F.col("filepath")).alias("target"), F.col("id").alias("node"))
    named = other.where(F.col("name").isin(*entries)).select(F.col("name").alias("target"), F.col("id").alias("node"))
    calls = F.col("relation") == "subprocess"
    joined = g.edges.where(calls).join(stems.unionAll(named), "target", "left")
    hit = F.col("node").isNotNull()
    rewritten = joined.select("ord", "source", F.coalesce("node", "target").alias("target"), F.when(hit, F.lit("cross-language")).otherwise(F.col("relation")).alias("relation"), "line", F.when(hit, F.lit("")).otherwise(F.col("repo")).alias("repo"))
    return Graph(g.nodes, g.edges.where(~calls).select(rewritten.columns).unionByName(rewritten))


def with_repo_nodes(g: Graph, relations: tuple[str, ...] = ("cross_repo_call", "cross_repo_import")) -> Graph:
    """Add a node of kind repo for every target of a repo-level edge that has none."""
    targets = g.edges.where(F.col("relation").isin(*relations)).groupBy(F.col("target").alias("id")).agg(F.min("ord").alias("ord"))
    missing = targets.join(g.nodes.select("id"), "id", "left_anti")
    # New nodes come after all others.
    last = g.nodes.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last"))
    made = missing.crossJoin(F.broadcast(last)).select((F.col("_last") + 1 + F.col("ord")).alias("ord"), "id", F.col("id").alias("name"), F.lit("repo").alias("kind"), F.lit("repo").alias("language"))
    return g.add(nodes=made)
