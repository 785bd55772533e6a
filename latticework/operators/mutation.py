"""Changes to a graph, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph


def without_files(g: Graph, files: DataFrame) -> Graph:
    """The graph without the nodes of some files (filepath), the edges at those nodes and the edges that start at the files themselves."""
    paths = files.select("filepath").distinct()
    gone = g.nodes.join(paths, "filepath", "left_semi").select("id")
    starts = gone.unionByName(paths.select(F.col("filepath").alias("id"))).withColumnRenamed("id", "source")
    edges = g.edges.join(starts, "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return Graph(g.nodes.join(paths, "filepath", "left_anti").select(g.nodes.columns), edges.select(g.edges.columns))


def removed_by(g: Graph, files: DataFrame) -> DataFrame:
    """(filepath, n_removed): nodes that `without_files` takes out."""
    return g.nodes.join(files.select("filepath").distinct(), "filepath").groupBy("filepath").agg(F.count(F.lit(1)).alias("n_removed"))


def upsert_files(g: Graph, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
    """Replace what the graph has of some files by new nodes and edges, which come after all others."""
    rest = without_files(g, files)
    last = lambda df: F.broadcast(df.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("_last")))
    shift = lambda new, old: new.crossJoin(last(old)).withColumn("ord", F.col("ord") + F.col("_last")).drop("_last")
    return rest.add(shift(nodes, g.nodes), shift(edges, g.edges))
