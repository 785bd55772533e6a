"""Communities: directories, merged where they share an import target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..model import Graph
from . import iterative


def _merge(nodes: DataFrame, imports: DataFrame, by: list[str]) -> DataFrame:
    """(*by, id, community): nodes (*by, id, dir), imports (*by, dir, target)."""
    known = nodes.select(*by, "dir").distinct()
    imports = imports.join(known, [*by, "dir"], "left_semi").distinct()
    # Linking each directory to the least one of its target connects the same directories as all pairs would.
    name = F.to_json(F.struct(*by, "dir"))
    named = imports.select(name.alias("d"), *by, "target")
    links = named.withColumn("least", F.min("d").over(Window.partitionBy(*by, "target"))).select("d", "least")
    merged = iterative.components(links)
    labelled = known.withColumn("node", name).join(merged, "node", "left").withColumn("root", F.coalesce("component", "node"))
    # A community is named by its least directory.
    roots = labelled.withColumn("community", F.min("dir").over(Window.partitionBy("root"))).select(*by, "dir", "community")
    return nodes.join(roots, [*by, "dir"]).select(*by, "id", "community")


def labels(g: Graph) -> DataFrame:
    """(id, community) over the whole graph: connected components of directories that share an import target.

    A directory without nodes neither merges nor bridges.
    """
    nodes = g.nodes.select("id", paths.parent_dir(F.col("filepath")).alias("dir"))
    imports = g.edges.where("relation = 'imports'").select(paths.parent_dir(F.col("source")).alias("dir"), "target")
    return _merge(nodes, imports, [])


def language_labels(g: Graph) -> DataFrame:
    """(language, id, community): the same within each language, over its own nodes and the edges between them."""
    nodes = g.nodes.select("language", "id", paths.parent_dir(F.col("filepath")).alias("dir"))
    of = g.nodes.select("id", "language")
    inside = g.edges.where("relation = 'imports'").select("source", "target").join(of.withColumnRenamed("id", "source"), "source")
    inside = inside.join(of.select(F.col("id").alias("target"), F.col("language").alias("other")), "target").where("language = other")
    return _merge(nodes, inside.select("language", paths.parent_dir(F.col("source")).alias("dir"), "target"), ["language"])


def describe(g: Graph, labelled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per community: number, size, languages, dominant_language, density, top_node, top_ids; numbered in insertion order.

    density is edges within over n (n - 1), over 1 for a single node; parallel
    edges and loops count, so it may exceed 1.
    """
    keys = [*by, "community"]
    label = labelled.select(*by, "id", "community")
    nodes = g.nodes.select("ord", "id", "name", F.col("language").alias("_language")).join(label, "id")
    counts = nodes.groupBy(*keys, "_language").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    entry = F.array_sort(F.collect_list(F.struct("first", "_language", "n")))
    # `languages` in order of first appearance; one language names the community, several make it mixed.
    about = counts.groupBy(*keys).agg(F.sum("n").alias("size"), F.min("first").alias("first"), entry.alias("l"))
    top = nodes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("place <= 5")
    top = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "name"))).alias("t"))
    s = label.select(F.col("id").alias("source"), *[F.col(k).alias(f"s_{k}") for k in keys])
    t = label.select(F.col("id").alias("target"), *[F.col(k).alias(f"t_{k}") for k in keys])
    pairs = g.edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("m")).join(s, "source").join(t, "target")
    for k in keys:
        pairs = pairs.where(F.col(f"s_{k}") == F.col(f"t_{k}"))
    inner = pairs.groupBy(*[F.col(f"s_{k}").alias(k) for k in keys]).agg(F.sum("m").alias("inner"))
    size = F.col("size")
    possible = F.when(size > 1, size * (size - 1)).otherwise(1)
    out = about.join(top, keys).join(inner, keys, "left")
    out = out.select(
        *keys, "first", "size", F.map_from_arrays("l._language", "l.n").alias("languages"),
        F.when(F.size("l") > 1, F.lit("mixed")).otherwise(F.col("l")[0]["_language"]).alias("dominant_language"),
        (F.coalesce("inner", F.lit(0)) / possible).alias("density"), F.col("t")[0]["name"].alias("top_node"), F.col("t.id").alias("top_ids"),
    )
    return out


def numbered(described: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Numbers 1..n: groups of `by` in order of their first node, communities within in order of theirs."""
    group = F.min("first").over(Window.partitionBy(*by)) if by else F.lit(0)
    # One row per community: the single partition of this window is as long as the list of communities.
    return described.withColumn("_g", group).withColumn("number", F.row_number().over(Window.orderBy("_g", "first"))).drop("_g")


def communities(g: Graph, mixed: bool = False) -> DataFrame:
    """All communities, across languages if `mixed`, else language by language."""
    if mixed:
        return numbered(describe(g, labels(g)))
    return numbered(describe(g, language_labels(g), ("language",)), ("language",))


def overview(g: Graph, mixed: bool = False) -> DataFrame:
    found = communities(g, mixed)
    return found.select("number", "dominant_language", "languages", "size", F.bround("density", 4).alias("density"), "top_node")
