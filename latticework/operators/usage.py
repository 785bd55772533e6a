"""Unused symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from .relations import incoming
from .stats import named_repo


def is_entry(explicit: tuple[str, ...] = ()):
    name, kind = F.col("name"), F.col("kind")
    known = (name.isin("main", "__init__") & (kind == "function")) | ((name == "__main__") & (kind == "module"))
    return F.col("id").isin(*explicit) | known if explicit else known


def classified(g: Graph, entry_points: tuple[str, ...] = ()) -> DataFrame:
    """Nodes with `incoming` and `status`: entry, dead (nothing comes in), suspicious (one edge does) or used."""
    status = F.when(is_entry(entry_points), "entry").when(F.col("incoming") == 0, "dead").when(F.col("incoming") == 1, "suspicious").otherwise("used")
    return g.nodes.join(incoming(g), "id").withColumn("status", status)


def summary(g: Graph, entry_points: tuple[str, ...] = (), threshold: float = 0.0) -> DataFrame:
    """One row: total, dead_count, entry_point_count, suspicious_count, coverage (1 without nodes), meets_threshold, has_dead."""
    count = lambda s: F.count_if(F.col("status") == s)
    total = F.count(F.lit(1))
    coverage = F.when(total == 0, F.lit(1.0)).otherwise((total - count("dead")) / total)
    out = classified(g, entry_points).agg(total.alias("total"), count("dead").alias("dead_count"), count("entry").alias("entry_point_count"), count("suspicious").alias("suspicious_count"), coverage.alias("coverage"))
    return out.withColumn("meets_threshold", F.col("coverage") >= threshold).withColumn("has_dead", F.col("dead_count") > 0)


def dead_per_repo(g: Graph) -> DataFrame:
    dead = classified(g).where("status = 'dead'")
    return dead.groupBy(named_repo(F.col("repo")).alias("repo")).agg(F.count(F.lit(1)).alias("n_dead"))
