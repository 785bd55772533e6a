"""The graph: two DataFrames with fixed schemas and an insertion order.

nodes(ord, id, name, kind, filepath, line, docstring, signature, parent, language, repo)
edges(ord, source, target, relation, line, repo)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import dealt

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()

NODE_SCHEMA = T.StructType(
    [T.StructField("ord", _L), T.StructField("id", _S), T.StructField("name", _S), T.StructField("kind", _S), T.StructField("filepath", _S), T.StructField("line", _I)]
    + [T.StructField(c, _S) for c in ("docstring", "signature", "parent", "language", "repo")]
)
EDGE_SCHEMA = T.StructType([T.StructField("ord", _L), T.StructField("source", _S), T.StructField("target", _S), T.StructField("relation", _S), T.StructField("line", _I), T.StructField("repo", _S)])

#: Values of absent node fields; parent stays null.
NODE_DEFAULTS = {"name": "", "kind": "", "filepath": "", "line": 0, "docstring": "", "signature": "", "language": "python", "repo": ""}
EDGE_DEFAULTS = {"source": "", "target": "", "relation": "", "line": 0, "repo": ""}


def conform(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """`df` with exactly the columns of `schema`: absent ones and nulls take the default."""
    columns = []
    for field in schema:
        column = df[field.name].cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        columns.append((F.coalesce(column, F.lit(defaults[field.name])) if field.name in defaults else column).alias(field.name))
    return df.select(*columns)


def latest(nodes: DataFrame) -> DataFrame:
    """One row per id: the value inserted last at the place of the first."""
    by_id = Window.partitionBy("id")
    ranked = nodes.withColumn("_last", F.row_number().over(by_id.orderBy(F.col("ord").desc()))).withColumn("_first", F.min("ord").over(by_id))
    return ranked.where("_last = 1").withColumn("ord", F.col("_first")).drop("_last", "_first").select(nodes.columns)


@dataclass(frozen=True)
class Graph:
    """A property multigraph; edges may end at ids that no node has."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, distinct_ids: bool = False) -> "Graph":
        """Conform both tables; nodes of one id are merged unless the caller knows that ids are distinct."""
        n = conform(nodes, NODE_SCHEMA, NODE_DEFAULTS)
        return Graph(n if distinct_ids else latest(n), conform(edges, EDGE_SCHEMA, EDGE_DEFAULTS))

    @staticmethod
    def empty(spark: SparkSession) -> "Graph":
        return Graph(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

    def add(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> "Graph":
        """Append; a node whose id is known replaces it in place."""
        out_n, out_e = self.nodes, self.edges
        if nodes is not None:
            out_n = latest(self.nodes.unionByName(conform(nodes, NODE_SCHEMA, NODE_DEFAULTS)))
        if edges is not None:
            out_e = self.edges.unionByName(conform(edges, EDGE_SCHEMA, EDGE_DEFAULTS))
        return Graph(out_n, out_e)

    def union(self, other: "Graph") -> "Graph":
        """All nodes and edges of both; ids are merged as by `add`."""
        return self.add(other.nodes, other.edges)

    def adjacency(self) -> DataFrame:
        """Distinct (source, target)."""
        return self.edges.select("source", "target").distinct()

    def inner_edges(self) -> DataFrame:
        """Edges of which both ends are nodes."""
        ids = self.nodes.select("id")
        return self.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(self.edges.columns)

    def links(self) -> DataFrame:
        """Distinct (source, target) of the edges of which both ends are nodes."""
        return dealt(self.inner_edges().select("source", "target"), self.edges.count(), "source", "target").distinct()


def node_id(filepath, name, parent=None):
    """filepath::name, or filepath::parent.name; an empty parent counts as none."""
    prefix = F.when(F.coalesce(parent, F.lit("")) == "", F.lit("")).otherwise(F.concat(parent, F.lit("."))) if parent is not None else F.lit("")
    return F.concat(filepath, F.lit("::"), prefix, name)
