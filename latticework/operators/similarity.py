"""Structural similarity of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import Graph
from .relations import call_names

METHODS = ("jaccard", "cosine", "ast")


def features(g: Graph) -> DataFrame:
    """(ord, id, name, kind, language, calls, control_flow, types)."""
    none = F.array().cast("array<string>")
    return g.nodes.join(call_names(g), "id", "left").select(
        "ord", "id", "name", "kind", "language", F.coalesce("calls", none).alias("calls"),
        text.control_flow(F.col("signature"), F.col("docstring")).alias("control_flow"), text.type_words(F.col("signature")).alias("types"),
    )


def _score(method: str, a: str, b: str):
    col = lambda t, c: F.col(f"{t}.{c}")
    calls = text.jaccard(col(a, "calls"), col(b, "calls"))
    flow = text.cosine(col(a, "control_flow"), col(b, "control_flow"))
    types = text.cosine(col(a, "types"), col(b, "types"))
    if method == "jaccard":
        return calls
    if method == "cosine":
        return (flow + types) / 2
    same = lambda c: F.when(col(a, c) == col(b, c), 1.0).otherwise(0.0)
    return (calls * 0.4 + flow * 0.2 + types * 0.2 + same("kind") * 0.1 + same("language") * 0.1) / (0.4 + 0.2 + 0.2 + 0.1 + 0.1)


def similar_to(g: Graph, anchor: DataFrame, top_k: int | None = 10, method: str = "jaccard") -> DataFrame:
    """The `top_k` nodes (all if None) most like the one in `anchor` (one id), of its kind or language: id, name, score, method, matched, ord."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}: one of {', '.join(METHODS)}")
    all_nodes = features(g)
    # One row, whatever the graph's size.
    one = F.broadcast(all_nodes.join(F.broadcast(anchor), "id", "left_semi").limit(1)).alias("t")
    n = all_nodes.alias("n")
    pairs = n.crossJoin(one).where("n.id <> t.id and (n.kind = t.kind or n.language = t.language)")
    shared = F.sort_array(F.array_intersect("t.calls", "n.calls"))
    constant = F.array(*[F.lit(x) for x in text.FEATURE_NAMES])
    matched = {"jaccard": shared, "cosine": constant, "ast": F.concat(shared, constant)}[method]
    scored = pairs.select("n.id", "n.name", "n.ord", _score(method, "t", "n").alias("score"), F.lit(method).alias("method"), matched.alias("matched"))
    scored = scored.where("score > 0")
    # Sums whose last bits differ tie, and ties go by insertion.
    return scored if top_k is None else scored.orderBy(F.round("score", 9).desc(), "ord").limit(top_k)


def find_similar(g: Graph, node: str, top_k: int | None = 10, method: str = "jaccard") -> DataFrame:
    """The same for an id; an unknown id gives no rows."""
    return similar_to(g, g.nodes.where(F.col("id") == node).select("id"), top_k, method)


def find_similar_by_name(g: Graph, node: str, top_k: int | None = 10, method: str = "ast") -> DataFrame:
    """The same for an id, or else the first node of that name."""
    either = g.nodes.where((F.col("id") == node) | (F.col("name") == node)).orderBy((F.col("id") == node).desc(), "ord").limit(1)
    return similar_to(g, either.select("id"), top_k, method)
