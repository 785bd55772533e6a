"""Iterative graph algorithms: driver loops over DataFrames, each round a written table."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import mapped
from ..model import Graph
from ..storage import dealt, drop_stored, fingerprint, maybe_broadcast, shared_dir, stored

#: Largest adjacency, in bytes, that every worker of `betweenness` holds: 4 for each edge and each node.
LINK_BYTES = 64 << 20
#: Scores that such a worker holds before it hands them on.
HELD_SCORES = 1 << 18


def reachable(g: Graph, start: str) -> DataFrame:
    """Nodes reachable from `start` over edges of any relation, through dangling ids too, without `start` itself.

    Each round writes its frontier alone, into one folder that is read as the
    set of what was seen.
    """
    spark = g.nodes.sparkSession
    adjacency = stored(g.adjacency(), "adjacency")
    folder, rounds = f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}", 0
    at = lambda r: spark.read.schema("id string").parquet(f"{folder}/round={r}")
    spark.createDataFrame([(start,)], "id string").write.parquet(f"{folder}/round=0")
    while True:
        after = adjacency.join(at(rounds).withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        after.join(spark.read.schema("id string").parquet(folder), "id", "left_anti").write.parquet(f"{folder}/round={rounds + 1}")
        rounds += 1
        if at(rounds).isEmpty():
            break
    drop_stored(adjacency)
    seen = spark.read.schema("id string").parquet(folder)
    return g.nodes.join(seen.where(F.col("id") != start), "id", "left_semi").select(g.nodes.columns)


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least v of each u.

    One shuffle, read twice; the pairs of a u stream past its least one, so that
    a node with a third of all pairs is neither sorted nor held in memory.
    """
    dealt = pairs.repartition("u")
    return dealt.join(dealt.groupBy("u").agg(F.min("v").alias("m")).hint("shuffle_hash"), "u")


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given by the first two columns; component is the least node of its own.

    Alternating large-star and small-star rounds: O(log n) of them in practice.
    Ends of any ordered type; self loops and nulls are ignored.
    """
    a, b = pairs.columns[:2]
    state = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "stars")
    before = fingerprint(state)
    while True:
        both = _with_least(state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large)
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after = stored(small.select(F.inline(ends)).where("u <> v").distinct(), "stars")
        drop_stored(state)
        state, now = after, fingerprint(after)
        if now == before:
            break
        before = now
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def pagerank(g: Graph, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, fixed: int | None = None) -> DataFrame:
    """(id, score): power iteration on distinct edges between nodes, dangling mass spread evenly.

    Stops when the ranks' total change is below n * tol, raises after `max_iter`
    rounds; `fixed` asks for exactly so many rounds instead.  Edges are dealt by
    target once, so that a round shuffles a row for each target, not for each edge,
    as long as the nodes that have edges are few enough to be broadcast.
    """
    edges = stored(dealt(g.links(), g.edges.count(), "target"), "links")
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    nodes = stored(g.nodes.select("id").join(out, "id", "left").select("id", F.coalesce("out", F.lit(0)).alias("out")), "pages")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    senders = nodes.where("out > 0").count()
    ranks = nodes.withColumn("score", F.lit(1.0 / n))
    for step in range(fixed or max_iter):
        lost = ranks.where("out = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        shares = ranks.where("out > 0").select(F.col("id").alias("source"), (F.col("score") / F.col("out")).alias("share"))
        sent = edges.join(maybe_broadcast(shares, senders, 64), "source")
        got = sent.groupBy(F.col("target").alias("id")).agg(F.sum("share").alias("got"))
        even = (1 - alpha) / n + alpha * lost / n
        after = ranks.join(got, "id", "left").select("id", "out", (F.coalesce("got", F.lit(0.0)) * alpha + even).alias("score"), F.col("score").alias("was"))
        after = stored(after, "ranks")
        change = None if fixed else after.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0]
        if step:
            drop_stored(ranks)
        ranks = after.drop("was")
        if change is not None and change < n * tol:
            return ranks.select("id", "score")
    if not fixed:
        raise RuntimeError(f"no convergence in {max_iter} rounds")
    return ranks.select("id", "score")


def betweenness(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): Brandes' betweenness of directed, unweighted paths, over (n - 1)(n - 2); ends don't count.

    Sources are shared out among tasks, each with the whole adjacency if that is
    within LINK_BYTES, so that only scores are shuffled; a larger one stays a
    table that all sources walk together.  `sources` (id) restricts the sum to
    some sources, unscaled.
    """
    nodes = _numbered(g.nodes.select("id"))
    n = nodes.count()
    number = lambda end: nodes.select(F.col("id").alias(end), F.col("k").alias(f"k_{end}"))
    links = stored(g.links().where("source <> target").join(number("source"), "source").join(number("target"), "target").select("k_source", "k_target"), "links")
    if 4 * (n + links.count()) > LINK_BYTES:
        return _betweenness_by_levels(g, sources)
    table = links.toArrow()
    a, b = (table.column(c).to_numpy() for c in ("k_source", "k_target"))
    order = np.argsort(a, kind="stable")
    first = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(a, minlength=n), out=first[1:])
    held = g.nodes.sparkSession.sparkContext.broadcast((first, b[order].astype(np.int32)))

    def batch(scores):
        return pa.RecordBatch.from_arrays([pa.array(list(scores), pa.int64()), pa.array(list(scores.values()), pa.float64())], ["k", "dep"])

    def run(batches: Iterable[pa.RecordBatch]):
        first, ahead = held.value
        scores = defaultdict(float)
        for part in batches:
            for s in part.column("k").to_pylist():
                for v, dep in _dependencies(s, first, ahead):
                    scores[v] += dep
                if len(scores) >= HELD_SCORES:
                    yield batch(scores)
                    scores.clear()
        yield batch(scores)

    starts = nodes if sources is None else nodes.join(sources.select("id"), "id", "left_semi")
    # By number of sources, as each of them is a walk.
    total = mapped(starts.select("k").repartition(max(1, -(-n // 4096)), "k"), run, "k long, dep double").groupBy("k").agg(F.sum("dep").alias("dep"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(total, "k", "left").select("id", F.coalesce(F.col("dep") * scale, F.lit(0.0)).alias("score"))


def _numbered(ids: DataFrame) -> DataFrame:
    """(id, k): the ids numbered from 0 without gaps."""
    rows = stored(ids.select("id", F.monotonically_increasing_id().alias("m")), "numbers").withColumn("part", F.shiftright("m", 33))
    offsets, total = [(-1, 0)], 0
    for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect():
        offsets.append((r["part"], total))
        total += r["rows"]
    starts = F.broadcast(ids.sparkSession.createDataFrame(offsets, "part long, start long"))
    return stored(rows.join(starts, "part").select("id", (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("k")), "numbered")


def _dependencies(s: int, first: np.ndarray, ahead: np.ndarray) -> list[tuple[int, float]]:
    """(node, dependency) of one source: levels forward, then back along the shortest paths."""
    far, paths, order, after = {s: 0}, {s: 1.0}, [s], {}
    for v in order:
        d, p, below = far[v] + 1, paths[v], []
        for w in ahead[first[v] : first[v + 1]].tolist():
            known = far.get(w)
            if known is None:
                far[w], paths[w] = d, p
                order.append(w)
                below.append(w)
            elif known == d:
                paths[w] += p
                below.append(w)
        after[v] = below
    dep = {}
    for v in reversed(order):
        dep[v] = paths[v] * sum((1 + dep[w]) / paths[w] for w in after[v])
    del dep[s]
    return [(v, x) for v, x in dep.items() if x]


def _betweenness_by_levels(g: Graph, sources: DataFrame | None) -> DataFrame:
    """The same in tables: one of (source, node, distance, number of shortest paths) grows level by level, then dependencies flow back level by level."""
    edges = stored(g.links().where("source <> target"), "links")
    nodes = stored(g.nodes.select("id"), "ids")
    n = nodes.count()
    starts = nodes if sources is None else nodes.join(sources.select("id"), "id", "left_semi")
    seen = level = stored(starts.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")), "level-0")
    levels = [level]
    while True:
        step = level.join(edges, level["v"] == edges["source"]).groupBy("s", F.col("target").alias("v")).agg(F.sum("paths").alias("paths"))
        step = step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(len(levels)).alias("d"), "paths")
        level = stored(step, f"level-{len(levels)}")
        if level.isEmpty():
            break
        levels.append(level)
        seen = stored(seen.unionByName(level), "seen")
    delta, scores = None, []
    for d in range(len(levels) - 1, 0, -1):
        below = levels[d] if delta is None else levels[d].join(delta, ["s", "v"], "left")
        below = below.select("s", F.col("v").alias("w"), "paths", (F.coalesce("dep", F.lit(0.0)) if delta is not None else F.lit(0.0)).alias("dep"))
        scores.append(below.select(F.col("w").alias("id"), "dep"))
        up = below.join(edges, below["w"] == edges["target"]).select("s", F.col("source").alias("v"), ((1 + F.col("dep")) / F.col("paths")).alias("share"))
        above = levels[d - 1].select("s", "v", F.col("paths").alias("own"))
        delta = stored(up.join(above, ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("own") * F.col("share")).alias("dep")), "dependency")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if not scores:
        return nodes.select("id", F.lit(0.0).alias("score"))
    total = scores[0]
    for more in scores[1:]:
        total = total.unionByName(more)
    total = total.groupBy("id").agg((F.sum("dep") * scale).alias("score"))
    return nodes.join(total, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def cycles(links: DataFrame, longest: int | None = None) -> DataFrame:
    """(cycle array<string>): simple cycles in a digraph (source, target), each once, closed, least member first.

    Paths start at their least member and never visit a smaller one, so each
    cycle is found once.  Meant for graphs of groups (repos), which are small:
    a dense graph has more cycles than can be listed, whatever lists them.
    `longest` leaves out cycles of more members.
    """
    links = stored(links.select("source", "target").where("source <> target").distinct(), "links")
    hop = links.select(F.col("source").alias("at"), F.col("target").alias("next"))
    paths = stored(links.where("source < target").select(F.array("source", "target").alias("path"), F.col("target").alias("at")), "paths")
    found, members = [], 2
    while not paths.isEmpty() and (longest is None or members <= longest):
        ahead = paths.join(hop, "at")
        found.append(stored(ahead.where(F.col("next") == F.col("path")[0]).select(F.concat("path", F.array("next")).alias("cycle")), "cycles"))
        ahead = ahead.where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next")))
        longer = stored(ahead.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at")), "paths")
        drop_stored(paths)
        paths, members = longer, members + 1
    drop_stored(paths)
    if not found:
        return links.sparkSession.createDataFrame([], "cycle array<string>")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


__all__ = ["betweenness", "components", "cycles", "pagerank", "reachable"]
