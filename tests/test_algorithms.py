"""Iterative algorithms against brute force on small random graphs."""

import collections
import random

import pytest
from graphs import graph, hot

from latticework import storage
from latticework.model import Graph
from latticework.operators import iterative, ranking


def random_graph(spark, seed, n=14, m=34):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n + 1)}") for _ in range(m)]  # v14 is no node
    return graph(spark, [(f"v{k}", f"name{k}") for k in range(n)], edges), n, {(a, b) for a, b in edges if b != f"v{n}"}, edges


def brute_betweenness(n, edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    score = dict.fromkeys([f"v{k}" for k in range(n)], 0.0)
    for s in score:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in sorted(out[v]):
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = collections.Counter()
        for w in reversed(order):
            for v in order:
                if w in out[v] and dist[w] == dist[v] + 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def brute_pagerank(n, edges, rounds=500):
    names = [f"v{k}" for k in range(n)]
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    rank = dict.fromkeys(names, 1 / n)
    for _ in range(rounds):
        lost = sum(rank[v] for v in names if not out[v])
        rank = {v: 0.15 / n + 0.85 * (lost / n + sum(rank[u] / len(out[u]) for u in names if v in out[u])) for v in names}
    return rank


@pytest.mark.parametrize("seed", [1, 2])
def test_centralities(spark, seed):
    g, n, edges, _ = random_graph(spark, seed)
    got = {r["id"]: r["score"] for r in iterative.betweenness(g).collect()}
    assert got == pytest.approx(brute_betweenness(n, edges))
    ranks = {r["id"]: r["score"] for r in iterative.pagerank(g).collect()}
    assert sum(ranks.values()) == pytest.approx(1)
    assert ranks == pytest.approx(brute_pagerank(n, edges), abs=1e-5)


def test_betweenness_beyond_what_workers_hold(spark, monkeypatch):
    g, n, edges, _ = random_graph(spark, 3)
    held = {r["id"]: r["score"] for r in iterative.betweenness(g).collect()}
    monkeypatch.setattr(iterative, "LINK_BYTES", 0)
    tables = {r["id"]: r["score"] for r in iterative.betweenness(g).collect()}
    assert held == pytest.approx(brute_betweenness(n, edges))
    assert tables == pytest.approx(held)


def test_betweenness_shuffles_scores_alone(spark):
    g, _, _, _ = random_graph(spark, 1)
    plan = iterative.betweenness(g)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "dependency-" not in plan and "level-" not in plan


def test_links_are_grouped_in_tasks_of_known_size(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 8)
    g, _, edges, all_edges = random_graph(spark, 1)
    links = g.links()
    assert links.rdd.getNumPartitions() == -(-len(all_edges) // 8)
    assert {tuple(r) for r in links.collect()} == edges and links.count() == len(edges)


def test_pagerank_sends_the_nodes_that_have_edges(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(iterative, "maybe_broadcast", lambda df, rows, row_bytes: asked.append(rows) or df)
    g, n, edges, _ = random_graph(spark, 1)
    iterative.pagerank(g, fixed=1).count()
    assert asked == [len({a for a, _ in edges})]


def test_reachable_through_cycles_and_dangling_ids(spark):
    g = graph(spark, [("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")], [("a", "b"), ("b", "a"), ("b", "ghost"), ("ghost", "c"), ("c", "c")])
    assert {r["id"] for r in iterative.reachable(g, "a").collect()} == {"b", "c"}
    assert iterative.reachable(g, "d").count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in iterative.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {v for a, b in pairs if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}


def test_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "source string, target string")
    assert sorted(tuple(r["cycle"]) for r in iterative.cycles(links).collect()) == [("a", "b", "a"), ("a", "b", "c", "a")]


def test_hot_paths(spark):
    g = hot(spark)
    top = {r["id"]: r for r in ranking.hot_paths(g).collect()}
    assert top["n3"]["rank"] == 1 and top["n3"]["in_degree"] == 3 and top["n1"]["out_degree"] == 2
    assert ranking.hot_paths(g, 2).count() == 2
    assert [r["id"] for r in ranking.hot_paths(g, 1, "pagerank").collect()] == ["n3"]
    assert [r["id"] for r in ranking.hot_paths(g, 1, "betweenness").collect()] == ["n1"]
    with pytest.raises(ValueError):
        ranking.hot_paths(g, 5, "colour")
    assert ranking.hot_paths(Graph.empty(spark), 5, "colour").count() == 0


def test_empty_graph(spark):
    g = Graph.empty(spark)
    assert iterative.pagerank(g).count() == 0
    assert iterative.betweenness(g).count() == 0
    assert iterative.reachable(g, "x").count() == 0
