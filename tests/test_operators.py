"""Operators on small hand-made graphs."""

import pytest
from graphs import graph, hot
from pyspark.sql import functions as F

from latticework.functions import text
from latticework.operators import communities, filters, mutation, records, relations, search, similarity, stats, usage


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def library(spark):
    nodes = [
        ("n1", "parse_json_response", {"docstring": "Parse a JSON response body.", "signature": "def parse_json_response(body: str)"}),
        ("n2", "parse_xml", {"docstring": "Parse XML text.", "signature": "def parse_xml(text: str)"}),
        ("n3", "handle_request", {"docstring": "Handle one request.", "signature": "def handle_request(r)"}),
        ("n4", "handle_error", {"docstring": "Handle errors.", "signature": "def handle_error(e)"}),
    ]
    return graph(spark, nodes, [("n1", "n3"), ("n2", "n3"), ("n4", "n1")])


def test_search(library):
    found = ids(search.search(library, "parse json"))
    assert found[0] == "n1" and found.index("n1") < found.index("n2")
    assert sorted(ids(filters.pattern_search(library, "handle_*"))) == ["n3", "n4"]
    assert ids(filters.find_symbol(library, "XML")) == ["n2"]
    assert filters.find_symbol(library, "").count() == 4
    assert search.search(library, "zebra").count() == 0


def test_search_by_rows_index_and_stored_index(library, monkeypatch, tmp_path):
    """The same scores from rows, from a table of n-grams and from a stored index, also where a node's calls are too many to lie in its row."""
    want = None
    for calls in (4096, 1):
        monkeypatch.setattr(search, "CALLS", calls)
        stored = search.write_index(library, str(tmp_path / f"index{calls}"))
        assert stored.buckets == search.BUCKETS
        for index in (None, search.ngram_index(library), stored, search.read_index(library.nodes.sparkSession, str(tmp_path / f"index{calls}"))):
            got = {r["id"]: (round(r["score"], 9), r["matched"]) for r in search.bm25(library, "handle parse json handle", index).collect()}
            want = want or got
            assert got == want and len(got) >= 3
    weights = {(r["id"], r["ngram"]): r["weight"] for r in search.ngram_index(library).collect()}
    assert weights["n1", "parse"] == 3 + 1.5 and weights["n3", "handle"] == 3 + 1.5 and weights["n1", "request"] == 1 and weights["n4", "parse json"] == 1


def test_ngrams_are_summed_within_rows(spark, library, monkeypatch):
    plan = search.ngram_index(library)._jdf.queryExecution().executedPlan().toString()
    # No aggregate over n-grams, which are many times the texts.
    assert "MapInArrow" in plan and "keys=[id" not in plan.split("MapInArrow")[0] and "sum(" not in plan.split("MapInArrow")[0]
    monkeypatch.setattr(search, "TASK_GRAMS", 8)
    assert search.distinct_ngrams(library, 50).rdd.getNumPartitions() == 7
    stats = search.corpus_stats(library).first()
    rows = search.ngram_index(library).collect()
    assert stats["n_docs"] == 4 and stats["n_ngrams"] == len({r["ngram"] for r in rows}) and stats["avg_len"] == len(rows) / 4


def test_ngrams_of_odd_texts(spark):
    texts = ["", " ", "a b", "The quick, BROWN\u212aiwi \u0130stanbul x\u00e9y\x0bz zz", "aa aa aa aa", "one_two three"]
    g = graph(spark, [(f"t{k}", "same thing_x", {"docstring": t, "signature": "f(same thing)"}) for k, t in enumerate(texts)], [("t0", "t1")])
    want = {r["id"]: list(r["n"]) for r in g.nodes.select("id", text.extract_ngrams(F.col("docstring")).alias("n")).collect()}
    got = {r["id"]: search._doc_grams(r["doc"], (1, 2, 3)) for r in search._own(g).collect()}
    assert got == want
    lengths = {r["id"]: r["dl"] for r in search._profiles(g, [], 3).collect()}
    assert lengths == {r["id"]: r["count"] for r in search.ngram_index(g).groupBy("id").count().collect()}


def test_hybrid(library):
    pure = {r["id"]: r for r in search.hybrid_search(library, "parse json", alpha=1.0).collect()}
    assert all(r["score"] == pytest.approx(r["ngram_score"]) for r in pure.values())
    assert search.hybrid_search(library, "zebra").count() == 0


def test_similarity(library):
    assert ids(similarity.find_similar(library, "n1"))[0] == "n2"
    for method in similarity.METHODS:
        assert similarity.find_similar(library, "n1", method=method).count() > 0
    with pytest.raises(ValueError):
        similarity.find_similar(library, "n1", method="guess")
    assert similarity.find_similar(library, "nobody").count() == 0


def test_text_functions(spark):
    one = spark.createDataFrame([("parseJSONResponse", "load_theBigFile", "The quick, brown fox is here a b", "")], "a string, b string, c string, d string")
    row = one.select(
        text.split_identifier(F.col("a")).alias("a"), text.split_identifier(F.col("b")).alias("b"), text.tokenize(F.col("c")).alias("c"), text.ngrams(text.tokenize(F.col("d"))).alias("d"),
        text.extract_ngrams(F.col("c"), 2).alias("n"), text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"), text.occurrences(F.lit("if elif"), "if").alias("o"),
        F.lit("handleIt").rlike(text.glob_regex("handle??")).alias("g1"), F.lit("Handle").rlike(text.glob_regex("[!H]*")).alias("g2"), F.lit("a\nb").rlike(text.glob_regex("a*b")).alias("g3"),
    ).first()
    assert row["a"] == ["parse", "json", "response"] and row["b"] == ["load", "thebigfile"]
    assert row["c"] == ["quick", "brown", "fox", "here"] and row["d"] == []
    assert row["n"] == ["quick", "brown", "fox", "here", "quick brown", "brown fox", "fox here"]
    assert row["j"] == pytest.approx(1 / 3) and row["o"] == 2 and row["g1"] and not row["g2"] and row["g3"]


def test_min_max(spark):
    scaled = lambda xs: [r["s"] for r in stats.min_max(spark.createDataFrame([(x,) for x in xs], "v double"), "v", "s").collect()]
    assert sorted(scaled([10.0, 5.0, 0.0])) == [0, 0.5, 1] and scaled([3.0, 3.0]) == [1, 1] and scaled([]) == []


def test_unused(spark):
    g = graph(spark, [("1", "main"), ("2", "dead_func"), ("3", "used_a"), ("4", "used_b")], [("1", "used_a"), ("2", "used_a"), ("3", "used_b"), ("1", "used_b")])
    s = usage.summary(g).first()
    assert (s["dead_count"], s["entry_point_count"], s["suspicious_count"], s["coverage"]) == (1, 1, 0, 0.75)
    lonely = graph(spark, [("1", "main"), ("2", "lonely")], [("1", "lonely")])
    s = usage.summary(lonely).first()
    assert (s["dead_count"], s["suspicious_count"]) == (0, 1)
    assert ids(usage.classified(g, ("2",)).where("status = 'entry'")) in (["1", "2"], ["2", "1"])


def test_communities(spark):
    full = graph(spark, [(x, x) for x in "abc"], [(x, y) for x in "abc" for y in "abc" if x != y])
    row = communities.communities(full).first()
    assert row["size"] == 3 and row["density"] == 1.0 and row["dominant_language"] == "python"
    mixed = graph(spark, [("a", "a"), ("b", "b", {"language": "go"})], [("a", "nowhere", "cross-language")])
    row = communities.communities(mixed, mixed=True).first()
    assert row["dominant_language"] == "mixed" and row["languages"] == {"python": 1, "go": 1}
    dirs = graph(spark, [("a", "a", {"filepath": "/src/x.py"}), ("b", "b", {"filepath": "/src/y.py"}), ("c", "c", {"filepath": "/src/sub/z.py"}), ("d", "d", {"filepath": "/other/w.py"})], [("/src/x.py", "os", "imports"), ("/src/sub/z.py", "os", "imports"), ("/ghost/v.py", "os", "imports")])
    label = {r["id"]: r["community"] for r in communities.labels(dirs).collect()}
    assert label == {"a": "/src", "b": "/src", "c": "/src", "d": "/other"}


def test_repos(spark):
    g = graph(spark, [("a", "main", {"repo": "r1"}), ("b", "b", {"repo": "r1"}), ("c", "c", {"repo": "r2"}), ("d", "d", {"repo": "r2"})], [("a", "b", "calls", "r1"), ("b", "c", "calls", "r1"), ("c", "a", "calls", "r2"), ("c", "ghost", "calls", "r2")])
    assert {(r[0], r[1]): r[2] for r in stats.cross_repo_matrix(g).collect()} == {("r1", "r2"): 1, ("r2", "r1"): 1}
    assert [tuple(r["cycle"]) for r in records.repo_cycles(g).collect()] == [("r1", "r2", "r1")]
    by = {r["repo"]: r for r in stats.repo_stats(g).collect()}
    assert by["r1"]["node_count"] == 2 and by["r1"]["edge_count"] == 2 and by["r2"]["edge_count"] == 2
    sub = filters.repo_subgraph(g, "r1")
    assert sub.nodes.count() == 2 and [(r["source"], r["target"]) for r in sub.edges.collect()] == [("a", "b")]
    found = records.decision_records(g, F.lit("2024-01-01"))
    assert {1, 5} <= set(ids(found, "rule"))
    names = ids(records.markdown(found), "file_name")
    assert all(n.startswith("adr-") and n.endswith(".md") for n in names)


def test_cross_language_and_repo_nodes(spark):
    g = graph(spark, [("p", "run"), ("g1", "main", {"language": "go", "filepath": "/tool/main.go"}), ("g2", "serve", {"language": "go", "filepath": "/tool/server.go"})], [("p", "main", "subprocess", "r"), ("p", "server", "subprocess", "r"), ("p", "unknown", "subprocess", "r"), ("p", "x", "calls", "r")])
    out = sorted((r["target"], r["relation"], r["repo"]) for r in relations.resolve_cross_language(g).edges.collect())
    assert out == [("g1", "cross-language", ""), ("g1", "cross-language", ""), ("g2", "cross-language", ""), ("unknown", "subprocess", "r"), ("x", "calls", "r")]
    h = graph(spark, [("p", "p")], [("f.py", "lib", "cross_repo_import"), ("f.py", "lib", "cross_repo_import")])
    assert sorted(ids(relations.with_repo_nodes(h).nodes)) == ["lib", "p"]


def test_mutation(spark):
    g = graph(spark, [("a", "a", {"filepath": "x.py"}), ("b", "b", {"filepath": "y.py"})], [("a", "b"), ("b", "a"), ("x.py", "os", "imports"), ("y.py", "os", "imports")])
    files = spark.createDataFrame([("x.py",)], "filepath string")
    left = mutation.without_files(g, files)
    assert ids(left.nodes) == ["b"] and [r["source"] for r in left.edges.collect()] == ["y.py"]
    new = graph(spark, [("a", "a2", {"filepath": "x.py"})], [("x.py", "os", "imports")])
    again = mutation.upsert_files(mutation.upsert_files(g, files, new.nodes, new.edges), files, new.nodes, new.edges)
    assert sorted(ids(again.nodes, "name")) == ["a2", "b"]
    assert sorted(r["source"] for r in again.edges.collect()) == ["x.py", "y.py"]
    assert mutation.removed_by(g, files).first()["n_removed"] == 1


def test_filters(spark):
    g = hot(spark)
    assert ids(filters.nodes(g, language="python", limit=2)) == ["n1", "n2"]
    assert filters.nodes(g, language="go").count() == 0
    assert filters.edges(g, source="n1").count() == 2
    assert filters.index_size(g).first()[0] == 20
    assert ids(filters.repos(g), "repo") == []
    with pytest.raises(ValueError):
        filters.lookup(g, "docstring", "x")
    assert filters.api_nodes(filters.node(g, "n1")).first()["type"] == "function"
    assert filters.api_edges(g.edges).columns == ["id", "source", "target", "type", "line", "weight", "repo"]


def test_graph_keeps_the_last_value_at_the_first_place(spark):
    g = graph(spark, [("a", "old"), ("b", "b"), ("a", "new")], [])
    assert [(r["ord"], r["id"], r["name"]) for r in g.nodes.orderBy("ord").collect()] == [(0, "a", "new"), (1, "b", "b")]
