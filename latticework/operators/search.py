"""Weighted n-gram search (BM25) and its combination with structural similarity.

A single search needs, of each node, the number of its distinct n-grams and the
weights of the few n-grams that the query has.  Both come from the node's own
row and the names of the nodes that it calls.  For searching again and again
there is a stored index, laid out by n-gram.

The n-grams of a row are made in Python over Arrow batches: as arrays they take
the higher-order functions about four times as long (437 and 112 task seconds at 0.1 GB).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import mapped
from ..functions import text
from ..model import Graph
from ..storage import maybe_broadcast, stored
from . import similarity
from .stats import min_max

K1, B = 1.5, 0.75
#: A node's n-grams from called names are put beside its own if there are at most so many; with more of them they are joined as rows.
CALLS = 4096
#: Folders that the postings of a stored index are dealt to.
BUCKETS = 64
#: N-grams that one task groups or sorts in memory, and that a Python worker holds before it hands them on.
TASK_GRAMS, HELD_GRAMS = 1 << 20, 1 << 17
#: Weights of a node's own n-grams, by the column that their tokens lie in.
WEIGHTS = {"name": 3.0, "doc": 1.5, "sig": 1.0}
_STOPWORDS = frozenset(text.STOPWORDS)


def _doc_tokens(lowered: str) -> list[str]:
    """`text.tokenize` of a text in lower case."""
    return [t for t in re.findall("[a-z]{2,}", lowered) if t not in _STOPWORDS]


def _runs(tokens: list[str], n: int) -> Iterator[tuple[str, ...]]:
    return zip(*[tokens[i:] for i in range(n)])


def _grams(tokens: list[str], sizes: tuple[int, ...]) -> list[str]:
    return [" ".join(run) for n in sizes for run in _runs(tokens, n)]


def _doc_grams(lowered: str, sizes: tuple[int, ...]) -> list[str]:
    """`text.extract_ngrams`: all lengths up to the longest."""
    return _grams(_doc_tokens(lowered), tuple(range(1, max(sizes) + 1)))


def _called(g: Graph, sizes: tuple[int, ...]) -> DataFrame:
    """(id, ngram) for each place in the names of the nodes that a node calls."""
    n = g.nodes
    calls = g.edges.where("relation = 'calls'").join(n.select(F.col("id").alias("target"), F.col("name").alias("callee")), "target").where("callee <> ''")
    calls = calls.join(n.select(F.col("id").alias("source")), "source", "left_semi")
    return calls.select(F.col("source").alias("id"), F.explode(text.ngrams(text.split_identifier(F.col("callee")), sizes)).alias("ngram"))


def _beside(g: Graph, sizes: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with `calls`, their n-grams from called names and how often each comes; all of these as rows; the ids that have too many of them."""
    called = stored(_called(g, sizes).groupBy("id", "ngram").agg(F.count(F.lit(1)).alias("n")), "called-ngrams")
    per = called.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    few = called.join(per.where(F.col("k") <= CALLS), "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct("ngram", "n")).alias("calls"))
    nothing = F.array().cast("array<struct<ngram:string,n:long>>")
    # The calls are the side that is held: rows with texts stream past them unsorted.
    nodes = _own(g).join(few.hint("shuffle_hash"), "id", "left").withColumn("calls", F.coalesce("calls", nothing))
    return nodes, called, per.where(F.col("k") > CALLS).select("id")


def _own(g: Graph) -> DataFrame:
    """(id, name, doc, sig): what the n-grams of a node's own row are made of, tokens or, for the docstring, the text in lower case."""
    name, signature = text.split_identifier(F.col("name")), text.signature_tokens(F.col("signature"))
    return g.nodes.select("id", name.alias("name"), F.lower(F.coalesce("docstring", F.lit(""))).alias("doc"), signature.alias("sig"))


def _weights(row: dict, sizes: tuple[int, ...]) -> Counter:
    """Weight of each n-gram of a row."""
    found = Counter()
    for part, weight in WEIGHTS.items():
        grams = _doc_grams(row["doc"], sizes) if part == "doc" else _grams(row[part], sizes)
        for gram, k in Counter(grams).items():
            found[gram] += weight * k
    for c in row.get("calls") or ():
        found[c["ngram"]] += c["n"]
    return found


def _postings(nodes: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(id, ngram, weight) of rows as `_beside` makes them."""

    def batch(ids, grams, weights):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(grams, pa.string()), pa.array(weights, pa.float64())], ["id", "ngram", "weight"])

    def run(batches: Iterable[pa.RecordBatch]):
        ids, grams, weights = [], [], []
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                found = _weights(row, sizes)
                ids += [row["id"]] * len(found)
                grams += found
                weights += map(float, found.values())
                while len(ids) >= HELD_GRAMS:
                    yield batch(ids[:HELD_GRAMS], grams[:HELD_GRAMS], weights[:HELD_GRAMS])
                    del ids[:HELD_GRAMS], grams[:HELD_GRAMS], weights[:HELD_GRAMS]
        yield batch(ids, grams, weights)

    return mapped(nodes, run, "id string, ngram string, weight double")


def ngram_index(g: Graph, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(id, ngram, weight): 3 for each place in the name, 1.5 in the docstring, 1 in the signature, 1 in a called node's name.

    Each node's n-grams are summed within its row, so that texts are shuffled
    once, to meet the calls, and n-grams, many times as large, not at all.
    """
    nodes, called, many = _beside(g, sizes)
    index = _postings(nodes, sizes)
    if many.isEmpty():
        return index
    more = called.join(many, "id", "left_semi").select("id", "ngram", F.col("n").cast("double").alias("weight"))
    more = _postings(nodes.join(many, "id", "left_semi"), sizes).unionByName(more).groupBy("id", "ngram").agg(F.sum("weight").alias("weight"))
    return _postings(nodes.join(many, "id", "left_anti"), sizes).unionByName(more)


def distinct_ngrams(g: Graph, expected: int, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(ngram) of all nodes; `expected`, the sum of the nodes' numbers of them, settles in how many tasks."""

    def run(batches: Iterable[pa.RecordBatch]):
        held = set()
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                held.update(_doc_grams(row["doc"], sizes), _grams(row["name"], sizes), _grams(row["sig"], sizes))
                if len(held) >= HELD_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], ["ngram"])
                    held = set()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], ["ngram"])

    # A called node's name is a node's name too. Dealt first: n-grams are grouped in tasks of known size only.
    return mapped(_own(g), run, "ngram string").repartition(_tasks(expected), "ngram").distinct()


def _tasks(grams: int) -> int:
    return max(1, math.ceil(grams / TASK_GRAMS))


def corpus_stats(g: Graph, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row: nodes that have n-grams, their mean number, and how many there are in all."""
    lengths = stored(_profiles(g, [], max(sizes)).select("dl"), "lengths")
    expected = lengths.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    counts = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len"))
    return counts.crossJoin(distinct_ngrams(g, expected, sizes).agg(F.count(F.lit(1)).alias("n_ngrams")))


@dataclass(frozen=True)
class Index:
    """A stored index: postings (id, ngram, weight, bucket), lengths (id, dl), corpus (n, avgdl)."""

    postings: DataFrame
    lengths: DataFrame
    corpus: DataFrame
    buckets: int


def _bucket(ngram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ngram), F.lit(buckets)).cast("int")


def write_index(g: Graph, path: str, sizes: tuple[int, ...] = (1, 2, 3), buckets: int = BUCKETS) -> Index:
    """Write the n-gram index of a graph under `path`: a folder per bucket of n-grams, sorted by n-gram within its files."""
    spark = g.nodes.sparkSession
    _profiles(g, [], max(sizes)).select("id", "dl").write.parquet(f"{path}/lengths")
    size = spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("size"), F.lit(buckets).alias("buckets"))
    size.write.parquet(f"{path}/corpus")
    # Salted by id, as a hot n-gram has more postings than one task should hold.
    tasks = _tasks(spark.read.parquet(f"{path}/corpus").first()["size"])
    salt = F.pmod(F.xxhash64("id"), F.lit(math.ceil(tasks / buckets)))
    postings = ngram_index(g, sizes).withColumn("bucket", _bucket(F.col("ngram"), buckets))
    postings = postings.repartition(tasks, "bucket", salt).sortWithinPartitions("bucket", "ngram")
    postings.write.partitionBy("bucket").parquet(f"{path}/postings")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    """The index that `write_index` wrote."""
    corpus = spark.read.parquet(f"{path}/corpus")
    postings = spark.read.schema("id string, ngram string, weight double, bucket int").parquet(f"{path}/postings")
    return Index(postings, spark.read.schema("id string, dl long").parquet(f"{path}/lengths"), corpus.select("n", "avgdl"), corpus.first()["buckets"])


def query_ngrams(spark, query: str, max_n: int = 3) -> DataFrame:
    """(place, ngram) of a query, repeats included."""
    return spark.range(1).select(F.posexplode(text.extract_ngrams(F.lit(query), max_n)).alias("place", "ngram"))


def _profiles(g: Graph, asked: list[str], max_n: int) -> DataFrame:
    """(id, dl, hits array<(ngram, weight)>) of every node that has an n-gram: its number of distinct ones, and those that are asked for."""
    sizes = tuple(range(1, max_n + 1))
    nodes, called, many = _beside(g, sizes)
    wanted = {gram: tuple(gram.split(" ")) for gram in asked}

    def measured(row):
        tokens = _doc_tokens(row["doc"])
        # The tokens of a text have no spaces in them, so that a run stands for its n-gram.
        runs = [set(_runs(tokens, n)) for n in sizes]
        hits = [(gram, WEIGHTS["doc"] * sum(x == run for x in _runs(tokens, len(run)))) for gram, run in wanted.items() if run in runs[len(run) - 1]]
        others = Counter()
        for part in ("name", "sig"):
            for gram in _grams(row[part], sizes):
                others[gram] += WEIGHTS[part]
        for c in row["calls"]:
            others[c["ngram"]] += c["n"]
        hits += [(gram, float(others[gram])) for gram in asked if gram in others]
        apart = sum(len(x := tuple(gram.split(" "))) > max_n or x not in runs[len(x) - 1] for gram in others)
        return sum(map(len, runs)) + apart, [{"ngram": gram, "w": w} for gram, w in hits]

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            found = [measured(b.slice(k, 1).to_pylist()[0]) for k in range(b.num_rows)]
            hits = pa.array([h for _, h in found], pa.list_(pa.struct([("ngram", pa.string()), ("w", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([dl for dl, _ in found], pa.int64()), hits], ["id", "dl", "hits"])

    out = mapped(nodes, run, "id string, dl long, hits array<struct<ngram:string,w:double>>")
    if many.isEmpty():
        return out.where("dl > 0")
    # Nodes with more: their n-grams as rows.
    rows = ngram_index(Graph(g.nodes.join(many, "id", "left_semi"), g.edges.limit(0)), sizes)
    rows = rows.unionByName(called.join(many, "id", "left_semi").select("id", "ngram", F.col("n").cast("double").alias("weight"))).groupBy("id", "ngram").agg(F.sum("weight").alias("weight"))
    hit = F.when(F.col("ngram").isin(*asked), F.struct("ngram", F.col("weight").alias("w")))
    rows = rows.groupBy("id").agg(F.count(F.lit(1)).alias("dl"), F.collect_list(hit).alias("hits"))
    return out.join(many, "id", "left_anti").where("dl > 0").unionByName(rows)


def bm25(g: Graph, query: str, index: DataFrame | Index | None = None, k1: float = K1, b: float = B, max_n: int = 3) -> DataFrame:
    """(id, score, matched) of the nodes that score above 0; a repeated query n-gram counts again.

    `index` is a stored index or a table as `ngram_index` makes it; without
    one, nodes are measured row by row.
    """
    spark = g.nodes.sparkSession
    # As many rows as the query has n-grams.
    asked = query_ngrams(spark, query, max_n)
    grams = sorted({r["ngram"] for r in asked.collect()})
    if not grams:
        return spark.createDataFrame([], "id string, score double, matched array<string>")
    if isinstance(index, Index):
        buckets = [r[0] for r in spark.createDataFrame([(x,) for x in grams], "ngram string").select(_bucket(F.col("ngram"), index.buckets)).distinct().collect()]
        hits = index.postings.where(F.col("bucket").isin(*buckets) & F.col("ngram").isin(*grams)).select("id", "ngram", "weight").join(index.lengths, "id")
        corpus = index.corpus
    elif index is not None:
        lengths = index.groupBy("id").agg(F.count(F.lit(1)).alias("dl"))
        corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        hits = index.where(F.col("ngram").isin(*grams)).join(lengths, "id")
    else:
        profiles = stored(_profiles(g, grams, max_n), "search-profiles")
        corpus = profiles.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        hits = profiles.where(F.size("hits") > 0).select("id", "dl", F.inline("hits")).groupBy("id", "dl", "ngram").agg(F.sum("w").alias("weight"))
    df = hits.groupBy("ngram").agg(F.count(F.lit(1)).alias("df"))
    # One row, and one or a few for each n-gram of the query.
    rows = hits.join(F.broadcast(asked), "ngram").join(F.broadcast(df), "ngram").crossJoin(F.broadcast(corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    tf = F.col("weight")
    part = idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    matched = F.transform(F.array_sort(F.collect_list(F.struct("place", "ngram"))), lambda x: x["ngram"])
    # Summed in the order of the query, as floating-point sums depend on it.
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"])
    score = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return rows.groupBy("id").agg(score.alias("score"), matched.alias("matched")).where("score > 0")


def _best(score: str = "score") -> list[Column]:
    """Order of ranking: sums whose last bits differ tie, and ties go by insertion."""
    return [F.round(score, 9).desc(), F.col("ord")]


def search(g: Graph, query: str, top_k: int = 10, index: DataFrame | Index | None = None, max_n: int = 3) -> DataFrame:
    """The `top_k` nodes by BM25: id, name, score, matched, snippet, ord."""
    top = g.nodes.select("id", "ord").join(bm25(g, query, index, max_n=max_n), "id").orderBy(*_best()).limit(top_k)
    found = g.nodes.drop("ord").join(maybe_broadcast(top, top_k, 500), "id")
    return found.select("id", "name", "score", "matched", text.snippet().alias("snippet"), "ord").orderBy(*_best())


def hybrid_search(g: Graph, query: str, top_k: int = 10, alpha: float = 0.5, index: DataFrame | Index | None = None, equal: float = 1.0) -> DataFrame:
    """alpha * BM25 + (1 - alpha) * similarity to the best BM25 hit, each scaled to 0..1 (`equal` if all are): id, score, ngram_score, sim_score, matched, features, ord."""
    # At most 2 * top_k rows, read several times.
    grams = stored(search(g, query, 2 * top_k, index), "search-hits")
    anchor = grams.orderBy(*_best()).limit(1).select("id")
    alike = similarity.similar_to(g, anchor, 2 * top_k, "ast")
    a = min_max(grams.select("id", "score", "matched"), "score", "ngram_score", equal).drop("score")
    b = min_max(alike.select("id", "score", F.col("matched").alias("features")), "score", "sim_score", equal).drop("score")
    none = F.array().cast("array<string>")
    both = a.join(b, "id", "full").select(
        "id", F.coalesce("ngram_score", F.lit(0.0)).alias("ngram_score"), F.coalesce("sim_score", F.lit(0.0)).alias("sim_score"),
        F.coalesce("matched", none).alias("matched"), F.coalesce("features", none).alias("features"),
    )
    both = both.withColumn("score", alpha * F.col("ngram_score") + (1 - alpha) * F.col("sim_score"))
    # The cut comes first, then what scores nothing goes.
    best = g.nodes.select("id", "ord").join(maybe_broadcast(both, 4 * top_k, 500), "id").orderBy(*_best()).limit(top_k)
    return best.where("score > 0").select("id", "score", "ngram_score", "sim_score", "matched", "features", "ord")
