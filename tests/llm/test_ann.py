import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from latticework.llm import ann


def exact(ids, x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {i: [(ids[j], d[r, j]) for j in np.lexsort((ids, d[r]))[:k]] for r, i in enumerate(ids)}


def result(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["neighbor_id"], r["distance"]))
    return out


def test_recall(spark):
    """All vectors of sf0.1 as queries: recall of the ten nearest at least 0.9, distances exact."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 3000")
    table = vectors.orderBy("vec_id").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(np.float64)
    want, got = exact(ids, x, 10), result(ann.nearest(vectors))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = [len({n for n, _ in got[i]} & {n for n, _ in want[i]}) / 10 for i in want]
    assert np.mean(hit) >= 0.9
    place = {i: k for k, i in enumerate(ids)}
    assert all(abs(np.sqrt(((x[place[i]] - x[place[n]]) ** 2).sum()) - d) < 1e-9 for i, v in got.items() for n, d in v)


def test_hard_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [0.0, 1.0]), (8, [0.0, None]), (9, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "'x' as v", "2 as bucket")
    got = result(ann.nearest(df))
    assert {k: [n for n, _ in v] for k, v in got.items()} == {1: [2, 3, 9], 2: [3, 1, 9], 3: [2, 1, 9], 9: [1, 2, 3]}
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id = 1")).count() == 0


def test_probes_come_in_order_of_success():
    p = ann.Params(tables=1, functions=3)
    h = ann.Hashes(8, 1.0, p)
    x = np.random.default_rng(0).standard_normal((5, 8)).astype(np.float32)
    q, key = h.probes(x, 0, 1.0, 0.999, 343)
    own = h.keys(h.slots(h.project(x, 0)))
    counts = np.bincount(q, minlength=5)
    assert (counts > 1).all() and len(set(zip(q.tolist(), key.tolist()))) == len(q)
    assert all(own[i] in key[q == i] for i in range(5))


def recalls(spark, x):
    """Share of the ten nearest (by distance) that each row finds; every row has ten."""
    ids = np.arange(len(x))
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    kth = np.partition(d, 9, axis=1)[:, 9]
    df = spark.createDataFrame([(int(i), row.tolist()) for i, row in zip(ids, x.astype(np.float32))], "vec_id long, embedding array<float>")
    got = result(ann.nearest(df))
    assert set(got) == set(ids.tolist()) and all(len(v) == 10 for v in got.values())
    return np.array([sum(v <= kth[i] + 1e-4 for _, v in got[i]) / 10 for i in ids.tolist()])


def test_isolated_rows_beside_near_copies(spark):
    """A radius of its own for each query: a hot mass of near copies doesn't narrow what the isolated rows visit."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 1900)] + 0.02 * rng.standard_normal((1900, 64))
    recall = recalls(spark, np.concatenate((x, 1.5 * rng.standard_normal((100, 64)))))
    assert recall[1900:].mean() >= 0.9 and recall[:1900].mean() >= 0.9


def test_many_dimensions_and_small_tables(spark):
    """Where 1024 buckets don't hold the share, and where few rows are in reach."""
    rng = np.random.default_rng(2)
    assert recalls(spark, rng.standard_normal((1500, 384))).mean() >= 0.94
    assert recalls(spark, rng.standard_normal((300, 16))).mean() >= 0.94


def clusters(n, dim, size, noise, seed):
    """Rows around n / size centres."""
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n // size, dim))[rng.integers(0, n // size, n)] + noise * rng.standard_normal((n, dim))).astype(np.float32)


def test_recall_and_pruning_on_a_large_table(spark, tmp_path):
    """50,000 clustered vectors: a tenth of the table or less is reranked, with recall 0.9 or more."""
    x = clusters(50_000, 64, 25, 0.35, 7)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.reshape(-1), 64).cast(pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "x.parquet", row_group_size=5000)
    df = spark.read.parquet(str(tmp_path / "x.parquet"))
    asked = F.col("id") % 250 == 0
    got = result(ann.nearest(df, queries=asked))
    assert sorted(got) == list(range(0, 50_000, 250)) and all(len(v) == 10 for v in got.values())
    hits = []
    for i, v in got.items():
        d = np.sqrt(((x - x[i]).astype(np.float64) ** 2).sum(1))
        d[i] = np.inf
        kth = np.partition(d, 9)[9]
        hits.append(sum(e <= kth + 1e-6 for _, e in v) / 10)
        assert all(abs(d[n] - e) < 1e-6 for n, e in v)
    share = np.mean([r["n_candidates"] / r["n_rows"] for r in ann.candidates(df, queries=asked).collect()])
    assert np.mean(hits) >= 0.9 and share <= 0.1, (np.mean(hits), share)


def test_some_queries_against_all_rows(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    every, some = result(ann.nearest(vectors)), result(ann.nearest(vectors, queries=F.col("id") % 20 == 0))
    table = vectors.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(np.float64)
    want = exact(ids, x, 10)
    assert set(some) == {i for i in ids.tolist() if i % 20 == 0} and set(every) == set(ids.tolist())
    for got in (every, some):
        assert np.mean([len({n for n, _ in got[i]} & {n for n, _ in want[i]}) / 10 for i in got]) >= 0.9


def test_queries_beyond_the_share_meet_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = result(ann.nearest(df, ann.Params(most=1, start=1)))
    want = exact(np.arange(200), x.astype(np.float64), 10)
    assert {i: [n for n, _ in v] for i, v in got.items()} == {i: [n for n, _ in v] for i, v in want.items()}
