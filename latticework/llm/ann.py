"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of `tables` tables hashes a vector with Gaussian projections, h(x) =
floor((a.x + b) / w).  A query's neighbour at distance R has the projection
a.x + N(0, R**2), which gives the probability of each slot of each function
and, by their product, the success probability of each bucket.

Every query has its own R.  It first visits `start` buckets a table; the k-th
distance found there is at least that of the true k-th neighbour.  With it as R
the query visits buckets in descending success probability until their sum
reaches the share that makes `tables` independent tables find `target` of the
neighbours.  A query that found fewer than k rows at first, or for which `most`
buckets of some table don't reach the share, is held against all rows instead,
in blocks of `GROUP_ROWS`: nothing is left out for want of probes.

Buckets are dealt to groups by their hashes; those of more than `GROUP_ROWS`
rows are cut into chunks.  A group's rows and the queries that visit it meet in
one task, which takes the distances of each bucket's rows to the queries that
visit this very bucket, reranks the best exactly and returns k for each query.
Merging groups and tables keeps the best k.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, mapped, maybe_broadcast, stored

GROUP_ROWS = 4096
QUERY_ROWS = 16384
#: The table that has all rows in each query's reach.
ALL = -1
#: Queries whose probes are worked out at once; each has some thousands of prefixes.
VISIT_ROWS = 128
#: Prefixes kept for that many queries; queries that need more are worked out in smaller parts.
PREFIXES = 1024
#: Slots to either side of a query's own that its probes are taken from; success beyond them doesn't count towards the share.
REACH = 3


@dataclass(frozen=True)
class Params:
    k: int = 10
    tables: int = 3
    #: Functions a table: by default half the binary logarithm of the rows, so that buckets stay small as the table grows.
    functions: int | None = None
    #: Slot width in standard deviations of a projection of the data.
    width: float = 1.7
    target: float = 0.95
    #: Buckets a table that a query visits to learn its distance, and at most before it goes by all rows.
    start: int = 16
    most: int = 4096
    seed: int = 7


def cleaned(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id long, v array<float>): one row per id, the least vector if they differ; see `nearest` for what is left out."""
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[column].cast("array<float>").alias("v"))
    whole = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e15))
    return rows.where(whole).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function (Zelen and Severo's approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-x * x / 2) / 2.5066282746310002 * poly
    return np.where(x > 0, 1 - tail, tail)


class Hashes:
    """Projections, offsets and slots of all tables for one dimension."""

    def __init__(self, dim: int, spread: float, p: Params, rows: int = 1):
        rng = np.random.default_rng(p.seed)
        self.p, self.w = p, p.width * spread
        self.functions = p.functions or max(5, math.ceil(math.log2(max(rows, 1)) / 2))
        self.a = rng.standard_normal((p.tables, dim, self.functions)).astype(np.float32)
        self.b = (rng.random((p.tables, self.functions)) * self.w).astype(np.float32)
        # Two buckets that share a key by chance are visited together, which does no harm.
        self.odd = rng.integers(1 << 61, 1 << 62, self.functions, dtype=np.int64) * 2 + 1

    def project(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.a[table] + self.b[table]

    def slots(self, projected: np.ndarray) -> np.ndarray:
        return np.floor(projected / self.w).astype(np.int64)

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """One number per bucket."""
        return (slots * self.odd).sum(axis=1)

    def probes(self, x: np.ndarray, table: int, radius: float | np.ndarray, share: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, bucket key) in descending success probability, until `share` of the success is covered."""
        return self.covering(x, table, radius, share, most)[:2]

    def covering(self, x: np.ndarray, table: int, radius: float | np.ndarray, share: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`probes` for a radius of each query, and whether `most` buckets cover the query's share.

        Functions are added one by one, keeping the `most` best prefixes: the
        best `most` buckets have all their prefixes among them.
        """
        radius = np.maximum(np.broadcast_to(np.asarray(radius, dtype=np.float64), len(x)), 1e-12)[:, None]
        at = self.project(x, table)
        own = self.slots(at)
        near = np.arange(-REACH, REACH + 1)
        score, key = np.ones((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
        for f in range(self.functions):
            slot = own[:, f, None] + near
            edges = (np.concatenate((slot, slot[:, -1:] + 1), axis=1) * self.w - at[:, f, None]) / radius
            chance = np.diff(_phi(np.clip(edges, -9, 9)), axis=1)
            score = (score[:, :, None] * chance[:, None, :]).reshape(len(x), -1)
            key = (key[:, :, None] + (slot * self.odd[f])[:, None, :]).reshape(len(x), -1)
            if score.shape[1] > most:
                best = np.argpartition(-score, most - 1, axis=1)[:, :most]
                score, key = np.take_along_axis(score, best, 1), np.take_along_axis(key, best, 1)
        order = np.argsort(-score, axis=1)
        score, key = np.take_along_axis(score, order, 1), np.take_along_axis(key, order, 1)
        before = np.cumsum(score, axis=1) - score
        visited = before < share
        visited[:, 0] = True
        return np.nonzero(visited)[0], key[visited], score.sum(axis=1) >= share


def _spread(rows: DataFrame) -> float:
    """Standard deviation of a projection: its variance is the sum of the coordinates' variances."""
    flat = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s")).agg(F.sum("s")).first()[0]
    return float(np.sqrt(flat)) if flat else 1.0


def _best(q: np.ndarray, x: np.ndarray, norm: np.ndarray, ids: np.ndarray, qid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, rough distance) of the `most` nearest rows of each query, itself left out."""
    rough = norm[None, :] - 2 * (q @ x.T)
    rough[ids[None, :] == qid[:, None]] = np.inf
    if most < len(ids):
        near = np.argpartition(rough, most - 1, axis=1)[:, :most]
        return np.repeat(np.arange(len(q)), most), near.reshape(-1), np.take_along_axis(rough, near, 1).reshape(-1)
    return np.repeat(np.arange(len(q)), len(ids)), np.tile(np.arange(len(ids)), len(q)), rough.reshape(-1)


def _group_ranking(p: Params):
    """Of rows that are held or ask (held, id, v, buckets): the k nearest held rows in the buckets that each asking row visits."""
    take = p.k + 6

    def rerank(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        mine = table.column("held").combine_chunks()
        rows_in, ask = table.filter(mine), table.filter(pc.invert(mine))
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if rows_in.num_rows and ask.num_rows:
            x, ids = _matrix(rows_in.column("v")), rows_in.column("id").to_numpy()
            bucket = rows_in.column("buckets").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            q, qid = _matrix(ask.column("v")), ask.column("id").to_numpy()
            by = np.lexsort((ids, bucket))
            x, ids, bucket = x[by], ids[by], bucket[by]
            norm = (x * x).sum(1)
            names, first = np.unique(bucket, return_index=True)
            first = np.append(first, len(bucket))
            visits = ask.column("buckets").combine_chunks()
            asking = np.repeat(np.arange(len(qid)), pc.list_value_length(visits).to_numpy(zero_copy_only=False))
            visited = visits.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(visited, kind="stable")
            asking, visited = asking[order], visited[order]
            low, high = np.searchsorted(visited, names, side="left"), np.searchsorted(visited, names, side="right")
            found = []
            for k in np.flatnonzero(high > low).tolist():
                span = slice(first[k], first[k + 1])
                for start in range(low[k], high[k], 512):
                    who = asking[start : min(start + 512, high[k])]
                    i, j, rough = _best(q[who], x[span], norm[span], ids[span], qid[who], take)
                    found.append((who[i], j + first[k], rough))
            if found:
                i, j, rough = map(np.concatenate, zip(*found))
                order = np.lexsort((rough, i))
                i, j, rough = i[order], j[order], rough[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                some = (place < take) & np.isfinite(rough)
                i, j = i[some], j[some]
                diff = q[i].astype(np.float64) - x[j].astype(np.float64)
                exact = np.sqrt((diff * diff).sum(1))
                order = np.lexsort((ids[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                some = np.arange(len(i)) - np.searchsorted(i, i) < p.k
                out = [qid[i[some]], ids[j[some]], exact[some]]
        return pa.table({"id": pa.array(out[0]), "neighbor_id": pa.array(out[1]), "distance": pa.array(out[2])})

    return rerank


class Search:
    """The steps of `nearest` over one table, with what they find in the shared folder."""

    def __init__(self, vectors: DataFrame, params: Params | None, id_column: str, column: str, queries: Column | None):
        self.p = params or Params()
        rows = stored(cleaned(vectors, id_column, column), "vectors")
        dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
        self.total = dims["n"] if dims else 0
        if not self.total:
            return
        self.rows = rows.where(F.size("v") == dims["d"])
        self.asked = self.rows if queries is None else self.rows.where(queries)
        self.n_asked = self.asked.count()
        self.hashes = Hashes(dims["d"], _spread(self.rows), self.p, self.total)
        self.blocks = -(-self.total // GROUP_ROWS)
        sizes = self.entries(range(self.p.tables)).groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n"))
        everywhere = self.rows.groupBy(F.lit(ALL).alias("t"), self._block().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        chunks = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
        group = F.pmod(F.xxhash64("t", "bucket"), F.lit(self.blocks)).cast("int")
        self.groups = stored(sizes.unionByName(everywhere).select("t", "bucket", "n", chunks.alias("chunks"), group.alias("g")), "buckets")
        self.n_groups = self.groups.count()
        # Probes are worked out for few rows at great length: as many tasks as a shuffle has.
        self.tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.blocks))

    def entries(self, tables) -> DataFrame:
        """(t, bucket, id, v): every row in its bucket of each of the tables."""
        hashes, tables = self.hashes, list(tables)

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("v"))
                for t in tables:
                    key = hashes.keys(hashes.slots(hashes.project(x, t)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(key), batch.column("id"), batch.column("v")], ["t", "bucket", "id", "v"])

        return mapped(self.rows, run, "t int, bucket long, id long, v array<float>")

    def first_visits(self) -> DataFrame:
        """(t, bucket, id): the `start` likeliest buckets of each query."""
        hashes, p = self.hashes, self.p

        def run(batches):
            for batch in batches:
                x, ids = _matrix(batch.column("v")), batch.column("id").to_numpy()
                for start in range(0, len(x), VISIT_ROWS):
                    for t in range(p.tables):
                        q, key = hashes.probes(x[start : start + VISIT_ROWS], t, hashes.w / 2, 2.0, p.start)
                        yield _visit_rows(t, key, ids[start + q])

        return self._met(mapped(self.asked.select("id", "v").repartition(self.tasks), run, "t int, bucket long, id long"))

    def _met(self, visits: DataFrame) -> DataFrame:
        """Visits to buckets that have rows, and those to all rows."""
        known = maybe_broadcast(self.groups.select("t", "bucket", F.lit(True).alias("there")), self.n_groups, 32)
        return visits.join(known, ["t", "bucket"], "left").where((F.col("t") == ALL) | F.col("there")).drop("there")

    def visits(self, first: DataFrame) -> DataFrame:
        """(t, bucket, id): the buckets that give each query its share, or a row under `ALL` where they don't."""
        hashes, p = self.hashes, self.p
        share = 1 - (1 - p.target) ** (1 / p.tables)
        kth = F.coalesce(F.get("best", F.lit(p.k - 1))["distance"], F.lit(float("inf")))
        asking = self.asked.join(first, "id", "left").select("id", "v", kth.alias("kth"))

        def run(batches):
            for batch in batches:
                x, ids = _matrix(batch.column("v")), batch.column("id").to_numpy()
                radius = batch.column("kth").to_numpy(zero_copy_only=False)
                open_, most = np.flatnonzero(np.isfinite(radius)), min(PREFIXES, p.most)
                everywhere = np.flatnonzero(~np.isfinite(radius))
                while len(open_):
                    left = []
                    step = max(1, VISIT_ROWS * PREFIXES // max(most, PREFIXES))
                    for start in range(0, len(open_), step):
                        part = open_[start : start + step]
                        found = [hashes.covering(x[part], t, radius[part], share, most) for t in range(p.tables)]
                        whole = np.all([covered for _, _, covered in found], axis=0)
                        left.append(part[~whole])
                        for t, (q, key, _) in enumerate(found):
                            yield _visit_rows(t, key[whole[q]], ids[part[q[whole[q]]]])
                    open_ = np.concatenate(left)
                    if most >= p.most:
                        break
                    most = min(most * 4, p.most)
                everywhere = np.concatenate((everywhere, open_))
                yield _visit_rows(ALL, np.zeros(len(everywhere), dtype=np.int64), ids[everywhere])

        return self._met(mapped(asking.repartition(self.tasks), run, "t int, bucket long, id long"))

    def reached(self, visit: DataFrame, held: DataFrame) -> DataFrame:
        """(id, best): the k nearest of the rows of `held` in the buckets that each query visits."""
        queries_in = max(1, -(-self.n_asked // QUERY_ROWS))
        groups = maybe_broadcast(self.groups.drop("n"), self.n_groups, 40)
        where = visit.join(groups, ["t", "bucket"]).select("t", "g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "bucket", "id")
        asked = where.groupBy("t", "g", "chunk", "id").agg(F.collect_list("bucket").alias("buckets")).join(self.asked.select("id", "v"), "id")
        asked = asked.select("t", "g", "chunk", F.pmod(F.xxhash64("id"), F.lit(queries_in)).cast("int").alias("part"), "id", "v", "buckets")
        held = held.join(groups, ["t", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int"))
        held = held.select("t", "g", "chunk", F.explode(F.sequence(F.lit(0), F.lit(queries_in - 1))).alias("part"), "id", "v", F.array("bucket").alias("buckets"))
        both = asked.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))
        near = both.groupBy("t", "g", "chunk", "part").applyInArrow(_group_ranking(self.p), "id long, neighbor_id long, distance double")
        return near.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("distance", "neighbor_id"))), 1, self.p.k).alias("best"))


def _visit_rows(t: int, key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, dtype=np.int32)), pa.array(key), pa.array(ids)], ["t", "bucket", "id"])


def nearest(vectors: DataFrame, params: Params | None = None, id_column: str = "vec_id", column: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(id, neighbor_id, distance, rank): the k nearest other rows of every query, by Euclidean distance, ties by id.

    Queries are the rows for which `queries`, a condition on `id`, holds, all
    rows if it is None; they are held against all rows.  Left out are rows
    whose id is null or whose vector is null, empty or has an element that is
    null or not finite; rows with one id count once (the least vector); vectors
    are compared with those of the dimension that most rows have, others are
    left out.  A query has fewer than k neighbours only if there are no more
    rows.  Other columns aren't read.  An empty table gives no rows.
    """
    s = Search(vectors, params, id_column, column, queries)
    if not s.total:
        return vectors.sparkSession.createDataFrame([], "id long, neighbor_id long, distance double, rank int")
    first = stored(s.reached(s.first_visits(), s.entries(range(s.p.tables))), "first-neighbours")
    visits = stored(s.visits(first), "visits")
    best = first.unionByName(s.reached(visits.where(F.col("t") != ALL), s.entries(range(s.p.tables))))
    if not visits.where(F.col("t") == ALL).isEmpty():
        # Every block of every row's table, one row of it at a time: their number grows with the table.
        blocks = s.groups.where(F.col("t") == ALL).select("t", "bucket")
        everywhere = visits.where(F.col("t") == ALL).select("t", "id").join(blocks, "t")
        best = best.unionByName(s.reached(everywhere, s.rows.select(F.lit(ALL).alias("t"), s._block().alias("bucket"), "id", "v")))
    # What was found at first may lie outside the buckets that were visited then.
    best = stored(best.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, s.p.k).alias("best")), "neighbours")
    drop_stored(first, visits, s.groups)
    ranked = best.select("id", F.posexplode("best").alias("rank", "n"))
    return ranked.select("id", F.col("n.neighbor_id").alias("neighbor_id"), F.col("n.distance").alias("distance"), (F.col("rank") + 1).cast("int").alias("rank"))


def candidates(vectors: DataFrame, params: Params | None = None, id_column: str = "vec_id", column: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(id, n_candidates, n_rows) of every query: how many of all rows its buckets hold; all of them where it goes by all rows.

    Counts what `nearest` reranks, row by row: for judging parameters on a few queries.
    """
    s = Search(vectors, params, id_column, column, queries)
    if not s.total:
        return vectors.sparkSession.createDataFrame([], "id long, n_candidates long, n_rows long")
    first = stored(s.reached(s.first_visits(), s.entries(range(s.p.tables))), "first-neighbours")
    visits = stored(s.first_visits().unionByName(s.visits(first)).distinct(), "visits")
    held = s.entries(range(s.p.tables)).select("t", "bucket", F.col("id").alias("row"))
    counted = visits.join(held, ["t", "bucket"]).groupBy("id").agg(F.count_distinct("row").alias("n"))
    everywhere = visits.where(F.col("t") == ALL).select("id", F.lit(s.total).alias("all"))
    out = s.asked.select("id").join(counted, "id", "left").join(everywhere, "id", "left")
    return out.select("id", F.coalesce("all", "n", F.lit(0)).cast("long").alias("n_candidates"), F.lit(s.total).cast("long").alias("n_rows"))
