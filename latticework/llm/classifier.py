"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, word pairs and
character 3- and 4-grams (spaces mark the ends of words), all hashed into
`buckets` rows, all pairs of a word with itself into one; a softmax over two classes reads it.  Training is stochastic
gradient descent in numpy on the driver, on at most `sample` labelled documents
(lowest hashes of their ids) whose features the executors extract.  The model
is linear after training, so a document's logit is the average of one number
per bucket, and scoring needs no vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import mapped

_U = np.uint64


@dataclass(frozen=True)
class Params:
    #: Bound on the labelled documents that the model is fitted to.
    sample: int = 3000
    buckets: int = 1 << 16
    dim: int = 16
    epochs: int = 6
    rate: float = 0.5
    seed: int = 11
    #: Documents below this probability of good quality are rejected.
    threshold: float = 0.5


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature occurrence, row of it): words, pairs of words, character 3- and 4-grams."""
    data, offsets = tv.buffers(texts)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = tv.NOT_SPACE[data]
    sums = tv.prefix(np.where(inside, data, np.uint8(32)))
    starts, ends, first = tv.words(data, offsets, tv.NOT_SPACE)
    word = tv.span_hash(sums, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    same = row[1:] == row[:-1]
    # A word after itself is one feature whatever the word: repetition tells more than which word it is.
    pair = np.where(word[:-1] == word[1:], _U(1), tv.mix(word[:-1] * _U(3) + word[1:], 1))[same]
    of_byte = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    spaces = np.concatenate(([0], np.cumsum(~inside, dtype=np.int32)))
    hashes, rows = [word, pair], [row, row[:-1][same]]
    for n in (3, 4):
        at = np.arange(len(data) - n + 1)
        at = at[(spaces[at + n - 1] == spaces[at + 1]) & (of_byte[at] == of_byte[at + n - 1])] if len(at) else at
        hashes.append(tv.span_hash(sums, at, at + n))
        rows.append(of_byte[at])
    return (np.concatenate(hashes) & _U(buckets - 1)).astype(np.int64), np.concatenate(rows)


class Model:
    """Logit weights by bucket and a bias; `weights` may be None for a model that knows nothing."""

    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def probability(self, texts: pa.Array) -> np.ndarray:
        """Softmax probability of good quality; 0.5 for rows without features."""
        rows = len(texts)
        if self.weights is None:
            return np.full(rows, 0.5)
        bucket, row = features(texts, len(self.weights))
        n = np.bincount(row, minlength=rows)
        total = np.bincount(row, weights=self.weights[bucket], minlength=rows)
        logit = np.where(n > 0, total / np.maximum(n, 1) + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(ids: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, p: Params) -> Model:
    """Stochastic gradient descent over documents given by distinct buckets and their counts."""
    if not len(labels) or labels.min() == labels.max():
        return Model(None, 0.0)
    rng = np.random.default_rng(p.seed)
    vectors = ((rng.random((p.buckets, p.dim), dtype=np.float32) - 0.5) / p.dim).astype(np.float32)
    output, bias = np.zeros((2, p.dim), dtype=np.float32), np.zeros(2, dtype=np.float32)
    share = [(c / c.sum()).astype(np.float32) for c in counts]
    # Classes weigh the same however unequal their numbers.
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    steps, done = p.epochs * len(labels), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(labels)):
            hidden = share[i] @ vectors[ids[i]]
            logits = output @ hidden + bias
            e = np.exp(logits - logits.max())
            error = (e / e.sum()).astype(np.float32)
            error[labels[i]] -= 1
            rate = np.float32(p.rate * weight[i] * (1 - done / steps))
            back = error @ output
            output -= rate * np.outer(error, hidden)
            bias -= rate * error
            # Buckets are distinct within a document; a frequent one takes a step by its share of the largest.
            vectors[ids[i]] -= (rate * share[i] / share[i].max())[:, None] * back[None, :]
            done += 1
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> Model:
    """Fit to the rows of `docs` that `labels` (doc_id, quality) covers.

    Null ids, texts and labels are left out; of several labels of an id the
    lowest counts; a sampled id with several rows gives each of them.  Without
    labelled documents of both classes the model keeps everything.
    """
    p = params or Params()
    known = labels.select(labels["doc_id"].cast("long").alias("__doc"), labels["quality"].cast("int").alias("__label")).where("__doc is not null and __label in (0, 1)")
    known = known.groupBy("__doc").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64("__doc"), "__doc").limit(p.sample)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("__doc")).select("doc_id", "__label", "text")

    def extract(batches):
        for batch in batches:
            for part in tv.slices(batch, "text"):
                bucket, row = features(part.column("text"), p.buckets)
                keys, counts = np.unique(row.astype(np.int64) * p.buckets + bucket, return_counts=True)
                bounds = np.searchsorted(keys, np.arange(len(part) + 1, dtype=np.int64) * p.buckets).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (keys % p.buckets, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__label"), *lists], ["doc_id", "label", "ids", "counts"]).filter(pa.array(np.diff(bounds) > 0))

    # At most `sample` documents' features; sorted, so that the model doesn't depend on their order.
    got = mapped(rows, extract, "doc_id long, label int, ids array<int>, counts array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return Model(None, 0.0)
    size = pc.list_value_length(got.column("ids"))
    order = pc.sort_indices(pa.table({"d": got.column("doc_id"), "n": size}), sort_keys=[("d", "ascending"), ("n", "ascending")]).to_numpy()
    lists = [[c.combine_chunks().flatten().to_numpy(), np.concatenate(([0], np.cumsum(size.to_numpy())))] for c in (got.column("ids"), got.column("counts"))]
    ids, counts = ([flat[at[i] : at[i + 1]] for i in order] for flat, at in lists)
    return fit(ids, counts, got.column("label").to_numpy()[order], p)


def classify(docs: DataFrame, model: Model, threshold: float = Params.threshold) -> DataFrame:
    """(doc_id, p_good, keep) of every row of `docs` (doc_id, text).

    A null or empty text has p_good 0.5 and, having nothing to keep, is rejected.
    Null ids and repeated rows pass through; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for part in tv.slices(batch, "text"):
                texts = part.column("text")
                p = own.probability(texts)
                some = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= threshold) & some)], ["doc_id", "p_good", "keep"])

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, "doc_id long, p_good double, keep boolean")


def keep_good(docs: DataFrame, model: Model, threshold: float = Params.threshold) -> DataFrame:
    """The rows of `docs` that `classify` keeps, with all their columns; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    column = docs.columns.index("text")

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            # By position: other columns may have clashing names.
            names = [f"c{i}" for i in range(batch.num_columns)]
            plain = pa.RecordBatch.from_arrays(batch.columns, names)
            for part in tv.slices(plain, f"c{column}"):
                texts = part.column(column)
                some = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0
                kept = part.filter(pa.array((own.probability(texts) >= threshold) & some))
                yield pa.RecordBatch.from_arrays(kept.columns, batch.schema.names)

    return mapped(docs, run, docs.schema)
