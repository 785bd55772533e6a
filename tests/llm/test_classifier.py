import numpy as np
import pyarrow as pa

from latticework.llm import classifier


def test_held_out_accuracy(spark):
    """Trained on the even labelled documents of sf0.1, judged on the odd ones."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.train(docs, labels.where("doc_id % 2 = 0"))
    rows = classifier.classify(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").select("keep", "quality").collect()
    good = np.mean([r["keep"] for r in rows if r["quality"] == 1])
    bad = np.mean([not r["keep"] for r in rows if r["quality"] == 0])
    assert len(rows) > 1000 and good >= 0.97 and bad >= 0.9, (good, bad)


def test_hard_rows(spark):
    good, bad = "the committee met and discussed the harbour plans at length", "WIN $$$ click here now !!! free $$$ click click"
    docs = spark.createDataFrame([(k, good + f" {k}" if k % 2 else bad + f" {k}", "x") for k in range(40)] + [(100, None, "x"), (101, "", "x"), (None, good, "x"), (1, good + " 1", "x"), (102, good * 3000, "x")], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (5, None), (5, 1), (999, 0)], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    rows = classifier.classify(docs, model).collect()
    assert len(rows) == docs.count()
    keep = {r["doc_id"]: r["keep"] for r in rows}
    assert not keep[100] and not keep[101] and keep[None] and keep[102] and [keep[k] for k in range(40)] == [bool(k % 2) for k in range(40)]
    kept = classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted([-1, 1, 102, *range(1, 40, 2)])
    assert classifier.classify(docs.limit(0), model).count() == 0 and classifier.keep_good(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(9, 0), (8, 1)]):
        model = classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["doc_id"]: r["keep"] for r in classifier.classify(docs, model).collect()} == {1: True, 2: False}


def test_features_by_brute_force():
    texts = ["ab cde  fghij", "", None, "é\nxyz"]
    bucket, row = classifier.features(pa.array(texts), 1 << 16)
    for k, t in enumerate(texts):
        words = (t or "").split()
        flat = " ".join((t or "").split("\n")).encode()
        grams = sum(1 for n in (3, 4) for i in range(len(flat) - n + 1) if b" " not in flat[i + 1 : i + n - 1])
        assert (row == k).sum() == len(words) + max(len(words) - 1, 0) + grams
    assert bucket.max() < 1 << 16


def test_training_and_scores_by_brute_force():
    """Plain stochastic gradient descent over dense vectors, and every document's softmax from its averaged vector."""
    p = classifier.Params(buckets=64, dim=4, epochs=3)
    rng = np.random.default_rng(3)
    docs = [np.unique(rng.integers(0, 64, 12)) for _ in range(30)]
    counts = [rng.integers(1, 4, len(d)) for d in docs]
    labels = rng.integers(0, 2, 30)
    model = classifier.fit(docs, counts, labels, p)
    again = np.random.default_rng(p.seed)
    vectors = ((again.random((64, 4), dtype=np.float32) - 0.5) / 4).astype(np.float64)
    out, bias, done = np.zeros((2, 4)), np.zeros(2), 0
    weight = [0.5 / (labels == y).mean() for y in (0, 1)]
    for _ in range(p.epochs):
        for i in again.permutation(30):
            share = counts[i] / counts[i].sum()
            hidden = sum(s * vectors[b] for s, b in zip(share, docs[i]))
            logits = [out[c] @ hidden + bias[c] for c in (0, 1)]
            e = np.exp(np.array(logits) - max(logits))
            error = e / e.sum() - np.eye(2)[labels[i]]
            rate = p.rate * weight[labels[i]] * (1 - done / (p.epochs * 30))
            back = error @ out
            for c in (0, 1):
                out[c] -= rate * error[c] * hidden
                bias[c] -= rate * error[c]
            for s, b in zip(share, docs[i]):
                vectors[b] -= rate * s / share.max() * back
            done += 1
    assert np.allclose(model.weights, vectors @ (out[1] - out[0]), atol=1e-4) and abs(model.bias - (bias[1] - bias[0])) < 1e-4
    texts = ["some words here", "here words some some", "", None, "x"]
    model = classifier.Model(np.random.default_rng(1).standard_normal(1 << 10).astype(np.float32), 0.3)
    got = model.probability(pa.array(texts))
    for k, t in enumerate(texts):
        bucket, _ = classifier.features(pa.array([t], pa.string()), 1 << 10)
        logit = np.mean(model.weights[bucket].astype(float)) + 0.3 if len(bucket) else 0
        assert abs(got[k] - 1 / (1 + np.exp(-logit))) < 1e-6


def test_ties_at_the_threshold(spark):
    """A document whose probability is the threshold itself is kept; slices and batches change nothing."""
    docs = spark.createDataFrame([(1, "one"), (2, "two two"), (2, "two two"), (3, "")], "doc_id long, text string")
    nothing = classifier.Model(None, 0.0)
    assert sorted((r["doc_id"], r["keep"]) for r in classifier.classify(docs, nothing, 0.5).collect()) == [(1, True), (2, True), (2, True), (3, False)]
    model = classifier.Model(np.ones(1 << 10, np.float32), 0.0)
    p = classifier.classify(docs, model).where("doc_id = 1").first()["p_good"]
    assert classifier.classify(docs, model, p).where("doc_id = 1").first()["keep"]
    assert not classifier.classify(docs, model, np.nextafter(p, 1)).where("doc_id = 1").first()["keep"]
