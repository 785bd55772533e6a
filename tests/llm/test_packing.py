import collections
import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import bpe, packing


def optimum(sizes, capacity):
    """Fewest bins, by trying all assignments in order of size."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_best_fit(sizes):
    n = optimum(sizes, 20)
    array = np.array(sizes, dtype=np.int64)
    bins, offsets, opened = packing.best_fit_decreasing(array, 20)
    assert packing.lower_bound(array, 20) <= n <= opened
    for b in range(opened):
        spans = sorted((offsets[i], offsets[i] + sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert spans and spans[-1][1] <= 20 and all(x[1] == y[0] for x, y in itertools.pairwise(spans)) and spans[0][0] == 0


def test_best_fit_by_brute_force():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(100 - s)
    bins, _, opened = packing.best_fit_decreasing(np.array(sizes), 100)
    load = np.bincount(bins, weights=sizes, minlength=opened)
    assert opened == len(rooms) and sorted(100 - load) == sorted(rooms)


def check(rows, lengths, capacity):
    """Every token of every document lies in one place, and no sequence overflows."""
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start_token"], r["n_tokens"]))
        if r["n_tokens"]:
            bins[r["part"], r["bin"]].append((r["bin_offset"], r["n_tokens"]))
    want = collections.defaultdict(list)
    for d, n in lengths:
        want[d].append(max(n or 0, 0))
    for d, ns in want.items():
        spans = collections.Counter(pieces.pop(d))
        expected = collections.Counter()
        for n in ns:
            expected.update([(0, 0)] if not n else [(s, min(capacity, n - s)) for s in range(0, n, capacity)])
        assert spans == expected
    assert not pieces
    parts = collections.Counter(p for p, _ in bins)
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][0] + spans[-1][1] <= capacity and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(spans))
    for r in rows:
        if r["n_tokens"]:
            assert parts[r["part"]] == r["part_bins"] >= r["part_bound"] and r["certified"] == (r["part_bins"] == r["part_bound"])
    return bins


def test_hard_lengths(spark):
    rng = random.Random(2)
    lengths = [(k, rng.choice((1, 5, 30, 50, 51, 99, 100, 101, 250, 700))) for k in range(400)] + [(1, 30), (1, 30), (None, 70), (None, None), (500, 0), (501, None), (502, -3), (503, 100_000)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    one = check(packing.pack_lengths(df, 100, 1 << 20).collect(), lengths, 100)
    many = check(packing.pack_lengths(df, 100, 40).collect(), lengths, 100)
    lone = check(packing.pack_lengths(df, 100, 40, rounds=1).collect(), lengths, 100)
    assert len(one) <= len(many) <= len(lone)
    assert packing.pack_lengths(df.limit(0), 100).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as part", "2 as bin")
    n = [(r["doc_id"], r["n_tokens"]) for r in bpe.encode_documents(docs).collect()]
    rows = packing.pack_documents(docs).collect()
    bins = check(rows, n, packing.CAPACITY)
    items = np.array([k % packing.CAPACITY for _, k in n if k % packing.CAPACITY])
    _, _, opened = packing.best_fit_decreasing(items, packing.CAPACITY)
    assert len(bins) == opened + sum(k // packing.CAPACITY for _, k in n)


def test_files_and_order_change_nothing(spark, tmp_path):
    rng = random.Random(4)
    lengths = [(rng.randrange(300), rng.choice((1, 7, 30, 60, 130, 250))) for _ in range(1500)] + [(None, 40)] * 200 + [(5, 0), (None, None)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    rng.shuffle(lengths)
    spark.createDataFrame(lengths, "doc_id long, n_tokens long").repartition(7).write.parquet(str(tmp_path / "seven"))
    one, seven = (sorted(map(tuple, packing.pack_lengths(spark.read.parquet(str(tmp_path / t)), 100, 200).collect()), key=str) for t in ("one", "seven"))
    assert one == seven
    check(packing.pack_lengths(df, 100, 200).collect(), lengths, 100)
