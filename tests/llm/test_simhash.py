import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from latticework.llm import simhash


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(x) for x in range(n)]


def close_pairs(hi, lo, radius):
    hi, lo = hi.astype(np.uint64), lo.astype(np.uint64)
    return [(i, i + 1 + int(j)) for i in range(len(hi)) for j in np.flatnonzero(np.bitwise_count(hi[i] ^ hi[i + 1 :]).astype(int) + np.bitwise_count(lo[i] ^ lo[i + 1 :]) <= radius)]


def expected(rows, radius=simhash.RADIUS):
    """Groups of (doc_id, text) rows by comparing all fingerprints: {(least id, number of documents, ids)}."""
    rows = [r for r in dict.fromkeys(rows) if r[1] is not None]
    hi, lo, n = simhash.hash_texts(pa.array([t for _, t in rows], pa.string()))
    rows = [r for r, k in zip(rows, n) if k]
    hi, lo = hi[n > 0], lo[n > 0]
    by = collections.defaultdict(list)
    for (d, _), c in zip(rows, components(len(rows), close_pairs(hi, lo, radius))):
        by[c].append(d)
    out = []
    for ids in by.values():
        known = sorted({d for d in ids if d is not None})
        out.append((known[0] if known else None, len(ids), known))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_docs"], r["members"]) for r in simhash.near_duplicates(df).collect()), key=str)


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs) == expected(rows)
    # Documents that share most of their three-word runs are together.
    runs = {d: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for d, t in rows for w in [t.lower().split()]}
    of = {d: r["doc_id"] for r in simhash.near_duplicates(docs).collect() for d in r["members"]}
    ids = sorted(of)
    like = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(runs[a] & runs[b]) >= 0.6 * len(runs[a] | runs[b]) > 0]
    assert len(like) > 10 and np.mean([of[a] == of[b] for a, b in like]) >= 0.9


@pytest.mark.parametrize("large", [1, 1000])
def test_clusters_against_all_pairs(spark, monkeypatch, large):
    """Clusters of fingerprints whose members are partly out of one another's reach, with few and many in a group."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(128)
        for _ in range(rng.choice((1, 4, 30))):
            flip = sum(1 << b for b in rng.sample(range(128), rng.randrange(0, 13)))
            prints.add(centre ^ flip)
    prints = sorted(prints)
    hi, lo = (np.array([(p >> s) & ((1 << 64) - 1) for p in prints], dtype=np.uint64) for s in (64, 0))
    df = spark.createDataFrame([(int(h), int(x)) for h, x in zip(hi.view(np.int64), lo.view(np.int64))], "hi long, lo long")
    node = {r["node"]: (r["hi"], r["lo"]) for r in df.select(simhash._node().alias("node"), "hi", "lo").collect()}
    place = {(int(h), int(x)): k for k, (h, x) in enumerate(zip(hi.view(np.int64), lo.view(np.int64)))}
    got = collections.defaultdict(set)
    for r in simhash.linked(df).collect():
        got[r["component"]].add(place[node[r["node"]]])
    want = collections.defaultdict(set)
    for k, c in enumerate(components(len(prints), close_pairs(hi, lo, simhash.RADIUS))):
        want[c].add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


TEXT = " ".join(f"{a}{b}ing {b}{a}er" for a in ("grand", "mellow", "tin") for b in ("port", "lake", "rush"))


def test_hard_rows(spark):
    rows = [(5, TEXT), (3, TEXT), (3, TEXT), (None, TEXT + " more"), (None, "something else entirely different"), (7, ""), (8, None), (9, "... !!!"), (4, TEXT.upper()), (6, TEXT.replace("tin", "tins") * 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == expected(rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect()), key=str)
    assert sorted((d for d, t in kept if t and t.strip(".! ")), key=str) == sorted((r[0] for r in expected(rows)), key=str)
    assert sorted((x for x in kept if not x[1] or not x[1].strip(".! ")), key=str) == [(7, ""), (8, None), (9, "... !!!")]
    extra = df.selectExpr("doc_id as node", "doc_id", "text", "1 as hi", "2 as label", "3 as keep")
    assert simhash.drop_near_duplicates(extra).columns == extra.columns
    empty = df.limit(0)
    assert found(empty) == [] and simhash.drop_near_duplicates(empty).count() == 0


def test_long_text(spark):
    long = " ".join(f"word{k % 9000}" for k in range(40000))
    rows = [(1, long), (2, long + " tail"), (3, TEXT)]
    assert [r[2] for r in found(spark.createDataFrame(rows, "doc_id long, text string"))] == [[1, 2], [3]]


def test_repeats_of_what_stays_are_kept_once(spark):
    """A shard read twice: each row with words comes out once, with all columns; rows without words are left alone."""
    rows = [(3, TEXT, 1), (4, TEXT.upper(), 1), (None, "something else entirely different", 1), (7, "", 1), (8, None, 1), (5, "quite another text about harbours", 1)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, simhash.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[5], *[rows[3], rows[4]] * 2], key=str)


def test_near_copies_without_spaces(spark):
    """A changed character in texts of 120 Chinese characters: together, and apart from other texts."""
    rng = random.Random(8)
    signs = [chr(c) for c in range(0x4E00, 0x5A00)]
    rows, pairs = [], []
    for k in range(60):
        a = [*(rng.choice(signs) for _ in range(120))]
        for p in (30, 61, 90):
            a[p] = "，"
        b = list(a)
        b[rng.randrange(120)] = rng.choice(signs)
        rows += [(2 * k, "".join(a) + "。"), (2 * k + 1, "".join(b) + "。")]
        pairs.append((2 * k, 2 * k + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(df)
    assert got == expected(rows)
    of = {d: first for first, _, members in got for d in members}
    assert sum(of[a] == of[b] for a, b in pairs) >= 57 and len(got) >= 60
