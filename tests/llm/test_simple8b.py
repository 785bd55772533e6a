import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import bpe, simple8b


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(-(1 << 63), (1 << 63) - 1), st.just(0)), max_size=700), max_size=5), st.sampled_from([1, 7, 240, 1024]))
def test_round_trip(rows, block):
    values = np.array([v for r in rows for v in r], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    words, at, _ = simple8b.encode(values, offsets, block)
    start, end, _ = simple8b.blocks_of(offsets, block)
    assert np.array_equal(simple8b.decode(words, at, end - start), values)
    # Any block by itself.
    for k in range(len(start)):
        own = words[at[k] : at[k + 1]]
        assert np.array_equal(simple8b.decode(own, np.array([0, len(own)]), (end - start)[k : k + 1]), values[start[k] : end[k]])


TABLE = [(0, 240, 0), (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60)]


def scalar(values):
    """A block's words, one value after another: the selector of the most values that fit, a last word filled up with zeros."""
    words, at = [], 0
    while at < len(values):
        for selector, count, bits in TABLE:
            own = [v & ((1 << 64) - 1) for v in values[at : at + count]] + [0] * max(0, at + count - len(values))
            if all(v < 1 << bits for v in own):
                words.append(selector << 60 | sum(v << (bits * k) for k, v in enumerate(own)))
                at += count
                break
        else:
            words += [1 << 60, values[at] & ((1 << 64) - 1)]
            at += 1
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 1 << 61), st.integers(-(1 << 63), (1 << 63) - 1), st.just(0)), max_size=300), max_size=4), st.sampled_from([1, 7, 64, 1024]))
def test_words_against_a_scalar_coder(rows, block):
    values = np.array([v for r in rows for v in r], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    words, at, _ = simple8b.encode(values, offsets, block)
    want = [scalar(r[k : k + block]) for r in rows for k in range(0, len(r), block)]
    assert [words[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_long_text_and_clashing_columns(spark):
    text = "".join(f"harbour {k} masts; " for k in range(60_000))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").selectExpr("*", "'x' as payload", "1 as n_tokens", "2 as tokens")
    back = {r["doc_id"]: r["tokens"] for r in simple8b.unpack_documents(simple8b.pack_documents(df)).collect()}
    assert back == {r["doc_id"]: r["tokens"] for r in bpe.encode_documents(df).collect()} and len(back[1]) > 200_000


def test_selectors_pack_densely():
    words, *_ = simple8b.encode(np.zeros(240, dtype=np.int64), np.array([0, 240]))
    assert len(words) == 1
    words, *_ = simple8b.encode(np.full(60, 30000, dtype=np.int64), np.array([0, 60]))
    assert len(words) == 15  # four of 15 bits each
    words, *_ = simple8b.encode(np.array([1 << 62]), np.array([0, 1]))
    assert len(words) == 2 and int(words[0]) >> 60 == 1


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = simple8b.pack_documents(docs)
    want = {r["doc_id"]: r["tokens"] for r in bpe.encode_documents(docs).collect()}
    assert {r["doc_id"]: r["tokens"] for r in simple8b.unpack_documents(packed).collect()} == want
    for r in packed.collect():
        assert len(r["payload"]) == 8 * r["n_words"] and len(r["block_offsets"]) == -(-r["n_tokens"] // simple8b.BLOCK)
    hard = spark.createDataFrame([(1, None), (2, ""), (None, "abc abc"), (2, "")], "doc_id long, text string")
    back = sorted(map(tuple, simple8b.unpack_documents(simple8b.pack_documents(hard)).collect()), key=str)
    assert [t for _, t in back if t is None] == [None] and [t for d, t in back if d == 2] == [[], []]
    ids = spark.createDataFrame([(1, [5, None, -1, 1 << 61]), (2, None)], "doc_id long, tokens array<long>")
    assert {r["doc_id"]: r["tokens"] for r in simple8b.unpack_documents(simple8b.pack_ids(ids)).collect()} == {1: [5, 0, -1, 1 << 61], 2: None}
    assert simple8b.pack_documents(hard.limit(0)).count() == 0
