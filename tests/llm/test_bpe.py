import base64

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import bpe, fertility

CONTENT = open(bpe.VOCABULARY, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}
WHOLE = tiktoken.Encoding("whole", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})

def encoded(texts):
    ids, offsets = bpe.codec(CONTENT).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]

HARD = ["", " ", "a", "\n\n  x", "it's we'll they're I'VE 'd", "naïve café x　  y", "日本語のテキスト、かな。", "🙂🙃x‍", "x" * 5000, "a  b   c\t\t\nd ", "%$#@!~ 123456789 abc123def", " q\u0085w e r", "<|endoftext|>", "re've're"]

def test_same_ids_as_whole_encoding():
    assert encoded(HARD) == [WHOLE.encode_ordinary(t) for t in HARD]

@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeiou'lvre  \n\t 　zqx09_-"))), max_size=6))
def test_any_text(texts):
    got = encoded(texts)
    assert got == [WHOLE.encode_ordinary(t) for t in texts]
    codec = bpe.codec(CONTENT)
    ids = np.array([i for g in got for i in g], dtype=np.int64)
    data, offsets = codec.decode(ids, np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int64))
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])] == texts

def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "doc_id as tokens", "text as n_bytes")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = bpe.encode_documents(docs).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    for r in rows:
        assert r["tokens"] == WHOLE.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["tokens"]) and r["n_bytes"] == len(texts[r["doc_id"]].encode())
    df = spark.createDataFrame([(1, None), (None, "abc"), (2, ""), (2, "")], "doc_id long, text string")
    got = sorted(map(tuple, bpe.encode_documents(df).collect()), key=str)
    assert got == sorted([(1, None, 0, 0, None), (None, encoded(["abc"])[0], 1, 3, True), (2, [], 0, 0, True), (2, [], 0, 0, True)], key=str)
    back = {(r["doc_id"], r["text"]) for r in bpe.decode_documents(bpe.encode_documents(df)).collect()}
    assert back == {(1, None), (None, "abc"), (2, "")}
    assert bpe.encode_documents(df.limit(0)).count() == 0

def test_fertility_measures(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    partial = {i for t, i in RANKS.items() if not bpe._whole(t)}
    for r in fertility.fertility(docs).collect():
        ids = WHOLE.encode_ordinary(texts[r["doc_id"]])
        count = np.array([ids.count(i) for i in set(ids)]) / len(ids)
        bits = -(count * np.log2(count)).sum()
        assert r["byte_en_tokens"] == len(ids) and r["byte_en_chars_per_token"] == pytest.approx(len(texts[r["doc_id"]]) / len(ids))
        assert r["byte_en_fallback"] == pytest.approx(sum(i in partial for i in ids) / len(ids))
        assert r["byte_en_entropy"] == pytest.approx(bits / min(np.log2(len(ids)), 10) if len(ids) > 1 else 1, abs=1e-9)

def test_fertility_verdicts(spark):
    clean = "The harbour committee met on Tuesday and discussed several plans for the new bridge across the river."
    rows = [(1, clean, "en", 0), (2, "zq" * 300, "en", 0), (3, "aaaa " * 200, "en", 0), (4, "", "en", 0), (5, None, None, 0), (None, clean, "xx", 0), (7, "Привет, как дела? Сегодня хорошая погода, и мы идём гулять в парк.", "ru", 0), (8, "ok", "en", 0), (1, clean, "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep int")
    got = {}
    for r in fertility.fertility(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    keep = {k: v[0]["keep"] for k, v in got.items()}
    assert keep == {1: True, 2: False, 3: False, 4: False, 5: False, None: True, 7: True, 8: True} and len(got[1]) == 2
    assert got[4][0]["reason"] == "empty" and got[3][0]["reason"] == "entropy" and got[7][0]["script"] == "Cyrillic" and got[1][0]["reason"] is None
    assert fertility.fertility(df.limit(0)).count() == 0
    pieces = fertility.fertility(df.limit(1), {"piece": "/opt/tokenizers/piece_bpe_32k.model"}).first()
    assert pieces["piece_tokens"] > 10 and pieces["piece_fallback"] == 0

def test_fertility_keeps_good_documents(spark):
    """At least 95 % of the documents labelled good are kept in each language."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))

    good = fertility.fertility(docs).join(labels, "doc_id").where("quality = 1").selectExpr("lang", "cast(keep as int) as k").groupBy("lang").avg("k").collect()
    assert len(good) == 4 and all(r[1] >= 0.95 for r in good), good
