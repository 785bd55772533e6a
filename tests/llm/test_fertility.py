"""Every measure and verdict of every registered vocabulary against the libraries' own encoders, document by document."""

import base64
import collections
import math

import sentencepiece
import tiktoken

from latticework.llm import bpe, fertility


def encoders():
    found = {}
    for name, path in fertility.VOCABULARIES.items():
        if path.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            found[name] = model.encode, model.is_byte
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
            whole = {r: _whole(t) for t, r in ranks.items()}
            found[name] = encoding.encode_ordinary, lambda i, whole=whole: not whole[i]
    return found


def _whole(token):
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


REASONS = ["few characters a token", "many characters a token", "byte fallback", "entropy"]


def brute(text, lang, script, found, bands):
    out, best = {}, None
    for name, (encode, partial) in found.items():
        ids = encode(text or "")
        n = len(ids)
        counts = collections.Counter(ids).values()
        bits = sum(c / n * math.log2(n / c) for c in counts) if n else 0
        spread = min(n, 1) if n < 2 else bits / min(math.log2(n), 10)
        out |= {f"{name}_tokens": n, f"{name}_chars_per_token": len(text or "") / max(n, 1), f"{name}_fallback": sum(map(partial, ids)) / max(n, 1), f"{name}_entropy": spread}
        if best is None or n < best[0]:
            band = bands.short if n < bands.least else bands.of(lang, script)
            per = len(text or "") / max(n, 1)
            failed = [per < band.low, per > band.high, out[f"{name}_fallback"] > band.fallback, spread < band.entropy - 1e-12]
            best = n, next((r for r, f in zip(REASONS, failed) if f), None)
    return out | {"reason": best[1] if text else "empty", "keep": bool(text) and best[1] is None}


def held(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as script", "1 as keep", "2 as byte_en_tokens")
    found, bands = encoders(), fertility.Bands()
    got = fertility.fertility(df).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["lang"]): r for r in got}
    for d, t, lang in rows:
        r = by[d, lang]
        want = brute(t, lang, r["script"], found, bands)
        for k, v in want.items():
            assert r[k] == v if not isinstance(v, float) else abs(r[k] - v) < 1e-9, (d, k, r[k], v)
    return by


def test_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held(spark, list({r[0]: r for r in rows}.values()))


def test_hard_rows(spark):
    long = "Every harbour has its own weather, and sailors learn to read it. " * 12000
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " ", "en"), (4, "a", None), (5, "ok then", "e\0n"), (6, "word " * 400, "en"), (7, "日本語の文章です。" * 40, "ja"), (8, "日" * 15, "zh"),
        (9, "કા" * 50, "gu"), (10, long, "en"), (11, "x" * 60_000, "xx"), (12, "🙂🙃" * 30, "en"), (None, "The ships came in at dawn, and nobody on the quay had expected them so early.", "en"), (13, "\n\n\n", "en"), (14, "\x00\x01", "en"),
    ]
    by = held(spark, rows)
    assert not by[6, "en"]["keep"] and by[6, "en"]["reason"] == "entropy" and by[None, "en"]["keep"] and by[4, None]["keep"]
    assert by[1, "en"]["reason"] == by[2, "en"]["reason"] == "empty" and by[9, "gu"]["piece_fallback"] > 0.7
    df = spark.createDataFrame([(1, "same text", "en")] * 3, "doc_id long, text string, lang string")
    assert len({tuple(r) for r in fertility.fertility(df).collect()}) == 1 and fertility.fertility(df).count() == 3
    assert fertility.fertility(df.limit(0)).count() == 0


def test_good_documents_stay(spark):
    """Of the labelled documents of sf0.01 nearly all good ones are kept in each language, and part of the others goes."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = fertility.fertility(docs).join(labels, "doc_id").selectExpr("lang", "quality", "cast(keep as int) as k").groupBy("lang", "quality").avg("k").collect()
    share = {(r["lang"], r["quality"]): r[2] for r in rows}
    assert all(v >= 0.99 for (_, q), v in share.items() if q == 1)
    assert sum(v for (_, q), v in share.items() if q == 0) / 4 <= 0.7
