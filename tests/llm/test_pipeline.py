import random
import re
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from latticework.llm import bpe, classifier, linededup, packing, secretscan, simhash  # noqa: E402


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, sf_dir):
    """Each stage against what its operator decides about the stage's own input, applied row by row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "simhash near-dedup", "secret scan", "best-fit packing"]
    stage = dict(corpus_pipeline.STAGES)
    columns, before = docs.columns, texts(docs)

    quality = stage[names[0]](spark, docs, sf_dir).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keep = {r["doc_id"] for r in classifier.classify(docs, classifier.train(docs, labels)).collect() if r["keep"]}
    kept = texts(quality)
    assert quality.columns == columns and kept == {d: t for d, t in before.items() if d in keep} and 0 < len(kept) < len(before)

    lines = stage[names[1]](spark, quality, sf_dir).cache()
    gone = {(r["doc_id"], r["line_no"]) for r in linededup.line_groups(quality).collect() if not r["keep"]}
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in kept.items()}
    want = {d: t for d, t in want.items() if t.strip() or t == kept[d]}
    cut = texts(lines)
    assert lines.columns == columns and cut == want and gone
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = stage[names[2]](spark, lines, sf_dir).cache()
    stays = {r["doc_id"] for r in simhash.near_duplicates(lines).collect()}
    assert near.columns == columns and texts(near) == {d: t for d, t in cut.items() if d in stays or not re.search(r"\w", t)}

    clean = stage[names[3]](spark, near, sf_dir).cache()

    def masked(t):
        for rule in secretscan.RULES:
            t = re.sub(rule.pattern, secretscan.MASK, t, flags=re.ASCII)
        return t

    assert clean.columns == columns and texts(clean) == {d: masked(t) for d, t in texts(near).items()}

    packed = stage[names[4]](spark, clean, sf_dir)
    tokens = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(clean).collect()}
    got = {}
    for r in packed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
        assert r["n_tokens"] <= packing.CAPACITY
    assert got == tokens
    # The whole run gives the same documents and tokens.
    ran = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        ran[r["doc_id"]] = ran.get(r["doc_id"], 0) + r["n_tokens"]
    assert ran == tokens


WORDS = [f"{a}{b}" for a in ("cal", "mor", "ven", "tis", "pel", "dra", "ho", "ru") for b in ("den", "lia", "mark", "ton", "ge", "sting", "wen", "bury")]


def good(k):
    """Two lines of words that no other document has in this order."""
    rng = random.Random(k)
    return "\n".join(" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)) for n in (20, 40))


BAD = "WIN $$$ click {k} now !!! free $$$ click click $$$ buy {k} !!!"
TOKEN = "ghp_" + "a1B2" * 9


def hard_documents(spark):
    copy = good(3)
    rows = [(k, good(k) if k % 2 else BAD.format(k=k), "en", "s", 7) for k in range(60)]
    rows += [(100, None, "en", "s", None), (101, "", None, None, 0), (None, good(200), None, "s", None), (3, copy, "en", "s", 7), (102, copy + " indeed", "en", "s", 1), (103, good(300) + f"\ntoken {TOKEN}", "en", None, 5), (104, "\n".join(good(k) for k in range(1000, 2000)), "en", "s", 1), (105, good(301) + "\n" + good(5).split("\n")[1], "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as k_doc", "'x' as blob", "2 as part", "3 as node", "4 as label", "true as keep", "'y' as open", "5 as __doc", "6 as __gone", "7 as __bad")


def test_hard_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, near and exact copies, clashing columns: through every stage."""
    docs = hard_documents(spark)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (5, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        kept.append(sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str))
    ids = lambda rows: sorted((d for d, _ in rows), key=str)
    odd = list(range(1, 60, 2))
    assert ids(kept[0]) == sorted([*odd, 3, 102, 103, 104, 105, None], key=str)
    # The lines of document 3 go from its near copy; of document 5 from the document that repeats its last line.
    lines = dict(kept[1])
    assert ids(kept[1]).count(3) == 2 and 102 not in lines and lines[105] == good(301)
    assert all(lines[k] == good(k) for k in odd) and lines[None] == good(200)
    # Repeated rows once.
    assert ids(kept[2]) == sorted([*odd, 103, 104, 105, None], key=str)
    secrets = dict(kept[3])
    assert ids(kept[3]) == ids(kept[2]) and secrets[103] == good(300) + "\ntoken [SECRET]" and all(secrets[d] == t for d, t in kept[2] if d != 103)
    packed = stages["best-fit packing"](spark, now, folder).collect()
    tokens = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(now).collect()}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == tokens and got[104] > packing.CAPACITY


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    hard_documents(spark).limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_registered():
    import __spark_entry__ as e

    found = e.queries()
    assert "pipeline" in found and {int(n[2:].split("_")[0]) for n in found if n.startswith("op")} == set(range(1, 11))
    source = "".join(p.read_text() for p in Path(corpus_pipeline.__file__).parent.joinpath("latticework/llm").glob("*.py"))
    assert "localCheckpoint" not in source
