import hashlib
import re

import duckdb
import pytest

from latticework.llm import secretscan as ss

KEY = "AKIA" + "ABCDEFGH12345678"
TOKEN = "ghp_" + "a1B2" * 9


def brute(rows):
    out = set()
    for d, t in set(rows):
        for rule in ss.RULES if t is not None else ():
            hits = [m.group(0) for m in re.finditer(rule.pattern, t, re.ASCII)]
            out |= {(d, rule.key, hashlib.sha256(h.encode()).hexdigest(), hits.count(h), hashlib.sha256(t.encode()).hexdigest()) for h in hits}
    return out


def test_documents_and_hard_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    hard = [(1, f"key {KEY} and {KEY}"), (1, f"key {KEY} and {KEY}"), (None, f"x {TOKEN}"), (2, None), (3, ""), (4, "y" * 300_000 + " password=abcdefgh1 "), (5, "https://u:secret@host/x"), (6, "-----BEGIN RSA PRIVATE KEY-----"), (7, "token: short")]
    for data in (rows, hard):
        df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as blob", "text as path")
        got = [(r["doc_id"], r["rule"], r["secret_sha256"], r["n_hits"], r["blob"]) for r in ss.scan_documents(df).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(data) and got
    assert ss.scan_documents(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert {tuple(r) for r in con.execute(f"select doc_id, rule, secret_sha256, n_hits, blob from ({ss.oracle_sql()})").fetchall()} == brute(rows)


def test_ledger_is_incremental(spark, tmp_path):
    versions = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    ledger = ss.Ledger(spark, str(tmp_path / "ledger"))
    n = len(ss.RULES)
    assert ledger.scan(versions(("a", f"v1 {KEY}"), ("b", f"v1 {KEY}"), ("c", "clean"))) == 2 * n
    assert ledger.scan(versions(("d", f"v1 {KEY}"), ("c", "clean"))) == 0
    assert ledger.scan(versions(("a", f"v2 {TOKEN}"))) == n
    found = {(r["path"], r["rule"], r["secret"]) for r in ledger.by_path().collect()}
    assert found == {(p, "aws_access_key@1", KEY) for p in "abd"} | {("a", "github_token@1", TOKEN)}
    # A new version of a rule is scanned over all of history, whatever comes in; the old one's findings stay apart.
    newer = (ss.Rule("aws_access_key", 2, r"\bAKIA[0-9A-Z]{16}\b", ("akia",)),)
    assert ledger.scan(versions(("e", "clean too")), newer) == 4
    assert {(r["path"], r["rule"]) for r in ledger.by_path(newer).collect()} == {(p, "aws_access_key@2") for p in "abd"}
    assert ledger.scan(versions(), newer) == 0
    assert {r["rule"] for r in ledger.by_path().collect()} == {"aws_access_key@1", "github_token@1"}
    # The rules that the last version hasn't been scanned under are still open.
    assert ledger.scan(versions()) == n
    # A text is kept where its blob was new.
    assert ledger.stored.where("text is not null").select("blob").distinct().count() == 4


def test_a_scan_that_was_cut_off(spark, tmp_path):
    """Between any two of a scan's writes: the next scan takes what is open, findings count once."""
    import shutil

    rows = spark.createDataFrame([("a", f"x {KEY} {KEY}"), ("b", "clean"), ("c", f"y {TOKEN}")], "path string, text string")
    want = {("a", "aws_access_key@1", KEY, 2), ("c", "github_token@1", TOKEN, 1)}
    for lost in (("scanned",), ("scanned", "findings")):
        where = tmp_path / f"ledger{len(lost)}"
        ledger = ss.Ledger(spark, str(where))
        ledger.scan(rows)
        for table in lost:
            shutil.rmtree(where / table)
        assert ledger.scan(rows) == 3 * len(ss.RULES)
        got = [(r["path"], r["rule"], r["secret"], r["n_hits"]) for r in ledger.by_path().collect()]
        assert sorted(got) == sorted(want)
        assert ledger.scan(rows) == 0


@pytest.mark.parametrize("most", [100_000, 30, 5])
def test_increments_give_the_same(spark, monkeypatch, most):
    """Also where known, new or open blobs are too many to be sent to every executor."""
    monkeypatch.setattr(ss, "_MOST", most)
    rows = [(i, f"n{i} {KEY if i % 3 == 0 else ''} DB_PASSWORD={'abcd1234' if i % 4 == 0 else ''}") for i in range(40)] + [(7, None), (None, f"z {KEY}"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    earlier = tuple(r for r in ss.RULES if r.version == 1)
    got = {tuple(r) for r in ss.scan_documents(df, increments=(earlier, ())).select("doc_id", "rule", "secret_sha256", "n_hits", "blob").collect()}
    assert got == brute(rows) and len(got) > 20


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"a {KEY} b", 5, "x"), (2, "clean", 5, "y"), (3, None, None, "z"), (1, f"a {KEY} b", 5, "x"), (None, TOKEN, 5, "w")], "doc_id long, text string, n_chars long, rule string")
    out = ss.redact_documents(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a [SECRET] b", 12, "x")] * 2 + [(2, "clean", 5, "y"), (3, None, None, "z"), (None, "[SECRET]", 8, "w")], key=str)
    assert ss.redact_documents(df.limit(0)).count() == 0


BODY = "\n".join(["MIIEowIBAAKCAQEA" + "x9/+" * 12] * 12 + ["q2Zk0w=="])


def test_private_keys_go_with_their_body(spark):
    """Header, body and END line are one secret, in every form that a key comes in; the text around it stays."""
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    keys = [
        f"{begin}\n{BODY}\n{end}",
        f"{begin}\n{fields}{BODY}\n{end}",
        f"{begin}\n{BODY}\n{end}".replace("\n", "\\n"),
        f"{begin}\n{BODY}\n{end}".replace("\n", "\n-"),
        f"{begin}\n{BODY}",
        f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x\n\n{BODY}\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----",
        f"{begin}\n" + "A1b2" * 100_000 + f"\n{end}",
    ]
    rows = [(i, f"before it\n{k}\n\nafter-wards, more.") for i, k in enumerate(keys)] + [(90, f"The line {begin} opens a key - so it is."), (91, f"{keys[0]} and - {keys[0]}!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in ss.redact_documents(df).collect()}
    assert {i: clean[i] for i in range(len(keys))} == {i: "before it\n[SECRET]\n\nafter-wards, more." for i in range(len(keys))}
    assert clean[90] == "The line [SECRET] opens a key - so it is." and clean[91] == "[SECRET] and - [SECRET]!"
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = {tuple(r) for r in ss.scan_documents(df).select("doc_id", "rule", "secret_sha256", "n_hits", "blob").collect()}
    assert got == brute(rows) == {tuple(r) for r in con.execute(f"select doc_id, rule, secret_sha256, n_hits, blob from ({ss.oracle_sql()})").fetchall()}


def test_assignments_of_environments_and_json(spark):
    value = "a1B2c3D4e5F6g7H8"
    forms = [f"DB_PASSWORD={value}", f"AWS_SECRET_ACCESS_KEY={value}", f"auth_token={value}", f"client_secret: {value}", f'"api_key": "{value}"', f'\\"dbPassword\\": \\"{value}\\"']
    df = spark.createDataFrame([(i, f"x {f} y") for i, f in enumerate(forms)] + [(99, f"tokens {value} password {value}")], "doc_id long, text string")
    assert {r["doc_id"] for r in ss.scan_documents(df).collect()} == set(range(len(forms)))
    clean = {r["doc_id"]: r["text"] for r in ss.redact_documents(df).collect()}
    assert not any(value in clean[i] for i in range(len(forms)))
