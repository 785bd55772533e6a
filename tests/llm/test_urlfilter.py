import re

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import textvec as tv
from latticework.llm import urlfilter as uf


def regex(glob):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), re.S)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab*?é/", max_size=12), min_size=1, max_size=20), st.lists(st.text("abé/c日", max_size=14), max_size=8))
def test_automaton_is_every_glob_at_once(globs, urls):
    data, offsets = tv.buffers(pa.array(urls, pa.string()))
    got = uf.Automaton(globs).match(data, offsets)
    want = np.array([[bool(regex(g).fullmatch(u)) for g in globs] for u in urls], dtype=bool).reshape(len(urls), len(globs))
    assert np.array_equal(got, want)


def test_pages(spark, sf_dir):
    got = {(r["page_id"], r["url"], r["canonical_url"], r["rules"], r["keep"]) for r in uf.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert got == {tuple(r) for r in con.execute(f"select page_id, url, canonical_url, rules, keep from ({uf.oracle_sql()})").fetchall()} and got
    for _, _, url, rules, keep in got:
        hits = [r for r in uf.RULES if regex(r.glob).fullmatch(url)]
        assert rules == ",".join(r.name for r in hits) and keep == (not any(r.block for r in hits))


def test_hard_rows(spark):
    long = "http://a.example/" + "x" * 200_000 + "/free-download"
    rows = [(1, "HTTP://User@WWW.Example.COM:80/a/b/?utm_source=x&b=2&a=1#frag"), (1, "HTTP://User@WWW.Example.COM:80/a/b/?utm_source=x&b=2&a=1#frag"), (2, None), (None, ""), (3, long), (4, "not a url #x"), (5, "ftp://casino.example"), (6, "https://x.example/login?next=/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as keep", "'x' as canonical_url")
    out = [(r["page_id"], r["canonical_url"], r["rules"], r["keep"]) for r in uf.filter_urls(df).collect()]
    assert out.count((1, "https://example.com/a/b?a=1&b=2", "", True)) == 2
    by = {r[0]: r[1:] for r in out}
    assert by[2] == (None, "", True) and by[None] == ("", "", True) and by[3][1:] == ("free_download", False) and by[4] == ("not a url ", "", True) and not by[5][2] and not by[6][2]
    assert uf.filter_urls(df.limit(0)).count() == 0
