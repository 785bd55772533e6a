"""Every registered query of the graph engine against its SQL in DuckDB."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from latticework.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    found = con.execute(sql)
    return table([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        assert got == duck(sf_dir, ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def documents(spark, folder, rows):
    """A folder with a table of documents (doc_id, text)."""
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/parts")
    next(Path(folder, "parts").glob("*.parquet")).rename(Path(folder, "documents.parquet"))
    return str(folder)


def test_snippets_of_odd_texts(spark, tmp_path):
    texts = ["", "  \n ", "abc \u2028", "abc \u0085", "a \r\u2029", "\x0babc", "abc\x0b ", " \x0b\nabc", "plain\nlines\n"]
    test_query(spark, documents(spark, tmp_path, enumerate(texts)), "snippets")


def test_hybrid_of_equal_similarities(spark, tmp_path):
    test_query(spark, documents(spark, tmp_path, ((i, " ".join(["released license tion", *("x" * k for k in range(2, 2 + (i - 101) % 200))])) for i in range(200))), "hybrid_half")
