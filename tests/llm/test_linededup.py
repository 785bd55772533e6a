import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex

from latticework.llm import editdistance, linededup


def norm(line):
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line.lower().translate(str.maketrans("123456789", "0" * 9))).strip()


def long_enough(n):
    return len(n) >= linededup.MIN_CHARS


def similar_pairs(lines):
    """Every pair with an edit similarity of at least SIMILARITY: letter counts rule out most, the distance decides."""
    lines = sorted(lines, key=len)
    size = np.array([len(x) for x in lines])
    counts = np.zeros((len(lines), 40), np.int32)
    for i, x in enumerate(lines):
        for c in x:
            counts[i, ord(c) % 40] += 1
    found = []
    for i in range(len(lines)):
        end = np.searchsorted(size, size[i] / linededup.SIMILARITY + 1e-9, side="right")
        apart = np.abs(counts[i + 1 : end] - counts[i]).sum(1)
        found += [(lines[i], lines[j + i + 1]) for j in np.flatnonzero(apart <= 2 * (1 - linededup.SIMILARITY) * size[i + 1 : end] + 1e-6)]
    table = pd.DataFrame(found, columns=["a", "b"])  # noqa: F841
    return duckdb.sql(f"select a, b from table where levenshtein(a, b) <= greatest(length(a), length(b)) * {1 - linededup.SIMILARITY} + 1e-9".replace("from table", 'from "table"')).fetchall()


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def decisions(spark, rows):
    return {(r["doc_id"], r["line_no"]): r for r in linededup.line_groups(docs_of(spark, rows)).collect()}


def test_recall_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lines = {norm(x) for t in texts.values() for x in t.split("\n")}
    pairs = similar_pairs([x for x in lines if long_enough(x)])
    rows = linededup.line_groups(docs).collect()
    group = {norm(texts[r["doc_id"]].split("\n")[r["line_no"]]): (r["kept_doc_id"], r["kept_line_no"]) for r in rows}
    together = [a in group and group[a] == group.get(b) for a, b in pairs]
    assert len(pairs) > 10
    assert np.mean(together) >= 0.9
    # Groups are the components of similar pairs and equal lines, nothing more.
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    for kept in set(group.values()):
        assert len({find(x) for x, k in group.items() if k == kept}) == 1
    # Every exact repeat is there, one occurrence of each group is kept.
    held = {(r["doc_id"], r["line_no"]) for r in rows}
    seen = {}
    for d, t in texts.items():
        for k, x in enumerate(t.split("\n")):
            if norm(x):
                seen.setdefault(norm(x), []).append((d, k))
    assert all(p in held for places in seen.values() if len(places) > 1 for p in places)
    assert all((r["doc_id"], r["line_no"]) == (r["kept_doc_id"], r["kept_line_no"]) for r in rows if r["keep"])
    assert sum(r["keep"] for r in rows) == len(set(group.values()))


LINE = "the committee discussed several proposals concerning harbour improvements yesterday evening"


def test_ties_nulls_and_repeats(spark):
    other = LINE.replace("several", "seveeral")
    rows = [(3, LINE), (2, other + "\nshort line"), (2, other + "\nshort line"), (None, LINE), (9, None), (10, ""), (11, "a\n" + LINE.upper() + "!")]
    found = decisions(spark, rows)
    assert set(found) == {(3, 0), (2, 0), (None, 0), (11, 1)}
    assert all(r["kept_doc_id"] == 2 and r["kept_line_no"] == 0 and r["n_lines"] == 4 for r in found.values())
    assert [k for k, r in found.items() if r["keep"]] == [(2, 0)]
    left = sorted(((r["doc_id"], r["text"]) for r in linededup.drop_lines(docs_of(spark, rows)).collect()), key=str)
    assert left == sorted([(2, other + "\nshort line"), (2, other + "\nshort line"), (9, None), (10, ""), (11, "a")], key=str)


def test_chain_needs_pairs_beyond_the_leader(spark):
    """Lines that are near their neighbour only are one group."""
    words = LINE.split() + "across northern counties following lengthy consultations involving residents merchants sailors engineers".split()
    rows = []
    for k in range(8):
        changed = [w + "xyz" if i < k * 1 else w for i, w in enumerate(words)]
        rows.append((k, " ".join(changed)))
    found = decisions(spark, rows)
    assert len(found) == 8 and {r["kept_doc_id"] for r in found.values()} == {0}


def test_extra_columns_and_counts(spark):
    rows = spark.createDataFrame([(1, LINE + "\nfirst", "x", 99, 1, 2), (2, LINE + "\nsecond", "y", 99, 3, 4), (3, LINE, "z", 99, 5, 6)], "doc_id long, text string, key string, n_chars long, node long, `group` long")
    out = sorted(linededup.drop_lines(rows).collect())
    assert rows.columns == linededup.drop_lines(rows).columns
    assert [tuple(r) for r in out] == [(1, LINE + "\nfirst", "x", 99, 1, 2), (2, "second", "y", 6, 3, 4)]


def test_empty_table_and_long_text(spark):
    assert linededup.line_groups(docs_of(spark, [])).count() == 0
    assert linededup.drop_lines(docs_of(spark, [])).count() == 0
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}" for k in range(12000))
    found = decisions(spark, [(1, long), (2, long.replace("wordbbb", "wordyyy"))])
    assert len(found) == 2


def keys_of(lines):
    data, kind, bounds, _ = linededup.normalised(pa.array(lines))
    found = linededup.Lines(data, kind, bounds)
    return linededup.block_keys(*found.of(np.arange(len(lines))))


def test_normal_form_and_identity():
    """Lines, their normal forms and their hashes against a regular expression line by line."""
    rng = np.random.default_rng(9)
    signs = ["a", "B", "é", "Ñ", "7", "0", " ", "  ", "\t", ".", "。", "—", "日", "本", "ก", "ไ", "\n", "x", "٣", "\u00a0", "🙂", "e\u0301"]
    rows = ["".join(rng.choice(signs, int(rng.integers(0, 25)))) for _ in range(400)] + ["", "\n", "\n\n", " ", "one"]
    data, kind, bounds, first = linededup.normalised(pa.array(rows))
    got = [data[a : b - 1].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])]
    want = [[norm(x) for x in r.split("\n")] for r in rows]
    assert [got[a:b] for a, b in zip(first[:-1], first[1:])] == want
    found = linededup.Lines(data, kind, bounds)
    by = {}
    for line, h1, h2 in zip(got, found.h1.tolist(), found.h2.tolist()):
        assert by.setdefault(line, (h1, h2)) == (h1, h2)
    assert len(set(by.values())) == len(by) and found.chars.tolist() == [len(x) for x in got]


def share_found(lines, edited):
    """Share of the pairs that are candidates: an odd key in common, or an even one and fingerprints within the radius."""
    sig, keys, first = keys_of(lines + edited)
    n = len(lines)
    keys = [set(keys[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    near = np.bitwise_count(sig[:n] ^ sig[n:]) <= linededup.RADIUS
    return np.mean([any(k & 1 or near[i] for k in keys[i] & keys[n + i]) for i in range(n)])


@pytest.mark.parametrize("typos, least", [(1, 0.97), (2, 0.9)])
def test_typos_in_short_lines(typos, least):
    """Random one-character typos in lines of 5 to 10 words."""
    rng = np.random.default_rng(typos)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = ["".join(rng.choice(letters, int(rng.integers(2, 11)))) for _ in range(3000)]
    lines, edited = [], []
    while len(lines) < 2000:
        a = " ".join(rng.choice(words, int(rng.integers(5, 11))))
        b = list(a)
        for _ in range(typos):
            b[int(rng.choice([k for k, c in enumerate(b) if c != " "]))] = str(rng.choice(letters))
        if typos <= 0.1 * len(a):
            lines.append(a)
            edited.append("".join(b))
    assert share_found(lines, edited) >= least


def test_lines_without_spaces():
    """A changed word of two characters in Chinese lines of 40 to 80 characters."""
    rng = np.random.default_rng(5)
    signs = [chr(c) for c in range(0x4E00, 0x5600)]
    lines = ["".join(rng.choice(signs, int(rng.integers(40, 80)))) for _ in range(500)]
    edited = []
    for a in lines:
        k = int(rng.integers(0, len(a) - 2))
        edited.append(a[:k] + "".join(rng.choice(signs, 2)) + a[k + 2 :])
    assert share_found(lines, edited) >= 0.9


def test_chinese_lines_end_to_end(spark):
    line = "这是一个没有空格的句子它有很多个字符长度所以可以找到相似的行因为只改变了一个词语其余的部分完全相同没有任何差别"
    other = line.replace("词语", "单词")
    found = decisions(spark, [(1, line), (2, "前言\n" + other), (3, "完全不同的一行文字讲述港口改造工程的进展情况以及居民们对此提出的各种各样的意见和建议")])
    assert set(found) == {(1, 0), (2, 1)} and found[2, 1]["kept_doc_id"] == 1


@pytest.mark.parametrize("changed", range(1, 4))
def test_changed_words_share_a_block(changed):
    """Up to three changed words of thirty always leave a block in common."""
    rng = np.random.default_rng(changed)
    words = [f"{a}{b}{c}" for a in ("ber", "kan", "lom") for b in ("tu", "ri", "so", "pe") for c in ("gan", "del", "mir", "vok", "zat")]
    for _ in range(50):
        a = list(rng.choice(words, 30))
        b = list(a)
        for k in rng.choice(30, changed, replace=False):
            b[k] = str(rng.choice(words))
        _, keys, first = keys_of([" ".join(a), " ".join(b)])
        assert set(keys[: first[1]].tolist()) & set(keys[first[1] :].tolist())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, above = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (x != y)))
    return row[-1]


def test_edit_distances_against_the_table():
    rng = np.random.default_rng(4)
    pairs = [("", ""), ("", "abc"), ("abc", ""), ("same", "same"), ("é日🙂", "日🙂x")]
    for size in (3, 20, 63, 64, 65, 127, 130, 200, 300, 520, 600):
        for edits in (0, 1, 3, size // 8, size):
            a = list(rng.choice(list("abcdé 日"), size))
            b = list(a)
            for _ in range(edits):
                k = int(rng.integers(0, len(b) + 1))
                b[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abcx"), int(rng.integers(0, 2))))
            pairs.append(("".join(a), "".join(b)))
    left, right = map(list, zip(*pairs))
    true = np.array([distance(a, b) for a, b in pairs])
    for d in (-1, 0, 1):
        allowed = true + d
        assert np.array_equal(editdistance.within(left, right, allowed), true <= allowed)
        assert np.array_equal(editdistance.within(right, left, allowed), true <= allowed)


def test_long_lines_are_compared_together(monkeypatch):
    rng = np.random.default_rng(5)
    pairs = []
    for edits in (0, 20, 69, 70, 71, 72, 150) * 20:
        a = rng.choice(list("abcdé 日"), 700)
        b = a.copy()
        # Letters that the other side doesn't have: the distance is their number.
        b[rng.choice(700, edits, replace=False)] = "x"
        pairs.append(("".join(a), "".join(b), edits))
    left, right, true = zip(*pairs)
    monkeypatch.setattr(editdistance, "_one", None)
    monkeypatch.setattr(editdistance, "_letters_differ", lambda *_: 0)
    assert np.array_equal(editdistance.within(left, right, np.full(len(true), 70)), np.array(true) <= 70)


@pytest.mark.parametrize("cut", [0, 40, 400])
def test_very_long_lines_one_by_one(cut):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 9, 6000)
    b = np.delete(a, np.s_[100 : 100 + cut])
    b[rng.choice(np.arange(200, len(b)), 50, replace=False)] = 9
    true = 50 + cut
    for allowed in (true - 1, true, true + 1, 2000):
        assert (editdistance._one(b, a, allowed) <= allowed) == (true <= allowed)


def test_equal_lines_of_any_length(spark):
    """Short lines and lines without spaces are kept once if they are equal; near matching leaves them alone."""
    lines = ["All rights reserved", "of edti oner", "ok", "这是一个没有空格的句子它有二十多个字符长度", "Home"]
    rows = [(1, "\n".join([*lines, "Homes", "", "---"])), (2, "\n".join(["", "---", "ALL RIGHTS RESERVED.", *lines[1:], "mine"])), (3, lines[0] + "\nAll rights reservd")]
    found = decisions(spark, rows)
    assert set(found) == {(1, k) for k in range(5)} | {(2, k) for k in range(2, 7)} | {(3, 0)}
    assert all(r["keep"] == (d == 1) for (d, _), r in found.items())
    left = {r["doc_id"]: r["text"] for r in linededup.drop_lines(docs_of(spark, rows)).collect()}
    assert left == {1: rows[0][1], 2: "\n---\nmine", 3: "All rights reservd"}
