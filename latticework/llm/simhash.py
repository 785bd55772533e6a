"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint is 128 bits over its distinct lower-cased words; in
scripts without spaces between words, over every two neighbouring characters.
A word weighs 1, those of 4 bytes or more 2 and of 7 or more 3, and
floor(log2(count)) besides: short words are common to all documents of a
language, and if they weighed as much, unrelated documents would have like
fingerprints.  A fingerprint is cut into `segments` segments.  If two
fingerprints differ in at most r = segments * (2 * ball + 1) - 1 bits, they
differ in at most 2 * ball bits of some segment (pigeonhole), so their Hamming
balls of radius `ball` in that segment meet.  Every fingerprint is entered in
the table under each value of its balls and looks itself up under the same
values, which serves both sides of the search with one shuffle; the complete
distance decides.

Wanted are the connected groups, so pairs inside a group that is connected
already are passed over (`linked`).  Equal fingerprints are collapsed first.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import apart, components, drop_stored, mapped, maybe_broadcast, row_key, stored

SEGMENTS = 6
RADIUS = 17
#: Groups of more fingerprints meet by label.
LARGE = 32
_LENGTHS = np.array([3, 6])
_U = np.uint64


def hash_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high 64 bits, low 64 bits, number of distinct words) of each text."""
    data, offsets = tv.buffers(pc.utf8_lower(texts))
    starts, ends, first = tv.tokens(data, offsets)
    hashes = tv.span_hash(tv.prefix(data), starts, ends)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # The two lowest bits of the 40 that `distinct` keeps say how long the word is.
    length = np.searchsorted(_LENGTHS, ends - starts).astype(np.uint64)
    row, feature, count = tv.distinct(rows, hashes & ~_U(3 << 24) | length << _U(24))
    length = (feature & _U(3)).astype(np.int64)
    weight = 1 + length + np.where(length > 0, np.log2(count).astype(np.int64), 0)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    totals = np.concatenate(([0], np.cumsum(weight)))
    repeated = np.repeat(feature, weight)
    return tv.simhash(repeated, totals[bounds], 0), tv.simhash(repeated, totals[bounds], 1), np.diff(bounds)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(k_doc, k_text, hi, lo) of the rows that have a word; k_doc and k_text identify the row."""

    def run(batches):
        for batch in batches:
            for part in tv.slices(batch, "text"):
                hi, lo, n = hash_texts(part.column("text"))
                mask = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([part.column("k_doc"), part.column("k_text"), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], ["k_doc", "k_text", "hi", "lo"]).filter(mask)

    source = docs.select(*row_key(docs["doc_id"], docs["text"]), docs["text"].cast("string").alias("text")).where("text is not null")
    return mapped(source, run, "k_doc long, k_text long, hi long, lo long")


def _widths(bits: int, segments: int) -> list[int]:
    return [bits // segments + (k < bits % segments) for k in range(segments)]


def segment(hi: Column, lo: Column, start: int, width: int) -> Column:
    """Bits start .. start+width-1 (of 128, from the top) as a non-negative number; width < 64."""
    mask = F.lit((1 << width) - 1).cast("long")
    end = start + width
    if end <= 64:
        return F.shiftrightunsigned(hi, 64 - end).bitwiseAND(mask)
    if start >= 64:
        return F.shiftrightunsigned(lo, 128 - end).bitwiseAND(mask)
    return F.shiftleft(hi, end - 64).bitwiseOR(F.shiftrightunsigned(lo, 128 - end)).bitwiseAND(mask)


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.hi").bitwiseXOR(F.col(f"{b}.hi"))) + F.bit_count(F.col(f"{a}.lo").bitwiseXOR(F.col(f"{b}.lo")))


def _entries(prints: DataFrame, segments: int, ball: int, *kept: str) -> DataFrame:
    """(key, hi, lo, *kept): each fingerprint under every value within `ball` bits of each of its segments."""
    widths = _widths(128, segments)
    starts = list(itertools.accumulate([0, *widths[:-1]]))
    masks = [(s, sum(1 << b for b in flip)) for s in range(segments) for k in range(ball + 1) for flip in itertools.combinations(range(widths[s]), k)]
    # A fixed table: its size depends on the parameters alone.
    table = F.broadcast(prints.sparkSession.createDataFrame(masks, "seg int, flip long"))
    value = F.coalesce(*[F.when(F.col("seg") == s, segment(F.col("hi"), F.col("lo"), starts[s], widths[s])) for s in range(segments)])
    return prints.crossJoin(table).select(F.shiftleft(F.col("seg").cast("long"), 58).bitwiseOR(value.bitwiseXOR(F.col("flip"))).alias("key"), "hi", "lo", *kept)


def _node(t: str = "") -> Column:
    return F.xxhash64(f"{t}hi", f"{t}lo")


def _met(a: DataFrame, b: DataFrame, on: list[str], extra: Column, radius: int) -> DataFrame:
    """(a, b): nodes of the rows of `a` and `b` that agree in `on`, meet `extra` and are within `radius`."""
    joined = a.alias("a").join(b.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [extra, distance("a", "b") <= radius])
    return joined.select(_node("a.").alias("a"), _node("b.").alias("b"))


def linked(prints: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """(node, component) of the distinct fingerprints (hi, lo) that are within `radius` of another; node is their hash, component that of the group.

    A group is a connected component of all pairs within the radius.  Pairs
    inside a group that is known to be connected add nothing, and in large
    groups they are nearly all of the work.  So fingerprints are first linked
    to one other of the same segment value; the search by balls then passes
    over pairs that have the same label.  Members of large groups meet one
    another by label, so that not even their comparison is paid for.
    """
    ball = 0
    while segments * (2 * ball + 1) - 1 < radius:
        ball += 1
    # One shuffle, read twice; a value's fingerprints stream past the first of them.
    dealt = _entries(prints, segments, 0).withColumn("node", _node()).repartition("key")
    ends = dealt.groupBy("key").agg(F.min("node").alias("first"), F.min_by("hi", "node").alias("first_hi"), F.min_by("lo", "node").alias("first_lo"))
    apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("first_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("first_lo")))
    led = dealt.join(ends.hint("shuffle_hash"), "key").where((F.col("node") != F.col("first")) & (apart <= radius))
    edges = stored(led.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "first-links")
    found = components(edges)
    found = stored(found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component"), "first-groups")
    known = prints.withColumn("node", _node()).join(maybe_broadcast(found, found.count(), 48), "node", "left")
    # A fingerprint without a group is its own label, which need not travel.  Each row is entered many times: as many tasks do that as read it.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = stored(known.select("hi", "lo", F.col("component").alias("label"), (F.coalesce("size", F.lit(1)) > LARGE).alias("large")).repartition(tasks), "labelled")
    few, many = (_entries(known.where(c), segments, ball, "label") for c in ("not large", "large"))
    label = lambda t: F.coalesce(f"{t}.label", _node(f"{t}."))
    differ = label("a") < label("b")
    # The labels of both sides always differ here; naming them lets this join read the shuffle of the one before.
    apart = label("a") != label("b")
    met = _met(few, few, ["key"], differ, radius).unionByName(_met(many, few, ["key"], apart, radius))
    if not known.where("large").isEmpty():
        labels = many.select("key", "label").distinct()
        both = labels.alias("a").join(labels.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label"))).select("a.key", "a.label", F.col("b.label").alias("other"))
        left = many.join(both, ["key", "label"]).select("key", "other", "hi", "lo")
        met = met.unionByName(_met(left, many.withColumnRenamed("label", "other"), ["key", "other"], F.lit(True), radius))
    more = stored(met.distinct(), "further-links")
    out = found.select("node", "component") if more.isEmpty() else stored(components(edges.unionByName(more)), "groups")
    drop_stored(known, edges, more)
    return out


def groups(docs: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """(k_doc, k_text, group, n_rows, keep) of every distinct row with words, n_rows being how often it occurs; one row of each group has keep.

    Kept is the lowest doc_id (nulls last), among equal ids the lowest content hash.
    """
    rows = stored(fingerprints(docs).groupBy("k_doc", "k_text", "hi", "lo").agg(F.count(F.lit(1)).alias("n_rows")), "fingerprints")
    prints = stored(rows.select("hi", "lo").distinct(), "distinct-fingerprints")
    near = linked(prints, segments, radius)
    drop_stored(prints)
    rows = rows.withColumn("node", _node())
    rows = rows.join(maybe_broadcast(near, near.count(), 40), "node", "left").withColumn("group", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("k_doc").isNull().alias("none"), "k_doc", "k_text"))
    best = rows.groupBy("group").agg(first.alias("best"))
    return rows.join(best, "group").select("k_doc", "k_text", "group", "n_rows", (F.struct(F.col("k_doc").isNull().alias("none"), "k_doc", "k_text") == F.col("best")).alias("keep"))


def near_duplicates(docs: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """One row per group of near-duplicates, groups of one included: (doc_id, n_docs, members).

    doc_id is the document that stays (the lowest id), members are the sorted
    distinct ids of the whole group.  Rows equal in id and text are one
    document.  Texts that are null or have no word belong to no group and are
    left out; rows with a null id are grouped but appear only if nothing else
    is in their group (doc_id null, members empty).  Only doc_id and text are
    read.  An empty table gives no rows.
    """
    found = groups(docs, segments, radius)
    return found.groupBy("group").agg(F.min("k_doc").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"), F.sort_array(F.collect_set("k_doc")).alias("members")).drop("group")


def drop_near_duplicates(docs: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, once each.

    Rows without words stay (repeated ones too).
    """
    found = stored(groups(docs, segments, radius).groupBy("k_doc", "k_text").agg(F.max("keep").alias("keep"), F.sum("n_rows").alias("n_rows")), "kept")
    own_doc, own_text = apart(docs, "__doc", "__text")
    known = found.select(F.col("k_doc").alias(own_doc), F.col("k_text").alias(own_text), "keep", "n_rows")
    doc, text = row_key(docs["doc_id"], docs["text"])
    same = F.col(own_doc).eqNullSafe(doc) & (F.col(own_text) == text)
    # What occurs once and stays needs no join; only repeats of what stays are shuffled with their texts.
    gone = known.where("not keep or n_rows > 1").select(own_doc, own_text)
    kept = docs.join(maybe_broadcast(gone, gone.count(), 48), same, "left_anti")
    repeated = known.where("keep and n_rows > 1").select(own_doc, own_text)
    n = repeated.count()
    if not n:
        return kept
    once = docs.join(maybe_broadcast(repeated, n, 48), same).dropDuplicates([own_doc, own_text])
    return kept.unionByName(once.select(*[docs[c] for c in docs.columns]))
