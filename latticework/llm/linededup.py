"""Fuzzy line dedup.

Lines are normalised (lower case, digits to 0, punctuation to spaces, spaces
collapsed) and equal ones collapsed.  A line's features are its words, those of
up to `SHORT` bytes together with the word after them; in scripts without
spaces between words, every two neighbouring characters.  Its SimHash comes in
blocks: the features are dealt to blocks by their hashes, and each block is the
SimHash of its own features.  A changed word then disturbs two blocks at most,
the one that it leaves and the one that it enters, and by the pigeonhole
principle lines that differ in k features still share one of 2 k + 1 blocks.
(Blocks cut from one SimHash over all words don't serve here: one word of
twenty turns a tenth of its bits.)  There are up to `LEVELS[-1]` blocks, of
`PER_BLOCK` features or more each; a line close to the border between two
numbers of blocks is entered under both.  Lines of fewer than `FEW` features
are entered under all of them, all but each one and, from `BUT_TWO` features
on, all but each two: that is complete for two changed features.

Lines that share a block and differ in at most `radius` bits of the SimHash of
all features are candidates, as are those of few features that are equal but
for two; and the edit similarity of the normalised lines,
1 - distance / longer length, decides.  The lines of a block are first held
against one of their number; what that doesn't connect is compared pair by
pair, so that large groups cost little and no pair that matters is left out.
One occurrence of each connected group stays: the one in the lowest doc_id,
then content hash, then line number.  Equal lines are one whatever their
length; near matching leaves out lines of fewer than `min_chars` characters
and those of fewer than three features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import editdistance
from . import textvec as tv
from .common import apart, components, drop_stored, mapped, maybe_broadcast, stored

RADIUS = 16
SIMILARITY = 0.9
MIN_CHARS = 20
MIN_FEATURES = 3
SHORT = 4
PER_BLOCK = 2.2
#: Lines of fewer features are entered under all and all but one or two of them.
FEW, BUT_TWO = 9, 4
#: Numbers of blocks, and the share of its features that a similar line may lack.
LEVELS = np.array([4, 6, 9])
SHARE = 0.87
#: Lines that a task remembers, not to give their blocks again; giving them twice changes nothing.
MET = 1 << 20
#: Text of the pairs that are verified at once.
PAIR_BYTES = 2 << 20
_U = np.uint64
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128][~tv.IS_WORD[:128]] = 32
_PLAIN[48:58] = 48
_PLAIN[10] = 10


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of all rows in the form in which they are compared.

    (bytes, a line feed after each line; the bytes' classes; start of each line
    and the end; first line of each row and the end).  A row has a line more
    than line feeds.
    """
    ended = pc.binary_join_element_wise(pc.utf8_lower(texts), pa.scalar("", texts.type), pa.scalar("\n", texts.type))
    data, offsets = tv.buffers(ended)
    kind = tv.classes(data)
    out = _PLAIN[data]
    out[(kind == 0) & (data >= 128)] = 32
    first = np.searchsorted(np.flatnonzero(data == 10), offsets)
    # Of white space, the first of a run stays unless a line starts or ends there.
    gap = out <= 32
    stays = np.ones(len(out), dtype=bool)
    stays[1:] = ~gap[:-1]
    stays[:1] = ~gap[:1]
    stays |= out != 32
    out, kind = out[stays], kind[stays]
    stays = out != 32
    stays[:-1] |= out[1:] != 10
    out, kind = out[stays], kind[stays]
    return out, kind, np.concatenate(([0], np.flatnonzero(out == 10) + 1)), first


class Lines:
    """Hashes and features of normalised lines."""

    def __init__(self, data: np.ndarray, kind: np.ndarray, bounds: np.ndarray):
        starts, ends, first = tv.tokens(data, bounds, kind)
        sums = tv.prefix(data)
        #: A hash of the bytes and one of the sequence of words: together a line's identity.
        self.h1 = tv.span_hash(sums, bounds[:-1], bounds[1:] - 1)
        size = np.diff(first)
        place = np.arange(len(starts), dtype=np.uint64) - np.repeat(first[:-1], size).astype(np.uint64)
        total = np.concatenate(([_U(0)], np.cumsum(tv.mix(tv.span_hash(sums, starts, ends) + place * _U(0x9E3779B97F4A7C15), 6), dtype=np.uint64)))
        self.h2 = total[first[1:]] - total[first[:-1]]
        letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        #: Characters without the line feed.
        self.chars = letters[bounds[1:] - 1] - letters[bounds[:-1]]
        closes = ends - starts > SHORT
        closes[first[1:][size > 0] - 1] = True
        opens = np.concatenate(([True], closes[:-1]))[: len(closes)]
        self.features = tv.span_hash(sums, starts[opens], ends[closes])
        self.first = np.concatenate(([0], np.cumsum(closes)))[first]

    def of(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, first of each line and the end) of some of the lines."""
        size = np.diff(self.first)[lines]
        first = np.concatenate(([0], np.cumsum(size)))
        return self.features[np.arange(first[-1]) + np.repeat(self.first[:-1][lines] - first[:-1], size)], first


def _levels(n: np.ndarray) -> np.ndarray:
    """Number of blocks for n features; 0 below FEW."""
    return np.where(n < FEW, 0, LEVELS[np.maximum(np.searchsorted(LEVELS * PER_BLOCK, n, side="right") - 1, 0)])


def block_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SimHash of each line, keys of all lines' blocks, first key of each line and the end) of lines given by their features.

    Keys of all features or all but one or two are odd, those of blocks even.
    """
    size = np.diff(first)
    rows = len(size)
    row = np.repeat(np.arange(rows), size)
    keys, owners = [], []
    high, low = _levels(size), _levels(np.floor(size * SHARE))
    place = tv.mix(hashes, 2)
    sig = np.zeros(rows, dtype=np.uint64)
    short = np.flatnonzero(high == 0)
    part = np.repeat(high == 0, size)
    sig[short] = tv.simhash(hashes[part], np.concatenate(([0], np.cumsum(size[short]))))
    for blocks, use in ((high, high > 0), (low, (low > 0) & (low != high))):
        mine = use[row]
        f, r = hashes[mine], row[mine]
        if not len(f):
            continue
        block = (place[mine] % blocks[r].astype(np.uint64)).astype(np.int64)
        order = np.argsort(r * 16 + block, kind="stable")
        f, r, block = f[order], r[order], block[order]
        begin = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (block[1:] != block[:-1]))))
        own = np.flatnonzero(use)
        value, whole = tv.nested_simhash(f, np.append(begin, len(f)), np.searchsorted(r[begin], np.append(own, rows)))
        sig[own] = whole
        keys.append(tv.mix(value ^ tv.mix((blocks[r[begin]] << 24 | block[begin]).astype(np.uint64), 3)) & ~_U(1))
        owners.append(r[begin])
    few = ((high == 0) | (low == 0)) & (size > 0)
    part = tv.mix(hashes, 4)
    total = np.concatenate(([_U(0)], np.cumsum(part, dtype=np.uint64)))
    total = total[first[1:]] - total[first[:-1]]
    keys.append(tv.mix(total[few], 5) | _U(1))
    owners.append(np.flatnonzero(few))
    but_one = (few & (size > 1))[row]
    keys.append(tv.mix(total[row[but_one]] - part[but_one], 5) | _U(1))
    owners.append(row[but_one])
    for n in range(BUT_TWO, FEW):
        mine = np.flatnonzero(size == n)
        a, b = np.triu_indices(n, 1)
        left = total[mine, None] - part[first[mine, None] + a] - part[first[mine, None] + b]
        keys.append(tv.mix(left.reshape(-1), 5) | _U(1))
        owners.append(np.repeat(mine, len(a)))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return sig, keys[order], np.searchsorted(owners[order], np.arange(rows + 1))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("k_doc"), F.xxhash64(docs["text"]).alias("k_text"), docs["text"].cast("string").alias("text")).where("text is not null")


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k_doc, k_text, line_no, h1, h2, sig, blocks): each line whose normalised form isn't empty, with that form's hashes, SimHash and blocks.

    A task gives a line's SimHash and blocks where it meets the line first,
    null elsewhere and for lines that near matching leaves out.
    """

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            for part in tv.slices(batch, "text"):
                data, kind, bounds, first = normalised(part.column("text"))
                row = np.repeat(np.arange(len(part)), np.diff(first))
                line_no = np.arange(len(row)) - first[:-1][row]
                lines = Lines(data, kind, bounds)
                values, at = np.unique(lines.h1, return_index=True)
                if len(met) > MET:
                    met.clear()
                new = np.fromiter((v not in met for v in values.tolist()), dtype=bool, count=len(values))
                met.update(values[new].tolist())
                fresh = np.zeros(len(row), dtype=bool)
                fresh[at[new]] = True
                fresh &= (lines.chars >= min_chars) & (np.diff(lines.first) >= MIN_FEATURES)
                some = lines.chars > 0
                mine = np.flatnonzero(fresh)
                sig, keys, key_at = block_keys(*lines.of(mine))
                fresh_kept = fresh[some]
                sizes, sigs = np.zeros(len(fresh_kept), dtype=np.int64), np.zeros(len(fresh_kept), dtype=np.uint64)
                sizes[fresh_kept], sigs[fresh_kept] = np.diff(key_at), sig
                none = pa.array(~fresh_kept)
                blocks = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(keys.view(np.int64)), mask=none)
                own = pa.array(row[some])
                yield pa.RecordBatch.from_arrays(
                    [part.column("k_doc").take(own), part.column("k_text").take(own), pa.array(line_no[some].astype(np.int32)), pa.array(lines.h1[some].view(np.int64)), pa.array(lines.h2[some].view(np.int64)), pc.if_else(none, None, pa.array(sigs.view(np.int64))), blocks],
                    ["k_doc", "k_text", "line_no", "h1", "h2", "sig", "blocks"],
                )

    return mapped(_rows(docs), run, "k_doc long, k_text long, line_no int, h1 long, h2 long, sig long, blocks array<long>")


def _node() -> Column:
    return F.xxhash64("h1", "h2")


def _shared_blocks(seen: DataFrame) -> DataFrame:
    """(key, node, sig, leader, leader_sig) of the blocks that several lines have; the leader is the lowest of them."""
    entries = seen.where("blocks is not null").select(F.explode("blocks").alias("key"), _node().alias("node"), "sig")
    # One shuffle, read twice; a block's lines stream past its least one, so that no block is sorted or held in memory.
    entries = entries.repartition("key")
    ends = entries.groupBy("key").agg(F.min("node").alias("leader"), F.min_by("sig", "node").alias("leader_sig"), F.max("node").alias("last")).where("leader <> last")
    return entries.join(ends.drop("last").hint("shuffle_hash"), "key")


def _near(a: str, b: str, radius: int) -> Column:
    """Whether two lines of one block are candidates: few features that are equal but for two say so by themselves."""
    return (F.col("key").bitwiseAND(F.lit(1)) == 1) | (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius)


def _texts(docs: DataFrame, lines: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """nodes (node) -> (node, norm), the lines being read again from their documents."""
    wanted = lines.join(maybe_broadcast(nodes, n, 16), "node", "left_semi").select("node", "place.k_doc", "place.k_text", "place.line_no")
    by_doc = stored(wanted.groupBy("k_doc", "k_text").agg(F.collect_list(F.struct("line_no", "node")).alias("lines")), "wanted")
    size = by_doc.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("m")).first()
    small = maybe_broadcast(by_doc.withColumnsRenamed({"k_doc": "w_doc", "k_text": "w_text"}), 1, 64 * size["n"] + 24 * size["m"])
    rows = _rows(docs).join(small, (F.col("k_text") == F.col("w_text")) & F.col("k_doc").eqNullSafe(F.col("w_doc")))
    rows = rows.select(F.split("text", "\n").alias("parts"), F.explode("lines").alias("w")).select("w.node", F.get("parts", F.col("w.line_no")).alias("text"))

    def run(batches):
        for batch in batches:
            data, _, bounds, _ = normalised(batch.column("text"))
            # Without the line feeds: each row is one line.
            lines = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer((bounds - np.arange(len(bounds))).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[data != 10])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lines.cast(pa.string())], ["node", "norm"])

    out = stored(mapped(rows, run, "node long, norm string").dropDuplicates(["node"]), "line-texts")
    drop_stored(by_doc)
    return out


def _verified(docs: DataFrame, lines: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough."""
    n = pairs.count()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    text = _texts(docs, lines, ends, 2 * n)
    near = pairs.join(text.select(F.col("node").alias("a"), F.col("norm").alias("x")), "a").join(text.select(F.col("node").alias("b"), F.col("norm").alias("y")), "b")
    near = near.where(F.abs(F.char_length("x") - F.char_length("y")) <= F.greatest(F.char_length("x"), F.char_length("y")) * (1 - similarity) + 1e-9).select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            for part in tv.slices(batch, "x", PAIR_BYTES):
                x, y = part.column("x").to_pylist(), part.column("y").to_pylist()
                allowed = np.floor(np.array([max(len(s), len(t)) for s, t in zip(x, y)]) * (1 - similarity) + 1e-9).astype(np.int64)
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(editdistance.within(x, y, allowed)))

    out = stored(mapped(near, run, "a long, b long"), "near-lines")
    drop_stored(text)
    return out


def linked_lines(docs: DataFrame, seen: DataFrame, lines: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(node, component) of the distinct lines that have a similar one."""
    shared = stored(_shared_blocks(seen), "shared-blocks")
    first = stored(shared.where((F.col("node") != F.col("leader")) & _near("sig", "leader_sig", radius)).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "line-pairs")
    edges = _verified(docs, lines, first, similarity)
    linked = stored(components(edges), "line-groups")
    # What is connected already need not be compared any more.
    label = F.coalesce("component", "node").alias("label")
    rest = shared.select("key", "node", "sig").join(maybe_broadcast(linked, linked.count(), 40), "node", "left").select("key", "node", "sig", label)
    rest = rest.distinct().repartition("key")
    open_ = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rest = rest.join(open_.hint("shuffle_hash"), "key", "left_semi")
    rest = stored(rest, "open-blocks")
    drop_stored(shared)
    x, y = (rest.select("key", *[F.col(c).alias(f"{t}_{c}") for c in ("node", "sig", "label")]) for t in "xy")
    both = x.join(y, "key").where((F.col("x_node") < F.col("y_node")) & (F.col("x_label") != F.col("y_label")) & _near("x_sig", "y_sig", radius))
    second = stored(both.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "line-pairs")
    drop_stored(rest, first)
    more = _verified(docs, lines, second, similarity)
    drop_stored(second)
    if more.isEmpty():
        drop_stored(edges, more)
        return linked
    drop_stored(linked)
    linked = stored(components(edges.unionByName(more)), "line-groups")
    drop_stored(edges, more)
    return linked


def _removed(docs: DataFrame, radius: int, similarity: float, min_chars: int) -> DataFrame:
    """All occurrences of lines that occur more than once, exactly or nearly, with the kept occurrence of their group."""
    seen = stored(occurrences(docs, min_chars), "lines")
    occurrence = seen.select("k_doc", "k_text", "line_no", "h1", "h2").distinct()
    place = F.struct(F.col("k_doc").isNull().alias("none"), "k_doc", "k_text", "line_no")
    lines = stored(occurrence.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).withColumn("node", _node()), "distinct-lines")
    linked = linked_lines(docs, seen, lines, radius, similarity)
    named = lines.join(maybe_broadcast(linked, linked.count(), 40), "node", "left").withColumn("group", F.coalesce("component", "node"))
    # Lines that occur once and are near no other stay; they need no join.
    named = named.where("n > 1 or component is not null")
    kept = named.groupBy("group").agg(F.min("place").alias("kept"), F.sum("n").alias("n_lines"))
    decided = stored(named.select("h1", "h2", "group").join(kept, "group"), "line-decisions")
    drop_stored(lines, linked)
    return occurrence.join(decided, ["h1", "h2"]).withColumn("is_kept", place == F.col("kept"))


def line_groups(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every occurrence of a line that occurs more than once, exactly or nearly: (doc_id, line_no, kept_doc_id, kept_line_no, n_lines, keep).

    line_no counts from 0.  Rows equal in id and text count as one document.
    Null and empty texts have no lines; rows with a null id take part, their
    doc_id is null.  Only doc_id and text are read.  Lines whose normalised
    form is empty are left alone.  Lines of fewer than `min_chars` characters
    or `MIN_FEATURES` features match only if they are equal.
    """
    marked = _removed(docs, radius, similarity, min_chars)
    return marked.select(F.col("k_doc").alias("doc_id"), "line_no", F.col("kept.k_doc").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), "n_lines", F.col("is_kept").alias("keep"))


def drop_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` without the lines that `line_groups` doesn't keep; all columns stay, text is rewritten and n_chars, if there, recounted.

    Documents of which nothing but white space is left are dropped, unless they
    were so before.  Rows with a null text are unchanged; rows equal in id and
    text lose the same lines.
    """
    marked = _removed(docs, radius, similarity, min_chars)
    doc, text, lines, cut = apart(docs, "__doc", "__text", "__gone", "__left")
    gone = stored(marked.where("not is_kept").groupBy(F.col("k_doc").alias(doc), F.col("k_text").alias(text)).agg(F.collect_list("line_no").alias(lines)), "gone-lines")
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(lines)), F.lit(0)).alias("m")).first()
    gone = maybe_broadcast(gone, 1, 64 * size["n"] + 8 * size["m"])
    joined = docs.join(gone, (F.col(text) == F.xxhash64(docs["text"])) & F.col(doc).eqNullSafe(docs["doc_id"].cast("long")), "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(F.col(lines), i)), "\n")
    changed = F.col(lines).isNotNull()
    joined = joined.withColumn(cut, F.when(changed, left).otherwise(docs["text"]))
    out = joined.where(~changed | (F.trim(F.regexp_replace(cut, r"\s+", " ")) != ""))
    columns = [F.col(cut).alias(c) if c == "text" else F.when(changed, F.char_length(cut)).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return out.select(*columns)
