"""Best-fit packing into sequences of `capacity` tokens, certified by lower bounds.

Documents longer than a sequence fill whole sequences; what is left of them and
all shorter documents are items.  Items are dealt to partitions of about
`PART_ITEMS`, each packed by best-fit decreasing.  Dual feasible functions (the
identity, Fekete and Schepers' U^(lambda) for every lambda that occurs and
u^(k)) give a lower bound of each partition's bins.  Partitions whose bin count
meets the bound are certified; those with a gap put the documents of their
unfilled bins together, deal them anew and pack them again, as long as that
saves bins.  Items are dealt by what they are, so that the result depends
neither on the order of the rows nor on the files that they come in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from . import textvec as tv
from .common import drop_stored, mapped, stored

CAPACITY = 4096
PART_ITEMS = 16384
#: Copies of a row that are made at once.
COPIES = 1 << 14


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Largest bound of the dual feasible functions on the bins that items of 1 .. capacity need."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(count * np.arange(capacity + 1))))
    number = np.concatenate(([0], np.cumsum(count)))
    best = -(-int(total[-1]) // capacity)
    # U^(lambda): above capacity - lambda counts as a whole bin, below lambda as nothing.
    lam = np.arange(1, capacity // 2 + 1)
    middle = total[capacity - lam + 1] - total[lam]
    large = number[-1] - number[capacity - lam + 1]
    best = max(best, int((large + -(-middle // capacity)).max(initial=0)))
    # u^(k): x where (k + 1) x is a multiple of the capacity, else rounded down to a multiple of capacity / k.
    x = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 21):
        up = (k + 1) * x
        value = np.where(up % capacity == 0, x * k, up // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset in it) of each item and the number of bins; among equal fits the bin opened last."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, opened = 0, 0  # bit r is set if a bin has room r
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - r
        r -= size
        if r:
            room[r].append(b)
            open_rooms |= 1 << r
    return bins, offsets, opened


def token_counts(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; null texts have 0."""
    shared = bpe.vocabulary(docs.sparkSession, path)

    def run(batches):
        codec = bpe.codec(shared.value)
        for batch in batches:
            for part in tv.slices(batch, "text", bpe.SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(codec.count(part.column("text")))], ["doc_id", "n_tokens"])

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, "doc_id long, n_tokens long")


_ITEM = "doc_id long, chunk long, start_token long, n_tokens long, part long, copy long"
_PACKED = _ITEM + ", bin long, bin_offset long, part_bins long, part_bound long"


def _pack(items: DataFrame, capacity: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("chunk", "ascending"), ("copy", "ascending")])
        sizes = table.column("n_tokens").to_numpy()
        bins, offsets, opened = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        extra = {"bin": bins, "bin_offset": offsets, "part_bins": np.full(len(sizes), opened), "part_bound": np.full(len(sizes), bound)}
        for name, column in extra.items():
            table = table.append_column(name, pa.array(column.astype(np.int64)))
        return table

    return items.groupBy("part").applyInArrow(run, _PACKED)


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, rounds: int | None = None) -> DataFrame:
    """Pack rows (doc_id long, n_tokens long).

    Gives a row per piece: (doc_id, chunk, start_token, n_tokens, part, bin,
    bin_offset, part_bins, part_bound, certified); (part, bin) names a sequence,
    parts below 0 hold the whole sequences of long documents.  Rows of 0 tokens
    or null are given once, unpacked (part, bin and the rest null).  Repeated
    rows are packed as often as they occur.  Partitions exchange documents as
    often as that saves a bin; `rounds` bounds how often all are packed.
    """
    counted = lengths.select(lengths["doc_id"].cast("long"), F.greatest(F.coalesce(lengths["n_tokens"].cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens")).groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    # Copies are numbered, a block of them at a time.
    block = counted.select("doc_id", "n_tokens", "copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))).alias("block"))
    copies = F.sequence(F.col("block") * COPIES, F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1)
    lengths = stored(block.select("doc_id", "n_tokens", F.explode(copies).alias("copy")), "lengths")
    totals = lengths.agg(F.sum(F.when(F.col("n_tokens") % capacity > 0, 1)), F.sum(F.floor(F.col("n_tokens") / capacity))).first()
    parts, whole_parts = (max(1, -(-(n or 0) // part_items)) for n in totals)
    spread = F.xxhash64("doc_id", "n_tokens", "copy")
    nothing = lengths.where("n_tokens = 0").select("doc_id", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("start_token"), "n_tokens")
    long = lengths.where(F.col("n_tokens") >= capacity)
    chunk = F.explode(F.sequence(F.lit(0), F.floor(F.col("n_tokens") / capacity) - 1)).alias("chunk")
    whole = long.select("doc_id", "copy", chunk).select("doc_id", "chunk", (F.col("chunk") * capacity).alias("start_token"), F.lit(capacity).cast("long").alias("n_tokens"), (-1 - F.pmod(F.xxhash64("doc_id", "chunk", "copy"), F.lit(whole_parts))).alias("part"))
    whole = whole.withColumn("bin", F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "chunk")).cast("long") - 1)
    whole = whole.withColumn("bin_offset", F.lit(0).cast("long")).withColumn("part_bins", F.count(F.lit(1)).over(Window.partitionBy("part"))).withColumn("part_bound", F.col("part_bins"))
    rest = F.col("n_tokens") % capacity
    items = lengths.where(rest > 0).select("doc_id", F.floor(F.col("n_tokens") / capacity).alias("chunk"), (F.col("n_tokens") - rest).alias("start_token"), rest.alias("n_tokens"), F.pmod(spread, F.lit(parts)).alias("part"), "copy")
    packed = stored(_pack(items, capacity), "packed-0")
    r = 0
    while rounds is None or r + 1 < rounds:
        r += 1
        gapped = packed.where("part_bins > part_bound")
        free = gapped.withColumn("load", F.sum("n_tokens").over(Window.partitionBy("part", "bin"))).where(F.col("load") < capacity)
        state = free.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part", "bin").alias("bins"), F.count_distinct("part").alias("parts")).first()
        # A single partition has nobody to exchange with; what it has left was packed together already.
        if state["parts"] < 2:
            break
        m = max(1, -(-state["n"] // part_items))
        again = free.select("doc_id", "chunk", "start_token", "n_tokens", (F.lit(r * (1 << 32)) + F.pmod(F.xxhash64("doc_id", "chunk", "n_tokens", "copy", F.lit(r)), F.lit(m))).alias("part"), "copy")
        fresh = stored(_pack(again, capacity), f"packed-{r}")
        if fresh.agg(F.count_distinct("part", "bin")).first()[0] >= state["bins"]:
            drop_stored(fresh)
            break
        full = gapped.withColumn("load", F.sum("n_tokens").over(Window.partitionBy("part", "bin"))).where(F.col("load") == capacity).drop("load")
        # Bins that are full meet the bound of their own content.
        kept = full.withColumn("part_bins", F.size(F.collect_set("bin").over(Window.partitionBy("part"))).cast("long")).withColumn("part_bound", F.col("part_bins"))
        columns = packed.columns
        after = stored(packed.where("part_bins = part_bound").select(columns).unionByName(kept.select(columns)).unionByName(fresh.select(columns)), f"state-{r}")
        drop_stored(packed, fresh)
        packed = after
    packed = packed.drop("copy")
    out = packed.unionByName(whole.select(packed.columns)).withColumn("certified", F.col("part_bins") == F.col("part_bound"))
    return out.unionByName(nothing, allowMissingColumns=True)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = bpe.VOCABULARY, part_items: int = PART_ITEMS, rounds: int | None = None) -> DataFrame:
    """`pack_lengths` of the token counts of `docs` (doc_id, text): every row is packed; null and empty texts have no tokens; other columns aren't read."""
    return pack_lengths(token_counts(docs, path), capacity, part_items, rounds)
