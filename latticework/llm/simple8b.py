"""Simple-8b word-aligned coding of token ids, and a binary table of coded documents.

A word has a 4-bit selector on top and 60 bits of payload:

    selector   0    1   2   3   4   5   6   7   8   9  10  11  12  13  14  15
    values   240  esc  60  30  20  15  12  10   8   7   6   5   4   3   2   1
    bits       0    -   1   2   3   4   5   6   7   8  10  12  15  20  30  60

Selector 1 is an escape: the next word holds one value that needs more than 60
bits (negative ones included) as it is.  Values are packed greedily in blocks of
`BLOCK` values; the first word of each block is recorded, and a block never
reads past its own words, so blocks are encoded and decoded side by side: both
directions step through all blocks of a batch at once in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bpe
from . import textvec as tv
from .common import mapped

BLOCK = 1024
_U = np.uint64
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
_PACKED = [0, *range(2, 16)]
_PAD = int(COUNTS.max())
_MASK = np.array([(1 << min(int(b), 63)) - 1 for b in BITS], dtype=np.uint64)


def blocks_of(offsets: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first block of each row and the end) of every block; rows without values have none."""
    sizes = np.diff(offsets)
    per = (sizes + block - 1) // block
    first = np.concatenate(([0], np.cumsum(per)))
    row = np.repeat(np.arange(len(sizes)), per)
    start = offsets[:-1][row] + block * (np.arange(first[-1]) - first[:-1][row])
    return start, np.minimum(start + block, offsets[1:][row]), first


def _selectors(values: np.ndarray) -> np.ndarray:
    """For each position but the last `_PAD` the greedy selector of a word that starts there."""
    n = len(values) - _PAD
    best = np.ones(n, dtype=np.uint8)  # the escape
    top = values.max(initial=_U(0))
    for s in _PACKED[::-1]:
        count, good = int(COUNTS[s]), values < _U(1 << int(BITS[s]))
        if top < _U(1 << int(BITS[s])):
            best[:] = s
            continue
        width = 1  # good[i]: the `width` values from i on fit
        while width < count:
            step = min(width, count - width)
            good = good[:-step] & good[step:]
            width += step
        np.putmask(best, good[:n], s)
    return best


def encode(values: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and the end, first block of each row and the end) of rows of 64-bit values."""
    start, end, row_block = blocks_of(offsets, block)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), row_block
    # Zeros between the blocks: a block's last word takes as many as it has room for.
    size = end - start
    start = start + _PAD * np.arange(len(start))
    end = start + size
    padded = np.zeros(len(values) + _PAD * len(start), dtype=np.uint64)
    padded[np.arange(len(values)) + np.repeat(_PAD * np.arange(len(start)), size)] = values.astype(np.int64, copy=False).view(np.uint64)
    selector = _selectors(padded)
    # All blocks take one step at a time; a step visits one word of each.
    used = np.zeros(len(padded), dtype=bool)
    per_block = np.zeros(len(start), dtype=np.int64)
    at, stop, live = start, end, np.arange(len(start))
    while len(live):
        used[at] = True
        chosen = selector[at]
        per_block[live] += 1 + (chosen == 1)
        at = at + COUNTS[chosen]
        more = at < stop
        if not more.all():
            at, stop, live = at[more], stop[more], live[more]
    where = np.flatnonzero(used)
    chosen = selector[where]
    width = 1 + (chosen == 1)
    slot = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), dtype=np.uint64)
    for s in _PACKED + [1]:
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            base, word = where[mine], np.full(len(mine), s << 60, dtype=np.uint64)
            if s == 1:
                out[slot[mine] + 1] = padded[base]
            elif s:
                for j in range(int(COUNTS[s])):
                    word |= padded[base + j] << _U(int(BITS[s]) * j)
            out[slot[mine]] = word
    return out, np.concatenate(([0], np.cumsum(per_block))), row_block


def decode(words: np.ndarray, block_words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values of blocks: block i has words[block_words[i]:block_words[i+1]] and sizes[i] values."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(total[-1]), dtype=np.uint64)
    live = np.flatnonzero(sizes > 0)
    word, to = block_words[:-1][live].astype(np.int64), total[:-1][live]
    while len(live):
        chosen = (words[word] >> _U(60)).astype(np.int64)
        stop = total[1:][live]
        for s in np.unique(chosen):
            mine = np.flatnonzero(chosen == s)
            if s == 1:
                out[to[mine]] = words[word[mine] + 1]
            elif s:
                payload = words[word[mine]]
                for j in range(int(COUNTS[s])):
                    p = to[mine] + j
                    inside = p < stop[mine]
                    out[p[inside]] = ((payload >> _U(int(BITS[s]) * j)) & _MASK[s])[inside]
        to = to + COUNTS[chosen]
        word = word + 1 + (chosen == 1)
        more = to < stop
        live, word, to = live[more], word[more], to[more]
    return out.view(np.int64)


def _coded(part: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray, valid: pa.Array) -> pa.RecordBatch:
    words, block_words, row_block = encode(ids, offsets)
    at = block_words[row_block]
    raw = pa.py_buffer(words.astype("<u8", copy=False))
    payload = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((at * 8).astype(np.int32)), raw])
    # A row's block offsets count from its own first word; there is one for each block.
    rows = np.repeat(np.arange(len(part)), np.diff(row_block))
    own = (block_words[:-1] - at[:-1][rows]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(np.diff(offsets)), bpe.lists(own, row_block, valid), pc.if_else(valid, payload, None), pa.array(np.diff(at))],
        ["doc_id", "n_tokens", "block_offsets", "payload", "n_words"],
    )


_SCHEMA = "doc_id long, n_tokens long, block_offsets array<int>, payload binary, n_words long"


def pack_documents(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """Tokenise every row of `docs` (doc_id, text) and code its ids.

    Gives (doc_id, n_tokens, block_offsets, payload, n_words): payload is
    little-endian 64-bit words, block_offsets the word at which each block of
    `BLOCK` ids starts.  A null text has a null payload, an empty one an empty
    payload; ids may be null or repeat, and other columns are not read.
    """
    shared = bpe.vocabulary(docs.sparkSession, path)

    def run(batches):
        codec = bpe.codec(shared.value)
        for batch in batches:
            for part in tv.slices(batch, "text", bpe.SLICE_BYTES):
                ids, offsets = codec.encode(part.column("text"))
                yield _coded(part, ids, offsets, part.column("text").is_valid())

    return mapped(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, _SCHEMA)


def pack_ids(rows: DataFrame) -> DataFrame:
    """The same for rows (doc_id, tokens array<long>) of any 64-bit values; null elements count as 0."""

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            flat = pc.fill_null(tokens.flatten(), 0).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            yield _coded(batch, flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), tokens.is_valid())

    return mapped(rows.select(rows["doc_id"].cast("long"), rows["tokens"].cast("array<long>")), run, _SCHEMA)


def unpack_documents(packed: DataFrame) -> DataFrame:
    """(doc_id, tokens array<long>) of rows that `pack_documents` or `pack_ids` made; null payloads give null."""

    def run(batches):
        for batch in batches:
            payload, at = batch.column("payload"), batch.column("block_offsets")
            size = pc.fill_null(batch.column("n_tokens"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = pc.fill_null(pc.binary_length(payload), 0).to_numpy(zero_copy_only=False) // 8
            words = np.frombuffer(b"".join(x or b"" for x in payload.to_pylist()), dtype="<u8").astype(np.uint64)
            base = np.concatenate(([0], np.cumsum(raw))).astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(size)))
            start, end, first = blocks_of(offsets)
            row = np.repeat(np.arange(len(size)), np.diff(first))
            begin = base[:-1][row] + at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            values = decode(words, np.append(begin, base[-1]), end - start)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=pc.invert(payload.is_valid()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "tokens"])

    return mapped(packed.select("doc_id", "n_tokens", "block_offsets", "payload"), run, "doc_id long, tokens array<long>")
