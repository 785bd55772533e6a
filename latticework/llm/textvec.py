"""Whole-batch numpy kernels over Arrow string columns.

Every kernel works on the concatenated UTF-8 bytes of a slice of documents, so
the Python interpreter runs a constant number of statements per slice, not per
document or per word.  Slices are cut by bytes (`slices`), which bounds memory
by the larger of the slice size and the longest single text.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_PINV = _U(pow(int(_P), -1, 1 << 64))

#: A word byte is an ASCII letter or digit, or any byte of a non-ASCII character.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_pow = np.ones(1, dtype=np.uint64)
_ipow = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = 1 << max(n - 1, 1).bit_length()
        _pow, _ipow = (np.multiply.accumulate(np.concatenate(([_U(1)], np.full(size - 1, p)))) for p in (_P, _PINV))
    return _pow, _ipow


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit finaliser of splitmix, one stream per seed."""
    x = x + _U(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Consecutive row ranges of a batch, each with at most `most` bytes of text or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


#: Scripts that put no spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_SPACELESS = ((0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x323AF))
_code_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """Of each code point: 1 for letters, marks and numbers, 2 for those of scripts without spaces, 0 for all else."""
    global _code_classes
    if _code_classes is None:
        table = np.zeros(0x110000, dtype=np.uint8)
        # No letters beyond these but for the variation selectors, which are marks.
        table[:0x33480] = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x33480)), dtype=np.uint8, count=0x33480)
        table[0xE0100:0xE01F0] = 1
        for low, high in _SPACELESS:
            table[low : high + 1] *= 2
        _code_classes = table
    return _code_classes


def classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte's character: 0 no part of a word, 1 part of one, 2 part of one in a script without spaces."""
    kind = IS_WORD[data].astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        last = len(data) - 1
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        tail = [data[np.minimum(lead + k, last)].astype(np.int32) & 63 for k in (1, 2, 3)]
        head = data[lead].astype(np.int32)
        code = np.where(size == 2, (head & 31) << 6 | tail[0], np.where(size == 3, (head & 15) << 12 | tail[0] << 6 | tail[1], (head & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        found = _class_table()[np.minimum(code, 0x10FFFF)]
        odd = found != 1
        lead, size, found = lead[odd], size[odd], found[odd]
        for k in range(4):
            long = size > k
            kind[np.minimum(lead[long] + k, last)] = found[long]
    return kind


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(inside)]
    begin[edges] = inside[edges]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    finish[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end): maximal runs within a row of bytes for which `member` holds."""
    starts, ends = _runs(member[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def tokens(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like `words`, cut at punctuation of every script; where a script has no spaces, a token is two neighbouring characters, or a lone one.

    `kind` are the bytes' `classes`, if they are known.
    """
    if kind is None:
        if not len(data) or data.max() < 0xC0:
            return words(data, offsets)
        kind = classes(data)
    starts, ends = _runs(kind == 1, offsets)
    lead = np.flatnonzero((kind == 2) & (data >= 0xC0))
    if len(lead):
        end = lead + 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        row = np.searchsorted(offsets, lead, side="right")
        paired = np.zeros(len(lead), dtype=bool)
        paired[:-1] = (lead[1:] == end[:-1]) & (row[1:] == row[:-1])
        alone = ~paired
        alone[1:] &= ~paired[:-1]
        second = np.flatnonzero(paired) + 1
        starts = np.concatenate((starts, lead[paired], lead[alone]))
        ends = np.concatenate((ends, end[second], end[alone]))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; feed to `span_hash`."""
    power, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that depend on content alone, not on position."""
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 40-bit feature, count) for each distinct feature of a row; rows < 2**24."""
    keys = np.sort((rows.astype(np.uint64) << _U(40)) | (hashes >> _U(24)))
    if not len(keys):
        return np.zeros(0, dtype=np.int64), keys, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> _U(40)).astype(np.int64), keys & _U((1 << 40) - 1), counts


_SPREAD = np.zeros(256, dtype=np.uint64)
for _j in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> _U(_j)) & _U(1)) << _U(8 * _j)


def _pieces(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where runs of up to 255 features start, first run of each row that has features, those rows)."""
    total = np.diff(firsts)
    pieces = (total + 254) // 255
    owner = np.repeat(np.arange(len(total)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    rows = np.flatnonzero(pieces)
    return firsts[:-1][owner] + 255 * nth, np.cumsum(pieces)[rows] - pieces[rows], rows


def simhash(features: np.ndarray, firsts: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit SimHash of each row; features[firsts[i]:firsts[i+1]] are row i's, repeats count as weight.

    Bit counts are kept in eight byte lanes of a 64-bit word, so runs of up to
    255 features are summed without unpacking; rows without features give 0.
    """
    return nested_simhash(features, firsts, None, seed)[0]


def nested_simhash(features: np.ndarray, firsts: np.ndarray, outer: np.ndarray | None, seed: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """(SimHash of each block, SimHash of each row): row i has the blocks outer[i]:outer[i+1], of which none is empty."""
    out = np.zeros(len(firsts) - 1, dtype=np.uint64)
    whole = None if outer is None else np.zeros(len(outer) - 1, dtype=np.uint64)
    if not len(features):
        return out, whole
    at, first_piece, rows = _pieces(firsts)
    half = np.diff(firsts)[rows, None] / 2
    if outer is not None:
        some = np.flatnonzero(np.diff(outer))
        half_whole = np.diff(firsts[outer])[some, None] / 2
    single = len(at) == len(rows)
    h = mix(features, seed).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[h[:, k]], at).view(np.uint8).reshape(-1, 8)
        counts = lanes if single else np.add.reduceat(lanes.astype(np.int64), first_piece, axis=0)
        out[rows] |= np.packbits(counts > half, axis=1, bitorder="little")[:, 0].astype(np.uint64) << _U(8 * k)
        if outer is not None:
            total = np.add.reduceat(counts.astype(np.int64), outer[some], axis=0)
            whole[some] |= np.packbits(total > half_whole, axis=1, bitorder="little")[:, 0].astype(np.uint64) << _U(8 * k)
    return out, whole
