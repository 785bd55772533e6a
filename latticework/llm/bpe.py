"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a
merge, so the text may be cut between its two bytes for certain.  The cuts of a
whole slice of documents come from one numpy table lookup; the fragments are
dictionary-encoded by Arrow, each distinct fragment is encoded once, and the
documents' ids are the concatenation of their fragments' ids.

The public vocabularies define their merges within pre-tokens of a pattern.
A fragment is pre-tokenised by itself, which gives the same pre-tokens as the
whole text provided that no cut follows white space, touches an apostrophe or
falls inside a character; those cuts are left out (fewer cuts are always safe).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import textvec as tv
from .common import mapped

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fragments repeat within a slice: larger ones than other kernels' pay.
SLICE_BYTES = 2 << 20
#: Distinct fragments that a worker remembers between slices.
MEMORY = 250_000

_codecs: dict[bytes, "Codec"] = {}


class Codec:
    """Encoder and decoder of one rank file (its bytes, as read from a .tiktoken file)."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        inside = np.zeros(65536, dtype=bool)
        for token in self.ranks:
            raw = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            inside[raw[:-1] * 256 + raw[1:]] = True
        cut = ~inside.reshape(256, 256)
        cut[~tv.NOT_SPACE] = False
        cut[39] = cut[:, 39] = False
        for pair in ("re", "ve", "ll"):
            cut[ord(pair[0]), ord(pair[1])] = False
        cut[:, 128:192] = False
        self.cut = cut.reshape(-1)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.lengths)))
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        #: Tokens that aren't whole characters: of a byte-level vocabulary, its byte fallback.
        self.partial = np.array([not _whole(t) for t in tokens], dtype=bool)
        self.line_feed = self.ranks[b"\n"]
        self._forget()

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the fragments, the rows' starts included (rows without bytes have none)."""
        first = np.zeros(len(data), dtype=bool)
        if len(data) > 1:
            pair = data[:-1].astype(np.uint16) << np.uint16(8)
            pair |= data[1:]
            first[1:] = self.cut[pair]
            first[1:][_ends_wide_space(data)[:-1]] = False
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(first)

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the fragments, their slots in the arena, rows' byte offsets)."""
        data, offsets = tv.buffers(texts)
        if not len(data):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), offsets
        starts = self.fragments(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(spans)
        index = coded.indices.to_numpy(zero_copy_only=False)
        return starts, self._slots(coded.dictionary.to_pylist())[index], offsets

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each row."""
        starts, slots, offsets = self._coded(texts)
        ends = np.concatenate(([0], np.cumsum(self.slot_size[slots])))
        return np.diff(ends[np.searchsorted(starts, offsets)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another as int32, row offsets); null rows have no ids."""
        starts, slots, offsets = self._coded(texts)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        n = self.slot_size[slots]
        begin = np.cumsum(n) - n
        ids = self.arena[np.arange(int(n.sum())) + np.repeat(self.slot_at[slots] - begin, n)]
        ends = np.append(begin, n.sum())
        return ids, ends[np.searchsorted(starts, offsets)]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.arena = np.zeros(0, dtype=np.int32)
        self.slot_at = self.slot_size = np.zeros(0, dtype=np.int64)

    def _slots(self, fragments: list[bytes]) -> np.ndarray:
        """Where in the arena each fragment's ids are; fragments that aren't there yet are encoded and added.

        Fragments of letters (with a space before them at most) are encoded in
        one call, a line each: line feeds are pre-tokens of their own there.
        """
        if len(self.known) > MEMORY:
            self._forget()
        known, base = self.known, len(self.slot_at)
        plain, other = [], []
        for piece in fragments:
            if piece not in known:
                text = piece.decode("utf-8", errors="replace")
                (plain if text.isalpha() or (text[0] == " " and text[1:].isalpha()) else other).append((piece, text))
        if plain or other:
            ids = np.array(self.encoding.encode_ordinary("\n".join(t for _, t in plain)) if plain else [], dtype=np.int32)
            breaks = np.append(np.flatnonzero(ids == self.line_feed), len(ids))
            keep = ids != self.line_feed
            size = np.diff(breaks, prepend=-1) - 1 if plain else np.zeros(0, dtype=np.int64)
            rest = [self.encoding.encode_ordinary(t) for _, t in other]
            size = np.concatenate((size, np.fromiter(map(len, rest), dtype=np.int64, count=len(rest)))).astype(np.int64)
            at = len(self.arena) + np.cumsum(size) - size
            self.arena = np.concatenate([self.arena, ids[keep], np.array([i for r in rest for i in r], dtype=np.int32)])
            self.slot_at, self.slot_size = np.concatenate((self.slot_at, at)), np.concatenate((self.slot_size, size))
            known.update((piece, base + k) for k, (piece, _) in enumerate(plain + other))
        return np.fromiter(map(known.__getitem__, fragments), dtype=np.int64, count=len(fragments))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows one after another, and row offsets."""
        n = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(int(ends[-1])) + np.repeat(self.token_at[ids] - ends[:-1], n)
        return self.token_bytes[at], ends[offsets]


def _ends_wide_space(data: np.ndarray) -> np.ndarray:
    """Whether each byte is the last of a white-space character outside ASCII: U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    ends = np.zeros(len(data), dtype=bool)
    for lead, middle, last in ((0xC2, None, (0x85, 0xA0)), (0xE1, 0x9A, (0x80,)), (0xE2, 0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, (0x9F,)), (0xE3, 0x80, (0x80,))):
        at = np.flatnonzero(data == lead) + (1 if middle is None else 2)
        at = at[at < len(data)]
        good = np.isin(data[at], last)
        if middle is not None:
            good &= data[at - 1] == middle
        ends[at[good]] = True
    return ends


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def codec(content: bytes) -> Codec:
    """The codec of a rank file, built once in a process."""
    key = hashlib.md5(content).digest()
    if key not in _codecs:
        _codecs[key] = Codec(content)
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast of a vocabulary file's bytes (about 1 MB, whatever the corpus), read on the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def lists(ids: np.ndarray, offsets: np.ndarray, valid: pa.Array | None = None) -> pa.ListArray:
    """Arrow list<int32> rows; where `valid` (booleans) is false the row is null."""
    mask = pc.invert(valid) if valid is not None else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()), mask=mask)


def encode_documents(docs: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, tokens array<int>, n_tokens, n_bytes, round_trip) for every row of `docs`.

    round_trip says whether decoding gives the text's bytes again.  A null text
    has null tokens and round_trip and 0 counts; an empty text has no tokens.
    Null ids and repeated rows pass through row by row; other columns are not
    read, whatever their names.
    """
    shared = vocabulary(docs.sparkSession, path)

    def run(batches):
        bpe = codec(shared.value)
        for batch in batches:
            for part in tv.slices(batch, "text", SLICE_BYTES):
                texts = part.column("text")
                data, at = tv.buffers(texts)
                ids, offsets = bpe.encode(texts)
                again, back = bpe.decode(ids, offsets)
                same = np.diff(back) == np.diff(at)
                if len(again) == len(data):
                    wrong = np.concatenate(([0], np.cumsum(again != data)))
                    same &= wrong[at[1:]] == wrong[at[:-1]]
                else:
                    for i in np.flatnonzero(same):
                        same[i] = np.array_equal(again[back[i] : back[i + 1]], data[at[i] : at[i + 1]])
                valid = texts.is_valid()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists(ids, offsets, valid), pa.array(np.diff(offsets)), pa.array(np.diff(at)), pc.if_else(valid, pa.array(same), None)],
                    ["doc_id", "tokens", "n_tokens", "n_bytes", "round_trip"],
                )

    source = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return mapped(source, run, "doc_id long, tokens array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens array<int>).  Null tokens give a null text; ids outside the vocabulary raise an error."""
    shared = vocabulary(encoded.sparkSession, path)

    def run(batches):
        bpe = codec(shared.value)
        for batch in batches:
            tokens = batch.column("tokens")
            flat = tokens.flatten().to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            data, offsets = bpe.decode(flat, np.concatenate(([0], np.cumsum(counts))).astype(np.int64))
            texts = [data[a:b].tobytes().decode("utf-8", errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.if_else(tokens.is_valid(), pa.array(texts, type=pa.string()), None)], ["doc_id", "text"])

    return mapped(encoded.select(encoded["doc_id"].cast("long"), encoded["tokens"].cast("array<int>")), run, "doc_id long, text string")
