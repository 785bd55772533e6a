"""Tokeniser fertility: how well public vocabularies fit a document, with rejection bands per language or script.

For each vocabulary and document: characters per token, the share of byte
fallback (tokens of a byte-level vocabulary that aren't whole characters, byte
pieces of a piece vocabulary), and the entropy of the document's own token
distribution, in bits, as a share of what its token count allows (at most
2**10 tokens' worth: the entropy of a language levels off, log2 of a length doesn't).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bpe
from . import textvec as tv
from .common import mapped

VOCABULARIES = {"byte_en": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_multi": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "piece": "/opt/tokenizers/piece_bpe_32k.model"}


@dataclass(frozen=True)
class Band:
    """Documents inside are kept: characters per token from `low` to `high`, byte fallback up to `fallback`, relative entropy from `entropy`."""

    low: float = 1.3
    high: float = 8.0
    fallback: float = 0.35
    entropy: float = 0.6


@dataclass(frozen=True)
class Bands:
    """A band by language, else by script, else `default`; `short` for documents of fewer than `least` tokens, whose measures scatter."""

    by_lang: dict = field(default_factory=lambda: {"en": Band(1.3, 7.0, 0.10), "de": Band(1.3, 7.0, 0.20), "fr": Band(1.3, 7.0, 0.20), "es": Band(1.3, 7.0, 0.20)})
    by_script: dict = field(default_factory=lambda: {"Latin": Band(1.3, 7.0, 0.20), "Cyrillic": Band(0.8, 6.0, 0.60), "Greek": Band(0.6, 5.0, 0.80), "Arabic": Band(0.6, 5.0, 0.80), "Han": Band(0.3, 3.0, 0.98, 0.5), "Kana": Band(0.3, 3.0, 0.98, 0.5), "Hangul": Band(0.3, 3.0, 0.98, 0.5), "Devanagari": Band(0.3, 4.0, 0.98, 0.5)})
    default: Band = field(default_factory=lambda: Band(0.3, 8.0, 0.98, 0.5))
    short: Band = field(default_factory=lambda: Band(0.25, 16.0, 0.98, 0.0))
    least: int = 16

    def of(self, lang: str | None, script: str) -> Band:
        return self.by_lang.get(lang) or self.by_script.get(script) or self.default


SCRIPTS = ("Latin", "Greek", "Cyrillic", "Arabic", "Devanagari", "Kana", "Han", "Hangul", "Other")
_LEAD = np.full(256, SCRIPTS.index("Other"), dtype=np.uint8)
_LEAD[65:91] = _LEAD[97:123] = _LEAD[0xC3:0xCA] = 0
_LEAD[0xCE:0xD0] = 1
_LEAD[0xD0:0xD4] = 2
_LEAD[0xD8:0xDC] = 3
_LEAD[0xE3] = 5
_LEAD[0xE4:0xEA] = 6
_LEAD[0xEA:0xEE] = 7
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True


def scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index into SCRIPTS of each row's most frequent script, by the lead bytes of its letters; rows without letters are Other."""
    at = np.flatnonzero(_LETTER[data])
    kind = _LEAD[data[at]].copy()
    three = at[(data[at] == 0xE0) & (at + 1 < len(data))]
    if len(three):
        kind[np.searchsorted(at, three[(data[three + 1] >= 0xA4) & (data[three + 1] <= 0xA5)])] = 4
    row = np.searchsorted(offsets, at, side="right") - 1
    n = len(SCRIPTS)
    counts = np.bincount(row * n + kind, minlength=n * (len(offsets) - 1)).reshape(-1, n)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), n - 1)


def entropy(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Entropy of each row's ids over log2 of their number, 10 at most; 1 for rows of one id, 0 for none."""
    rows = len(offsets) - 1
    n = np.diff(offsets)
    row = np.repeat(np.arange(rows, dtype=np.int64), n)
    keys = np.sort((row << 32) | ids.astype(np.int64))
    if not len(keys):
        return np.zeros(rows)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.append(first, len(keys))).astype(np.float64)
    plogp = np.bincount((keys[first] >> 32), weights=count * np.log2(count), minlength=rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(n) - plogp / n
        return np.where(n > 1, np.maximum(bits, 0) / np.minimum(np.log2(n), 10), np.minimum(n, 1))


class _Pieces:
    """A sentencepiece vocabulary with the codec's interface."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.partial = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode(pc.fill_null(texts, "").to_pylist(), num_threads=1)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum())), np.concatenate(([0], np.cumsum(sizes)))


_pieces: dict[str, _Pieces] = {}


def _encoder(name: str, path: str, content: bytes):
    if path.endswith(".model"):
        if name not in _pieces:
            _pieces[name] = _Pieces(content)
        return _pieces[name]
    return bpe.codec(content)


def fertility(docs: DataFrame, vocabularies: dict[str, str] | None = None, bands: Bands | None = None) -> DataFrame:
    """Measures and verdict for every row of `docs` (doc_id, text, lang).

    Columns: doc_id, lang, script, n_chars, then for each vocabulary v
    v_tokens, v_chars_per_token, v_fallback, v_entropy, and keep, reason.  The
    vocabulary that fits a document best, the one with the fewest tokens (of
    equal ones the first), judges it: a vocabulary made for other languages
    doesn't condemn it, nor does one that fits it badly acquit it.  The
    document is kept if that vocabulary's measures are within its band;
    `reason` is the first measure that isn't, in the order few characters a
    token, many, byte fallback, entropy.  Texts of fewer than `Bands.least`
    tokens have a band of their own; null and empty texts aren't kept (reason
    "empty").  Null ids, unknown languages, repeated rows and other columns
    have no influence.
    """
    vocabularies, bands = vocabularies or VOCABULARIES, bands or Bands()
    shared = {name: (path, bpe.vocabulary(docs.sparkSession, path)) for name, path in vocabularies.items()}
    per = "".join(f", {v}_tokens long, {v}_chars_per_token double, {v}_fallback double, {v}_entropy double" for v in vocabularies)
    names = ["doc_id", "lang", "script", "n_chars", *(f"{v}_{m}" for v in vocabularies for m in ("tokens", "chars_per_token", "fallback", "entropy")), "keep", "reason"]

    def run(batches):
        encoders = {v: _encoder(v, path, content.value) for v, (path, content) in shared.items()}
        for batch in batches:
            for part in tv.slices(batch, "text", bpe.SLICE_BYTES):
                texts, lang = part.column("text"), part.column("lang")
                data, at = tv.buffers(texts)
                script = scripts(data, at)
                chars = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
                kinds: dict[tuple, int] = {}
                kind = np.fromiter((kinds.setdefault(k, len(kinds)) for k in zip(lang.to_pylist(), script.tolist())), dtype=np.int64, count=len(part))
                chosen = [bands.of(a, SCRIPTS[b]) for a, b in kinds]
                band = {f: np.array([getattr(b, f) for b in (*chosen, bands.short)]) for f in ("low", "high", "fallback", "entropy")}
                columns, fewest, wrong = [], np.full(len(part), np.iinfo(np.int64).max), np.zeros(len(part), dtype=np.int64)
                for encoder in encoders.values():
                    ids, offsets = encoder.encode(texts)
                    n = np.diff(offsets)
                    per_token = chars / np.maximum(n, 1)
                    sums = np.concatenate(([0], np.cumsum(encoder.partial[ids])))
                    fallback = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)
                    spread = entropy(ids, offsets)
                    own = np.where(n < bands.least, len(chosen), kind)
                    found = np.select([per_token < band["low"][own], per_token > band["high"][own], fallback > band["fallback"][own], spread < band["entropy"][own]], [1, 2, 3, 4], 0)
                    best = n < fewest
                    wrong, fewest = np.where(best, found, wrong), np.minimum(fewest, n)
                    columns += [pa.array(n), pa.array(per_token), pa.array(fallback), pa.array(spread)]
                keep = (wrong == 0) & (chars > 0)
                reasons = pa.array(["few characters a token", "many characters a token", "byte fallback", "entropy", "empty"])
                reason = pc.if_else(pa.array(keep), None, reasons.take(pa.array(np.where(chars > 0, wrong - 1, 4).clip(0))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lang, pa.array(SCRIPTS).take(pa.array(script)), pa.array(chars.astype(np.int64)), *columns, pa.array(keep), reason], names)

    source = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["lang"].cast("string"))
    return mapped(source, run, f"doc_id long, lang string, script string, n_chars long{per}, keep boolean, reason string")
