"""Edit distances of many pairs of strings at once: Myers' bit-vectors, a numpy step for a character of all pairs together.

Only the words of 64 rows that a distance within the bound can pass through are
worked out; rows above them are taken to grow by one a step, which never makes
a distance too small, and leaves those within the bound as they are.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONE, _TOP = _U(1), _U(63)
#: Pairs are worked out together with those of a like number of words and a like bound.
WIDTHS, BANDS = (1, 2, 4, 8, 16, 32, 64), (24, 48, 96, 192, 1 << 60)
#: Patterns of more words than `WIDE`, if they are fewer than `MANY` together, go one by one, as Python's long integers; so do those of more than `WIDTHS`.
WIDE, MANY = 8, 64
#: Bytes of a group's table of character masks.
TABLE = 64 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points one after another, offsets)."""
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offsets


def _same(a: np.ndarray, start_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """How many characters agree from the starts on, in steps of 1 or -1, `size` at most."""
    out = size.copy()
    some = np.flatnonzero(size > 0)
    if len(some):
        n = size[some]
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = a[np.repeat(start_a[some], n) + step * k] == b[np.repeat(start_b[some], n) + step * k]
        out[some] = np.minimum(np.minimum.reduceat(np.where(equal, np.iinfo(np.int64).max, k), first), n)
    return out


def _one(pattern: np.ndarray, text: np.ndarray, allowed: int) -> int:
    """The distance if it is within `allowed`, else more than that."""
    m, n = len(pattern), len(text)
    masks: dict[int, int] = {}
    for word in range(0, m, 4096):
        part: dict[int, int] = {}
        for i, c in enumerate(pattern[word : word + 4096].tolist()):
            part[c] = part.get(c, 0) | 1 << i
        for c, bits in part.items():
            masks[c] = masks.get(c, 0) | bits << word
    # Rows `first` to `last` of the pattern are worked out, for a stretch of the text at a time.
    stretch, first, last = max(allowed, 1024), 0, 0
    plus = minus = score = 0
    for start in range(0, n, stretch):
        skip, reach = max(0, start - allowed) - first, min(m, start + stretch + allowed) - last
        first, last, score = first + skip, last + reach, score + reach
        width = last - first
        every, top = (1 << width) - 1, 1 << (width - 1)
        plus, minus = plus >> skip | (every >> (width - reach)) << (width - reach), minus >> skip
        near = {c: bits >> first & every for c, bits in masks.items()}
        for c in text[start : start + stretch].tolist():
            eq = near.get(c, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up, down = (minus | ~(across | plus)) & every, plus & across
            score += bool(up & top) - bool(down & top)
            up, down = up << 1 | 1, down << 1
            plus, minus = (down | ~(vertical | up)) & every, up & vertical & every
    return score


def _group(codes: np.ndarray, at_p: np.ndarray, size_p: np.ndarray, at_t: np.ndarray, size_t: np.ndarray, allowed: np.ndarray, letters: int, words: int) -> np.ndarray:
    """Distances of pairs whose patterns take up to `words` words, if they are within `allowed`, else more than that; texts in descending order of size."""
    n, band = len(size_p), int(allowed.max())
    masks = np.zeros((words, n * letters), dtype=np.uint64)
    row = np.repeat(np.arange(n), size_p)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size_p) - size_p, size_p)
    # Every (pair, letter, word, bit) occurs once, so adding is setting.
    np.add.at(masks, (place >> 6, row * letters + codes[np.repeat(at_p, size_p) + place]), _ONE << (place & 63).astype(np.uint64))
    plus = np.full((words, n), ~_U(0))
    minus = np.zeros((words, n), dtype=np.uint64)
    base, out = np.arange(n) * letters, np.zeros(n, dtype=np.int64)
    last_word, above = (size_p - 1) >> 6, ~_U(0) << ((size_p - 1) & 63).astype(np.uint64) << _ONE
    # The distance at the lowest row of the lowest word that has been reached.
    low = min(words - 1, band >> 6)
    score, live = np.full(n, 64 * (low + 1)), n
    for step in range(int(size_t[0])):
        at = base[:live] + codes[at_t[:live] + step]
        while low < min(words - 1, (step + band) >> 6):
            low += 1
            score += 64
        up_in, down_in = np.full(live, _ONE), np.zeros(live, dtype=np.uint64)
        for w in range(max(0, step - band) >> 6, low + 1):
            eq, p, m = masks[w][at], plus[w, :live], minus[w, :live]
            vertical = eq | m
            eq = eq | down_in
            across = (((eq & p) + p) ^ p) | eq
            up, down = m | ~(across | p), p & across
            up_out, down_out = up >> _TOP, down >> _TOP
            up, down = up << _ONE | up_in, down << _ONE | down_in
            plus[w, :live], minus[w, :live] = down | ~(vertical | up), up & vertical
            up_in, down_in = up_out, down_out
        score[:live] += up_in.view(np.int64) - down_in.view(np.int64)
        left = int(np.searchsorted(-size_t[:live], -step - 1, side="left"))
        if left < live:
            done = slice(left, live)
            out[done] = score[done]
            # Back from the lowest row to the pattern's last.
            for w in range(int(last_word[done].min()), low + 1):
                rest = np.where(last_word[done] == w, above[done], np.where(last_word[done] < w, ~_U(0), _U(0)))
                out[done] += np.bitwise_count(minus[w, done] & rest).astype(np.int64) - np.bitwise_count(plus[w, done] & rest).astype(np.int64)
            live = left
    return out


def _letters_differ(codes: np.ndarray, at_p: np.ndarray, size_p: np.ndarray, at_t: np.ndarray, size_t: np.ndarray, letters: int) -> np.ndarray:
    """A lower bound of each distance: how often letters must be changed for both sides to have the same."""
    out, most = np.zeros(len(size_p), dtype=np.int64), max(1, (1 << 21) // max(letters, 1))
    for start in range(0, len(out), most):
        part = slice(start, start + most)
        counts = []
        for at, size in ((at_p[part], size_p[part]), (at_t[part], size_t[part])):
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            counts.append(np.bincount(row * letters + codes[np.repeat(at, size) + place], minlength=len(size) * letters).reshape(-1, letters))
        apart = counts[0] - counts[1]
        out[part] = np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1))
    return out


def within(left: list[str], right: list[str], allowed: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most `allowed`."""
    n = len(left)
    result = np.zeros(n, dtype=bool)
    if not n:
        return result
    a, at_a = _codes(left)
    b, at_b = _codes(right)
    # The letters that occur, numbered.
    letters = np.zeros(0x110000, dtype=bool)
    letters[a] = letters[b] = True
    number = np.cumsum(letters) - 1
    a, b, letters = number[a], number[b], int(number[-1]) + 1
    size_a, size_b = np.diff(at_a), np.diff(at_b)
    at_a, at_b = at_a[:-1], at_b[:-1]
    # What agrees at either end costs nothing.
    shorter = np.minimum(size_a, size_b)
    head = _same(a, at_a, b, at_b, shorter, 1)
    tail = _same(a, at_a + size_a - 1, b, at_b + size_b - 1, shorter - head, -1)
    at_a, at_b, size_a, size_b = at_a + head, at_b + head, size_a - head - tail, size_b - head - tail
    swap = size_a > size_b
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    result[(small == 0) & (large <= allowed)] = True
    open_ = (small > 0) & (large - small <= allowed) & (allowed > 0)
    result[(small > 0) & (large <= allowed)] = True
    open_ &= ~result
    # One array for both sides: the pattern is the shorter.
    codes = np.concatenate((a, b))
    at_b = at_b + len(a)
    at_p, at_t = np.where(swap, at_b, at_a), np.where(swap, at_a, at_b)
    some = np.flatnonzero(open_)
    open_[some] = _letters_differ(codes, at_p[some], small[some], at_t[some], large[some], letters) <= allowed[some]
    words = (small + 63) >> 6
    low = 0
    single = [np.flatnonzero(open_ & (words > WIDTHS[-1]))]
    for width in WIDTHS:
        narrow = -1
        for band in BANDS if width > 1 else BANDS[-1:]:
            mine = np.flatnonzero(open_ & (words > low) & (words <= width) & (allowed > narrow) & (allowed <= band))
            narrow = band
            if width > WIDE and len(mine) < MANY:
                single.append(mine)
                continue
            mine = mine[np.argsort(-large[mine], kind="stable")]
            most = max(1, TABLE // (8 * width * max(letters, 1)))
            for start in range(0, len(mine), most):
                k = mine[start : start + most]
                result[k] = _group(codes, at_p[k], small[k], at_t[k], large[k], allowed[k], letters, width) <= allowed[k]
        low = width
    for k in np.concatenate(single).tolist():
        result[k] = _one(codes[at_p[k] : at_p[k] + small[k]], codes[at_t[k] : at_t[k] + large[k]], int(allowed[k])) <= allowed[k]
    return result
