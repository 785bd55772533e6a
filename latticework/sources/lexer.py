"""Tokens of brace languages: words, numbers, strings and signs, with line numbers; comments are skipped."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, sign
    text: str
    line: int
    start: int
    end: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<word>[^\W\d]\w*|\$\w*)|(?P<number>\d[\w.]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<sign>=>|\.\.\.|:=|</|/>|.)""",
    re.S | re.X,
)


def tokens(text: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), line, m.start(), m.end()))
        line += m.group().count("\n")
    return out


_OPEN, _CLOSE = "([{", ")]}"


def closing(ts: list[Token], i: int) -> int:
    """Index of the bracket that closes the one at `i`; the last index if none does."""
    depth = 0
    for k in range(i, len(ts)):
        if ts[k].kind == "sign":
            depth += (ts[k].text in _OPEN) - (ts[k].text in _CLOSE)
            if depth == 0:
                return k
    return len(ts) - 1


def between(text: str, ts: list[Token], i: int, j: int) -> str:
    return text[ts[i].start : ts[j].end]
