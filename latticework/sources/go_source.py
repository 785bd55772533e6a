"""Symbols and edges of Go files, from a token scan of the top level."""

from __future__ import annotations

from .lexer import Token, between, closing, tokens
from .records import Collector

_NOT_CALLED = {"func", "if", "for", "switch", "select", "return", "go", "defer", "range", "case", "var", "const", "type", "map", "chan", "interface", "struct", "else"}


def _calls(out: Collector, caller: str, ts: list[Token]) -> None:
    """Callees as dotted names, in order of their brackets."""
    for i, t in enumerate(ts):
        if t.text == "(" and i and ts[i - 1].kind == "word" and ts[i - 1].text not in _NOT_CALLED:
            k, parts = i - 1, [ts[i - 1].text]
            while k >= 2 and ts[k - 1].text == "." and ts[k - 2].kind == "word":
                parts.append(ts[k - 2].text)
                k -= 2
            if k and ts[k - 1].text == "func":
                continue
            out.edge(caller, ".".join(reversed(parts)), "calls", ts[k].line)


def _fields(out: Collector, owner: str, ts: list[Token]) -> None:
    """Embedded types of a struct body: lines that hold a type and no field name."""
    i = 0
    while i < len(ts):
        depth, last = 0, i
        for k in range(i, len(ts)):
            if depth == 0 and (ts[k].line != ts[i].line or ts[k].text == ";"):
                break
            depth += (ts[k].text in "([{") - (ts[k].text in ")]}")
            last = k
        line = [t for t in ts[i : last + 1] if t.kind != "string" and t.text != ";"]
        bare = line[1:] if line and line[0].text == "*" else line
        if bare and all(t.kind == "word" for t in bare[::2]) and all(t.text == "." for t in bare[1::2]) and len(bare) in (1, 3):
            out.edge(owner, "".join(t.text for t in bare), "inherits", bare[0].line)
        i = max(last + 1, i + 1)


def _function(out: Collector, text: str, ts: list[Token], i: int) -> int:
    """A declaration that starts with `func` at i; the index after it."""
    k, receiver = i + 1, ""
    if k < len(ts) and ts[k].text == "(":
        end = closing(ts, k)
        kind = [t for t in ts[k + 1 : end] if t.text != ","]
        star = any(t.text == "*" for t in kind)
        names = [t.text for t in kind if t.kind == "word"]
        dotted = any(t.text == "." for t in kind)
        receiver = ("*" if star else "") + (".".join(names[-2:]) if dotted else (names[-1] if names else ""))
        k = end + 1
    if k >= len(ts) or ts[k].kind != "word":
        return i + 1
    name, line = ts[k].text, ts[k].line
    k += 1
    if k < len(ts) and ts[k].text == "[":
        k = closing(ts, k) + 1
    parts = ["func", *([f"({receiver})"] if receiver else []), name]
    body_from = k
    if k < len(ts) and ts[k].text == "(":
        end = closing(ts, k)
        parts.append(between(text, ts, k, end))
        k = end + 1
        # A plain named result belongs to the signature; lists and composite types don't.
        if k < len(ts) and ts[k].kind == "word" and ts[k].text not in ("struct", "interface", "map", "chan", "func"):
            stop = k + 2 if k + 2 < len(ts) and ts[k + 1].text == "." else k
            parts.append(between(text, ts, k, stop))
    while k < len(ts) and ts[k].text != "{":
        if ts[k].text == "func" or ts[k].line > ts[max(k - 1, 0)].line and ts[k].text in ("type", "var", "const", "import"):
            break
        k = closing(ts, k) + 1 if ts[k].text in "([" else k + 1
    end = closing(ts, k) if k < len(ts) and ts[k].text == "{" else min(k, len(ts)) - 1
    me = out.symbol(name, "method" if receiver else "function", line, "", " ".join(parts), receiver.lstrip("*") or None)
    _calls(out, me, ts[body_from : end + 1])
    return max(end + 1, i + 1)


def extract(filepath: str, text: str) -> list[dict]:
    out, ts, i = Collector(filepath, "go"), tokens(text), 0
    while i < len(ts):
        word = ts[i].text if ts[i].kind == "word" else ""
        if word == "import":
            group = i + 1 < len(ts) and ts[i + 1].text == "("
            end = closing(ts, i + 1) if group else next((k for k in range(i, len(ts)) if ts[k].kind == "string"), i)
            for t in ts[i : end + 1]:
                if t.kind == "string":
                    out.edge(filepath, t.text.strip('"`'), "imports", t.line)
            i = end + 1
        elif word == "type" and i + 1 < len(ts):
            k = i + 2 if ts[i + 1].text == "(" else i + 1
            if k + 1 < len(ts) and ts[k].kind == "word":
                what = ts[k + 1].text if ts[k + 1].text in ("struct", "interface") else "type"
                me = out.symbol(ts[k].text, what, ts[k].line)
                if what == "struct" and k + 2 < len(ts) and ts[k + 2].text == "{":
                    _fields(out, me, ts[k + 3 : closing(ts, k + 2)])
            if ts[i + 1].text == "(":
                i = closing(ts, i + 1) + 1
            else:
                brace = k + 2 if k + 2 < len(ts) and ts[k + 2].text == "{" else None
                i = closing(ts, brace) + 1 if brace else k + 1
        elif word == "func":
            i = _function(out, text, ts, i)
        else:
            i += 1
    return out.rows
