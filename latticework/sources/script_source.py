"""Symbols and edges of TypeScript and JavaScript files.

`extract` scans tokens of the top level, and matches line by line what the scan
can't make sense of; `by_line` does the latter for whole tables, as Column
expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexer import Token, between, closing, tokens
from .records import Collector

_NOT_CALLED = {"if", "while", "for", "switch", "catch", "return", "function", "typeof", "await", "super", "import", "of", "in", "new", "async"}


def _calls(out: Collector, caller: str, ts: list[Token]) -> None:
    """Dotted callees and capitalised elements of markup."""
    for i, t in enumerate(ts):
        if t.text == "(" and i and ts[i - 1].kind == "word" and ts[i - 1].text not in _NOT_CALLED:
            k, parts = i - 1, [ts[i - 1].text]
            while k >= 2 and ts[k - 1].text == "." and ts[k - 2].kind == "word":
                parts.append(ts[k - 2].text)
                k -= 2
            before = ts[k - 1].text if k else ""
            if before not in ("function", "new"):
                out.edge(caller, ".".join(reversed([p for p in parts if p != "this"])), "calls", ts[k].line)
        elif t.text == "<" and i + 1 < len(ts) and ts[i + 1].kind == "word" and ts[i + 1].text[0].isupper() and t.end == ts[i + 1].start:
            # After a word a `<` begins type arguments.
            if not i or ts[i - 1].kind != "word" or ts[i - 1].text == "return":
                out.edge(caller, ts[i + 1].text, "calls", t.line)


def _params(text: str, ts: list[Token], i: int) -> str:
    return between(text, ts, i, closing(ts, i)) if i < len(ts) and ts[i].text == "(" else "()"


def _find(ts: list[Token], i: int, sign: str) -> int:
    """Index of a sign at this depth from i on, or the number of tokens."""
    while i < len(ts) and ts[i].text != sign:
        if ts[i].text in (";",):
            return len(ts)
        i = closing(ts, i) + 1 if ts[i].kind == "sign" and ts[i].text in "([{" else i + 1
    return i


class _Scan:
    def __init__(self, filepath: str, text: str):
        self.out, self.text, self.ts = Collector(filepath, "typescript"), text, tokens(text)

    def exported(self, name: str, line: int, export: bool, default: bool) -> None:
        for target in [name] * export + ["default"] * default:
            self.out.edge(self.out.filepath, target, "exports", line)

    def imports(self, i: int) -> int:
        ts = self.ts
        end = next((k for k in range(i, len(ts)) if ts[k].kind == "string"), None)
        if end is None:
            return i + 1
        module, k = ts[end].text[1:-1], i + 1
        while k < end:
            if ts[k].text == "{":
                stop, names = closing(ts, k), []
                for t in [*ts[k + 1 : stop], ts[stop]]:
                    if t.text in (",", "}"):
                        if names:
                            self.out.edge(self.out.filepath, f"{module}::{names[-1].text}", "imports", names[0].line)
                        names = []
                    elif t.kind == "word" and t.text not in ("as", "type"):
                        names.append(t)
                k = stop
            elif ts[k].kind == "word" and ts[k].text not in ("from", "type", "as") and ts[k - 1].text not in ("as", "*"):
                self.out.edge(self.out.filepath, module, "imports", ts[k].line)
            k += 1
        return end + 1

    def function(self, i: int, export: bool, default: bool) -> int:
        ts, line = self.ts, self.ts[i].line
        k = i + 1 + (i + 1 < len(ts) and ts[i + 1].text == "*")
        named = k < len(ts) and ts[k].kind == "word"
        name = ts[k].text if named else "anonymous"
        k = _find(ts, k, "(")
        me = self.out.symbol(name, "function", line, "", _params(self.text, ts, k))
        self.exported(name, line, export, default)
        brace = _find(ts, closing(ts, k) + 1, "{") if k < len(ts) else len(ts)
        if brace >= len(ts):
            return i + 1
        end = closing(ts, brace)
        _calls(self.out, me, ts[brace + 1 : end])
        return end + 1

    def type_like(self, i: int, export: bool, default: bool) -> int:
        ts, line, kind = self.ts, self.ts[i].line, self.ts[i].text
        named = i + 1 < len(ts) and ts[i + 1].kind == "word" and ts[i + 1].text != "extends"
        name = ts[i + 1].text if named else "Anonymous"
        brace = next((k for k in range(i, len(ts)) if ts[k].text == "{"), len(ts))
        bases = []
        if kind == "class":
            head = ts[i:brace]
            at = next((k for k, t in enumerate(head) if t.text == "extends"), None)
            if at is not None and at + 1 < len(head) and head[at + 1].kind == "word":
                bases = [head[at + 1].text]
        me = self.out.symbol(name, kind, line, "", f"({', '.join(bases)})")
        for b in bases:
            self.out.edge(me, b, "inherits", line)
        self.exported(name, line, export, default)
        if brace >= len(ts):
            return i + 1
        end = closing(ts, brace)
        if kind == "class":
            self.members(name, me, brace + 1, end)
        return end + 1

    def members(self, owner: str, owner_id: str, i: int, end: int) -> None:
        ts, modifiers = self.ts, ("public", "private", "protected", "static", "async", "readonly", "get", "set", "abstract", "override", "*")
        while i < end:
            start = i
            while i < end and ts[i].text in modifiers and i + 1 < end and ts[i + 1].text not in ("(", "=", ":", ";"):
                i += 1
            if ts[i].kind != "word":
                i = closing(ts, i) + 1 if ts[i].text in ("(", "[", "{") else i + 1
                continue
            name, line, k = ts[i].text, ts[start].line, i + 1
            if k < end and ts[k].text == "<":
                k = _find(ts, k, "(")
            if k < end and ts[k].text == "(":
                me = self.out.symbol(name, "function", line, "", _params(self.text, ts, k), owner)
                k = closing(ts, k) + 1
                while k < end and ts[k].text not in ("{", ";"):
                    k += 1
                if k < end and ts[k].text == "{":
                    stop = closing(ts, k)
                    _calls(self.out, me, ts[k + 1 : stop])
                    k = stop
                i = k + 1
            else:
                self.out.symbol(name, "function", line, "", "()", owner)
                stop = min(_find(ts, k, ";"), end)
                nxt = next((j for j in range(k, end) if ts[j].text == ";" or ts[j].line > ts[j - 1].line and ts[j - 1].text not in ("=", "{", ",", "(")), end)
                i = max(min(stop, nxt) + (nxt < end and ts[nxt].text == ";"), k)

    def variables(self, i: int, export: bool, default: bool) -> int:
        ts, k = self.ts, i + 1
        while k < len(ts) and ts[k].kind == "word":
            name, line = ts[k].text, ts[k].line
            equals = k + 1
            while equals < len(ts) and ts[equals].text not in ("=", ";", ",") and ts[equals].line - line < 3:
                equals = closing(ts, equals) + 1 if ts[equals].text in ("(", "[", "{") else equals + 1
            v = equals + 1 if equals < len(ts) and ts[equals].text == "=" else len(ts)
            v += v < len(ts) and ts[v].text == "async"
            arrow = None
            if v < len(ts):
                after = closing(ts, v) + 1 if ts[v].text == "(" else v + 1
                stop = after
                while stop < len(ts) and ts[stop].text not in ("=>", ";", "{", ",", "=") and ts[stop].line - ts[v].line < 20:
                    stop += 1
                arrow = stop if stop < len(ts) and ts[stop].text == "=>" and (ts[v].text == "(" or stop == v + 1) else None
            if arrow is not None:
                me = self.out.symbol(name, "function", line, "", _params(self.text, ts, v))
                k = arrow + 1
                if k < len(ts) and ts[k].text == "{":
                    end = closing(ts, k)
                    _calls(self.out, me, ts[k + 1 : end])
                    k = end + 1
            else:
                self.out.symbol(name, "variable", line)
                k = equals
            self.exported(name, line, export, default)
            while k < len(ts) and ts[k].text not in (";", ",") and not (ts[k].line > ts[k - 1].line and ts[k].kind == "word" and ts[k - 1].text not in ("=", "=>", "+", ".", "?", ":", "(")):
                k = closing(ts, k) + 1 if ts[k].text in ("(", "[", "{") else k + 1
            if k >= len(ts) or ts[k].text != ",":
                break
            k += 1
        return max(k, i + 1)

    def run(self) -> list[dict]:
        ts, i = self.ts, 0
        for k, t in enumerate(ts):
            if t.text == "import" and t.kind == "word" and (not k or ts[k - 1].line < t.line or ts[k - 1].text == ";") and k + 1 < len(ts) and ts[k + 1].text != "(":
                self.imports(k)
        while i < len(ts):
            line, export, default = ts[i].line, False, False
            start = i
            if ts[i].text == "export":
                export, i = True, i + 1
                if i < len(ts) and ts[i].text == "default":
                    default, i = True, i + 1
            while i < len(ts) and ts[i].text in ("async", "abstract", "declare"):
                i += 1
            word = ts[i].text if i < len(ts) and ts[i].kind == "word" else ""
            if word == "function":
                i = self.function(i, export, default)
            elif word in ("class", "interface"):
                i = self.type_like(i, export, default)
            elif word in ("const", "let", "var"):
                i = self.variables(i, export, default)
            else:
                if export:
                    self.out.edge(self.out.filepath, "default" if default else "*", "exports", line)
                i = closing(ts, i) + 1 if i < len(ts) and ts[i].kind == "sign" and ts[i].text in "([{" else max(i, start + 1) if i > start else i + 1
        return self.out.rows


#: What a line can hold: kind and pattern of its name.
PATTERNS = (
    ("function", r"function\s+(\w+)"),
    ("function", r"(?:var|let|const)\s+(\w+)\s*=[^=]*=>"),
    ("class", r"class\s+(\w+)"),
    ("interface", r"interface\s+(\w+)"),
    ("imports", r"""import\s+(?:(?:\w+|[{][^}]+[}])\s+from\s+)?["']([^"']+)["']"""),
    ("exports", r"export\s+(?:default\s+)?(?:const|let|var|interface|class|function)?\s*(\w+)?"),
    ("calls", r"(\w+)\s*[(]"),
    ("calls", r"<([A-Z]\w*)(?:\s|/?>)"),
)
_NO_CALLS = ("if", "while", "for", "switch", "catch", "return")
_ENDS = r"\r\n|\n|\r"


def scan_lines(filepath: str, text: str) -> list[dict]:
    """Rows of one file as `by_line` finds them, for a file whose tokens can't be scanned."""
    out = Collector(filepath, "typescript")
    for line, content in enumerate(re.split(_ENDS, text), 1):
        for place, (what, pattern) in enumerate(PATTERNS):
            for name in re.findall(pattern, content, re.ASCII):
                if what in ("function", "class", "interface"):
                    out.symbol(name, what, line, signature="()")
                elif what != "calls" or place != 6 or name not in _NO_CALLS:
                    out.edge(filepath, name or "*", what, line)
    return out.rows


def extract(filepath: str, text: str) -> list[dict]:
    """Rows of one file by its tokens; line by line if brackets or nesting defeat that."""
    try:
        return _Scan(filepath, text).run()
    except (IndexError, RecursionError):
        return scan_lines(filepath, text)




def _labelled(place: int, what: str):
    return lambda x: F.struct(F.lit(place).alias("place"), F.lit(what).alias("what"), x.alias("name"))


def by_line(files: DataFrame) -> DataFrame:
    """Rows (filepath, text) -> (filepath, line, what, name): what is function, class, interface, imports, exports or calls.

    Each line is matched by itself on the JVM; symbols have no parent, every
    edge starts at the file.
    """
    lines = files.select("filepath", F.posexplode(F.split("text", _ENDS)).alias("n", "line"))
    found = []
    for place, (what, pattern) in enumerate(PATTERNS):
        names = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
        if what == "exports":
            names = F.transform(names, lambda x: F.when(F.coalesce(x, F.lit("")) == "", "*").otherwise(x))
        if what == "calls" and place == 6:
            names = F.filter(names, lambda x: ~x.isin(*_NO_CALLS))
        found.append(F.transform(names, _labelled(place, what)))
    return lines.select("filepath", (F.col("n") + 1).alias("line"), F.explode(F.concat(*found)).alias("f")).select("filepath", "line", "f.place", "f.what", "f.name")
