"""What source readers yield: rows of one table that holds symbols and edges."""

from __future__ import annotations

#: `what` is "symbol" or "edge"; the other's columns are null.
EXTRACTED = "filepath string, place int, what string, id string, name string, kind string, line int, docstring string, signature string, parent string, language string, source string, target string, relation string, error string"


class Collector:
    """Symbols and edges of one file in the order in which they are met."""

    def __init__(self, filepath: str, language: str):
        self.filepath, self.language, self.rows = filepath, language, []

    def symbol(self, name, kind, line, docstring="", signature="", parent=None) -> str:
        ident = f"{self.filepath}::{parent}.{name}" if parent else f"{self.filepath}::{name}"
        self.rows.append({"what": "symbol", "id": ident, "name": name, "kind": kind, "line": line, "docstring": docstring, "signature": signature, "parent": parent, "language": self.language})
        return ident

    def edge(self, source, target, relation, line) -> None:
        self.rows.append({"what": "edge", "source": source, "target": target, "relation": relation, "line": line})
