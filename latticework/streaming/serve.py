"""A graph over HTTP: JSON answers from the last whole version of a live graph, and its feed.

    /nodes?language=&kind=&repo=&limit=   /node?id=   /edges?source=&target=&relation=
    /search?q=&top=   /similar?id=&top=   /hot?top=&weight=   /stats   /feed?topic=&repo=&since=

A subscriber asks /feed again with the last batch that it has seen; `wait`
seconds at most pass before an empty answer.  Answers are bounded by `limit` and
`top`, which are part of the question.
"""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, ranking, search, similarity, stats
from .watch import LiveGraph

#: Rows of an answer where the question names no limit.
LIMIT = 100


def answer(live: LiveGraph, path: str, asked: dict[str, str]) -> list[dict] | None:
    """Rows for a path and its parameters; None if there is no such path."""
    g, top = live.read(), int(asked.get("top", 10))
    limit = int(asked.get("limit", LIMIT))
    chosen = lambda *names: {n: asked[n] for n in names if n in asked}
    rows: DataFrame
    if path == "/nodes":
        rows = filters.api_nodes(filters.nodes(g, **chosen("language", "kind", "repo"), limit=limit))
    elif path == "/node":
        rows = filters.api_nodes(filters.node(g, asked.get("id", "")))
    elif path == "/edges":
        rows = filters.api_edges(filters.edges(g, **chosen("source", "target", "relation"))).limit(limit)
    elif path == "/search":
        rows = search.search(g, asked.get("q", ""), top)
    elif path == "/similar":
        rows = similarity.find_similar_by_name(g, asked.get("id", ""), top)
    elif path == "/hot":
        rows = ranking.hot_paths(g, top, asked.get("weight", "in_degree")).orderBy("rank")
    elif path == "/stats":
        rows = stats.graph_stats(g)
    elif path == "/feed":
        end = time.monotonic() + float(asked.get("wait", 0))
        while True:
            rows = live.feed(asked.get("topic"), asked.get("repo"), int(asked.get("since", -1)))
            if time.monotonic() >= end or not rows.isEmpty():
                break
            time.sleep(0.2)
        rows = rows.orderBy("batch", "topic", "id").limit(limit)
    else:
        return None
    return [r.asDict(recursive=True) for r in rows.collect()]


def server(live: LiveGraph, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to `serve_forever`; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            where = urlsplit(self.path)
            try:
                rows = answer(live, where.path, dict(parse_qsl(where.query)))
                status, body = (200, rows) if rows is not None else (404, {"error": f"no {where.path}"})
            except ValueError as e:
                status, body = 400, {"error": str(e)}
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
