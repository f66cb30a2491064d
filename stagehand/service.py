"""The answers of the search service: HTTP paths and tool calls over a snapshot, with an index read from tables.

Events and index are tables that Spark keeps cached; a call runs one search job and at most 80 rows come back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagehand.operators import search

ARGUMENTS = {"query": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}, "venue": {"type": "string"}, "limit": {"type": "integer"}}
#: The tools with their descriptions and arguments.
TOOLS = {
    "search_shows": ("Shows by meaning, tags and venue; without a query the first ones in their order.", ARGUMENTS),
    "list_venues": ("Venues with the number of their shows.", {}),
}


class Service:
    """``events`` has ``idx`` (see ``search.event_chunks``); ``index`` has ``owner`` and ``vec``, or is None while there is none. ``page`` is the reader's page."""

    def __init__(self, events: DataFrame, index: DataFrame | None, venues: DataFrame, page: str = "", **models: Callable | None):
        self.events, self.index, self.venues, self.page, self.models = events.cache(), index.cache() if index is not None else None, venues.cache(), page, models

    def hits(self, query: str = "", tags: str | list[str] | None = None, venue: str | None = None, limit: int | None = None) -> DataFrame:
        """``Unavailable`` if there is no index that fits the events, whatever is asked."""
        if self.index is None:
            raise search.Unavailable("no index")
        return search.retrieve(self.events, self.index, self.venues, query, tags=search.parse_tags(tags), venue=(venue or "").strip() or None, limit=limit, **self.models)

    def search_shows(self, **asked) -> list[dict]:
        """The fields of each hit with its ``id`` and rounded ``score``."""
        rows = self.hits(**asked).drop("idx").withColumn("score", F.round("score", 4)).toJSON().collect()  # at most 80 rows
        return [json.loads(r) for r in rows]

    def list_venues(self) -> list[dict]:
        counted = self.events.groupBy(F.coalesce("venue_id", F.lit("")).alias("venue_id")).agg(F.count("*").alias("shows")).orderBy("venue_id")
        return [r.asDict() for r in counted.collect()]  # a row a venue

    def shows(self):
        """The extract as lines of JSON, streamed from the executors."""
        return self.events.orderBy("idx").drop("idx").toJSON().toLocalIterator()

    def answer(self, path: str, asked: dict[str, str]) -> tuple[int, object]:
        """(status, body) of a GET."""
        if path == "/api/search":
            limit = asked.get("limit", "")
            try:
                hits = self.hits(asked.get("q", "").strip(), asked.get("tags"), asked.get("venue"), int(limit) if limit.lstrip("-").isdigit() else 20)
                rows = hits.select("id", F.round("score", 4).alias("score")).collect()  # at most 80 rows
            except search.Unavailable as e:
                return 503, {"error": str(e)}
            return 200, {"ids": [r["id"] for r in rows], "scores": [r["score"] for r in rows], "count": len(rows)}
        return 404, {"error": "not found"}

    def called(self, request: dict) -> dict | None:
        """The answer to a JSON-RPC request for tools; None to a notification."""
        told = {"jsonrpc": "2.0", "id": request.get("id")}
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        if method == "initialize":
            return {**told, "result": {"protocolVersion": params.get("protocolVersion", "2025-03-26"), "capabilities": {"tools": {}}, "serverInfo": {"name": "stagehand", "version": "1"}}}
        if method == "tools/list":
            return {**told, "result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, (d, p) in TOOLS.items()]}}
        if method == "tools/call" and params.get("name") in TOOLS:
            given = {k: v for k, v in (params.get("arguments") or {}).items() if k in TOOLS[params["name"]][1]}
            try:
                rows, failed = getattr(self, params["name"])(**given), False
            except search.Unavailable as e:
                rows, failed = str(e), True
            return {**told, "result": {"content": [{"type": "text", "text": rows if failed else json.dumps(rows)}], "isError": failed}}
        return {**told, "error": {"code": -32601, "message": f"no method {method}"}}


def server(service: Service, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """An HTTP server: ``/``, ``/api/shows``, ``/api/search?q&tags&venue&limit``, and tools by POST at ``/mcp``, open to any origin."""
    class Handler(BaseHTTPRequestHandler):
        def start(self, status: int, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            if urlsplit(self.path).path == "/mcp":
                for name, value in (("Origin", "*"), ("Methods", "GET, POST, OPTIONS"), ("Headers", "*")):
                    self.send_header(f"Access-Control-Allow-{name}", value)
            self.end_headers()

        def say(self, status: int, body: object) -> None:
            self.start(status, "application/json")
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            if at.path == "/" and service.page:
                self.start(200, "text/html; charset=utf-8")
                self.wfile.write(service.page.encode())
            elif at.path == "/api/shows":
                self.start(200, "application/json")
                self.wfile.write(b'{"events": [')
                for n, line in enumerate(service.shows()):
                    self.wfile.write((", " if n else "").encode() + line.encode())
                self.wfile.write(b"]}")
            else:
                self.say(*service.answer(at.path, {k: v[0] for k, v in parse_qs(at.query).items()}))

        def do_OPTIONS(self) -> None:
            self.start(204, "text/plain")

        def do_POST(self) -> None:
            if urlsplit(self.path).path != "/mcp":
                return self.say(404, {"error": "not found"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            except ValueError:
                return self.say(400, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}})
            told = service.called(request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
            return self.say(200, told) if told else self.start(202, "application/json")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
