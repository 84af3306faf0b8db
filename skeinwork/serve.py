"""A loopback-only HTTP front for query contracts, for one identity: GET /health, POST /query {query, args}."""

from __future__ import annotations

import json
import socket
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession

from skeinwork.runtime import execute_contract
from skeinwork.schemas import Graph, GraphError

LOOPBACK = ("127.0.0.1", "localhost", "::1")
#: Rows of an answer, unless the server is given another number; a result beyond it is refused, not cut.
MOST_ROWS = 10_000


def _request(raw: bytes) -> tuple[str, dict | None]:
    """The query and its arguments; a body of another shape raises ValueError."""
    ask = json.loads(raw)
    if not isinstance(ask, dict) or not isinstance(ask.get("query"), str) or not isinstance(ask.get("args"), dict | None):
        raise ValueError("the body must be {query, args}")
    if "identity" in ask:
        raise ValueError("the identity is the server's")
    return ask["query"], ask.get("args")


def answer(spark: SparkSession, g: Graph, rules: DataFrame, identity: str, raw: bytes, most_rows: int) -> tuple[int, dict]:
    """Status and body for a request's body."""
    try:
        query, args = _request(raw)
    except ValueError as e:  # JSON that can't be read is one too
        return 400, {"error": str(e)}
    try:
        rows = execute_contract(spark, g, rules, identity, query, args).limit(most_rows + 1).collect()
    except PermissionError as e:
        return 403, {"error": str(e)}
    except Exception as e:  # a front must answer
        return 500, {"error": str(e)}
    if len(rows) > most_rows:
        return 500, {"error": f"the result has more than {most_rows} rows"}
    return 200, {"rows": [r.asDict(recursive=True) for r in rows]}


def server(spark: SparkSession, g: Graph, rules: DataFrame, identity: str, host: str = "127.0.0.1", port: int = 0, most_rows: int = MOST_ROWS) -> HTTPServer:
    """A server that isn't started yet and asks as ``identity``, whatever a request says; other hosts than the loopback raise."""
    if host not in LOOPBACK:
        raise GraphError(f"only the loopback is served, not {host}")

    class Handler(BaseHTTPRequestHandler):
        def _dispatch(self) -> None:
            length = self.headers.get("Content-Length", "0")
            if (self.command, self.path) == ("GET", "/health"):
                status, body = 200, {"status": "ok"}
            elif (self.command, self.path) != ("POST", "/query"):
                status, body = 404, {"error": "not found"}
            elif not length.isdigit():
                status, body = 400, {"error": "bad length"}
            else:
                status, body = answer(spark, g, rules, identity, self.rfile.read(int(length)), most_rows)
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _dispatch

        def log_message(self, *_args) -> None:
            pass

    kind = type("Loopback", (HTTPServer,), {"address_family": socket.AF_INET6 if ":" in host else socket.AF_INET})
    return kind((host, port), Handler)
