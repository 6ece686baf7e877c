"""The search service over HTTP: GET /health and /info, POST /query/by-id and /query/by-coords, JSON both ways."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .api import Service, ServiceError

_NUMBERS = {"lon": float, "lat": float, "x": float, "y": float, "k": int, "patch_id": int}


def respond(service: Service, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """Status and answer of one request; requests with unknown, missing or misshapen fields are a 422."""
    try:
        if (method, path) == ("GET", "/health"):
            return 200, service.health()
        if (method, path) == ("GET", "/info"):
            return 200, service.info().first().asDict()
        if method != "POST" or path not in ("/query/by-id", "/query/by-coords"):
            return 404, {"detail": f"no {method} {path}"}
        asked = _fields(body)
        if path == "/query/by-id":
            if "patch_id" not in asked:
                raise ServiceError(422, "patch_id is needed")
            found = service.query_by_id(**asked)
        else:
            found = service.query_by_coords(**asked)
        return 200, {"query": asked, "results": [r.asDict() for r in found.orderBy("rank").collect()]}  # at most k rows
    except ServiceError as error:
        return error.status, {"detail": str(error)}
    except TypeError as error:
        return 422, {"detail": str(error)}


def _fields(body: bytes) -> dict:
    try:
        given = json.loads(body or b"{}")
        return {k: _NUMBERS[k](v) if k in _NUMBERS else str(v) for k, v in given.items() if v is not None}
    except (ValueError, AttributeError, TypeError) as error:
        raise ServiceError(422, f"not a request: {error}") from error


def server(service: Service, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is not started yet; ``serve_forever`` runs it, ``shutdown`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, answer = respond(service, method, self.path, self.rfile.read(size))
            data = json.dumps(answer, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
