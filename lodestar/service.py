"""``/health``, ``/ask`` and ``/stream`` over HTTP, with the standard library's server."""

from __future__ import annotations

import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from .plans.engine import Engine
from .streaming.questions import server_sent


def server(engine: Engine, port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: bytes, kind: str = "application/json", code: int = 200) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path == "/health":
                self._send(b'{"status": "ok"}')
            elif url.path == "/stream" and (q := parse_qs(url.query).get("question")):
                self._send("".join(server_sent(engine.answer(q[0]))).encode(), "text/event-stream")
            else:
                self._send(b'{"error": "not found"}', code=404)

        def do_POST(self) -> None:
            try:
                q = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))["question"]
            except (ValueError, KeyError, TypeError):
                return self._send(b'{"error": "a JSON object with a question is needed"}', code=400)
            self._send(json.dumps(asdict(engine.answer(str(q)))).encode())

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
