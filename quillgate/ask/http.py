"""The question pipeline over HTTP, with nothing but the standard library.

``GET / /health /ready /metrics`` and ``POST /ask /ask/confirm /ask/execute``; bodies are JSON objects whose
unknown keys are refused. The caller is told by the bearer token of the registry.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from quillgate.ask.pipeline import Asker, Outcome, describe
from quillgate.plans.issues import Rejected
from quillgate.principals import Counters, RateLimit, Registry
from quillgate.session import Principal, TimedOut

MOST_BYTES = 64 * 1024


@dataclass
class Service:
    """``asker_for`` gives the pipeline of a principal; keep sessions in a ``SessionCache`` behind it."""

    registry: Registry
    asker_for: Callable[[Principal], Asker]
    limit: RateLimit = field(default_factory=RateLimit)
    counters: Counters = field(default_factory=Counters)
    ready: Callable[[], bool] = lambda: True

    def handle(self, method: str, path: str, token: str, body: bytes) -> tuple[int, str, str]:
        """(status, content type, text) of a request."""
        if method == "GET":
            if path == "/":
                return 200, "application/json", json.dumps({"service": "quillgate", "ask": ["/ask", "/ask/confirm", "/ask/execute"], "state": ["/health", "/ready", "/metrics"]})
            if path == "/health":
                return 200, "text/plain", "ok"
            if path == "/ready":
                return (200, "text/plain", "ready") if self.ready() else (503, "text/plain", "not ready")
            if path == "/metrics":
                return 200, "text/plain", self.counters.text()
        if method != "POST" or path not in ("/ask", "/ask/confirm", "/ask/execute"):
            return self._error(404, "not_found", path)
        try:
            principal = self.registry.by_token(token)
        except PermissionError:
            return self._error(401, "auth", "unknown token")
        if not self.limit.allow(principal.id):
            return self._error(429, "rate_limited", "too many questions")
        wanted = "review" if path == "/ask/execute" else "question"
        try:
            data = json.loads(body)
            if not isinstance(data, dict) or set(data) != {wanted}:
                raise ValueError(f"the body holds {wanted!r} and nothing else")
        except ValueError as e:
            return self._error(400, "invalid_request", str(e))
        began = time.monotonic()
        try:
            asker = self.asker_for(principal)
            out = asker.execute_reviewed(data["review"]) if path == "/ask/execute" else asker.ask(str(data["question"]), confirm_only=path == "/ask/confirm")
        except PermissionError as e:
            return self._error(409 if "changed since" in str(e) else 403, "auth", str(e))
        except Rejected as e:
            return self._error(409, e.codes[0], str(e))
        except (RuntimeError, TimedOut) as e:
            return self._error(502, "validation_failed", str(e))
        self.counters.add(out.status, out.code, time.monotonic() - began)
        return 200, "application/json", json.dumps(self._body(out), default=str, ensure_ascii=False)

    @staticmethod
    def _body(out: Outcome) -> dict[str, Any]:
        return {k: v for k, v in {**out.__dict__, "text": describe(out)}.items() if v not in ("", (), None)}

    @staticmethod
    def _error(status: int, code: str, message: str) -> tuple[int, str, str]:
        return status, "application/json", json.dumps({"status": "error", "code": code, "message": message})


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server ready for ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                answer = Service._error(413, "invalid_request", "the body is too large")
            else:
                token = self.headers.get("Authorization", "").removeprefix("Bearer ").strip()
                answer = service.handle(self.command, self.path.split("?")[0], token, self.rfile.read(size))
            status, kind, text = answer
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
