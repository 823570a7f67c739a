"""A small HTTP endpoint that drops posted span payloads into the folder that a stream reads.

Requests are written to a temporary name and renamed, so that the stream never sees half a file.
"""

from __future__ import annotations

import base64
import json
import os
import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from meshlens.sources import protobuf


PROTOBUF, JSON = "application/x-protobuf", "application/json"


def accept(folder: str, body: bytes, content_type: str) -> tuple[int, dict | bytes]:
    """(status, reply) of one posted body: 200 kept, 400 not in the encoding that its type names, 415 another type. The reply is in the body's encoding."""
    kind = content_type.partition(";")[0].strip().lower()
    if kind == PROTOBUF:
        try:
            protobuf.read(body)
        except protobuf.Malformed as e:
            return 400, {"error": f"not protobuf: {e}"}
        _drop(folder, base64.b64encode(body).decode())
        return 200, b""  # a reply without fields has no bytes
    if kind != JSON:
        return 415, {"error": f"unsupported content type {kind}: send {JSON} or {PROTOBUF}"}
    try:
        payload = json.loads(body)
    except ValueError:
        return 400, {"error": "not JSON"}
    if not isinstance(payload, dict):
        return 400, {"error": "not a JSON object"}
    _drop(folder, json.dumps(payload))
    return 200, {"partialSuccess": {}}


def _drop(folder: str, line: str) -> None:
    os.makedirs(folder, exist_ok=True)
    name = uuid.uuid4().hex
    hidden = os.path.join(folder, f".{name}")
    with open(hidden, "w", encoding="utf-8") as f:
        f.write(line + "\n")
    os.rename(hidden, os.path.join(folder, f"{name}.json"))


def make_server(folder: str, port: int, tokens: dict[str, str] | None = None, pages: Callable[[str], tuple[bytes, str] | None] = lambda path: None, rescan: Callable[[], dict] | None = None) -> ThreadingHTTPServer:
    """Serves POST /v1/traces and /rescan, GET /healthz and pages(path); with tokens, posts need one as a bearer. One rescan runs at a time."""
    scanning = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, body: dict | bytes) -> None:
            self._send(status, *((body, PROTOBUF) if isinstance(body, bytes) else (json.dumps(body).encode(), JSON)))

        def _send(self, status: int, data: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            page = pages(self.path)
            if page is not None:
                self._send(200, *page)
            else:
                self._reply(200 if self.path == "/healthz" else 404, {"ok": self.path == "/healthz"})

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            bearer = self.headers.get("Authorization", "").removeprefix("Bearer ").strip()
            if tokens and bearer not in tokens:
                self._reply(401, {"error": "unauthorized"})
            elif self.path == "/rescan" and rescan is not None:
                if not scanning.acquire(blocking=False):
                    self._reply(409, {"error": "a scan is running"})
                    return
                try:
                    self._reply(200, rescan())
                except Exception as e:  # noqa: BLE001
                    self._reply(500, {"error": str(e)[:500]})
                finally:
                    scanning.release()
            elif self.path != "/v1/traces":
                self._reply(404, {"error": "not found"})
            else:
                self._reply(*accept(folder, body, self.headers.get("Content-Type", "")))

        def log_message(self, *_: object) -> None:
            """Quiet."""

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
