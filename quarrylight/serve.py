"""Serving over HTTP: health, answers as a stream of events, and what is known of chats; users and proxies are not its concern."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quarrylight import config
from quarrylight.engine import QueryEngine, health

MAX_QUESTION, MAX_TURNS = 2000, 8
#: Seconds that invites and lists of chats are kept.
INVITE_TTL, CHATS_TTL = 7 * 24 * 3600, 7 * 60


class Cache:
    """Values by key until they run out."""

    def __init__(self, ttl: float, now: Callable[[], float] = time.time):
        self.ttl, self.now, self.held = ttl, now, {}

    def get(self, key, make: Callable[[], object]):
        until, value = self.held.get(key, (0, None))
        if until <= self.now():
            value = make()
            self.held[key] = (self.now() + self.ttl, value)
        return value


def checked(body: bytes) -> dict:
    """A request's question, source and history, or ValueError with what is wrong."""
    said = json.loads(body or b"{}")
    question = str(said.get("question") or "").strip()
    source = str(said.get("source") or "all").lower()
    history = said.get("history") or []
    if not question or len(question) > MAX_QUESTION:
        raise ValueError(f"a question has 1 to {MAX_QUESTION} characters")
    if source not in (*config.SOURCES, "blog"):
        raise ValueError("source is " + ", ".join(config.SOURCES))
    if not isinstance(history, list) or len(history) > MAX_TURNS or not all(isinstance(t, dict) for t in history):
        raise ValueError(f"history has {MAX_TURNS} turns at most")
    return {"question": question, "source": source, "history": history}


def application(engine: QueryEngine, registry: Callable[[], list[dict]] = list):
    """A handler class over an engine and a registry of chats (chat_id, name, invite)."""
    chats, invites = Cache(CHATS_TTL), Cache(INVITE_TTL)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _json(self, status: int, said) -> None:
            data = json.dumps(said, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            path, _, query = self.path.partition("?")
            if path == "/api/health":
                self._json(200, json.loads(health()))
            elif path == "/api/internal/whatsapp/chats":
                self._json(200, {"chats": chats.get("all", registry)})
            elif path == "/api/internal/whatsapp/invite":
                wanted = dict(x.partition("=")[::2] for x in query.split("&")).get("chat_id", "")
                found = invites.get(wanted, lambda: next((c.get("invite") for c in registry() if c.get("chat_id") == wanted), None))
                self._json(200 if found else 404, {"invite": found})
            else:
                self._json(404, {"error": "no such address"})

        def do_POST(self):
            if self.path != "/api/chat/stream":
                self._json(404, {"error": "no such address"})
                return
            try:
                asked = checked(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            except (ValueError, AttributeError) as e:
                self._json(422, {"error": str(e)})
                return
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            for event in engine.ask_stream(**asked):
                self.wfile.write(f"data: {json.dumps(event, default=str)}\n\n".encode())

    return Handler


def serve(engine: QueryEngine, port: int = 8000, registry: Callable[[], list[dict]] = list) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), application(engine, registry))
