"""A small JSON server on the loopback interface around one corpus: context, score (with commit), reset."""

from __future__ import annotations

import json
import os
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from texlith.functions import constants as C
from texlith.plans.scorer import ScoringError, State, Submission, submit

MAX_BYTES = 16_384
HEADERS = {"Content-Security-Policy": "default-src 'self'", "X-Content-Type-Options": "nosniff", "X-Frame-Options": "DENY", "Referrer-Policy": "no-referrer", "Cache-Control": "no-store"}
LOOPBACK = ("127.0.0.1", "localhost", "[::1]")


class Refused(Exception):
    """An answer other than 200."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class App:
    """The corpus as it was loaded, the one that grows, and the log of what was submitted."""

    def __init__(self, state: State, log: str):
        self.first, self.log, self.lock = state, log, threading.Lock()
        self.state = state.grown([])
        self.saved = self._read()
        taken = {s.id for s in state.submissions}
        again = [r for r in self.saved if r.get("admitted") is True and isinstance(r.get("id"), str)]
        again = list({r["id"]: r for r in reversed(again) if r["id"] not in taken and problem(r) is None}.values())[::-1]
        if again:
            self.state.add([Submission(r["id"], r["headline"], r["body"], r["stance"]) for r in again])

    def _read(self) -> list[dict]:
        """The log's rows; a log that can't be read is moved aside."""
        if not os.path.exists(self.log):
            return []
        try:
            with open(self.log, encoding="utf-8") as f:
                rows = [json.loads(line) for line in f if line.strip()]
            if all(isinstance(r, dict) for r in rows):
                return rows
        except ValueError:
            pass
        os.replace(self.log, f"{self.log}.corrupt")
        return []

    def score(self, sub: Submission, commit: bool) -> dict:
        with self.lock:
            if not commit:
                return self.state.score(sub)
            out = submit(self.state, sub)
            row = {"id": out["id"], "stance": sub.stance, "headline": sub.headline, "body": sub.body, "score": out["score"], "admitted": out["admitted"], "submitted_at": datetime.now(UTC).isoformat(timespec="seconds")}
            with open(self.log, "a", encoding="utf-8") as f:
                f.write(json.dumps(row) + "\n")
            return out

    def reset(self) -> None:
        with self.lock:
            self.state = self.first.grown([])
            if os.path.exists(self.log):
                os.replace(self.log, f"{self.log}.old")

    def context(self) -> dict:
        return {"title": self.state.article[0], "text": self.state.article[1], "corpus_size": len(self.state.submissions), "stances": list(C.STANCES), "max_headline": C.MAX_HEADLINE, "min_body": C.MIN_BODY, "max_body": C.MAX_BODY}


def problem(row: dict) -> str | None:
    """What is wrong with a request as a submission."""
    missing = [k for k in ("headline", "body", "stance") if not isinstance(row.get(k), str)]
    if missing:
        return f"missing: {', '.join(missing)}"
    if not row["headline"].strip() or len(row["headline"]) > C.MAX_HEADLINE:
        return f"headline needs 1 to {C.MAX_HEADLINE} characters"
    if not C.MIN_BODY <= len(row["body"].strip()) <= C.MAX_BODY:
        return f"body needs {C.MIN_BODY} to {C.MAX_BODY} characters"
    return None if row["stance"] in C.STANCES else "unknown stance"


def handler(app: App) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        timeout = 15

        def log_message(self, *args) -> None:
            pass

        def _answer(self, status: int, value) -> None:
            data = value.encode() if isinstance(value, str) else json.dumps(value).encode()
            self.send_response(status)
            for k, v in {"Content-Type": "text/html; charset=utf-8" if isinstance(value, str) else "application/json", "Content-Length": str(len(data)), **HEADERS}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def _request(self) -> dict:
            """The JSON object that was sent, if its sender may send it."""
            port = self.server.server_address[1]
            if self.headers.get("Origin") not in (None, *(f"http://{h}:{port}" for h in LOOPBACK)):
                raise Refused(403, "another origin")
            if (self.headers.get("Content-Type") or "").split(";")[0].strip() != "application/json":
                raise Refused(415, "send application/json")
            length = self.headers.get("Content-Length") or ""
            if not length.isdigit() or int(length) > MAX_BYTES:
                raise Refused(400, f"send at most {MAX_BYTES} bytes")
            try:
                value = json.loads(self.rfile.read(int(length)) or b"null")
            except ValueError:
                raise Refused(400, "broken JSON") from None
            if not isinstance(value, dict):
                raise Refused(400, "send an object")
            return value

        def _handle(self, routes: dict, others: set[str]) -> None:
            try:
                if (self.headers.get("Host") or "").rsplit(":", 1)[0] not in LOOPBACK:
                    raise Refused(403, "another host")
                path = self.path.split("?")[0]
                if path not in routes:
                    raise Refused(405 if path in others else 404, "no such thing here")
                self._answer(200, routes[path]())
            except Refused as e:
                self._answer(e.status, {"error": str(e)})
            except ScoringError as e:
                self._answer(503, {"error": str(e)})
            except Exception:
                self._answer(500, {"error": "internal error"})

        def do_GET(self) -> None:
            page = lambda: f"<!DOCTYPE html><title>{len(app.state.submissions)} submissions</title><p>POST /api/score"
            self._handle({"/": page, "/api/context": app.context}, {"/api/score", "/api/reset"})

        def do_POST(self) -> None:
            self._handle({"/api/score": self._score, "/api/reset": self._reset}, {"/", "/api/context"})

        def _score(self) -> dict:
            row = self._request()
            if wrong := problem(row):
                raise Refused(400, wrong)
            return app.score(Submission(None, " ".join(row["headline"].split()), row["body"].strip(), row["stance"]), row.get("commit") is True)

        def _reset(self) -> dict:
            self._request()
            app.reset()
            return app.context()

    return Handler


def make(state: State, port: int, log: str) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(App(state, log)))


def serve(state: State, port: int, log: str) -> None:
    with make(state, port, log) as server:
        print(f"http://127.0.0.1:{server.server_address[1]}")
        server.serve_forever()
