"""The HTTP service: search, indexing in the background, feedback, documents and status, as JSON on a local port.

Requests are answered by a table of routes; what a request says is checked before anything is done, and errors say what is
wrong with the request, never what happened inside. One index job runs at a time; searches go on while it runs, over the
versions of the tables that were current when they began.
"""

from __future__ import annotations

import json
import logging
import os
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidepool.plans.ingest import Store

MOST_BODY = 64 * 1024
#: The files of the page, and nothing else, by the place they are asked for.
ASSETS = {"/": ("index.html", "text/html"), "/page.js": ("page.js", "text/javascript"), "/page.css": ("page.css", "text/css")}
log = logging.getLogger(__name__)


class Refused(Exception):
    """A request that is answered with a status other than success."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status, self.message = status, message


class Service:
    """What the routes do, without HTTP: each takes the request's object (or what stands in its path) and gives (status, answer)."""

    def __init__(self, store: Store):
        self.store = store
        self._job: threading.Thread | None = None
        self._guard = threading.Lock()
        self.progress = {"indexing_in_progress": False, "progress_percent": 0, "current_folder": None, "last_error": None, "last_indexed_ms": None, "counts": {}}
        self.routes = [
            ("POST", r"/search", self.search, "Search artifacts: query, k, filters."),
            ("POST", r"/index", self.index, "Index folders in the background: folders, reindex."),
            ("GET", r"/index/status", lambda _: (200, dict(self.progress)), "How far the index job is."),
            ("POST", r"/feedback", self.feedback, "Record a click, a pin or an ignore of a result."),
            ("GET", r"/document/(?P<id>\d+)", self.document, "An artifact's fields; opening it is recorded."),
            ("GET", r"/status", lambda _: (200, self.store.status()), "Counts of documents and chunks, and the model."),
            ("GET", r"/openapi.json", lambda _: (200, self.contract()), "This contract."),
        ]

    def answer(self, method: str, path: str, body: bytes | None) -> tuple[int, dict]:
        try:
            found = [(re.fullmatch(p, path), m, run) for m, p, run, _ in self.routes if re.fullmatch(p, path)]
            if not found:
                raise Refused(404, "no such place")
            mine = [(hit, run) for hit, m, run in found if m == method]
            if not mine:
                raise Refused(405, "no such method here")
            hit, run = mine[0]
            return run(hit.groupdict() if method == "GET" else self._object(body))
        except Refused as e:
            return e.status, {"error": e.message}
        except Exception:  # what went wrong inside is for the log alone
            log.exception("%s %s failed", method, path)
            return 500, {"error": "the request failed"}

    @staticmethod
    def _object(body: bytes | None) -> dict:
        if body is not None and len(body) > MOST_BODY:
            raise Refused(413, f"a request has at most {MOST_BODY} bytes")
        try:
            said = json.loads(body or b"")
        except ValueError:
            raise Refused(400, "the request is no JSON") from None
        if not isinstance(said, dict):
            raise Refused(400, "the request is no object")
        return said

    def search(self, said: dict) -> tuple[int, dict]:
        if not self.store.tables["artifacts"].exists():
            raise Refused(503, "nothing is indexed yet")
        try:
            return 200, self.store.engine().respond(said)
        except ValueError as e:
            raise Refused(400, str(e)) from None

    def index(self, said: dict) -> tuple[int, dict]:
        folders, again = said.get("folders"), said.get("reindex", False)
        if not isinstance(folders, list) or not folders or not all(isinstance(f, str) and f.strip() for f in folders) or not isinstance(again, bool):
            raise Refused(400, "folders must be a list of texts, reindex true or false")
        absent = [f for f in folders if not os.path.isdir(f)]
        if absent:
            raise Refused(404, "a folder is not there")
        with self._guard:
            if self._job is not None and self._job.is_alive():
                raise Refused(409, "an index job is running")
            self.progress |= {"indexing_in_progress": True, "progress_percent": 0, "last_error": None, "counts": {}}
            self._job = threading.Thread(target=self._work, args=(folders, again), daemon=True)
            self._job.start()
        return 202, {"accepted": True, "folders": folders}

    def _work(self, folders: list[str], again: bool) -> None:
        total: dict = {}
        try:
            for n, folder in enumerate(folders):
                self.progress |= {"current_folder": folder, "progress_percent": 100 * n // len(folders)}
                for k, v in self.store.ingest(folder, time.time_ns() // 1000, again).items():
                    total[k] = v if k in ("episodes", "memories") else total.get(k, 0) + v
            self.progress |= {"progress_percent": 100, "last_indexed_ms": time.time_ns() // 1_000_000}
        except Exception:
            log.exception("an index job failed")
            self.progress |= {"last_error": "the index job failed"}
        self.progress |= {"indexing_in_progress": False, "current_folder": None, "counts": total}

    def wait(self) -> None:
        if self._job is not None:
            self._job.join()

    def feedback(self, said: dict) -> tuple[int, dict]:
        values = [said.get(k) for k in ("query", "document_id", "action")]
        if not all(isinstance(v, str) and v.strip() for v in values):
            raise Refused(400, "query, document_id and action must be texts that are not blank")
        try:
            self.store.record_feedback(*values, time.time_ns() // 1_000_000)
        except ValueError as e:
            raise Refused(400, str(e)) from None
        return 200, {"recorded": True}

    def document(self, said: dict) -> tuple[int, dict]:
        found = self.store.open_document(int(said["id"]), time.time_ns() // 1000)
        if found is None:
            raise Refused(404, "no such document")
        return 200, {k: v if v is None or isinstance(v, (bool, int, str)) else str(v) for k, v in found.items()}

    def contract(self) -> dict:
        paths: dict = {}
        for method, pattern, _, what in self.routes:
            place = re.sub(r"\(\?P<(\w+)>[^)]*\)", r"{\1}", pattern)
            paths.setdefault(place, {})[method.lower()] = {"summary": what, "responses": {"200": {"description": "the answer"}, "400": {"description": "what is wrong with the request"}}}
        return {"openapi": "3.0.3", "info": {"title": "tidepool", "version": "1"}, "paths": paths}


def serve(store: Store, port: int = 8077, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for a store, bound to this machine alone; the caller runs serve_forever() and shutdown()."""
    service = Service(store)

    class Handler(BaseHTTPRequestHandler):
        def _do(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0) if (self.headers.get("Content-Length") or "0").isdigit() else 0
            body = None
            if method == "POST":
                if size > MOST_BODY:
                    return self._send(413, {"error": f"a request has at most {MOST_BODY} bytes"})
                body = self.rfile.read(size)
            path = self.path.split("?")[0]
            if method == "GET" and path in ASSETS:
                name, kind = ASSETS[path]
                with open(os.path.join(os.path.dirname(__file__), "static", name), "rb") as f:
                    return self._raw(200, f.read(), f"{kind}; charset=utf-8")
            self._send(*service.answer(method, path, body))

        def _send(self, status: int, answer: dict) -> None:
            self._raw(status, json.dumps(answer, default=str).encode(), "application/json")

        def _raw(self, status: int, raw: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self._do("GET")

        def do_POST(self):
            self._do("POST")

        def log_message(self, *args):
            log.debug("%s", args)

    server = ThreadingHTTPServer((host, port), Handler)
    server.service = service
    return server
