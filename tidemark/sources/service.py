"""The log store over HTTP, for clients that aren't Spark jobs.

Routes: ``GET /ok`` (503 while the store is read-only), ``GET /metrics`` (text
for a monitoring system), ``GET /openapi.json``, ``GET /docs``,
``GET /topics``, ``GET /topic/<t>``, ``POST /topic/<t>/partition/<p>`` (an Arrow IPC file),
``GET /topic/<t>/partition/<p>/records?start=`` and
``POST /topic/<t>/records`` (the cursor as a JSON object). Query parameters:
page_size, page_bytes, order, time.start, time.end, partition_filter (may
repeat), dataset, exclude (may repeat), dataset_separator, max_bytes. The
reply's status is in the header ``x-iteration-status`` and in the schema
metadata of Arrow replies.

A topic has one writer at a time; ``append_queue`` more appends may wait for
it. One that finds no place within ``append_wait_seconds`` is refused with 429.
"""

from __future__ import annotations

import json
import threading
from collections import defaultdict
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from tidemark.operators.cursor import InvalidQuery, Page
from tidemark.operators.focus import DataFocus

from . import formats
from .store import LogStore, RequestTooLong, WriterBusy


class NotFound(ValueError):
    pass


def _query(text: str) -> dict[str, list[str]]:
    found = parse_qs(text, keep_blank_values=True)
    return {k.removesuffix("[]").replace("[", ".").replace("]", ""): v for k, v in found.items()}


def _options(q: dict[str, list[str]]) -> dict:
    def one(name: str, kind=str):
        if name not in q:
            return None
        try:
            return kind(q[name][-1])
        except ValueError:
            raise InvalidQuery(f"{name}: {q[name][-1]!r}") from None

    size = one("max_bytes", int)
    focus = DataFocus(tuple(q.get("dataset", ())), tuple(q.get("exclude", ())), one("dataset_separator"), size)
    return {"page_size": one("page_size", int), "order": one("order"), "time_start": one("time.start"), "time_end": one("time.end"), "focus": focus}


class Writers:
    """A lock a topic with a bounded number of waiters."""

    def __init__(self, waiting: int, seconds: float):
        self.seconds = seconds
        self.places = defaultdict(lambda: threading.Semaphore(1 + waiting))
        self.locks: dict[str, threading.Lock] = defaultdict(threading.Lock)
        self.guard = threading.Lock()

    @contextmanager
    def writing(self, topic: str):
        with self.guard:
            place, lock = self.places[topic], self.locks[topic]
        if not place.acquire(timeout=self.seconds):
            raise WriterBusy(f"topic {topic!r} has appends waiting")
        try:
            with lock:
                yield
        finally:
            place.release()


_PAGE = ["page_size", "order", "time.start", "time.end", "dataset", "exclude", "dataset_separator", "max_bytes"]
ROUTES = [
    ("get", "/ok", "Whether the store takes appends", []), ("get", "/metrics", "Counters and gauges", []), ("get", "/topics", "The topics", []), ("get", "/topic/{topic}", "Index spans and bytes of a topic", []),
    ("post", "/topic/{topic}/partition/{partition}", "Append the rows of an Arrow IPC file", []),
    ("get", "/topic/{topic}/partition/{partition}/records", "A page of a partition", ["start", *_PAGE]),
    ("post", "/topic/{topic}/records", "A page of a topic after the cursor in the body", ["page_bytes", "partition_filter", *_PAGE]),
]


def openapi() -> dict:
    """The routes as an OpenAPI document."""
    paths: dict[str, dict] = {}
    errors = {"400": "bad request", "404": "no such route", "406": "no such format", "413": "body too long; x-max-request-size is the limit", "429": "read-only, or the writer is busy", "503": "unhealthy"}
    for method, path, text, query in ROUTES:
        named = [{"name": p[1:-1], "in": "path", "required": True, "schema": {"type": "string"}} for p in path.split("/") if p.startswith("{")]
        asked = [{"name": q, "in": "query", "required": q == "start", "schema": {"type": "integer" if q in ("start", "page_size", "page_bytes", "max_bytes") else "string"}} for q in query]
        paths.setdefault(path, {})[method] = {"summary": text, "parameters": named + asked, "responses": {"200": {"description": text}, **{k: {"description": v} for k, v in errors.items()}}}
    return {"openapi": "3.0.3", "info": {"title": "tidemark", "version": "1"}, "paths": paths}


def docs() -> str:
    rows = "".join(f"<tr><td>{m.upper()}</td><td><code>{p}</code></td><td>{t}</td><td>{', '.join(q)}</td></tr>" for m, p, t, q in ROUTES)
    return f'<!doctype html><title>tidemark</title><h1>tidemark</h1><p><a href="/openapi.json">openapi.json</a></p><table><tr><th>method<th>path<th>what<th>query</tr>{rows}</table>'


class Handler(BaseHTTPRequestHandler):
    store: LogStore
    writers: Writers
    protocol_version = "HTTP/1.1"

    def log_message(self, *_) -> None:
        pass

    def _send(self, code: int, body: bytes, kind: str = formats.JSON, **headers: str) -> None:
        self.send_response(code)
        self.send_header("content-type", kind)
        self.send_header("content-length", str(len(body)))
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(body)

    def _json(self, value) -> None:
        self._send(200, json.dumps(value).encode())

    def _page(self, page: Page) -> None:
        kind, body = formats.reply(page, self.headers.get("accept"))
        self._send(200, body, kind, x_iteration_status=json.dumps({"status": page.status.value, "next": page.next}))

    def _body(self) -> bytes:
        size = int(self.headers.get("content-length") or 0)
        if size > self.store.config.max_append_bytes:
            self.close_connection = True
            raise RequestTooLong(size, self.store.config.max_append_bytes)
        return self.rfile.read(size)

    def _run(self, handle) -> None:
        try:
            handle()
        except Exception as e:  # noqa: BLE001 - every failure has a reply
            code = 404 if isinstance(e, NotFound) else formats.status_code(e)
            extra = {"x_max_request_size": str(e.limit)} if isinstance(e, RequestTooLong) else {}
            self._send(code, json.dumps({"code": type(e).__name__, "message": str(e)}).encode(), **extra)

    def do_GET(self) -> None:
        self._run(self._get)

    def do_POST(self) -> None:
        self._run(self._post)

    def _get(self) -> None:
        url = urlsplit(self.path)
        match [unquote(p) for p in url.path.strip("/").split("/")]:
            case ["ok"]:
                ok = self.store.health()
                self._send(200 if ok else 503, json.dumps({"ok": ok}).encode())
            case ["metrics"]:
                self._send(200, self.store.exposition().encode(), "text/plain; version=0.0.4; charset=utf-8")
            case ["openapi.json"]:
                self._json(openapi())
            case ["docs"]:
                self._send(200, docs().encode(), "text/html; charset=utf-8")
            case ["topics"]:
                self._json({"topics": [{"name": t} for t in self.store.topics()]})
            case ["topic", topic]:
                spans = self.store.partitions(topic)
                self._json({"partitions": {p: {"start": a, "end": b} for p, (a, b) in spans.items()}, "bytes": self.store.size(topic)})
            case ["topic", topic, "partition", partition, "records"]:
                q = _query(url.query)
                if "start" not in q:
                    raise formats.CannotEmit("start is missing")
                self._page(self.store.records(topic, partition, int(q["start"][-1]), **_options(q)))
            case _:
                raise NotFound(self.path)

    def _post(self) -> None:
        url = urlsplit(self.path)
        match [unquote(p) for p in url.path.strip("/").split("/")]:
            case ["topic", topic, "partition", partition]:
                table = formats.read_arrow_file(self._body())
                with self.writers.writing(topic):
                    first, end = self.store.append_request(topic, partition, table)
                self._json({"span": {"start": first, "end": end}})
            case ["topic", topic, "records"]:
                raw = self._body()
                try:
                    cursor = {str(k): int(v) for k, v in json.loads(raw or b"{}").items()}
                except (ValueError, AttributeError, TypeError):
                    raise InvalidQuery("the cursor must be an object of integers") from None
                q = _query(url.query)
                size = q.get("page_bytes")
                self._page(self.store.iterate(topic, cursor, partitions=q.get("partition_filter"), page_bytes=int(size[-1]) if size else None, **_options(q)))
            case _:
                raise NotFound(self.path)


def serve(store: LogStore, host: str = "127.0.0.1", port: int = 3030) -> ThreadingHTTPServer:
    """A server over the store; call ``serve_forever`` on it."""
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"store": store, "writers": Writers(store.config.append_queue, store.config.append_wait_seconds)}))
