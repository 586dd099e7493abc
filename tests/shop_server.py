"""A shop API for tests: pages of records, and failures that a script asks for."""

import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse


class Shop:
    """entities: records by entity. failures: (entity, page) -> list of (status, headers) to answer with first. counts: whether pages tell the total."""

    def __init__(self, entities, failures=(), counts=True):
        self.entities, self.failures, self.counts = entities, {k: list(v) for k, v in dict(failures).items()}, counts
        self.calls, self.lock = [], threading.Lock()

    def answer(self, entity, page, size, since):
        with self.lock:
            self.calls.append((entity, page, size, since))
            if size > 1 and self.failures.get((entity, page)):
                return *self.failures[entity, page].pop(0), None
        rows = [r for r in self.entities[entity] if since is None or r["updated_at"] >= since]
        pages = max(1, -(-len(rows) // size))
        told = {"page": page, "page_size": size, "has_next": page < pages} | ({"total": len(rows), "total_pages": pages} if self.counts else {})
        return 200, {}, {"data": rows[(page - 1) * size : page * size], "pagination": told}


@contextmanager
def serving(shop):
    """The address of a shop."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            told = {k: v[0] for k, v in parse_qs(url.query).items()}
            status, headers, body = shop.answer(url.path.strip("/"), int(told["page"]), int(told["page_size"]), told.get("updated_since"))
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body, ensure_ascii=False).encode() if body else b"")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}"
    finally:
        server.shutdown()
        server.server_close()
