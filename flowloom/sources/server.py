"""A small HTTP front on the driver: health, metrics, entry listings, reload.

It holds no data. What it serves comes from functions that the job gives: metrics as exposition lines,
listings by breakdown. Listings are dear, so one is made at a time; others are told to come again.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

GATHERS = 10  # scrapes that may run at once


def serve(address: tuple[str, int], metrics: Callable[[], Iterable[str]], entries: dict[str, Callable[[], dict]], reload: Callable[[], object] | None = None) -> ThreadingHTTPServer:
    """A server on its own thread; `shutdown()` ends it. `entries` makes the listing of each breakdown by name."""
    scraping, listing = threading.BoundedSemaphore(GATHERS), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, status: int, body: str, kind: str = "text/plain; charset=utf-8") -> None:
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            url = urlsplit(self.path)
            if url.path == "/healthz":
                self.answer(200, "OK\n")
            elif url.path == "/":
                self.answer(200, "<html><body><a href='/metrics'>metrics</a> <a href='/entries'>entries</a></body></html>", "text/html; charset=utf-8")
            elif url.path == "/metrics":
                self.guarded(scraping, lambda: ("\n".join(metrics()) + "\n", "text/plain; version=0.0.4; charset=utf-8"))
            elif url.path == "/entries":
                names = parse_qs(url.query).get("aggregation", list(entries))
                if len(names) > 1 and "aggregation" in parse_qs(url.query) or any(n not in entries for n in names):
                    self.answer(400, f"aggregation is one of {', '.join(entries)}\n")
                else:
                    self.guarded(listing, lambda: (json.dumps({n: entries[n]() for n in names}, default=str), "application/json"))
            elif url.path == "/-/reload":
                self.answer(405, "reload by POST or PUT\n")
            else:
                self.answer(404, "not found\n")

        def guarded(self, gate, make) -> None:
            if not gate.acquire(blocking=False):
                self.answer(503, "busy\n")
                return
            try:
                body, kind = make()
            except Exception as e:  # one that fails is no reason to stop serving the others
                self.answer(500, f"{type(e).__name__}\n")
            else:
                self.answer(200, body, kind)
            finally:
                gate.release()

        def do_POST(self):
            if urlsplit(self.path).path != "/-/reload" or reload is None:
                self.answer(404, "not found\n")
                return
            try:
                reload()
            except Exception as e:
                self.answer(500, f"{type(e).__name__}\n")
            else:
                self.answer(200, "reloaded\n")

        do_PUT = do_POST

    server = ThreadingHTTPServer(address, Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
