"""The HTTP server: flows and exporters behind bearer keys; health, readiness and metrics in the open."""

from __future__ import annotations

import hmac
import json
import logging
import re
import secrets
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import wait as wait_all
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from ..functions.network import show_ip
from ..obs import Metrics
from ..plans import query as Q
from ..schema import PUBLIC
from .openapi import CODES
from .params import PARAMS, Invalid, bind

log = logging.getLogger(__name__)
READY_SECONDS = 2.0
#: A percent sign without two hexadecimal digits, or a semicolon, which separates nothing.
MALFORMED = re.compile(r"%(?![0-9A-Fa-f]{2})|;")
TIME = "%Y-%m-%dT%H:%M:%S.%fZ"


class Failure(Exception):
    def __init__(self, code: str, message: str, details: list | None = None):
        super().__init__(message)
        self.code, self.details = code, details


def shown_flow(r) -> dict:
    """A row as readers see it: no seq, no key, addresses as text, unsigned counters, six digits of a second."""
    r = r.asDict()
    out = {k: v for k, v in r.items() if k in PUBLIC}
    for k in ("received_at", "first_switched", "last_switched"):
        out[k] = out[k].strftime(TIME)
    for k in ("exporter_addr", "src_addr", "dst_addr", "next_hop"):
        out[k] = None if out[k] is None else show_ip(out[k])
    for k in ("packets", "bytes"):
        out[k] %= 1 << 64
    return out


def shown_exporter(r) -> dict:
    return {"id": r["id"], "ip_address": show_ip(r["ip_address"]), "label": r["label"], "first_seen_at": r["first_seen_at"].strftime(TIME), "last_seen_at": r["last_seen_at"].strftime(TIME)}


class Service:
    """What requests are answered from. stores: by name, in configured order; the first that can query serves flows."""

    def __init__(self, stores: dict[str, object], keys: tuple[str, ...], metrics: Metrics | None = None):
        if not keys:
            raise ValueError("at least one API key is needed")
        self.stores, self.keys, self.metrics = stores, keys, metrics or Metrics()
        self.store = next((s for s in stores.values() if hasattr(s, "query")), None)

    def authorize(self, header: str | None) -> None:
        scheme, _, key = (header or "").partition(" ")
        given, found = key.strip().encode(), False
        for k in self.keys:  # all keys, so that the time tells nothing
            found |= hmac.compare_digest(given, k.encode())
        if scheme.lower() != "bearer" or not found:
            log.warning("refused a key", extra={"fields": {"prefix": key[:6]}})
            raise Failure("unauthorized", "a valid API key is required")

    def bound(self, query: str, params: list) -> dict:
        if MALFORMED.search(query):
            raise Failure("bad_request", "the query string is malformed")
        return bind(query, params)

    def flows(self, query: str) -> dict:
        if self.store is None:
            raise Failure("backend_unavailable", "no storage is configured")
        values = self.bound(query, PARAMS)
        try:
            if "cursor" in values:
                Q.decode_cursor(values["cursor"])
        except Q.BadCursor:
            raise Failure("bad_request", "cursor is not valid") from None
        try:
            page = self.store.query(Q.FlowQuery(**values))
        except Exception:
            log.exception("a query failed")
            raise Failure("backend_unavailable", "storage is unavailable") from None
        meta = {"has_more": page.has_more} | ({"next_cursor": page.next_cursor} if page.next_cursor else {})
        return {"data": [shown_flow(r) for r in page.rows], "meta": meta}

    def exporters(self, query: str) -> dict:
        self.bound(query, [])
        for name in sorted(self.stores):
            if hasattr(self.stores[name], "list_exporters"):
                try:
                    return {"data": [shown_exporter(r) for r in self.stores[name].list_exporters()], "meta": {"has_more": False}}
                except Exception:
                    log.exception("listing exporters failed", extra={"fields": {"store": name}})
        raise Failure("backend_unavailable", "no storage can list exporters")

    def ready(self) -> tuple[int, dict]:
        """Pings all stores at once; those that have no ping answer an empty query."""

        def probe(s):
            s.ping() if hasattr(s, "ping") else s.query(Q.FlowQuery(0, 1, limit=1))

        pool = ThreadPoolExecutor(max(1, len(self.stores)))
        jobs = {n: pool.submit(probe, s) for n, s in self.stores.items()}
        done, _ = wait_all(jobs.values(), READY_SECONDS)
        pool.shutdown(wait=False, cancel_futures=True)
        state = {n: "ok" if j in done and not j.exception() else "unavailable" for n, j in jobs.items()}
        good = all(v == "ok" for v in state.values())
        return (200 if good else 503), {"status": "ready" if good else "unavailable", "sinks": state}


ROUTES = {"/v1/flows": Service.flows, "/v1/exporters": Service.exporters}


def serve(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server bound to the address; the caller runs serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _answer(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("X-Request-Id", self.request_id)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)
            log.info("request", extra={"fields": {"request_id": self.request_id, "method": self.command, "path": urlsplit(self.path).path, "status": status}})

        def _route(self) -> None:
            self.request_id = f"req_{secrets.token_hex(6)}"
            url = urlsplit(self.path)
            try:
                if url.path.startswith("/v1/"):
                    service.authorize(self.headers.get("Authorization"))
                    if url.path not in ROUTES:
                        raise Failure("not_found", "no such path")
                    if self.command != "GET":
                        raise Failure("method_not_allowed", "only GET is allowed")
                    return self._answer(200, json.dumps(ROUTES[url.path](service, url.query)).encode())
                if self.command != "GET":
                    raise Failure("method_not_allowed" if url.path in ("/healthz", "/readyz", "/metrics") else "not_found", "only GET is allowed")
                if url.path == "/healthz":
                    return self._answer(200, b'{"status": "ok"}')
                if url.path == "/readyz":
                    status, body = service.ready()
                    return self._answer(status, json.dumps(body).encode())
                if url.path == "/metrics":
                    return self._answer(200, service.metrics.text().encode(), "text/plain; version=0.0.4")
                raise Failure("not_found", "no such path")
            except Failure as e:
                return self._fail(e.code, str(e), e.details)
            except Invalid as e:
                return self._fail("validation_error", "some parameters are invalid", e.details)
            except Exception:
                log.exception("a request failed", extra={"fields": {"request_id": self.request_id}})
                return self._fail("internal_error", "something went wrong")

        def _fail(self, code: str, message: str, details: list | None = None) -> None:
            error = {"code": code, "message": message, "request_id": self.request_id} | ({"details": details} if details else {})
            self._answer(CODES[code], json.dumps({"error": error}).encode())

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = _route

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
