"""The landing daemon: UDP datagrams to Parquet files, through a bounded buffer that never blocks the socket.

offered == ingested + dropped holds at every moment that the counters are read together.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import os
import queue
import socket
import threading
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq

from ..functions.network import MAPPED_PREFIX
from ..obs import Metrics

SCHEMA = pa.schema([("exporter", pa.binary()), ("received_at", pa.timestamp("us", tz="UTC")), ("arrival", pa.int64()), ("payload", pa.binary())])
LARGEST = 65_535


class Buffer:
    """Items in order of offers; a full or closed one drops and counts."""

    def __init__(self, size: int, metrics: Metrics, source: str = "udp"):
        self._queue: queue.Queue = queue.Queue(size)
        self._lock = threading.Lock()
        self._metrics, self._source, self._closed, self._next = metrics, source, False, 0

    def offer(self, item) -> bool:
        with self._lock:
            if self._closed:
                self._metrics.count("records_dropped", reason="shutdown")
                return False
            try:
                self._queue.put_nowait((self._next, item))
            except queue.Full:
                self._metrics.count("records_dropped", reason="buffer_full")
                return False
            self._next += 1
            self._metrics.count("records_ingested", source=self._source)
            return True

    def take(self, most: int, seconds: float) -> list:
        """Up to `most` items, waiting until there are so many or `seconds` have passed since the first."""
        out, until = [], None
        while len(out) < most:
            try:
                wait = seconds if until is None else until - time.monotonic()
                out.append(self._queue.get(timeout=wait) if wait > 0 else self._queue.get_nowait())
            except queue.Empty:
                break
            until = until or time.monotonic() + seconds
        return out

    def close(self) -> None:
        with self._lock:
            self._closed = True

    def __len__(self) -> int:
        return self._queue.qsize()


class Landing:
    """Listens on an address; each flush is one file that appears whole. start() returns the bound address."""

    def __init__(self, folder: str, metrics: Metrics, buffer: int = 65_536, batch: int = 2000, seconds: float = 1.0):
        self.folder, self.metrics, self.batch, self.seconds = folder, metrics, batch, seconds
        self.buffer, self._stop, self._threads = Buffer(buffer, metrics), threading.Event(), []
        self._first = time.time_ns() // 1000  # arrivals go on rising over restarts

    def start(self, host: str, port: int) -> tuple[str, int]:
        os.makedirs(self.folder, exist_ok=True)
        family = socket.AF_INET6 if ":" in host else socket.AF_INET
        self._socket = socket.socket(family, socket.SOCK_DGRAM)
        self._socket.bind((host, port))
        self._socket.settimeout(0.2)
        self._threads = [threading.Thread(target=f, daemon=True) for f in (self._listen, self._write)]
        for t in self._threads:
            t.start()
        return self._socket.getsockname()[:2]

    def _listen(self) -> None:
        while not self._stop.is_set():
            try:
                payload, peer = self._socket.recvfrom(LARGEST)
            except TimeoutError:
                continue
            except OSError:
                break
            a = ipaddress.ip_address(peer[0].split("%")[0])
            self.buffer.offer((MAPPED_PREFIX + a.packed if a.version == 4 else a.packed, dt.datetime.now(dt.UTC), payload))

    def _write(self) -> None:
        while not (self._stop.is_set() and not len(self.buffer)):
            items = self.buffer.take(self.batch, self.seconds if not self._stop.is_set() else 0.01)
            if items:
                columns = list(zip(*((e, at, self._first + n, p) for n, (e, at, p) in items)))
                self.metrics.set("buffer_length", len(self.buffer))
                table = pa.table([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)
                name = f"{self._first + items[0][0]:020d}-{uuid.uuid4().hex}.parquet"
                pq.write_table(table, f"{self.folder}/_{name}")
                os.rename(f"{self.folder}/_{name}", f"{self.folder}/{name}")

    def stop(self, seconds: float = 10.0) -> None:
        """Stops listening and flushes what is buffered, for so long at most."""
        self._stop.set()
        self.buffer.close()
        for t in self._threads:
            t.join(seconds)
        self._socket.close()
