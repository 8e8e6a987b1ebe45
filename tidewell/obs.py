"""Metrics and redacted JSON logs."""

from __future__ import annotations

import datetime as dt
import json
import logging
import re
import threading

from pyspark.sql.streaming import StreamingQueryListener

from .operators.stats import LAG_BOUNDS, WRITE_BOUNDS

#: Name: kind, help, labels whose first values are shown from the start.
INSTRUMENTS = {
    "decode_errors": ("counter", "Datagrams or messages that did not decode.", {"source": ("udp", "bus")}),
    "records_ingested": ("counter", "Records taken into the buffer.", {"source": ("udp", "bus")}),
    "records_dropped": ("counter", "Records dropped in place of being buffered.", {"reason": ("buffer_full", "shutdown", "at_most_once")}),
    "deduped_rows": ("counter", "Rows that were stored before.", {}),
    "batch_write_errors": ("counter", "Batches that a sink refused.", {"sink": ()}),
    "source_rewinds": ("counter", "Batches that were delivered again.", {"source": ("udp", "bus")}),
    "buffer_length": ("gauge", "Records that wait in the buffer.", {}),
    "stream_rows_per_second": ("gauge", "Rows that a stream's last batch took in a second.", {"stream": ()}),
    "stream_batch_seconds": ("gauge", "Time of a stream's last batch, from its trigger to its commit.", {"stream": ()}),
    "stream_state_rows": ("gauge", "Rows that a stream keeps in state.", {"stream": ()}),
    "stream_failures": ("counter", "Streams that ended with an error.", {}),
    "batch_write_seconds": ("histogram", "Time of a batch's write.", {"sink": ()}),
    "visibility_lag_seconds": ("histogram", "Time from receipt to the end of the write.", {}),
}
BOUNDS = {"batch_write_seconds": WRITE_BOUNDS, "visibility_lag_seconds": LAG_BOUNDS}
PREFIX = "tidewell_"


class Metrics:
    def __init__(self):
        self._lock = threading.Lock()
        self._values: dict[tuple, float] = {}
        for name, (kind, _, labels) in INSTRUMENTS.items():
            for label, values in labels.items() or {"": ("",)}.items():
                if kind != "histogram":
                    for v in values:
                        self._values[name, ((label, v),) if label else ()] = 0

    def count(self, name: str, n: float = 1, **labels) -> None:
        with self._lock:
            key = (name, tuple(sorted(labels.items())))
            self._values[key] = self._values.get(key, 0) + n

    def set(self, name: str, value: float, **labels) -> None:
        with self._lock:
            self._values[name, tuple(sorted(labels.items()))] = value

    def observe(self, name: str, seconds: float, n: int = 1, **labels) -> None:
        own = tuple(sorted(labels.items()))
        with self._lock:
            for b in (*BOUNDS[name], float("inf")):
                key = (f"{name}_bucket", (*own, ("le", b)))
                self._values[key] = self._values.get(key, 0) + (n if seconds <= b else 0)
            for part, add in (("sum", seconds * n), ("count", n)):
                self._values[f"{name}_{part}", own] = self._values.get((f"{name}_{part}", own), 0) + add

    def value(self, name: str, **labels) -> float:
        return self._values.get((name, tuple(sorted(labels.items()))), 0)

    def text(self) -> str:
        """The Prometheus text format."""
        out = []
        with self._lock:
            for name, (kind, what, _) in INSTRUMENTS.items():
                full = PREFIX + name + ("_total" if kind == "counter" else "")
                out += [f"# HELP {full} {what}", f"# TYPE {full} {kind}"]
                for (key, labels), v in sorted(self._values.items(), key=str):
                    if key == name or kind == "histogram" and key.startswith(name + "_"):
                        shown = ",".join(f'{k}="{"+Inf" if x == float("inf") else x}"' for k, x in labels)
                        out.append(f"{full if key == name else PREFIX + key}{{{shown}}} {v:g}" if shown else f"{full if key == name else PREFIX + key} {v:g}")
        return "\n".join(out) + "\n"


class StreamWatch(StreamingQueryListener):
    """Brings what Spark tells of its streams into the same metrics as all else: spark.streams.addListener(StreamWatch(metrics))."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        stream = p.name or str(p.id)
        self.metrics.set("stream_rows_per_second", p.processedRowsPerSecond or 0, stream=stream)
        self.metrics.set("stream_batch_seconds", (p.durationMs or {}).get("triggerExecution", 0) / 1000, stream=stream)
        self.metrics.set("stream_state_rows", sum(o.numRowsTotal for o in p.stateOperators), stream=stream)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.metrics.count("stream_failures")


SECRET = re.compile(r"(?i)(password|secret|token|api[_-]?keys?|authorization|dsn)")
URL_PASSWORD = re.compile(r"(://[^:/@\s]+:)[^@/\s]+@")


def redacted(value, name: str = ""):
    """value with secrets replaced: by the name they go under, or as a password in an address."""
    if SECRET.search(name):
        return "[redacted]"
    if isinstance(value, dict):
        return {k: redacted(v, str(k)) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [redacted(v) for v in value]
    return URL_PASSWORD.sub(r"\1[redacted]@", value) if isinstance(value, str) else value


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        entry = {"time": dt.datetime.fromtimestamp(record.created, dt.UTC).isoformat(), "level": record.levelname.lower(), "logger": record.name, "message": redacted(record.getMessage())}
        return json.dumps(entry | redacted(getattr(record, "fields", {})), default=str)


def log_to_stderr(level: str = "info") -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter())
    logging.basicConfig(level=level.upper(), handlers=[handler], force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)  # else each call of a stream's batch is logged, at exit to closed files too
