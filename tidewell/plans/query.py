"""The flow query: a mandatory half-open range, exact filters, newest first, continued by a cursor."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row

from ..operators import predicates as P

DEFAULT_LIMIT, MOST_LIMIT = 100, 1000


class BadCursor(ValueError):
    """A cursor that this engine didn't make."""


def clamp(limit: int | None) -> int:
    """Rows per page: the default for none or less than one, never more than the most."""
    return DEFAULT_LIMIT if limit is None or limit < 1 else min(limit, MOST_LIMIT)


def encode_cursor(us: int, seq: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"t": us, "s": seq}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple[int, int]:
    try:
        if "=" in text:
            raise ValueError("padded")
        raw = json.loads(base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True))
        us, seq = raw["t"], raw["s"]
        if type(us) is not int or type(seq) is not int or not 0 <= seq < 1 << 63 or abs(us) > 253_402_300_799_999_999:
            raise ValueError("out of range")
        return us, seq
    except (ValueError, KeyError, TypeError, binascii.Error) as e:
        raise BadCursor(f"not a cursor: {text!r}") from e


@dataclass(frozen=True)
class FlowQuery:
    """Times in microseconds of UTC; a filter that is None doesn't apply. Addresses in the form of the table's columns."""

    start: int
    end: int
    exporter_id: int | None = None
    src_addr: bytes | str | None = None
    dst_addr: bytes | str | None = None
    protocol: int | None = None
    limit: int | None = None
    cursor: str | None = None

    def __post_init__(self):
        if self.start is None or self.end is None:
            raise ValueError("a flow query needs start and end")


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: str | None
    has_more: bool


def selected(flows: DataFrame, q: FlowQuery) -> DataFrame:
    """The rows that the query's filters and cursor leave, in no order."""
    out = P.matching(P.in_range(flows, q.start, q.end), exporter_id=q.exporter_id or None, src_addr=q.src_addr, dst_addr=q.dst_addr, protocol=q.protocol)
    return P.after_key(out, *decode_cursor(q.cursor)) if q.cursor else out


def plan(flows: DataFrame, q: FlowQuery, look_ahead: int = 1) -> DataFrame:
    """The page as a DataFrame: the clamped limit and, to tell if there is more, one row besides."""
    return P.newest_first(selected(flows, q), clamp(q.limit) + look_ahead)


def page(flows: DataFrame, q: FlowQuery) -> Page:
    """Runs a query; at most MOST_LIMIT + 1 rows come to the driver."""
    n = clamp(q.limit)
    rows = P.collected(plan(flows, q))
    more, rows = len(rows) > n, rows[:n]
    return Page(rows, encode_cursor(P.micros(rows[-1]["received_at"]), rows[-1]["seq"]) if more else None, more)


def pages(flows: DataFrame, q: FlowQuery):
    """All pages in order."""
    while True:
        one = page(flows, q)
        yield one
        if not one.has_more:
            return
        q = replace(q, cursor=one.next_cursor)
