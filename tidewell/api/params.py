"""The parameters of GET /v1/flows: one table that the binder, the validation and the OpenAPI document read."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import parse_qs

from ..functions.network import parse_ip
from ..operators.predicates import EPOCH
from ..plans import query as Q


@dataclass(frozen=True)
class Param:
    name: str
    parse: Callable
    schema: dict
    what: str
    required: bool = False
    least: int | None = None
    most: int | None = None


def _time(text: str) -> int:
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)", text)
    if not m:
        raise ValueError("is not an RFC 3339 time")
    try:
        whole = dt.datetime.fromisoformat(f"{m[1]}T{m[2]}{'+00:00' if m[4] in 'Zz' else m[4]}")
    except ValueError:
        raise ValueError("is not an RFC 3339 time") from None
    return (whole - EPOCH) // dt.timedelta(microseconds=1) + int((m[3] or "").ljust(6, "0")[:6])


def _int(text: str) -> int:
    if not re.fullmatch(r"[+-]?\d+", text) or not -(1 << 63) <= int(text) < 1 << 63:
        raise ValueError("is not a whole number")
    return int(text)


def _ip(text: str) -> bytes:
    try:
        return parse_ip(text)
    except ValueError:
        raise ValueError("is not an IP address") from None


_WHEN, _ADDRESS, _INTEGER = {"type": "string", "format": "date-time"}, {"type": "string"}, {"type": "integer"}
PARAMS = [
    Param("start", _time, _WHEN, "First moment of receipt, included (RFC 3339).", required=True),
    Param("end", _time, _WHEN, "Moment of receipt to stop before; later than start.", required=True),
    Param("exporter_id", _int, _INTEGER, "Flows of one exporter.", least=1),
    Param("src_addr", _ip, _ADDRESS, "Source address, IPv4 or IPv6, exactly."),
    Param("dst_addr", _ip, _ADDRESS, "Destination address, exactly."),
    Param("protocol", _int, _INTEGER, "Number of the IP protocol.", least=0, most=255),
    Param("limit", _int, _INTEGER, f"Flows per page: {Q.DEFAULT_LIMIT} by default and below 1, {Q.MOST_LIMIT} at most."),
    Param("cursor", str, {"type": "string"}, "next_cursor of the page before."),
]


class Invalid(ValueError):
    def __init__(self, details: list[dict]):
        super().__init__("invalid parameters")
        self.details = details


def bind(query: str, params: list[Param]) -> dict:
    """The parameters' values. Unknown names (sorted) and what doesn't parse are reported first, then what is out of bounds."""
    given = parse_qs(query, keep_blank_values=True)
    known = {p.name: p for p in params}
    wrong = [{"field": n, "message": "is no parameter of this path"} for n in sorted(set(given) - set(known))]
    values = {}
    for p in params:
        if given.get(p.name, [""])[0] == "":
            continue
        try:
            values[p.name] = p.parse(given[p.name][0])
        except ValueError as e:
            wrong.append({"field": p.name, "message": str(e)})
    if not wrong:
        for p in params:
            v = values.get(p.name)
            if v is None:
                wrong += [{"field": p.name, "message": "has to be given"}] * p.required
            elif p.least is not None and v < p.least:
                wrong.append({"field": p.name, "message": f"is below {p.least}"})
            elif p.most is not None and v > p.most:
                wrong.append({"field": p.name, "message": f"is above {p.most}"})
        if "start" in values and "end" in values and values["end"] <= values["start"]:
            wrong.append({"field": "end", "message": "has to be later than start"})
    if wrong:
        raise Invalid(wrong)
    return values
