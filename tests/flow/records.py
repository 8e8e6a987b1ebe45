"""Records for the tests of storage: traffic drawn from a table of services by a generator that a record's number seeds."""

import datetime as dt
import random

from pyspark.sql.types import _parse_datatype_string

from tidewell.functions.network import parse_ip
from tidewell.schema import DECODED, RECORD_DDL

BASE = dt.datetime(2026, 3, 4, 10, 30, tzinfo=dt.UTC)
A, B = "172.20.0.9", "172.20.0.10"
HOUR = 3_600_000_000


def us(t):
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)


WINDOW = {"start": us(BASE) - HOUR, "end": us(BASE) + HOUR}
#: Services of an invented site: flow type, protocol, port, weight of the draw.
SERVICES = {"mail": ("netflow5", 6, 993, 4), "names": ("netflow9", 17, 853, 3), "backup": ("ipfix", 6, 10_050, 2), "voice": ("ipfix", 17, 5061, 1), "tunnel": ("netflow9", 47, 0, 1)}
#: Networks that clients and servers are drawn from.
CLIENTS, SERVERS = ("172.30.{}.{}", "fd00:1ab:{:x}::{:x}"), ("10.99.{}.{}", "fd00:1ab:ff{:02x}::{:x}")
#: A record's number is its source AS less this, the first of the private ones of 32 bits.
FIRST_AS = 4_200_000_000


def number(r):
    return r["src_as"] - FIRST_AS


def record(i, exporter=A, at=None, keyed=True):
    draw = random.Random(i)
    kind, protocol, port, _ = draw.choices(list(SERVICES.values()), [s[-1] for s in SERVICES.values()])[0]
    family, at = draw.randrange(2), at or BASE + dt.timedelta(microseconds=i)
    seconds = draw.uniform(0.5, 40)
    values = {
        "received_at": at, "exporter_addr": parse_ip(exporter), "flow_type": kind,
        "first_switched": at - dt.timedelta(seconds=round(1 + seconds, 3)), "last_switched": at - dt.timedelta(seconds=1),
        "src_addr": parse_ip(CLIENTS[family].format(draw.randrange(8), draw.randrange(1, 255))), "dst_addr": parse_ip(SERVERS[family].format(draw.randrange(3), draw.randrange(1, 9))),
        "src_port": draw.randrange(1024, 65536) if port else 0, "dst_port": port, "protocol": protocol, "tcp_flags": draw.choice([0x12, 0x1B]) if protocol == 6 else 0,
        "packets": draw.randrange(1, 1 << 12), "bytes": draw.randrange(64, 1 << 22), "sampling_rate": draw.choice([1, 128, 512]), "input_iface": draw.randrange(4), "output_iface": draw.randrange(4),
        "src_as": FIRST_AS + i, "dst_as": draw.choice([65_010, 65_020, 65_030]),
        "next_hop": draw.choice([None, parse_ip("172.20.0.1")]), "dedup_key": draw.randbytes(12) if keyed else None,
    }
    return tuple(values[c] for c in DECODED)


def frame(spark, rows):
    kinds = dict(c.split(" ") for c in RECORD_DDL.split(", "))
    return spark.createDataFrame(rows, _parse_datatype_string(", ".join(f"{c} {kinds[c]}" for c in DECODED)))


def batch(spark, n, keyed=True, first=0, at=None):
    return frame(spark, [record(i, keyed=keyed, at=at) for i in range(first, first + n)])
