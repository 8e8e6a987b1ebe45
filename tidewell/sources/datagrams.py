"""Flow-export datagrams: version sniff and faults as Catalyst expressions, version 5 records by whole Arrow batches.

A datagram table has exporter (16 bytes), received_at, arrival (an increasing number) and payload. decode_v5 gives its
good records; undecodable() gives the datagrams that yield none, with the reason, so that good + bad accounts for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network as N
from ..schema import DECODED, RECORD_DDL
from . import fields as A

V5_HEADER, V5_RECORD = 24, 48
DATAGRAM_DDL = "exporter binary, received_at timestamp, arrival bigint, payload binary"


def version(payload: Column) -> Column:
    """5, 9 or 10; null for short or other datagrams."""
    v = N.be_uint(F.substring(payload, 1, 2)).cast("int")
    return F.when((F.length(payload) >= 2) & v.isin(5, 9, 10), v)


def _at(record: Column, offset: int, width: int) -> Column:
    return F.substring(record, offset + 1, width)


def _count(payload: Column) -> Column:
    return N.be_uint(F.substring(payload, 3, 2)).cast("int")


def v5_fault(payload: Column) -> Column:
    """Why a version 5 datagram can't be decoded; null if it can. Bytes behind the announced records are tolerated."""
    return F.when(F.length(payload) < V5_HEADER, "short header").when(F.length(payload) < V5_HEADER + _count(payload) * V5_RECORD, "fewer records than announced")


def undecodable(datagrams: DataFrame) -> DataFrame:
    """Datagrams of no known version, and faulty ones of version 5, with `reason`."""
    p = F.col("payload")
    reason = F.when(F.coalesce(F.length(p), F.lit(0)) < 2, "short datagram").when(version(p).isNull(), "unknown version").when(version(p) == 5, v5_fault(p))
    return datagrams.withColumn("reason", reason).where("reason is not null")


#: The fields of a version 5 record that are plain numbers: offset, width, type. Fixed values of the format.
V5_NUMBERS = {
    "src_port": (32, 2, pa.int32()), "dst_port": (34, 2, pa.int32()), "protocol": (38, 1, pa.int16()), "tcp_flags": (37, 1, pa.int16()), "packets": (16, 4, pa.int64()), "bytes": (20, 4, pa.int64()),
    "input_iface": (12, 2, pa.int64()), "output_iface": (14, 2, pa.int64()), "src_as": (40, 2, pa.int64()), "dst_as": (42, 2, pa.int64()),
}


def _decode_v5(batches):
    for batch in batches:
        data, bounds = A.binary_parts(batch["payload"])
        size = np.diff(bounds)
        whole = np.flatnonzero(size >= V5_HEADER)
        head = A.rows_of(data, bounds[whole], V5_HEADER)
        number = lambda at, width: A.big_endian(head[:, at : at + width]).astype(np.int64)
        count = number(2, 2)
        sound = (number(0, 2) == 5) & (count > 0) & (size[whole] >= V5_HEADER + count * V5_RECORD)
        boot = number(8, 4) * 1_000_000 + number(12, 4) // 1000 - number(4, 4) * 1000
        sampling = np.maximum(1, number(22, 2) & 0x3FFF)
        whole, count, boot, sampling = whole[sound], count[sound], boot[sound], sampling[sound]
        start, own, place = A.starts_of(bounds[whole] + V5_HEADER, count, V5_RECORD)
        r = A.rows_of(data, start, V5_RECORD)
        at = pa.array(whole[own])
        values = {name: A.numbers(A.big_endian(r[:, o : o + w]), kind) for name, (o, w, kind) in V5_NUMBERS.items()}
        values |= {name: A.instants(boot[own] + A.big_endian(r[:, o : o + 4]).astype(np.int64) * 1000) for name, o in (("first_switched", 24), ("last_switched", 28))}
        values |= {"src_addr": A.addresses(r[:, :4]), "dst_addr": A.addresses(r[:, 4:8]), "next_hop": A.addresses(r[:, 8:12], r[:, 8:12].any(1)), "sampling_rate": pa.array(sampling[own])}
        values |= {"received_at": batch["received_at"].take(at).cast(A.UTC), "exporter_addr": batch["exporter"].take(at), "flow_type": pa.array(["netflow5"] * len(own), pa.string()), "dedup_key": pa.nulls(len(own), pa.binary())}
        values |= {"arrival": batch["arrival"].take(at), "record_no": pa.array(place.astype(np.int32))}
        yield pa.RecordBatch.from_arrays([values[c] for c in V5_COLUMNS], V5_COLUMNS)


V5_DDL = ", ".join(f"{c} {dict(x.split(' ') for x in RECORD_DDL.split(', '))[c]}" for c in DECODED) + ", arrival bigint, record_no int"
V5_COLUMNS = [*DECODED, "arrival", "record_no"]


def decode_v5(datagrams: DataFrame) -> DataFrame:
    """One row per record of each sound version 5 datagram, in the decoded form; dedup_key is null, as nothing redelivers.

    Records have a fixed layout, so a batch of datagrams is cut up as a whole: each field is a slice of a matrix of bytes.
    """
    return datagrams.select("exporter", "received_at", "arrival", "payload").where(version(F.col("payload")) == 5).mapInArrow(_decode_v5, V5_DDL)


def encode_v5(flows: DataFrame, per_datagram: int = 30, uptime_ms: int = 1_000_000_000) -> DataFrame:
    """Packs records into version 5 datagrams of up to per_datagram records with consecutive seq, for replay and tests.

    flows: record columns with binary addresses. A datagram's received_at is its earliest record's, and its header clock that one's
    whole millisecond; so switch times survive to the millisecond.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    grouped = flows.withColumn("arrival", F.expr(f"seq div {min(30, per_datagram)}"))
    heads = grouped.groupBy("exporter_addr", "arrival", "sampling_rate").agg(F.min(us("received_at")).alias("at_us"))
    joined = grouped.join(heads, ["exporter_addr", "arrival", "sampling_rate"])
    header_us = F.expr("at_us div 1000 * 1000")
    since_boot = lambda c: F.floor((us(c) - (header_us - F.lit(uptime_ms * 1000))) / 1000)
    v4 = lambda c: F.substring(F.coalesce(F.col(c), F.lit(N.MAPPED_PREFIX + b"\0" * 4)), 13, 4)
    b = lambda c, w: N.be_bytes(F.col(c), w)
    zero = lambda w: F.lit(b"\0" * w)
    record = F.concat(
        v4("src_addr"), v4("dst_addr"), v4("next_hop"), b("input_iface", 2), b("output_iface", 2), b("packets", 4), b("bytes", 4),
        N.be_bytes(since_boot("first_switched"), 4), N.be_bytes(since_boot("last_switched"), 4), b("src_port", 2), b("dst_port", 2),
        zero(1), b("tcp_flags", 1), b("protocol", 1), zero(1), b("src_as", 2), b("dst_as", 2), zero(4),
    )
    packed = joined.groupBy("exporter_addr", "arrival", "sampling_rate", "at_us").agg(F.array_sort(F.collect_list(F.struct("seq", record.alias("r")))).alias("rs"))
    body = F.aggregate("rs", F.lit(b""), lambda acc, x: F.concat(acc, x["r"]))
    head = F.concat(
        N.be_bytes(F.lit(5), 2), N.be_bytes(F.size("rs"), 2), N.be_bytes(F.lit(uptime_ms), 4), N.be_bytes(F.floor(header_us / 1_000_000), 4),
        N.be_bytes(F.pmod(header_us, F.lit(1_000_000)) * 1000, 4), N.be_bytes(F.col("arrival"), 4), zero(2), N.be_bytes(F.col("sampling_rate"), 2),
    )
    return packed.select(F.col("exporter_addr").alias("exporter"), F.timestamp_micros("at_us").alias("received_at"), "arrival", F.concat(head, body).alias("payload"))
