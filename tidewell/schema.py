"""The flow record and the exporter dimension as Spark types.

Unsigned 64-bit counters keep their bit pattern in a bigint; u64() is the decimal view to aggregate and show. Addresses are
16 bytes, IPv4 in its mapped form, so both spellings of an IPv4 address are equal. Times are microseconds in UTC.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 2

#: The record kinds that exist; fixed values.
FLOW_TYPES = ("netflow5", "netflow9", "ipfix")


RECORD_DDL = (
    "received_at timestamp, seq bigint, exporter_id bigint, exporter_addr binary, flow_type string, first_switched timestamp, last_switched timestamp, "
    "src_addr binary, dst_addr binary, src_port int, dst_port int, protocol smallint, tcp_flags smallint, packets bigint, bytes bigint, "
    "sampling_rate bigint, input_iface bigint, output_iface bigint, src_as bigint, dst_as bigint, next_hop binary, dedup_key binary"
)
EXPORTER_DDL = "id bigint, ip_address binary, label string, first_seen_at timestamp, last_seen_at timestamp"
#: Columns of a record as decoders make them: without storage's seq and exporter_id.
DECODED = [c.split(" ")[0] for c in RECORD_DDL.split(", ") if c.split(" ")[0] not in ("seq", "exporter_id")]
#: What readers see: storage's seq and the dedup key stay hidden.
PUBLIC = [c.split(" ")[0] for c in RECORD_DDL.split(", ") if c.split(" ")[0] not in ("seq", "dedup_key")]
#: Fields without which a record is refused.
REQUIRED = ("received_at", "exporter_addr", "src_addr", "dst_addr", "first_switched", "last_switched")


def u64(c: Column) -> Column:
    """The unsigned value of a bigint's bit pattern."""
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(wide)


def known_flow_type(c: Column) -> Column:
    return F.coalesce(c.isin(*FLOW_TYPES), F.lit(False))


def refusal(columns: list[str]) -> Column:
    """Why a record can't be stored, null if it can."""
    reason = F.when(~known_flow_type(F.col("flow_type")), F.lit("unknown flow_type"))
    for name in REQUIRED:
        if name in columns:
            reason = reason.when(F.col(name).isNull(), F.lit(f"{name} is required"))
    return reason
