"""JSON messages: one object per record, decoded with a schema, split into good rows and quarantined ones."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network as N
from ..schema import DECODED, known_flow_type, u64

FORMAT = "tidewell/v1"
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
#: Bits of each unsigned number.
UNSIGNED = {"src_port": 16, "dst_port": 16, "protocol": 8, "tcp_flags": 8, "sampling_rate": 32, "input_iface": 32, "output_iface": 32, "src_as": 32, "dst_as": 32}
WIDE = ("packets", "bytes")
MESSAGE = (
    "exporter_addr string, flow_type string, received_at string, first_switched string, last_switched string, src_addr string, dst_addr string, src_port bigint, dst_port bigint, protocol bigint, tcp_flags bigint, "
    "packets decimal(20,0), bytes decimal(20,0), sampling_rate bigint, input_iface bigint, output_iface bigint, src_as bigint, dst_as bigint, next_hop string, _corrupt string"
)


def _time(c: Column) -> Column:
    """An RFC 3339 time with up to nine digits of a second, cut to microseconds; null if it is none."""
    shape = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d{1,9})?([Zz]|[+-]\d\d:\d\d)$"
    cut = F.when(F.length(c) > 26, F.regexp_replace(c, r"(\.\d{6})\d+", "$1")).otherwise(c)
    return F.when(c.rlike(shape), cut.try_cast("timestamp"))


def staged(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """df's columns `keep` with new ones, behind a generator: what comes later reads them and doesn't have them computed anew at each use."""
    return df.select(*keep, F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


ADDRESSES = ("exporter_addr", "src_addr", "dst_addr", "next_hop")
TIMES = ("received_at", "first_switched", "last_switched")


def decoded(messages: DataFrame) -> DataFrame:
    """messages (value string, timestamp: the transport's) with the record's columns and `reason`, null for good ones.

    Unknown fields are passed over. received_at is the message's, else the transport's time, never the reader's clock.
    """
    names = [c.split(" ")[0] for c in MESSAGE.split(", ")]
    parsed = F.array(F.from_json("value", MESSAGE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    m = messages.select("*", F.inline_outer(parsed).alias(*(f"m_{n}" for n in names)))
    f = lambda name: F.col(f"m_{name}")
    m = staged(m, m.columns, **{f"t_{n}": _time(f(n)) for n in TIMES}, **{f"a_{n}": N.ipv4_bytes(f(n)) for n in ADDRESSES})
    # only texts that aren't IPv4 go to Python
    other = {n: N.ip_bytes(F.when(F.col(f"a_{n}").isNull() & (f(n) != ""), f(n))) for n in ADDRESSES}
    m = m.withColumns({f"o_{n}": c for n, c in other.items()})
    most = F.lit(Decimal((1 << 64) - 1)).cast("decimal(20,0)")
    numbers = {n: F.coalesce(f(n), F.lit(0)) for n in UNSIGNED}
    wide = {n: F.coalesce(f(n), F.lit(0).cast("decimal(20,0)")) for n in WIDE}
    sound = {n: c.between(0, (1 << UNSIGNED[n]) - 1) for n, c in numbers.items()} | {n: (c >= 0) & (c <= most) for n, c in wide.items()}
    pattern = lambda c: F.when(c > F.lit(Decimal((1 << 63) - 1)).cast("decimal(20,0)"), c - F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(c).cast("bigint")
    kinds = {"src_port": "int", "dst_port": "int", "protocol": "smallint", "tcp_flags": "smallint"}
    malformed = F.lit(False)
    for n in ADDRESSES:
        malformed = malformed | ((F.coalesce(f(n), F.lit("")) != "") & F.col(f"a_{n}").isNull() & F.col(f"o_{n}").isNull())
    for n in TIMES:
        malformed = malformed | (f(n).isNotNull() & F.col(f"t_{n}").isNull())
    for c in sound.values():
        malformed = malformed | ~c
    values = {n: F.coalesce(f"a_{n}", f"o_{n}") for n in ADDRESSES} | {"flow_type": f("flow_type"), "first_switched": F.col("t_first_switched"), "last_switched": F.col("t_last_switched")}
    values["received_at"] = F.coalesce("t_received_at", F.col("timestamp").cast("timestamp"))
    values |= {n: F.when(sound[n], c).cast(kinds.get(n, "bigint")) for n, c in numbers.items()} | {n: F.when(sound[n], pattern(c)) for n, c in wide.items()}
    values["sampling_rate"] = F.greatest(values["sampling_rate"], F.lit(1))
    fault = F.when(F.col("value").isNull() | f("_corrupt").isNotNull(), "not a message").when(malformed, "malformed field")
    keep = [c for c in messages.columns if c not in DECODED]
    m = staged(m, keep, **{f"v_{n}": c for n, c in values.items()}, fault=fault)
    v = lambda n: F.col(f"v_{n}")
    reason = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(v("exporter_addr").isNull(), "no exporter").when(~known_flow_type(v("flow_type")), "no such flow type")
        .when(v("src_addr").isNull() | v("dst_addr").isNull(), "no source or destination")
        .when(v("first_switched").isNull() | v("last_switched").isNull(), "no first or last time").when(v("received_at").isNull(), "no time of receipt")
    )
    key = N.natural_key(v("exporter_addr"), F.unix_micros(v("first_switched")), v("src_addr"), v("dst_addr"), v("src_port"), v("dst_port"), v("protocol"))
    return staged(m, keep, **{n: key if n == "dedup_key" else v(n) for n in DECODED}, reason=reason)


def good(messages: DataFrame) -> DataFrame:
    """The records of messages that decode; their dedup_key is the natural key's digest."""
    found = decoded(messages).where("reason is null")
    # a good record has a time of receipt and a key, which the schema tells, so that deduplication doesn't decode anew for rows without
    sure = {"received_at": F.timestamp_micros(F.lit(0)), "dedup_key": F.lit(b"")}
    return found.select(*(F.coalesce(c, sure[c]).alias(c) if c in sure else c for c in DECODED))


def quarantined(messages: DataFrame) -> DataFrame:
    """What doesn't decode, as it came, with the reason; a bad message never stops a stream."""
    return decoded(messages).where("reason is not null").select("value", "timestamp", "reason")


def encoded(records: DataFrame) -> DataFrame:
    """key (exporter's text), value (JSON) and timestamp of each record; the dedup key isn't carried, as readers derive it."""
    text = lambda n: N.address_text(F.col(n)).alias(n)
    time = lambda n: F.date_format(n, TIME).alias(n)
    shown = [
        F.lit(FORMAT).alias("format"), text("exporter_addr"), "flow_type", time("received_at"), time("first_switched"), time("last_switched"), text("src_addr"), text("dst_addr"),
        "src_port", "dst_port", "protocol", "tcp_flags", u64(F.col("packets")).alias("packets"), u64(F.col("bytes")).alias("bytes"), "sampling_rate", "input_iface", "output_iface", "src_as", "dst_as", text("next_hop"),
    ]
    flat = records.select(F.col("received_at").alias("__at"), F.struct(*shown).alias("r"))
    message = F.struct(F.col("r.exporter_addr").alias("key"), F.to_json("r", {"ignoreNullFields": "false"}).alias("value"), F.col("__at").alias("timestamp"))
    return flat.select(F.inline_outer(F.array(message)))
