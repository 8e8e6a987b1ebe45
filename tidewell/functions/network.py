"""Column functions for flow-export fields: integers from bytes, clocks, addresses, identifiers."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds from the NTP era's start (1900) to the Unix epoch.
NTP_OFFSET = 2_208_988_800
MAPPED_PREFIX = b"\0" * 10 + b"\xff\xff"


def be_uint(c: Column) -> Column:
    """A big-endian unsigned integer of up to 8 bytes as a bigint's bit pattern; of longer ones the last 8 bytes count."""
    digits = F.hex(F.when(F.length(c) > 8, F.substring(c, F.length(c) - 7, F.lit(8))).otherwise(c))
    return F.conv(digits, 16, -10).cast("bigint")


def be_hex(c: Column, width: int) -> Column:
    """The hexadecimal digits of the last `width` bytes of an integer."""
    return F.substring(F.lpad(F.hex(c.cast("bigint")), 16, "0"), 17 - 2 * width, 2 * width)


def be_bytes(c: Column, width: int) -> Column:
    """The last `width` bytes of an integer, big-endian."""
    return F.unhex(be_hex(c, width))


def narrow(c: Column, bits: int) -> Column:
    """The low bits of an integer, as a fixed-width field would keep them."""
    return c.bitwiseAND(F.lit((1 << bits) - 1))


def uptime_micros(boot_micros: Column, uptime_ms: Column) -> Column:
    """A device's milliseconds since boot on the Unix clock."""
    return boot_micros + uptime_ms.cast("bigint") * 1000


def ntp64_micros(c: Column) -> Column:
    """An 8-byte NTP timestamp in Unix microseconds, rounded down."""
    high, low = be_uint(F.substring(c, 1, 4)), be_uint(F.substring(c, 5, 4))
    # low * 10^6 stays under 2^52
    return (high - F.lit(NTP_OFFSET)) * 1_000_000 + F.shiftrightunsigned(low * 1_000_000, 32)


def mapped(c: Column) -> Column:
    """4 or 16 address bytes in the 16-byte form; null for other lengths."""
    return F.when(F.length(c) == 16, c).when(F.length(c) == 4, F.concat(F.lit(MAPPED_PREFIX), c))


def present(c: Column) -> Column:
    """An address or null if it is all zeros (in either form)."""
    zero4, zero6 = F.lit(MAPPED_PREFIX + b"\0" * 4), F.lit(b"\0" * 16)
    return F.when((c != zero4) & (c != zero6), c)


def parse_ip(text: str) -> bytes:
    """16 bytes of an address; ValueError if it is none. Octets with leading zeros and zones are refused."""
    if "%" in text:
        raise ValueError(f"{text!r} has a zone")
    a = ipaddress.ip_address(text)
    return MAPPED_PREFIX + a.packed if a.version == 4 else a.packed


def show_ip(raw: bytes) -> str:
    """Canonical text; mapped addresses show as IPv4."""
    a = ipaddress.ip_address(bytes(raw))
    return str(a.ipv4_mapped or a) if a.version == 6 else str(a)


def _parsed(text):
    try:
        return None if text is None else parse_ip(text)
    except ValueError:
        return None


@F.pandas_udf(T.BinaryType())
def ip_bytes(text: pd.Series) -> pd.Series:
    """parse_ip over a column; null for what is no address. Each distinct text is parsed once a batch."""
    known = {t: _parsed(t) for t in text.dropna().unique()}
    return text.map(lambda t: known.get(t) if isinstance(t, str) else None)


@F.pandas_udf(T.StringType())
def ip_text(raw: pd.Series) -> pd.Series:
    """show_ip over a column. Each distinct address is shown once a batch."""
    known = {b: show_ip(b) for b in raw.dropna().unique()}
    return raw.map(lambda b: known.get(b) if b is not None else None)


#: IPv4 text: four numbers up to 255, written without leading zeros, and nothing else.
IPV4 = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|\z)){4}(?<!\.)\z"


def ipv4_bytes(text: Column) -> Column:
    """The mapped bytes of IPv4 text without leaving Catalyst; null for others. The text is matched and split once, without functions over each of its parts."""

    def joined(parts: Column) -> Column:
        number = F.lit(0xFFFF << 32).cast("bigint")
        for i in range(4):
            number = number + parts[i].cast("bigint") * (1 << 8 * (3 - i))
        # the mapped prefix ends in ones, so the digits need no padding
        return F.when(parts.isNotNull(), F.concat(F.lit(MAPPED_PREFIX[:10]), F.unhex(F.hex(number))))

    return F.transform(F.array(F.when(text.rlike(IPV4), F.split(text, r"\."))), joined)[0]


def address_bytes(text: Column) -> Column:
    """16 bytes of an address, null for what is none; only texts that aren't IPv4 go to Python."""
    four = ipv4_bytes(text)
    return F.coalesce(four, ip_bytes(F.when(four.isNull(), text)))


def address_text(raw: Column) -> Column:
    """Canonical text of an address; only what isn't mapped IPv4 goes to Python."""
    return F.coalesce(ipv4_text(raw), ip_text(F.when(F.substring(raw, 1, 12) != F.lit(MAPPED_PREFIX), raw)))


def ipv4_text(c: Column) -> Column:
    """Text of mapped IPv4 addresses without leaving Catalyst; null for others."""
    octet = lambda i: F.conv(F.hex(F.substring(c, i, 1)), 16, 10)
    return F.when(F.substring(c, 1, 12) == F.lit(MAPPED_PREFIX), F.concat_ws(".", *(octet(i) for i in range(13, 17))))


def natural_key(exporter: Column, first_micros: Column, src: Column, dst: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """The identity of a flow that a transport may deliver twice: 16 bytes of SHA-256 over its natural key."""
    packed = F.concat(exporter, be_bytes(first_micros, 8), src, dst, be_bytes(src_port, 2), be_bytes(dst_port, 2), be_bytes(protocol, 1))
    return F.unhex(F.substring(F.sha2(packed, 256), 1, 32))


#: FNV-1a over 64 bits: the offset basis in two halves; the prime is 2^40 + 435.
FNV_HIGH, FNV_LOW, FNV_SMALL = 0xCBF29CE4, 0x84222325, 435


def exporter_id(address: Column) -> Column:
    """A positive id of an exporter from its 16 address bytes: FNV-1a without the sign bit, 0 turned into 1.

    The state is two 32-bit halves, as a 64-bit product would overflow.
    """
    mask = F.lit(0xFFFFFFFF)

    def step(state: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(address, i, F.lit(1))), 16, 10).cast("bigint")
        x = state["lo"].bitwiseXOR(byte)
        product = x * FNV_SMALL
        high = (state["hi"] * FNV_SMALL + F.shiftrightunsigned(product, 32) + x * 256).bitwiseAND(mask)
        return F.struct(high.alias("hi"), product.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(FNV_HIGH).cast("bigint").alias("hi"), F.lit(FNV_LOW).cast("bigint").alias("lo"))
    done = lambda s: F.greatest(F.lit(1).cast("bigint"), F.shiftleft(s["hi"].bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(s["lo"]))
    return F.when(F.length(address) == 16, F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, step, done))


def corrected(counter: Column, sampling_rate: Column) -> Column:
    """What a sampled counter stands for."""
    from ..schema import u64

    return u64(counter) * sampling_rate.cast("decimal(10,0)")
