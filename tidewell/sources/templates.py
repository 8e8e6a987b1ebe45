"""Templates as a shared table: key codec, envelopes, and the latest template per key."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an envelope can hold; fixed values.
KINDS = ("template", "nfv9-options", "ipfix-options")


def template_key(exporter: str, version: int, domain: int, number: int) -> str:
    return f"{exporter}/{version}/{domain}/{number}"


def parse_key(key: str) -> tuple[str, int, int, int]:
    """The parts of a key; ValueError names what is wrong."""
    parts = key.split("/")
    if len(parts) != 4:
        raise ValueError(f"{key!r}: four parts expected")
    exporter = str(ipaddress.ip_address(parts[0]))
    numbers = []
    for text, name, bits in zip(parts[1:], ("version", "domain", "id"), (16, 32, 16)):
        if not (text.isascii() and text.isdigit() and int(text) < 1 << bits):
            raise ValueError(f"{key!r}: {name} must be an unsigned {bits}-bit number")
        numbers.append(int(text))
    return (exporter, *numbers)


def with_key_parts(df: DataFrame, column: str = "key") -> DataFrame:
    """exporter_text, version, domain, template_id of each key; null parts where it doesn't parse."""
    parts = F.split(column, "/")
    whole = F.size(parts) == 4
    number = lambda i, bits: F.when(whole & (F.try_to_number(parts[i], F.lit("9999999999")) < (1 << bits)), parts[i].try_cast("bigint"))
    return df.withColumns({"exporter_text": F.when(whole, parts[0]), "version": number(1, 16).cast("int"), "domain": number(2, 32), "template_id": number(3, 16).cast("int")})


def envelope(df: DataFrame) -> DataFrame:
    """key and value (JSON with kind and record) from exporter_text, version, domain, template_id, kind, fields (JSON)."""
    value = F.concat(F.lit('{"kind":"'), F.col("kind"), F.lit('","record":'), F.col("fields"), F.lit("}"))
    return df.select(F.concat_ws("/", "exporter_text", "version", "domain", "template_id").alias("key"), value.alias("value"))


def opened(df: DataFrame) -> DataFrame:
    """kind and fields of each envelope; rows of unknown kind are left out."""
    return df.withColumns({"kind": F.get_json_object("value", "$.kind"), "fields": F.get_json_object("value", "$.record")}).where(F.col("kind").isin(*KINDS) & F.col("fields").isNotNull())


def latest(df: DataFrame, order: str, removed: bool = False) -> DataFrame:
    """The value of each key that came last; a null value removes its key, as in a compacted log. removed: keep those keys, with null."""
    last = df.groupBy("key").agg(F.max_by(F.struct("value"), F.col(order)).alias("v"), F.max(order).alias(order)).select("key", "v.value", order)
    return last if removed else last.where("value is not null")
