"""Deduplication on (received_at, dedup_key), where a null key never equals another.

Within a batch the first row of a key survives, by `order`; aggregation needs no sort of a group and combines before the
shuffle, so a key that repeats without bound costs one row a task. Rows without a key pass by unshuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import be_uint

KEY = ["received_at", "dedup_key"]


def first_of_each(df: DataFrame, order: str, key: list[str] = KEY) -> DataFrame:
    """Keyed rows once each, the one with the least `order`; rows with a null in the key all stay."""
    complete = None
    for k in key:
        complete = F.col(k).isNotNull() if complete is None else complete & F.col(k).isNotNull()
    rest = [c for c in df.columns if c not in key]
    keyed = df.where(complete).groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    keyed = keyed.select(*key, "__row.*").select(*df.columns)
    return keyed.unionByName(df.where(~complete))


def not_stored(batch: DataFrame, stored: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows whose key isn't in stored. Plain equality lets null keys through."""
    return batch.join(stored.select(*key), key, "left_anti")


def key_seq(key: Column) -> Column:
    """The number that the key's first eight bytes spell, the least significant first, as a bigint's bit pattern; a shorter key ends in zeros."""
    wide = F.concat(key, F.lit(b"\0" * 8))
    return be_uint(F.concat(*(F.substring(wide, i, 1) for i in range(8, 0, -1))))


def collapsed(df: DataFrame, version: str) -> DataFrame:
    """Merge on read: of keyed rows with one (received_at, key_seq) the one with the greatest `version`, as a store that replaces rows would have them
    in the end; rows without a key all stay. Unlike first_of_each, a later delivery wins, and keys that begin alike are one."""
    rest = [c for c in df.columns if c != "received_at"]
    keyed = df.where(F.length("dedup_key") > 0).groupBy("received_at", key_seq(F.col("dedup_key")).alias("__seq")).agg(F.max_by(F.struct(*rest), F.col(version)).alias("__row"))
    return keyed.select("received_at", "__row.*").select(*df.columns).unionByName(df.where(~F.coalesce(F.length("dedup_key") > 0, F.lit(False))))
