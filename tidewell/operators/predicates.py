"""Predicates that reach the scan: half-open ranges with the partition's dates, exact matches, keyset continuation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def micros(t: dt.datetime) -> int:
    """Microseconds since 1970; naive times are UTC."""
    return ((t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t) - EPOCH) // dt.timedelta(microseconds=1)


def from_micros(us: int) -> dt.datetime:
    return EPOCH + dt.timedelta(microseconds=us)


def collected(df: DataFrame) -> list[Row]:
    """The rows with times as aware UTC datetimes. They come to the driver as microseconds, so its own time zone plays no part."""
    times = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    rows = df.select(*(F.unix_micros(c).alias(c) if c in times else F.col(c) for c in df.columns)).collect()
    made = Row(*df.columns)
    at = [df.columns.index(c) for c in times]
    out = []
    for r in rows:
        values = list(r)
        for i in at:
            values[i] = None if values[i] is None else from_micros(values[i])
        out.append(made(*values))
    return out


def instant(df: DataFrame, column: str, us: int) -> Column:
    """A literal of the column's own timestamp type, so that the comparison needs no cast and is pushed down."""
    text = from_micros(us).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"timestamp_ntz'{text}'" if isinstance(df.schema[column].dataType, T.TimestampNTZType) else f"timestamp'{text}+00:00'")


def in_range(df: DataFrame, start: int, end: int, column: str = "received_at", partition: str = "dt") -> DataFrame:
    """Rows of [start, end), in microseconds. The table's date partition is restricted too, which Spark doesn't infer."""
    out = df.where((F.col(column) >= instant(df, column, start)) & (F.col(column) < instant(df, column, end)))
    if partition in df.columns and end > start:
        first, last = from_micros(start).date(), from_micros(end - 1).date()
        out = out.where((F.col(partition) >= F.lit(first)) & (F.col(partition) <= F.lit(last)))
    return out


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every given value; None is no condition (0 is one)."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def after_key(df: DataFrame, us: int, seq: int, column: str = "received_at", partition: str = "dt") -> DataFrame:
    """Rows behind (us, seq) in newest-first order. Written out, as a comparison of structs would not be pushed down."""
    t = instant(df, column, us)
    out = df.where((F.col(column) <= t) & ((F.col(column) < t) | (F.col("seq") < F.lit(seq))))
    return out.where(F.col(partition) <= F.lit(from_micros(us).date())) if partition in df.columns else out


def newest_first(df: DataFrame, n: int, column: str = "received_at") -> DataFrame:
    """The first n rows by (time, seq), descending: a top-k that each task bounds at n."""
    return df.orderBy(F.col(column).desc(), F.col("seq").desc()).limit(n)
