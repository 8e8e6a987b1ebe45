"""Landed datagrams of all versions into sinks: one stream, version 5 by expressions, the others by keyed templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..obs import Metrics
from ..schema import DECODED
from ..sources import bus
from ..sources.datagrams import DATAGRAM_DDL, decode_v5, undecodable
from . import ingest
from .templated import decode_stream


def records_of(spark: SparkSession, landed: str | DataFrame, sinks: dict[str, ingest.Sink], checkpoint: str, metrics: Metrics, seconds: float = 1.0, once: bool = False, known: DataFrame | None = None, news: DataFrame | None = None, delivery: str = ingest.AT_LEAST_ONCE) -> StreamingQuery:
    """Decodes what lands (a stream of datagrams, or a folder of their files) and fans it out. What doesn't decode is counted and never stops the stream. known, news: shared templates, as in decode_stream."""
    landed = bus.folder_stream(spark, landed, schema=DATAGRAM_DDL) if isinstance(landed, str) else landed

    five = decode_v5(landed).select(*DECODED, F.lit(None).cast("string").alias("reason"))
    bad = undecodable(landed).select(*(F.lit(None).cast(five.schema[c].dataType).alias(c) for c in DECODED), "reason")
    others = decode_stream(landed, known, news).select(*DECODED, "reason")
    every = five.unionByName(bad).unionByName(others)

    return ingest.start(every, sinks, checkpoint, metrics, seconds, once, source="udp", delivery=delivery)
