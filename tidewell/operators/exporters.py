"""The exporter dimension: seen spans per batch, merged across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An exporter table up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def seen(flows: DataFrame, id_column: str = "exporter_id", address: str = "exporter_addr") -> DataFrame:
    """Per exporter of a batch: id, ip_address, label (null), first_seen_at, last_seen_at."""
    return flows.groupBy(F.col(id_column).alias("id"), F.col(address).alias("ip_address")).agg(
        F.lit(None).cast("string").alias("label"), F.min("received_at").alias("first_seen_at"), F.max("received_at").alias("last_seen_at")
    )


def merged(*spans: DataFrame) -> DataFrame:
    """Least first and greatest last sight per exporter, the last label that isn't null; in any order of batches."""
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return every.groupBy("id", "ip_address").agg(
        F.max_by("label", F.when(F.col("label").isNotNull(), F.col("last_seen_at"))).alias("label"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    )


def listed(exporters: DataFrame) -> DataFrame:
    return exporters.orderBy("id")


def with_address(page: DataFrame, exporters: DataFrame, count: int | None = None) -> DataFrame:
    """A page's rows with their exporters' addresses; joined behind the limit, which each row's one exporter allows."""
    side = exporters.select(F.col("id").alias("exporter_id"), F.col("ip_address").alias("exporter_addr"))
    n = exporters.count() if count is None else count
    return page.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, "exporter_id")
