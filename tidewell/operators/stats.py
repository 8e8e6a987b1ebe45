"""Operating statistics over flow tables: spans, days, retention, lag histograms, rates, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the histograms, in seconds; fixed values.
LAG_BOUNDS = (0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300)
WRITE_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)


def span(flows: DataFrame) -> DataFrame:
    return flows.agg(F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"), F.count("*").alias("n"))


def by_day(flows: DataFrame, top: int = 5) -> DataFrame:
    """The days with the most rows; equal days newest first."""
    days = flows.groupBy(F.to_date("received_at").alias("day")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return days.orderBy(F.col("n").desc(), F.col("day").desc()).limit(top)


def by_type(flows: DataFrame) -> DataFrame:
    return flows.groupBy("flow_type").agg(F.count("*").alias("n"))


def partitions(flows: DataFrame) -> DataFrame:
    """How many day partitions there are, and their largest."""
    return flows.groupBy(F.to_date("received_at").alias("day")).agg(F.count("*").alias("n")).agg(F.count("*").alias("days"), F.max("n").alias("largest"))


def histogram(df: DataFrame, seconds: Column, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts per upper bound `le` (null: no bound), in one pass."""
    counts = df.agg(*(F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(seconds).alias("all"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(F.inline(F.array(*pairs, F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))))


def histograms(df: DataFrame, seconds: Column, bounds: tuple[float, ...], labels: list[str]) -> DataFrame:
    """As histogram(), for each combination of labels."""
    counts = df.groupBy(*labels).agg(*(F.count_if(seconds <= b).alias(f"__b{i}") for i, b in enumerate(bounds)), F.count(seconds).alias("__all"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__b{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(*labels, F.inline(F.array(*pairs, F.struct(F.lit(None).cast("double").alias("le"), F.col("__all").alias("n")))))


def sketched(value: Column, k: int = 400) -> Column:
    """A KLL sketch of doubles: of bounded size, and merged with others later."""
    return F.kll_sketch_agg_double(value, k)


def merged_quantile(sketches: DataFrame, column: str, q: float) -> DataFrame:
    """The quantile of all that the sketches have seen."""
    return sketches.agg(F.kll_merge_agg_double(column).alias("s")).select(F.kll_sketch_get_quantile_double("s", F.lit(q)).alias("quantile"))


def rate(flows: DataFrame, width: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Rows and rows per second of each window of time that has any."""
    windows = flows.groupBy(F.window("received_at", width).alias("w")).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("window_start"), "n", (F.col("n") / F.lit(float(seconds))).alias("per_second"))


def quantile(df: DataFrame, seconds: Column, q: float = 0.95, approximate: bool = False) -> DataFrame:
    """The exact quantile, or an approximate one that merges sketches for tables too large to sort a column of."""
    found = F.percentile_approx(seconds, q, 10_000) if approximate else F.percentile(seconds, q)
    return df.agg(found.alias("quantile"), F.count(seconds).alias("n"))


def expired(flows: DataFrame, cutoff: Column) -> DataFrame:
    return flows.where(F.col("received_at") < cutoff)


def retained(flows: DataFrame, cutoff: Column) -> DataFrame:
    return flows.where(F.col("received_at") >= cutoff)
