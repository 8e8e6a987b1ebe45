"""Alert expressions over samples of counters: rates that see resets, and quantiles from cumulative buckets.

Samples are rows of labels, a time and a counter's value. A counter only rises; where a value is less than the one before, its process
began anew and the value itself is what was added since.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A window is carried on to its edge if the nearest sample is within this share of the samples' mean distance; else by half of that distance.
NEAR = 1.1


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def increases(samples: DataFrame, labels: list[str], step: int, at: str = "at", value: str = "value") -> DataFrame:
    """Per series and stretch of `step` seconds that has samples: n, the first and last sample, and what the counter rose by between them.

    The lag runs within a stretch, so a series' samples are dealt over tasks however many it has.
    """
    own = samples.select(*labels, _micros(at).alias("us"), F.col(value).cast("double").alias("v")).where("us is not null and v is not null")
    own = own.withColumn("stretch", F.expr(f"us div {step * 1_000_000} - if(us % {step * 1_000_000} < 0, 1, 0)"))
    before = F.lag("v").over(Window.partitionBy(*labels, "stretch").orderBy("us", "v"))
    rose = own.withColumn("rose", F.when(F.col("v") >= before, F.col("v") - before).when(before.isNotNull(), F.col("v")).otherwise(0.0))
    first, last = F.struct("us", "v"), F.struct("us", "v")
    return rose.groupBy(*labels, "stretch").agg(F.count("*").alias("n"), F.min(first).alias("first"), F.max(last).alias("last"), F.sum("rose").alias("rose"))


def counter_rate(samples: DataFrame, labels: list[str], seconds: int, step: int | None = None, at: str = "at", value: str = "value", carry_on: bool = True) -> DataFrame:
    """labels, window_end, increase and per_second over [window_end - seconds, window_end) every `step` seconds, for windows with two samples or more.

    carry_on: the increase is carried on to the window's edges where samples come close to them, but not below a counter of zero. seconds is a multiple
    of step; series are put together from stretches of one step, a row each.
    """
    step = step or seconds
    if step < 1 or seconds % step:
        raise ValueError("the window must be a multiple of the step")
    parts = increases(samples, labels, step, at, value)
    series = Window.partitionBy(*labels).orderBy("stretch")
    before = F.lag("last").over(series)["v"]
    parts = parts.withColumn("gap", F.when(F.col("first.v") >= before, F.col("first.v") - before).when(before.isNotNull(), F.col("first.v")).otherwise(0.0))
    wide = seconds // step
    # a stretch belongs to the windows that end with it and with the wide - 1 after it, though those may have no samples of their own
    dealt = parts.withColumn("ends", F.explode(F.sequence(F.col("stretch"), F.col("stretch") + F.lit(wide - 1))))
    found = dealt.groupBy(*labels, "ends").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.col("rose") + F.col("gap")).alias("rose"), F.min_by("gap", "stretch").alias("outside"))
    found = found.where("n >= 2").withColumn("rose", F.col("rose") - F.col("outside"))
    end = (F.col("ends") + 1) * F.lit(step * 1_000_000)
    spanned = (F.col("last.us") - F.col("first.us")) / 1e6
    mean = spanned / (F.col("n") - 1)
    edge = lambda away: F.when(away < mean * NEAR, away).otherwise(mean / 2)
    to_start = edge((F.col("first.us") - (end - F.lit(seconds * 1_000_000))) / 1e6)
    to_zero = F.when((F.col("rose") > 0) & (F.col("first.v") >= 0), spanned * F.col("first.v") / F.col("rose"))
    factor = (spanned + F.least(to_start, to_zero) + edge((end - F.col("last.us")) / 1e6)) / spanned
    whole = F.when(spanned > 0, F.col("rose") * factor).otherwise(F.col("rose")) if carry_on else F.col("rose")
    return found.select(*labels, F.timestamp_micros(end).alias("window_end"), whole.alias("increase"), (whole / F.lit(float(seconds))).alias("per_second"))


def histogram_quantile(buckets: DataFrame, q: float, labels: list[str], le: str = "le", n: str = "n") -> DataFrame:
    """labels and quantile, from cumulative counts (or their rates) per upper bound; a null or infinite bound is the last one.

    The value is placed within its bucket in proportion; the first bucket begins at 0 unless its bound is below. A quantile in the last bucket is
    the greatest finite bound. Without counts it's null; q below 0 or above 1 gives an infinity. Counts that fall from one bound to
    the next, as when buckets are read at different moments, are raised to those before.
    """
    bound = F.when(F.col(le).isNull(), F.lit(math.inf)).otherwise(F.col(le).cast("double"))
    rows = buckets.select(*labels, bound.alias("le"), F.col(n).cast("double").alias("n"))
    rows = rows.groupBy(*labels, "le").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*labels).orderBy("le")  # as many rows as there are bounds
    rows = rows.withColumn("n", F.max("n").over(own))
    rows = rows.withColumns({"under": F.coalesce(F.lag("n").over(own), F.lit(0.0)), "from": F.lag("le").over(own), "total": F.max("n").over(Window.partitionBy(*labels))})
    hit = F.when(F.col("n") >= F.col("total") * q, F.struct("le", "n", "under", "from"))
    found = rows.groupBy(*labels).agg(F.min(hit).alias("b"), F.max("total").alias("total"), F.max("le").alias("top"))
    start = F.coalesce(F.col("b.from"), F.when(F.col("b.le") <= 0, F.col("b.le")).otherwise(0.0))
    inside = start + (F.col("b.le") - start) * (F.col("total") * q - F.col("b.under")) / (F.col("b.n") - F.col("b.under"))
    value = F.when(F.col("b.le") == math.inf, F.col("b.from")).when((F.col("b.n") == F.col("b.under")) | (start == F.col("b.le")), F.col("b.le")).otherwise(inside)
    if not 0 <= q <= 1:
        value = F.lit(-math.inf if q < 0 else math.inf)
    return found.select(*labels, F.when((F.col("total") > 0) & (F.col("top") == math.inf), value).alias("quantile"))


def firing(values: DataFrame, labels: list[str], over: float, seconds: int, step: int, value: str = "quantile", at: str = "window_end") -> DataFrame:
    """labels, since and until of each stretch of time through which a value stood over a bound at every step, for `seconds` at least."""
    hot = values.where(F.col(value) > over).select(*labels, _micros(at).alias("us"))
    number = F.row_number().over(Window.partitionBy(*labels).orderBy("us"))
    runs = hot.withColumn("run", F.col("us") - number * F.lit(step * 1_000_000)).groupBy(*labels, "run").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return runs.where(F.col("b") - F.col("a") >= seconds * 1_000_000).select(*labels, F.timestamp_micros("a").alias("since"), F.timestamp_micros("b").alias("until"))
