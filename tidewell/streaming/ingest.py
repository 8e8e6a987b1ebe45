"""Ingest: a stream of decoded records to any number of sinks, at least once, with each batch replayed until all took it.

A micro-batch is atomic and in order: its offsets are committed once foreachBatch returns, so a failed sink makes a
restarted query deliver the same batch id again. Every sink is tried before the failure is raised; sinks that took the
batch replace or deduplicate it. There is no watermark on this path: late records are stored like any other.
"""

from __future__ import annotations

import inspect
import logging
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..obs import Metrics
from ..operators.stats import LAG_BOUNDS
from ..schema import DECODED
from ..sources import wire

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame, int], object]


def identity(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that keeps this checkpoint: made with it and kept in it, so that a new checkpoint is another source."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/source")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    if not names:
        names = [uuid.uuid4().hex]
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, names[0])).close()
    return min(names)


def bound(sink: Sink, source: str) -> Sink:
    """The sink for one source's batches, which are cached; sinks that ask for neither stay as they are."""
    told = {"source": source, "held": True}
    told = {k: v for k, v in told.items() if k in inspect.signature(sink).parameters}
    return partial(sink, **told) if told else sink


class SinkFailure(RuntimeError):
    """Some sinks did not take a batch."""


#: Points that stand for a batch's times of receipt when its lag is counted.
POINTS = 100


def measured(batch: DataFrame) -> dict:
    """In the one pass that also fills the batch's cache: its rows, those refused, and POINTS quantiles of the others' times of receipt."""
    good = F.col("reason").isNull() if "reason" in batch.columns else F.lit(True)
    times = F.percentile_approx(F.when(good, F.unix_micros("received_at")), [(i + 0.5) / POINTS for i in range(POINTS)], 1000) if "received_at" in batch.columns else F.lit(None)
    return batch.agg(F.count("*").alias("n"), F.count_if(~good).alias("refused"), times.alias("times")).first().asDict()


def count_lag(metrics: Metrics, n: int, times: list[int] | None, now: float) -> None:
    """The rows' lag from receipt to `now`, each point standing for its share of them."""
    for i, at in enumerate(times or ()):
        if share := n * (i + 1) // len(times) - n * i // len(times):
            metrics.observe("visibility_lag_seconds", max(0.0, now - at / 1e6), share)


class StartedBatches:
    """The numbers of batches that were begun, kept beside a checkpoint: what at-most-once delivery must not try again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.child = lambda n: spark._jvm.org.apache.hadoop.fs.Path(self.path, str(n))
        self.fs.mkdirs(self.path)

    def begin(self, batch_id: int) -> bool:
        """Whether the batch wasn't begun before; from now on it was."""
        new = self.fs.createNewFile(self.child(batch_id))
        if new:  # a stream goes back by one batch at most
            self.fs.delete(self.child(batch_id - 2), False)
        return new


def fan_out(sinks: dict[str, Sink], metrics: Metrics, drop_on_error: bool = False, source: str = "bus", started: StartedBatches | None = None, quarantine: Sink | None = None) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function. source: udp or bus, for the counters.

    Rows with a `reason` are counted as refused and go to quarantine, where there is one; sinks get the others. drop_on_error: a sink that fails loses the batch
    instead of stopping the stream; rows that no sink took count as dropped, not as visible. started: at most once, that is, a batch that was begun before is counted as lost and passed over.
    """

    def attempt(name: str, sink: Sink, batch: DataFrame, batch_id: int) -> Exception | None:
        began = time.monotonic()
        try:
            sink(batch, batch_id)
        except Exception as e:  # noqa: BLE001  reported after all sinks were tried
            metrics.count("batch_write_errors", sink=name)
            log.error("sink refused a batch", extra={"fields": {"sink": name, "batch": batch_id, "error": str(e)}})
            return e
        finally:
            metrics.observe("batch_write_seconds", time.monotonic() - began, sink=name)
        return None

    def write(batch: DataFrame, batch_id: int) -> None:
        if started and not started.begin(batch_id):
            metrics.count("records_dropped", batch.count(), reason="at_most_once")
            log.warning("batch was begun before, its rows are passed over", extra={"fields": {"batch": batch_id}})
            return
        batch = batch.persist()
        try:
            found = measured(batch)
            good, use = batch, dict(sinks)
            if "reason" in batch.columns:
                good = batch.where("reason is null").select(*DECODED)
                if found["refused"] and quarantine:
                    use["quarantine"] = lambda _, i: quarantine(batch.where("reason is not null"), i)
            with ThreadPoolExecutor(max(1, len(use))) as pool:
                failed = {n: e for n, e in zip(use, pool.map(lambda n: attempt(n, use[n], good, batch_id), use)) if e}
            if failed and not drop_on_error:
                metrics.count("source_rewinds", source=source)
                raise SinkFailure(f"batch {batch_id}: {', '.join(sorted(failed))} failed") from next(iter(failed.values()))
            # a batch that comes again is counted then
            metrics.count("decode_errors", found["refused"], source=source)
            if sinks and failed.keys() >= sinks.keys():
                metrics.count("records_dropped", found["n"] - found["refused"], reason="at_most_once")
            else:
                count_lag(metrics, found["n"] - found["refused"], found["times"], time.time())
        finally:
            batch.unpersist()

    return write


#: Deliveries: every batch until all sinks took it, or each begun once.
AT_LEAST_ONCE, AT_MOST_ONCE = "at_least_once", "at_most_once"


def start(
    records: DataFrame, sinks: dict[str, Sink], checkpoint: str, metrics: Metrics, seconds: float = 1.0, once: bool = False, drop_on_error: bool = False, name: str | None = None, source: str = "bus", delivery: str = AT_LEAST_ONCE, quarantine: Sink | None = None
) -> StreamingQuery:
    """Starts the query; once: takes what there is and ends. Batches are bounded at the source (files or offsets per trigger)."""
    spark = records.sparkSession
    own = identity(spark, checkpoint)
    sinks, quarantine = {n: bound(s, own) for n, s in sinks.items()}, quarantine and bound(quarantine, own)
    started = StartedBatches(spark, f"{checkpoint.rstrip('/')}/started") if delivery == AT_MOST_ONCE else None
    write = fan_out(sinks, metrics, drop_on_error or started is not None, source, started, quarantine)
    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def drain(query: StreamingQuery, seconds: float = 10.0) -> bool:
    """Lets a query take what has arrived, for so long at most, then stops it. Whether it got through."""
    until = time.monotonic() + seconds
    while query.isActive and time.monotonic() < until:
        status = query.status
        if not status["isDataAvailable"] and not status["isTriggerActive"]:
            break
        time.sleep(0.1)
    done = time.monotonic() < until
    query.stop()
    return done


def stored(table, metrics: Metrics) -> Sink:
    """The table's sink, counting the rows that were stored before."""

    def sink(batch: DataFrame, batch_id: int, source: str = "direct") -> None:
        came, new = table.store_batch(batch, batch_id, source, held=True)
        metrics.count("deduped_rows", came - new)

    return sink


def messages_of(messages: DataFrame, sinks: dict[str, Sink], checkpoint: str, metrics: Metrics, quarantine: str, seconds: float = 1.0, once: bool = False, delivery: str = AT_LEAST_ONCE) -> StreamingQuery:
    """JSON messages (value, timestamp) to sinks. What doesn't decode is counted, kept under `quarantine` with its reason, and never stops the stream."""

    def poison(batch: DataFrame, batch_id: int, source: str = "direct") -> None:
        bad = batch.select("value", F.col("transport_time").alias("timestamp"), "reason")
        bad.write.mode("overwrite").parquet(f"{quarantine}/source={source}/batch={batch_id}")

    every = wire.decoded(messages.select("value", "timestamp", F.col("timestamp").alias("transport_time"))).select(*DECODED, "value", "transport_time", "reason")
    return start(every, sinks, checkpoint, metrics, seconds, once, source="bus", delivery=delivery, quarantine=poison)
