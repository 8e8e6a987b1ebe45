"""Message sinks: JSON keyed by exporter, to a bus if its connector is installed, or to folders."""

from __future__ import annotations

import datetime as dt
import socket
from zlib import crc32

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import instant, micros
from ..sources import wire
from ..sources.bus import MESSAGES
from ..sources.templates import latest
from .snapshots import Snapshot, Snapshots


#: Compressed bytes of a row group in message files, some ten thousand messages: a reader deals a file over tasks by its row groups.
ROW_GROUP = 1 << 20


class MessageFolder:
    """One folder of message files per source and batch; writing a batch again replaces it."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write_batch(self, batch: DataFrame, batch_id: int, source: str = "direct") -> None:
        if not batch.isEmpty():
            wire.encoded(batch).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/source={source}/batch={batch_id}")

    def ping(self) -> None:
        pass


class KafkaSink:
    """Needs Spark's Kafka connector on the class path."""

    def __init__(self, brokers: list[str], topic: str):
        self.options = {"kafka.bootstrap.servers": ",".join(brokers), "topic": topic, "kafka.acks": "all", "kafka.compression.type": "snappy"}

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            wire.encoded(batch).write.format("kafka").options(**self.options).save()

    def ping(self) -> None:
        """Whether any broker takes connections."""
        refused = None
        for broker in self.options["kafka.bootstrap.servers"].split(","):
            host, _, port = broker.rpartition(":")
            try:
                socket.create_connection((host.strip("[]"), int(port)), timeout=1.0).close()
                return
            except OSError as e:
                refused = e
        raise RuntimeError("no broker answers") from refused


class EnvelopeFolder:
    """Envelopes (key, value, timestamp) as a log that keeps the last value of a key: the tested double of a compacted topic.

    Segments are batches behind marks (see snapshots), so a batch that comes again is known. Compaction writes the last value of each key as a new version;
    a null that ends a key is kept, so that an older value told late doesn't bring it back, until `forget`. Readers that began before go on in the old files for a time of grace.
    """

    UNIT = "log"

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _shots(self, spark: SparkSession) -> Snapshots:
        return Snapshots(spark, self.path, f"{self.path}/_marks")

    def create(self, spark: SparkSession) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.UNIT}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def write_batch(self, batch: DataFrame, batch_id: int, source: str = "direct") -> None:
        shots, number = self._shots(batch.sparkSession), crc32(source.encode())
        if not shots.at(self.UNIT).has(number, batch_id):
            rows = Observation()
            batch.select("key", "value", "timestamp").observe(rows, F.count("*").alias("n")).write.mode("overwrite").parquet(shots.folder(self.UNIT, number, batch_id))
            shots.commit(self.UNIT, number, batch_id, rows.get["n"])

    def mark(self, spark: SparkSession) -> Snapshot:
        """How far the log goes now: a reader of this snapshot has all that was written before."""
        return self._shots(spark).at(self.UNIT)

    def read(self, spark: SparkSession, upto: Snapshot | None = None) -> DataFrame:
        """The log's rows up to a mark, by default to its end."""
        folders = self._shots(spark).folders(self.UNIT, upto)
        return spark.read.schema(MESSAGES).parquet(*folders) if folders else spark.createDataFrame([], MESSAGES)

    def compact(self, spark: SparkSession, grace: float = 3600.0, forget: dt.datetime | None = None) -> int:
        """Folds all segments into the last value of each key; returns how many rows are left. Nulls from before `forget` go."""
        shots = self._shots(spark)
        now = shots.at(self.UNIT)
        if now.fresh:
            last = latest(self.read(spark, now), "timestamp", removed=True).select("key", "value", "timestamp")
            if forget:
                last = last.where(F.col("value").isNotNull() | (F.col("timestamp") >= instant(last, "timestamp", micros(forget))))
            shots.replace(self.UNIT, now, last.coalesce(1))
        shots.sweep(self.UNIT, grace)
        return shots.at(self.UNIT).count


class EnvelopeTopic:
    """Envelopes to a topic that keeps the last value of a key (cleanup.policy=compact, set where the topic is made)."""

    def __init__(self, brokers: list[str], topic: str):
        self.options = {"kafka.bootstrap.servers": ",".join(brokers), "topic": topic, "kafka.acks": "all"}

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch.select("key", "value").write.format("kafka").options(**self.options).save()
