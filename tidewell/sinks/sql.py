"""Records into a relational store, with a commit protocol: tasks stage their rows, the driver puts them in at once.

A data source writer: each task inserts its rows under the run's name into a staging table and commits that by itself; when all tasks are done the driver moves
them into the table in one transaction that also notes the batch, and leaves out rows whose (received_at, dedup_key) is there. A run that
fails, or whose driver dies before the transaction, leaves the table as it was; what it staged (also by tasks that outlive the failure) goes with it or with the
next run of the same source. A batch that was noted before is neither staged nor put in. Rows without a key are told apart by their batch alone.

Spark sorts a batch by its key over all tasks before it is staged, and the driver puts the tasks in in that order, so that the store's indexes are merged with a sorted run
and not entered at random, whose cost would grow with the store.

SQLite serves as the tested double (`sqlite:/path/flows.db`, on a disk that all executors mount); the statements are those that other stores with partial
indexes and ON CONFLICT understand, and CONNECT takes their drivers by the address's scheme.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..schema import DECODED

#: Opens a store by its address, given its scheme.
CONNECT: dict[str, Callable] = {"sqlite": lambda address: sqlite3.connect(address, timeout=120, isolation_level=None)}
#: The order in which Spark brings rows: that of the store's indexes, and then one that parts rows of the same time without a key.
ORDER = ("received_at", "dedup_key", "src_addr", "src_port")
TIMES = ("received_at", "first_switched", "last_switched")
BLOBS = ("exporter_addr", "src_addr", "dst_addr", "next_hop", "dedup_key")
KINDS = {n: "BLOB" if n in BLOBS else "TEXT" if n == "flow_type" else "BIGINT" for n in DECODED}
COLUMNS = ", ".join(DECODED)


def connect(url: str):
    scheme, _, address = url.partition(":")
    return CONNECT[scheme](address)


def migrate(url: str) -> None:
    """Makes the tables that are missing."""
    columns = ", ".join(f"{n} {k}" for n, k in KINDS.items())
    con = connect(url)
    try:
        try:
            con.execute("SELECT id FROM staged_flows LIMIT 0")
        except sqlite3.OperationalError:  # none, or one from before rows were numbered; what is staged is no loss
            con.execute("DROP TABLE IF EXISTS staged_flows")
        for statement in (
            f"CREATE TABLE IF NOT EXISTS flows (seq INTEGER PRIMARY KEY, {columns})",
            "CREATE UNIQUE INDEX IF NOT EXISTS flows_key ON flows (received_at, dedup_key) WHERE dedup_key IS NOT NULL",
            "CREATE INDEX IF NOT EXISTS flows_time ON flows (received_at, seq)",
            f"CREATE TABLE IF NOT EXISTS staged_flows (id INTEGER PRIMARY KEY, source TEXT, run TEXT, task TEXT, {columns})",
            "CREATE TABLE IF NOT EXISTS batches (source TEXT, batch BIGINT, stored BIGINT, PRIMARY KEY (source, batch))",
        ):
            con.execute(statement)
    finally:
        con.close()


class Staged(WriterCommitMessage):
    """A task's name and where its rows are: the first and last id of each insertion."""

    def __init__(self, task: str, places: list[tuple[int, int]]):
        self.task, self.places = task, places


class SqlWriter(DataSourceArrowWriter):
    def __init__(self, url: str, source: str, batch: int):
        self.url, self.source, self.batch, self.run = url, source, batch, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """On an executor: this task's rows, all or none."""
        task, con, staged = uuid.uuid4().hex, connect(self.url), []
        places = ", ".join("?" * (len(DECODED) + 3))
        last = lambda: con.execute("SELECT coalesce(max(id), 0) FROM staged_flows").fetchone()[0]
        try:
            # whole batches are taken, and their rows made, before the store is locked
            for found in iterator:
                mark = [[x] * found.num_rows for x in (self.source, self.run, task)]
                rows = list(zip(*mark, *(found[n].to_pylist() for n in DECODED), strict=True))
                con.execute("BEGIN IMMEDIATE")
                before = last()
                con.executemany(f"INSERT INTO staged_flows (source, run, task, {COLUMNS}) VALUES ({places})", rows)
                staged.append((before + 1, last()))
                con.execute("COMMIT")
        finally:
            con.close()
        return Staged(task, staged)

    def commit(self, messages: list[Staged | None]) -> None:
        """On the driver: rows of the tasks that count, once, in the tasks' order, and the batch's note. No row of another place is looked at."""
        con, tasks = connect(self.url), [(m.task, *place) for m in messages if m for place in m.places]
        try:
            con.execute("BEGIN IMMEDIATE")
            if not con.execute("SELECT 1 FROM batches WHERE source = ? AND batch = ?", (self.source, self.batch)).fetchone():
                stored = 0
                for task, first, last in tasks:
                    stored += con.execute(f"INSERT INTO flows ({COLUMNS}) SELECT {COLUMNS} FROM staged_flows WHERE id BETWEEN ? AND ? AND source = ? AND run = ? AND task = ? ORDER BY id ON CONFLICT DO NOTHING", (first, last, self.source, self.run, task)).rowcount
                con.execute("INSERT INTO batches (source, batch, stored) VALUES (?, ?, ?)", (self.source, self.batch, stored))
            # attempts that don't count, and runs of this source that died, go too
            con.execute("DELETE FROM staged_flows WHERE source = ?", (self.source,))
            con.execute("COMMIT")
        finally:
            con.close()

    def abort(self, messages: list[Staged | None]) -> None:
        con = connect(self.url)
        try:
            con.execute("DELETE FROM staged_flows WHERE source = ? AND run = ?", (self.source, self.run))
        finally:
            con.close()


class SqlFlows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flow_store"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SqlWriter(self.options["url"], self.options["source"], int(self.options["batch"]))


class SqlSink:
    """A sink beside the table: same records, same promises."""

    def __init__(self, url: str):
        self.url = url

    def migrate(self) -> None:
        migrate(self.url)

    def write_batch(self, batch: DataFrame, batch_id: int, source: str = "direct") -> int:
        """Stores decoded records; returns how many were new. Unsigned numbers keep their bit patterns."""
        if (before := self._noted(batch_id, source)) is not None:
            return before
        plain = batch.select(*(F.unix_micros(c).alias(c) if c in TIMES else F.when(F.length(c) > 0, F.col(c)).alias(c) if c == "dedup_key" else F.col(c) for c in DECODED))
        # a stream's batches have a session of their own, and the thread that writes one may have another, where the source's name is looked up
        session = batch.sparkSession
        session.dataSource.register(SqlFlows)
        session._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(session._jsparkSession)
        plain.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.format("flow_store").mode("append").options(url=self.url, source=source, batch=str(batch_id)).save()
        return self._noted(batch_id, source)

    def _noted(self, batch_id: int, source: str) -> int | None:
        """How many rows of the batch were stored; None if it wasn't."""
        con = connect(self.url)
        try:
            found = con.execute("SELECT stored FROM batches WHERE source = ? AND batch = ?", (source, batch_id)).fetchone()
        finally:
            con.close()
        return found and found[0]

    def totals(self) -> list[tuple]:
        """Exporter, rows and bytes of each exporter, added up by the store."""
        con = connect(self.url)
        try:
            return con.execute("SELECT exporter_addr, count(*), sum(bytes) FROM flows GROUP BY exporter_addr").fetchall()
        finally:
            con.close()

    def ping(self) -> None:
        connect(self.url).execute("SELECT 1 FROM flows LIMIT 1").fetchall()
