"""The flow table: Parquet partitioned by day, source and ingest batch, with the exporter dimension beside it.

A batch is named by its source (a stream's checkpoint, or any name) and its number there. It is stored once: its data are written
to its own (dt, source, ingest_batch) partitions and count when their mark stands (see snapshots), so a crash before that only has
them written again, and a batch that comes again later changes nothing, whether its day was merged meanwhile or not. Two sources never touch each
other's files, rows without a key don't double, and keyed ones are deduplicated against what other batches stored. Readers resolve a
snapshot of the days that they read and keep it through merging and retention. Each step is a plain Spark job on shared
storage without renames of data, so lost executors only repeat tasks and object stores will do.

One process (a collector with any number of streams) writes to and maintains a table; its writers take turns.
"""

from __future__ import annotations

import datetime as dt
import math
import threading

from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions.network import exporter_id
from ..operators import dedup, exporters
from ..operators import predicates as P
from ..plans import query as Q
from ..schema import DECODED, EXPORTER_DDL, RECORD_DDL, SCHEMA_VERSION, refusal
from .snapshots import Snapshots

#: seq is batch, source, row: so many bits each, 63 in all. A batch a second lasts for 8 years; a new checkpoint starts anew.
BATCH_BITS, SOURCE_BITS, ROW_BITS = 28, 9, 26
#: Rows that are numbered under one batch; a larger batch is stored in slices, each under a source of its own.
SLICE = 1 << (ROW_BITS - 1)
#: Rows in a bucket of numbering, about; days above which a batch is dealt by day before it is written.
BUCKET_ROWS, FEW_DAYS = 1 << 17, 4
#: Batches of a day above which it may be merged before it is over.
MOST_BATCHES = 500
#: Seconds for which a reader's files stay when they have been replaced.
GRACE = 3600.0
WHERE_FROM = "from_source int, from_batch bigint"
_lock = threading.RLock()


def numbered(df: DataFrame, batch_id: int, source: int = 0, rows: int = SLICE) -> DataFrame:
    """Adds seq: unique, positive, and the same when the batch is written again.

    Rows are numbered in parallel within buckets of their hash, as many as `rows` (how many there are) asks for.
    """
    for what, n, bits in (("batch id", batch_id, BATCH_BITS), ("source", source, SOURCE_BITS)):
        if not 0 <= n < 1 << bits:
            raise ValueError(f"{what} {n} has over {bits} bits")
    bits = min(12, max(2, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))))
    # rows are told apart by 128 bits of hash; equal rows are alike in either order
    hashed = df.withColumns({"__h": F.xxhash64(*DECODED), "__g": F.xxhash64(F.lit(1), *DECODED)})
    bucket = F.shiftrightunsigned("__h", 64 - bits)
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__h", "__g"))
    most = 1 << (ROW_BITS - bits)
    place = F.when(place < most, place.cast("bigint")).otherwise(F.raise_error(F.lit("one row repeats too often in a batch for seq")).cast("bigint"))
    high = F.lit((batch_id << SOURCE_BITS | source) << ROW_BITS)
    return hashed.withColumn("__bucket", bucket).withColumn("seq", high + F.col("__bucket") * most + place).drop("__bucket", "__h", "__g")


def day_of(column: str = "received_at"):
    """The UTC day of a time, whatever the session's zone."""
    return F.date_from_unix_date(F.expr(f"cast(floor(unix_micros({column}) / 86400000000) as int)"))


class FlowTable:
    """A table under `path` in any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.flows_path, self.exporters_path, self.version_path = f"{self.path}/flows", f"{self.path}/exporters", f"{self.path}/schema_version"
        self.sources_path = f"{self.path}/sources"
        self._schema = _parse_datatype_string(f"{RECORD_DDL}, {WHERE_FROM}, dt date, source int, ingest_batch bigint")
        self.flows, self.sights = Snapshots(spark, self.flows_path, f"{self.path}/marks/flows"), Snapshots(spark, self.path, f"{self.path}/marks")
        self._sources: dict[str, int] = {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def migrate(self) -> None:
        """Makes what is missing; running it again changes nothing. A newer table than this code knows is refused, an older one gets its marks."""
        found = self.spark.read.json(self.version_path).first()["version"] if self._exists(self.version_path) else None
        if found is not None and found > SCHEMA_VERSION:
            raise ValueError(f"{self.path} has schema version {found}; this code knows {SCHEMA_VERSION}")
        for path in (self.flows_path, self.exporters_path, self.sources_path, f"{self.path}/marks/flows"):
            fs, p = self._fs(path)
            fs.mkdirs(p)
        if found is not None and found < SCHEMA_VERSION:
            self._mark_all()
        if found != SCHEMA_VERSION:
            self.spark.createDataFrame([(SCHEMA_VERSION,)], "version long").coalesce(1).write.mode("overwrite").json(self.version_path)

    def _mark_all(self) -> None:
        """Marks every folder of a table from before there were marks."""
        for shots, unit in [(self.flows, n) for n in self._names(self.flows_path) if n.startswith("dt=")] + [(self.sights, "exporters")]:
            for source in self._names(f"{shots.path}/{unit}"):
                for batch in self._names(f"{shots.path}/{unit}/{source}"):
                    place = int(source.partition("=")[2]), int(batch.partition("=")[2])
                    shots.commit(unit, *place, self.spark.read.parquet(shots.folder(unit, *place)).count())

    def source_number(self, name: str) -> int:
        """The number that this source has in the table; the next free one for a new source. A number's file is created by one writer only."""
        if name not in self._sources:
            with _lock:
                fs, folder = self._fs(self.sources_path)
                fs.mkdirs(folder)
                known = [n.partition("=") for n in self._names(self.sources_path)]
                taken = {int(n) for n, _, _ in known}
                found = next((int(n) for n, _, own in known if own == name), None)
                number = len(taken) if found is None else found
                while found is None:
                    # the claim without a name is what only one process can create
                    if number not in taken and fs.createNewFile(self._fs(f"{self.sources_path}/{number}")[1]):
                        fs.create(self._fs(f"{self.sources_path}/{number}={name}")[1], False).close()
                        break
                    number += 1
                self._sources[name] = number
        return self._sources[name]

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).option("basePath", self.flows_path).parquet(*folders)

    def read(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """All flows, or those of the days from first to last, as they stand now: what is merged or dropped later stays readable for a time of grace."""
        units = [u for u in self._units() if (first is None or first <= self._day(u)) and (last is None or self._day(u) <= last)]
        return self._read([f for u in units for f in self.flows.folders(u)])

    def exporters(self) -> DataFrame:
        """The dimension: every batch's sights merged."""
        folders, kinds = self.sights.folders("exporters"), _parse_datatype_string(EXPORTER_DDL)
        return exporters.merged(self.spark.read.schema(kinds).parquet(*folders) if folders else self.spark.createDataFrame([], kinds))

    def write_batch(self, batch: DataFrame, batch_id: int, source: str = "direct", held: bool = False) -> int:
        """Stores decoded records; returns how many were new. An empty batch does nothing."""
        return self.store_batch(batch, batch_id, source, held)[1]

    def store_batch(self, batch: DataFrame, batch_id: int, source: str = "direct", held: bool = False) -> tuple[int, int]:
        """How many records came, and how many of them were new. Batches of several streams take turns, so that one sees the keys of the other. held: the caller caches the batch, which is else done here, as it is read several times."""
        with _lock:
            if held:
                return self._store(batch, batch_id, source)
            batch = batch.select(*DECODED).persist()
            try:
                return self._store(batch, batch_id, source)
            finally:
                batch.unpersist()

    def _store(self, batch: DataFrame, batch_id: int, source: str) -> tuple[int, int]:
        number = self.source_number(source)
        batch = batch.select(*DECODED).withColumn("dedup_key", F.when(F.length("dedup_key") > 0, F.col("dedup_key")))
        batch = batch.withColumn("dt", day_of())
        # one pass gives what is to be known of the batch and its exporters' sights
        sights = batch.groupBy(F.col("exporter_addr").alias("ip_address")).agg(
            F.lit(None).cast("string").alias("label"), F.min("received_at").alias("first_seen_at"), F.max("received_at").alias("last_seen_at"),
            F.count("*").alias("n"), F.count("dedup_key").alias("keyed"), F.count(refusal(batch.columns)).alias("bad"), F.collect_set("dt").alias("days"),
        ).withColumn("id", exporter_id(F.col("ip_address")))
        place = self.sights.folder("exporters", number, batch_id)
        known = self.sights.at("exporters").has(number, batch_id)
        if not known:
            sights.write.mode("overwrite").parquet(place)
            sights = self.spark.read.schema(sights.schema).parquet(place)
        facts = sights.agg(F.sum("n").alias("n"), F.sum("keyed").alias("keyed"), F.sum("bad").alias("bad"), F.count("*").alias("exporters"), F.unix_micros(F.min("first_seen_at")).alias("first"), F.unix_micros(F.max("last_seen_at")).alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("days")))).alias("days")).first()
        if not facts["n"]:
            return 0, 0
        if facts["bad"]:
            raise ValueError(f"{facts['bad']} of {facts['n']} records lack required fields")
        if facts["n"] > SLICE:
            slices = math.ceil(facts["n"] / (SLICE // 2))
            parts = [batch.where(F.pmod(F.xxhash64("received_at", F.coalesce("dedup_key", F.encode(F.xxhash64(*DECODED).cast("string"), "utf-8"))), F.lit(slices)) == i) for i in range(slices)]
            return facts["n"], sum(self._store(p, batch_id, f"{source}.{i}")[1] for i, p in enumerate(parts))
        if not known:  # the dimension goes first, so no stored flow lacks its exporter
            self.sights.commit("exporters", number, batch_id, facts["exporters"])
        units = {d: self.flows.at(f"dt={d}") for d in facts["days"]}
        todo = [d for d, s in units.items() if not s.has(number, batch_id)]
        new = sum(s.batches.get((number, batch_id), 0) for s in units.values())
        if merged := [d for d, s in units.items() if s.holds(number, batch_id) and (number, batch_id) not in s.batches]:
            new += self.read(merged[0], merged[-1]).where((F.col("from_source") == number) & (F.col("from_batch") == batch_id) & F.col("dt").isin(merged)).count()
        if not todo:
            return facts["n"], new
        if facts["keyed"]:
            batch = self._once(batch, number, batch_id, facts["first"], facts["last"])
        # an id is long to compute, so it is taken from the exporters' rows where they can be broadcast
        ids = sights.select(F.col("ip_address").alias("exporter_addr"), F.col("id").alias("exporter_id"))
        few = facts["exporters"] <= exporters.BROADCAST_ROWS
        batch = batch.join(F.broadcast(ids), "exporter_addr") if few else batch.withColumn("exporter_id", exporter_id(F.col("exporter_addr")))
        rows = numbered(batch, batch_id, number, facts["n"])
        if len(todo) < len(units):  # a crash left some days marked
            rows = rows.where(F.col("dt").isin(todo))
        rows = rows.withColumns({"from_source": F.lit(number), "from_batch": F.lit(batch_id).cast("bigint"), "source": F.lit(number), "ingest_batch": F.lit(batch_id).cast("bigint")})
        rows = rows.hint("rebalance", "dt") if len(todo) > FEW_DAYS else rows
        placed = rows.sortWithinPartitions("dt", "received_at", "seq").select(*(f.name for f in self._schema))
        seen, facts_of, few_days = Observation(), (("rows", F.count), ("first", F.min), ("last", F.max)), len(todo) <= FEW_DAYS
        of_day = lambda d: F.when(F.col("dt") == F.lit(d), F.unix_micros("received_at"))
        if few_days:  # the write counts what it writes
            placed = placed.observe(seen, *(f(of_day(d)).alias(f"{d} {n}") for d in todo for n, f in facts_of))
        bloom = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("exporter_id", "src_addr", "dst_addr")}
        placed.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **bloom).partitionBy("dt", "source", "ingest_batch").parquet(self.flows_path)
        if few_days:
            told = {d: [seen.get[f"{d} {n}"] for n, _ in facts_of] for d in todo}
        else:
            written = [p for d in todo if self._exists(p := self.flows.folder(f"dt={d}", number, batch_id))]
            told = {r.dt: r[1:] for r in self._read(written).groupBy("dt").agg(*(f(F.unix_micros("received_at")).alias(n) for n, f in facts_of)).collect()}
        for d in todo:
            rows, *span = told.get(d, (0, None, None))
            self.flows.commit(f"dt={d}", number, batch_id, rows, span if rows else None)
            new += rows
        return facts["n"], new

    def _once(self, batch: DataFrame, number: int, batch_id: int, first: int, last: int) -> DataFrame:
        """The rows whose key comes for the first time, within the batch and in the table."""
        # rows with one key that differ otherwise: the least by its other fields is the first
        others = F.struct(*(c for c in DECODED if c not in dedup.KEY))
        batch = dedup.first_of_each(batch.withColumn("__order", F.xxhash64(others)), "__order").drop("__order")
        own = (F.col("from_source") == number) & (F.col("from_batch") == batch_id)
        stored = P.in_range(self.read(P.from_micros(first).date(), P.from_micros(last).date()).where(~F.coalesce(own, F.lit(False)) & F.col("dedup_key").isNotNull()), first, last + 1)
        return dedup.not_stored(batch, stored)

    def query(self, q: Q.FlowQuery) -> Q.Page:
        if q.end <= q.start:
            return Q.Page([], None, False)
        return Q.page(self.read(P.from_micros(q.start).date(), P.from_micros(q.end - 1).date()), q)

    def list_exporters(self) -> list[Row]:
        return P.collected(exporters.listed(self.exporters()))

    def _units(self) -> list[str]:
        return [n for n in self.flows.units() if n.startswith("dt=")]

    @staticmethod
    def _day(unit: str) -> dt.date:
        return dt.date.fromisoformat(unit[3:])

    def days(self) -> list[dt.date]:
        """The days that have rows."""
        return [self._day(u) for u in self._units() if self.flows.folders(u)]

    def inspect(self) -> list[Row]:
        """Of each day with rows: day, rows, bytes, first and last time (microseconds), batches that wait to be merged, version. Marks and sizes of files tell it; no file is opened."""
        made = Row("day", "rows", "bytes", "first", "last", "waiting", "version")
        found = [(u, self.flows.at(u)) for u in self._units()]
        return [made(self._day(u), s.count, self.flows.size(u, s), *(s.times or (None, None)), len(s.fresh), s.version) for u, s in found if s.count]

    def _replace_day(self, day: dt.date, rows: DataFrame, snapshot) -> None:
        self.flows.replace(f"dt={day}", snapshot, rows.drop("dt", "source", "ingest_batch").hint("rebalance").sortWithinPartitions("received_at", "seq"), "received_at")

    def compact(self, day: dt.date) -> None:
        """Merges a day's small files into a new version. Batches that come again are known by it."""
        with _lock:
            unit = f"dt={day}"
            now = self.flows.at(unit)
            if now.fresh:
                self._replace_day(day, self._read(self.flows.folders(unit, now)), now)

    def fold_exporters(self) -> None:
        """Merges the log of sights into one."""
        with _lock:
            now = self.sights.at("exporters")
            if now.fresh:
                self.sights.replace("exporters", now, self.exporters().coalesce(1))

    def retain(self, cutoff: dt.datetime) -> list[dt.date]:
        """Drops rows received before cutoff: whole days without reading them, the day it falls on row by row. Returns the days dropped."""
        with _lock:
            day = (cutoff if cutoff.tzinfo is None else cutoff.astimezone(dt.UTC)).date()
            days = self.days()
            dropped = [d for d in days if d < day]
            for d in dropped:
                self.flows.replace(f"dt={d}", self.flows.at(f"dt={d}"), None)
            if day in days:
                now = self.flows.at(f"dt={day}")
                own = self._read(self.flows.folders(f"dt={day}", now))
                before = F.col("received_at") < P.instant(own, "received_at", P.micros(cutoff))
                if not own.where(before).isEmpty():
                    self._replace_day(day, own.where(~before), now)
            return dropped

    def sweep(self, grace: float = GRACE) -> None:
        """Deletes what was replaced more than `grace` seconds ago."""
        with _lock:
            for unit in self.flows.units():
                self.flows.sweep(unit, grace)
            self.sights.sweep("exporters", grace)

    def maintain(self, now: dt.datetime, keep_days: int) -> None:
        """What a running collector does from time to time: retention, merging days that are over by an hour or have many batches, folding the dimension, and deleting what was replaced."""
        self.retain(now - dt.timedelta(days=keep_days))
        for day in self.days():
            found = self.flows.at(f"dt={day}")
            # a day that goes on is merged when it has doubled, so that its rows are rewritten a few times only
            grown = len(found.fresh) > MOST_BATCHES and sum(found.fresh.values()) >= found.rows
            if day < (now - dt.timedelta(hours=1)).date() or grown:
                self.compact(day)
        self.fold_exporters()
        self.sweep()

    def ping(self) -> None:
        if not self._exists(self.version_path):
            raise RuntimeError(f"no table at {self.path}")
