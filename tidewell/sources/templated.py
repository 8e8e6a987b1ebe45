"""Batch decoding of version 9 and 10 datagrams: an as-of join of data sets with templates.

Datagrams are parsed once in Arrow batches to sets. A data set needs the latest template of its exporter, version, domain
and id that arrived before it, in its datagram or an earlier one. The join is a window over time buckets: the last template
of each bucket is carried over buckets first (few rows), then each bucket is filled from its carried template on, so a busy
exporter's sets are dealt over tasks by bucket. A datagram with any set of unknown template is rejected whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import NTP_OFFSET
from ..schema import refusal
from ..session import scratch
from . import elements as E
from . import fields as A

SETS = "exporter binary, received_at timestamp, arrival bigint, set_no int, version int, domain bigint, boot bigint, template_id int, fields string, content binary, fault string"
BUCKET = 4096
#: Compressed bytes of a row group of kept sets, by which readers deal them over tasks.
ROW_GROUP = 2 << 20
KEY = ["exporter", "version", "domain", "template_id"]
RECORD = (
    "received_at timestamp, exporter_addr binary, flow_type string, first_us bigint, last_us bigint, src_addr binary, dst_addr binary, src_port int, dst_port int, protocol smallint, "
    "tcp_flags smallint, packets bigint, bytes bigint, sampling_rate bigint, input_iface bigint, output_iface bigint, src_as bigint, dst_as bigint, next_hop binary, dedup_key binary, arrival bigint, set_no int, record_no int, fault string"
)


ARROW = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "timestamp": A.UTC}


def arrow_schema(ddl: str) -> pa.Schema:
    """What Spark takes back from mapInArrow for a DDL schema of plain columns; workers need no session for it."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _plain_sets(batch: pa.RecordBatch, schema: pa.Schema) -> tuple[pa.RecordBatch, np.ndarray]:
    """The data sets of all datagrams that hold nothing else, found set by set over the whole batch; and the other datagrams' rows."""
    data, bounds = A.binary_parts(batch["payload"])
    size = np.diff(bounds)
    head = A.rows_of(np.r_[data, np.zeros(20, np.uint8)], bounds[:-1], 20)
    number = lambda at, width: A.big_endian(head[:, at : at + width]).astype(np.int64)
    version = np.where(size >= 2, number(0, 2), 0)
    nine = version == 9
    told = np.where(nine, size, number(2, 2))
    odd = np.where(nine, size < 20, (version != 10) | (size < 16) | (told < 16) | (told > size))
    at, end = bounds[:-1] + np.where(nine, 20, 16), bounds[:-1] + told
    boot = np.where(nine, number(8, 4) * 1_000_000 - number(4, 4) * 1000, number(4, 4) * 1_000_000)
    domain = np.where(nine, number(16, 4), number(12, 4))
    count, found = np.zeros(len(size), np.int64), []
    rows = np.flatnonzero(~odd)
    while len(rows := rows[end[rows] - at[rows] >= 4]):
        four = A.rows_of(data, at[rows], 4)
        kind, length = (A.big_endian(four[:, i : i + 2]).astype(np.int64) for i in (0, 2))
        bad = (length < 4) | (at[rows] + length > end[rows]) | (kind == np.where(nine[rows], 0, 2))
        odd[rows[bad]] = True
        rows, kind, length = rows[~bad], kind[~bad], length[~bad]
        full = kind >= 256
        own = rows[full]
        found.append((own, count[own], kind[full], at[own] + 4, length[full] - 4))
        count[own] += 1
        at[rows] += length
    row, set_no, template, start, width = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
    keep = np.flatnonzero(~odd[row])
    row, set_no, template, start, width = row[keep], set_no[keep], template[keep], start[keep], width[keep]
    content = data[np.repeat(start - (np.cumsum(width) - width), width) + np.arange(width.sum())] if len(row) else np.zeros(0, np.uint8)
    offsets = np.r_[0, np.cumsum(width)].astype(np.int32)
    take = pa.array(row)
    columns = {c: batch[c].take(take) for c in ("exporter", "received_at", "arrival")}
    columns |= {"set_no": pa.array(set_no), "version": pa.array(version[row]), "domain": pa.array(domain[row]), "boot": pa.array(boot[row]), "template_id": pa.array(template)}
    columns["content"] = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(content.tobytes())])
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(len(row), f.type) for f in schema], schema=schema), np.flatnonzero(odd)


def sets_of(datagrams: DataFrame) -> DataFrame:
    """The template and data sets of version 9 and 10 datagrams; a malformed datagram is one row with its fault."""
    schema = arrow_schema(SETS)

    def run(batches):
        for batch in batches:
            plain, odd = _plain_sets(batch, schema)
            yield plain
            rows = []
            for d in batch.take(pa.array(odd)).to_pylist():
                base = {"exporter": d["exporter"], "received_at": d["received_at"], "arrival": d["arrival"]}
                try:
                    packet = E.parse(d["payload"] or b"")
                except E.Malformed as e:
                    rows.append(base | {"set_no": 0, "fault": str(e)})
                    continue
                for i, (kind, number, what) in enumerate(packet.sets):
                    own = {"fields": json.dumps(what)} if kind == "template" else {"content": what}
                    rows.append(base | {"set_no": i, "version": packet.version, "domain": packet.domain, "boot": packet.boot, "template_id": number} | own)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return datagrams.where(F.coalesce(F.conv(F.hex(F.substring("payload", 1, 2)), 16, 10).isin("9", "10"), F.lit(False))).mapInArrow(run, SETS)


def with_templates(sets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Data sets with `template`, the fields in force when they arrived (null: none). known: KEY and fields from before."""
    sound = sets.where("fault is null").withColumn("bucket", F.expr(f"arrival div {BUCKET}"))
    templates = sound.where("fields is not null")
    last = templates.groupBy(*KEY, "bucket").agg(F.max_by("fields", F.struct("arrival", "set_no")).alias("last"))
    if known is not None:
        last = last.unionByName(known.select(*KEY, F.lit(None).cast("bigint").alias("bucket"), F.col("fields").alias("last")))
    buckets = last.unionByName(sound.where("content is not null").select(*KEY, "bucket").distinct().withColumn("last", F.lit(None).cast("string")))
    buckets = buckets.groupBy(*KEY, "bucket").agg(F.max("last").alias("last"))
    before = Window.partitionBy(*KEY).orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("bucket is not null").drop("last")
    within = Window.partitionBy(*KEY, "bucket").orderBy("arrival", "set_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = sound.withColumn("own", F.last("fields", ignorenulls=True).over(within)).where("content is not null")
    same = [filled[k].eqNullSafe(carried[k]) for k in [*KEY, "bucket"]]
    joined = filled.join(carried, same, "left")
    return joined.select(*(filled[c] for c in sets.columns), F.coalesce("own", "carried").alias("template"))


def _fixed(fields: list, rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """All records of data sets under one template of fixed length, field by field over all of them; as flow() of each."""
    width = sum(size for _, size, _ in fields)
    data, bounds = A.binary_parts(rows["content"])
    start, own, number = A.starts_of(bounds[:-1], np.diff(bounds) // width, width)
    r, n = A.rows_of(data, start, width), len(start)
    boot = rows["boot"].to_numpy(zero_copy_only=False)[own]
    out = {name: np.zeros(n, np.uint64) for name, _ in E.NUMBERS.values()}
    out["sampling_rate"] = np.ones(n, np.uint64)
    address = dict.fromkeys(E.ADDRESSES.values())
    when: dict[str, np.ndarray | None] = {"first_switched": None, "last_switched": None}
    at = 0
    for element, size, pen in fields:
        raw = r[:, at : at + size]
        at += size
        if pen or not size:
            continue
        if element in E.ADDRESSES:
            name = E.ADDRESSES[element]
            if name != "next_hop":
                address[name] = A.addresses(raw) if size in (4, 16) else None
            elif size in (4, 16):
                given = A.addresses(raw, raw.any(1))
                address[name] = given if address[name] is None else pc.coalesce(given, address[name])
            continue
        value = A.big_endian(raw)
        if element in E.NUMBERS:
            name, bits = E.NUMBERS[element]
            out[name] = value & np.uint64((1 << bits) - 1)
        elif element in E.SAMPLING:
            value &= np.uint64(0xFFFFFFFF)
            out["sampling_rate"] = np.where(value > 0, value, out["sampling_rate"])
        elif element in E.UPTIMES:
            when[E.UPTIMES[element]] = boot + (value & np.uint64(0xFFFFFFFF)).astype(np.int64) * 1000
        elif element in E.SECONDS:
            when[E.SECONDS[element]] = value.astype(np.int64) * 1_000_000
        elif element in E.MILLIS:
            when[E.MILLIS[element]] = value.astype(np.int64) * 1000
        elif element in E.NTP:
            low = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
            when[E.NTP[element]] = ((value >> np.uint64(32)).astype(np.int64) - NTP_OFFSET) * 1_000_000 + (low * 1_000_000 >> 32)
    if when["last_switched"] is None:
        when["last_switched"] = when["first_switched"]
    take = pa.array(own)
    kind = pc.if_else(pc.equal(rows["version"], 9), "netflow9", "ipfix").take(take)
    columns = {"received_at": rows["received_at"].take(take).cast(A.UTC), "exporter_addr": rows["exporter"].take(take), "flow_type": kind, "arrival": rows["arrival"].take(take), "set_no": rows["set_no"].take(take), "record_no": pa.array(number.astype(np.int32))}
    columns |= {name: pa.array(value.view(np.int64)) for name, value in out.items()} | address
    columns |= {f"{name[:-9]}_us": None if value is None else pa.array(value) for name, value in when.items()}
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if columns.get(f.name) is None else columns[f.name].cast(f.type) for f in schema], schema=schema)


def _each(fields: list, rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Records of variable length, one after another."""
    out = []
    for d in rows.to_pylist():
        base = {"received_at": d["received_at"], "exporter_addr": d["exporter"], "flow_type": "netflow9" if d["version"] == 9 else "ipfix", "arrival": d["arrival"], "set_no": d["set_no"]}
        try:
            for i, values in enumerate(E.records(d["content"], fields)):
                f = E.flow(values, d["boot"])
                out.append(base | {"record_no": i, "first_us": f.pop("first_switched"), "last_us": f.pop("last_switched")} | f)
        except E.Malformed as e:
            out.append(base | {"fault": str(e)})
    return pa.RecordBatch.from_pylist(out, schema)


def decoded_sets(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The records of data sets that have their `template` beside them, all sets of a template in a batch at once."""
    for batch in batches:
        templates = batch["template"].dictionary_encode()
        which = templates.indices.to_numpy(zero_copy_only=False)
        for i, text in enumerate(templates.dictionary.to_pylist()):
            fields = json.loads(text)
            rows = batch.take(pa.array(np.flatnonzero(which == i)))
            sizes = [size for _, size, _ in fields]
            if E.VARIABLE in sizes:
                yield _each(fields, rows, schema)
            elif sum(sizes):
                yield _fixed(fields, rows, schema)


def decode_templated(datagrams: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): records in decoded form with arrival, set_no and record_no; rejects exporter, arrival, reason.

    The datagrams are read and parsed here and now, once, and their sets kept in a scratch folder, as the join goes over them several times.
    """
    spark, folder, schema = datagrams.sparkSession, scratch(datagrams.sparkSession, "sets"), arrow_schema(RECORD)
    sets_of(datagrams).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(folder)
    sets = spark.read.schema(SETS).parquet(folder)
    matched = with_templates(sets, known)
    unknown = matched.where("template is null").select("exporter", "arrival", F.lit("unknown template").alias("reason")).distinct()
    found = matched.where("template is not null").join(unknown.select("exporter", "arrival"), ["exporter", "arrival"], "left_anti").mapInArrow(lambda batches: decoded_sets(batches, schema), RECORD)
    found = found.withColumn("first_switched", F.timestamp_micros("first_us")).withColumn("last_switched", F.timestamp_micros("last_us"))
    reason = F.coalesce("fault", refusal(found.columns))
    bad = found.where(reason.isNotNull()).select(F.col("exporter_addr").alias("exporter"), "arrival", reason.alias("reason"))
    good = found.where(reason.isNull()).drop("first_us", "last_us", "fault")
    rejects = unknown.unionByName(bad).unionByName(sets.where("fault is not null").select("exporter", "arrival", F.col("fault").alias("reason")))
    return good, rejects
