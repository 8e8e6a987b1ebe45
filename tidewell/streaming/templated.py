"""Streaming decoding of version 9 and 10 datagrams: templates live in keyed state for as long as the stream.

Sets are parsed without state by whole Arrow batches, as in batch decoding, and a batch's data sets of one template and share are
one row from there on (a block: contents end to end, and a row of numbers for each). The state has one map per exporter, version, domain and share:
template id to its fields and when they were learned. A busy exporter's datagrams are dealt over SHARES shares by
stretches of arrivals; template sets (few) go to all of them, so each share has every template, and a datagram with all its
sets is in one share. Within a micro-batch each data set takes the template that came last before it in order of arrival (else the
state's): a block is given its template, or cut where it changes. Blocks are decoded behind the state, in Arrow. A datagram with a
data set of unknown template is rejected whole.

A new stream starts from the templates of the shared log (the state's initial rows). Envelopes that other collectors
add later can come in as a second stream; such a template counts only if it was learned after the one in the state.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import network as N
from ..schema import refusal
from ..sources import bus, templates
from ..sources import fields as A
from ..sources.datagrams import DATAGRAM_DDL
from ..sources.templated import BUCKET, RECORD, arrow_schema, decoded_sets, sets_of
from . import ingest

#: Shares of an exporter's traffic.
SHARES = 8
KEYS = ["exporter", "version", "domain", "share"]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that come from the log, not from a datagram.
FROM_LOG = -1
#: Bytes of content in a block, beyond which another one begins.
BLOCK = 1 << 20
#: Blocks that are handed on at a time.
FRAME = 1000
#: A null among numbers.
NONE = -(1 << 63)
#: What each set of a block has beside its content: bytes of it, place in the datagram, arrival, boot and receipt in microseconds.
HEAD = np.dtype([("size", "<i4"), ("set_no", "<i4"), ("arrival", "<i8"), ("boot", "<i8"), ("received", "<i8")])
BLOCKS = "exporter binary, received_at timestamp, arrival bigint, set_no int, version int, domain bigint, template_id int, fields string, fault string, content binary, heads binary"
MATCHED = "exporter binary, version int, received_at timestamp, arrival bigint, template string, fault string, content binary, heads binary"
MATCHED_COLUMNS = [c.split(" ")[0] for c in MATCHED.split(", ")]


def _learn(known, number: int, fields: str, learned_us: int) -> None:
    """Keeps a template unless the state has a later one."""
    own = known.getValue((number,)) if known.containsKey((number,)) else None
    if own is None or own[1] <= learned_us:
        known.updateValue((number,), (fields, learned_us))


def _cut(content: bytes, heads: np.ndarray, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A block with some of its sets only."""
    return np.frombuffer(content, np.uint8)[np.repeat(keep, heads["size"])].tobytes(), heads[keep]


def _places(told: pd.DataFrame, heads: np.ndarray) -> np.ndarray:
    """How many of the template sets `told`, which are in order, come before each set of a block."""
    at = told["arrival"].to_numpy(np.int64)
    first = np.searchsorted(at, heads["arrival"][0], "left")
    if first == np.searchsorted(at, heads["arrival"][-1], "right"):
        return np.full(len(heads), first)
    order = np.lexsort((np.r_[told["set_no"].to_numpy(np.int64), heads["set_no"]], np.r_[at, heads["arrival"]]))
    places = np.empty(len(order), np.int64)
    places[order] = np.cumsum(order < len(at))
    return places[len(at) :]


def match_share(key: tuple, rows: Iterator[pd.DataFrame], known) -> Iterator[pd.DataFrame]:
    """The blocks of a share in a micro-batch with their template, and its faults. known: its map of templates, which is brought up to date."""
    blocks = pd.concat(list(rows), ignore_index=True)
    told = blocks[blocks["fields"].notna()].sort_values(["arrival", "set_no"], kind="stable")
    for r in told[told["arrival"] == FROM_LOG].itertuples():
        _learn(known, int(r.template_id), r.fields, r.received_at.value // 1000)
    told = told[told["arrival"] != FROM_LOG]
    found, lost = [], []
    for number, own in blocks[blocks["content"].notna()].groupby("template_id"):
        news = told[told["template_id"] == number]
        # sets ahead of the batch's first template take the state's
        inforce = [known.getValue((int(number),))[0] if known.containsKey((int(number),)) else None, *news["fields"]]
        for content, raw in zip(own["content"], own["heads"]):
            heads = np.frombuffer(raw, HEAD)
            places = _places(news, heads)
            for place in np.unique(places):
                part = (content, heads) if places[0] == places[-1] else _cut(content, heads, places == place)
                if inforce[place] is None:
                    lost.append(part[1])
                else:
                    found.append((inforce[place], *part))
    for r in told.drop_duplicates("template_id", keep="last").itertuples():
        _learn(known, int(r.template_id), r.fields, r.received_at.value // 1000)
    frame = lambda **columns: pd.DataFrame(dict.fromkeys(MATCHED_COLUMNS) | columns).assign(exporter=key[0], version=key[1])
    faulty = blocks[blocks["fault"].notna()]
    if len(faulty):
        yield frame(**{c: faulty[c] for c in ("received_at", "arrival", "fault")})
    if lost:
        heads = np.concatenate(lost)
        bad, at = np.unique(heads["arrival"], return_index=True)
        yield frame(received_at=pd.Series(heads["received"][at].view("datetime64[us]")).dt.tz_localize("UTC"), arrival=pd.Series(bad, dtype="Int64").mask(bad == NONE), fault="unknown template")
        kept = ((template, content, heads, ~np.isin(heads["arrival"], bad)) for template, content, heads in found)
        found = [(template, content, heads) if keep.all() else (template, *_cut(content, heads, keep)) for template, content, heads, keep in kept if keep.any()]
    for i in range(0, len(found), FRAME):
        texts, contents, heads = zip(*found[i : i + FRAME])
        yield frame(template=list(texts), content=list(contents), heads=[h.tobytes() for h in heads])


def _matcher() -> StatefulProcessor:
    """The processor, of a class that is sent by value: Spark also loads it in a process of the driver that lacks this package."""

    class TemplateMatcher(StatefulProcessor):
        def init(self, handle) -> None:
            self._known = handle.getMapState("templates", "template_id int", "fields string, learned_us bigint")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            from tidewell.streaming.templated import _learn

            for r in initialState.itertuples():
                _learn(self._known, int(r.template_id), r.fields, int(r.learned_us))

        def handleInputRows(self, key, rows, timerValues):
            from tidewell.streaming.templated import match_share

            yield from match_share(key, rows, self._known)

        def close(self) -> None:
            pass

    return TemplateMatcher()


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)


def _blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes between the bounds as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _batch(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def blocks_of(sets: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The data sets of a batch as blocks, each of one exporter, version, domain, template and share, in order of arrival; template sets and faults as rows of their own."""
    alone = pc.is_null(sets["content"])
    single, data = sets.filter(alone), sets.filter(pc.invert(alone))
    if len(single):
        yield _batch(schema, len(single), {c: single[c] for c in sets.schema.names} | {c: single[c].fill_null(0) for c in ("version", "domain")})
    if not len(data):
        return
    arrival, set_no = _numbers(data["arrival"]), _numbers(data["set_no"])
    share = np.where(arrival == NONE, -1, _numbers(pc.divide(data["arrival"], BUCKET)) % SHARES)
    keys = [data["exporter"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), *(_numbers(data[c]) for c in ("version", "domain", "template_id")), share]
    order = np.lexsort((set_no, arrival, *keys))
    data = data.take(pa.array(order))
    content, bounds = A.binary_parts(data["content"])
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in (*(k[order] for k in keys), bounds[:-1] // BLOCK):
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    ends = np.r_[start, len(order)]
    heads = np.empty(len(order), HEAD)
    for name, values in (("size", np.diff(bounds)), ("set_no", set_no[order]), ("arrival", arrival[order]), ("boot", _numbers(data["boot"])), ("received", _numbers(data["received_at"]))):
        heads[name] = values
    first = data.take(pa.array(start))
    columns = {c: first[c] for c in ("exporter", "received_at", "arrival", "set_no", "version", "domain", "template_id")}
    yield _batch(schema, len(start), columns | {"content": _blobs(content, bounds[ends]), "heads": _blobs(heads, ends * HEAD.itemsize)})


def block_records(blocks: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The records of blocks that have their template beside them, some megabytes of content at a time, and the faults."""
    bad, blocks = blocks.filter(pc.is_valid(blocks["fault"])), blocks.filter(pc.is_valid(blocks["content"]))
    if len(bad):
        yield _batch(schema, len(bad), {"received_at": bad["received_at"], "exporter_addr": bad["exporter"], "arrival": bad["arrival"], "fault": bad["fault"]})
    content, bounds = A.binary_parts(blocks["content"])
    cuts = np.flatnonzero(np.diff(bounds[:-1] // (4 * BLOCK))) + 1
    for a, z in zip([0, *cuts], [*cuts, len(blocks)]):
        part = blocks.slice(a, z - a)
        data, ends = A.binary_parts(part["heads"])
        heads = np.frombuffer(data.tobytes(), HEAD)
        if not len(heads):
            continue
        own = pa.array(np.repeat(np.arange(len(part)), np.diff(ends) // HEAD.itemsize))
        sets = {c: part[c].take(own) for c in ("exporter", "version")} | {"template": part["template"].dictionary_encode().take(own)}
        sets |= {"received_at": A.instants(heads["received"], heads["received"] != NONE), "arrival": pa.array(heads["arrival"].copy(), mask=heads["arrival"] == NONE)}
        sets |= {"set_no": pa.array(heads["set_no"].copy()), "boot": pa.array(heads["boot"].copy()), "content": _blobs(content[bounds[a] : bounds[z]], np.r_[0, np.cumsum(heads["size"])])}
        yield from decoded_sets([pa.RecordBatch.from_pydict(sets)], schema)


def _dealt(sets: DataFrame) -> DataFrame:
    """Template sets to every share, data sets to the one of their stretch of arrivals."""
    own = F.array(F.pmod(F.expr(f"arrival div {BUCKET}"), F.lit(SHARES)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(SHARES - 1))
    return sets.withColumn("share", F.explode(F.when(F.col("fields").isNotNull(), every).otherwise(own)))


def logged_templates(log: DataFrame) -> DataFrame:
    """Templates of envelopes (key, value, timestamp) as sets that come from the log; what isn't one is left out."""
    parts = templates.with_key_parts(templates.opened(log)).withColumn("exporter", N.ip_bytes(F.col("exporter_text")))
    sound = parts.where("kind = 'template' and exporter is not null and version in (9, 10) and domain is not null and template_id is not null")
    return sound.select("exporter", F.col("timestamp").alias("received_at"), F.lit(FROM_LOG).cast("bigint").alias("arrival"), F.lit(0).alias("set_no"), "version", "domain", F.lit(0).cast("bigint").alias("boot"), "template_id", "fields", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("fault"))


def decode_stream(datagrams: DataFrame, known: DataFrame | None = None, news: DataFrame | None = None) -> DataFrame:
    """Decoded records and, with `reason` set, what was rejected (a row a datagram); the caller splits them in its batches.

    known: a log of envelopes as it stands, for a new stream to start from; news: envelopes as they are added. State of this kind
    needs Spark's RocksDB store, which the session is set to if it names none.
    """
    spark = datagrams.sparkSession
    if spark.conf.get(STATE_STORE, "").rpartition(".")[2] != ROCKS.rpartition(".")[2]:
        spark.conf.set(STATE_STORE, ROCKS)
    parts, records = arrow_schema(BLOCKS), arrow_schema(RECORD)
    # parsed in one pass: faults go through the state's operator too, not by a second reading
    every = sets_of(datagrams).mapInArrow(lambda batches: (p for b in batches for p in blocks_of(b, parts)), BLOCKS)
    if news is not None:
        every = every.unionByName(logged_templates(news).select("exporter", "received_at", "arrival", "set_no", "version", "domain", "template_id", "fields"), allowMissingColumns=True)
    start = None
    if known is not None:
        last = logged_templates(templates.latest(known, "timestamp"))
        start = _dealt(last).select(*KEYS, "template_id", "fields", F.unix_micros("received_at").alias("learned_us")).groupBy(*KEYS)
    matched = _dealt(every).groupBy(*KEYS).transformWithStateInPandas(_matcher(), MATCHED, "Append", "None", start)
    found = matched.mapInArrow(lambda batches: (r for b in batches for r in block_records(b, records)), RECORD)
    found = found.withColumn("first_switched", F.timestamp_micros("first_us")).withColumn("last_switched", F.timestamp_micros("last_us"))
    return found.withColumn("reason", F.coalesce("fault", refusal(found.columns))).drop("first_us", "last_us", "fault")


def learned(datagrams: DataFrame) -> DataFrame:
    """The templates that datagrams carry, as envelopes: key, value, timestamp."""
    found = sets_of(datagrams).where("fields is not null").withColumns({"exporter_text": N.ip_text(F.col("exporter")), "kind": F.lit("template")})
    parts = F.concat_ws("/", "exporter_text", "version", "domain", "template_id")
    value = F.concat(F.lit('{"kind":"'), F.col("kind"), F.lit('","record":'), F.col("fields"), F.lit("}"))
    return found.select(parts.alias("key"), value.alias("value"), F.col("received_at").alias("timestamp"))


def share(spark: SparkSession, folder: str, sink, checkpoint: str, metrics, seconds: float = 1.0, once: bool = False):
    """A stream of its own that publishes each template that lands in the folder, the last of a batch per key."""
    landed = bus.folder_stream(spark, folder, schema=DATAGRAM_DDL)

    def publish(batch: DataFrame, batch_id: int, source: str = "direct") -> None:
        last = batch.groupBy("key").agg(F.max_by(F.struct("value", "timestamp"), F.col("timestamp")).alias("v")).select("key", "v.*")
        if not last.isEmpty():
            ingest.bound(sink, source)(last, batch_id)

    return ingest.start(learned(landed), {"templates": publish}, checkpoint, metrics, seconds, once, source="udp")


def replayed(read: Callable[[], DataFrame], folder: str, seconds: float) -> DataFrame | None:
    """The last envelope of each key of a shared log, read to its end as of now and kept under `folder` for a new stream to start from.

    None if that takes longer than `seconds` or fails: then the stream starts without, and templates come as they are told.
    """

    def go() -> DataFrame:
        log = read()
        templates.latest(log, "timestamp").write.mode("overwrite").parquet(folder)
        return log.sparkSession.read.schema(bus.MESSAGES).parquet(folder)

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(go).result(seconds)
    except Exception as e:  # noqa: BLE001  sharing is a help, not a need
        logging.getLogger(__name__).warning("shared templates were not replayed", extra={"fields": {"error": str(e) or type(e).__name__, "seconds": seconds}})
        return None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
