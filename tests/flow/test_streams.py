"""Ingest end to end: landing, replay after a failed sink, templates in state, drop accounting, tiers."""

import datetime as dt
import json
import socket
import struct
import threading
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidewell.functions.network import parse_ip
from tidewell.obs import Metrics, StreamWatch
from tidewell.plans import query as Q
from tidewell.plans import registry
from tidewell.sinks.messages import EnvelopeFolder, MessageFolder
from tidewell.sinks.table import FlowTable
from tidewell.sources import bus, templates, wire
from tidewell.sources import templated as batch_decoder
from tidewell.sources.datagrams import DATAGRAM_DDL
from tidewell.sources.landing import Buffer, Landing
from tidewell.streaming import ingest, templated
from tidewell.streaming.datagrams import records_of

from .records import BASE, WINDOW, batch, number
from .test_decoding import REC_A, REC_B, data_set, landed, template_set, v5, v9

SF = "/root/testdata/sf0.001"


def table_at(spark, path):
    t = FlowTable(spark, str(path))
    t.migrate()
    return t


def test_failed_sink_is_replayed_to_exactly_all_rows(spark, tmp_path):
    messages = MessageFolder(str(tmp_path / "bus"))
    for i in range(5):
        messages.write_batch(batch(spark, 10, first=10 * i), i)
    table, metrics, other, calls = table_at(spark, tmp_path / "t"), Metrics(), [], []

    def flaky(df, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("refused")
        other.extend(number(r) for r in df.collect())

    records = wire.good(bus.folder_stream(spark, messages.path))
    run = lambda: ingest.start(records, {"table": table.write_batch, "flaky": flaky}, str(tmp_path / "ck"), metrics, once=True).awaitTermination()
    with pytest.raises(Exception, match="flaky failed"):
        run()
    assert len(table.query(Q.FlowQuery(**WINDOW)).rows) == 50  # the good sink has the batch
    run()
    assert len(table.query(Q.FlowQuery(**WINDOW)).rows) == 50 and sorted(other) == list(range(50))
    assert metrics.value("source_rewinds", source="bus") == 1 and metrics.value("batch_write_errors", sink="flaky") == 1
    assert metrics.value("visibility_lag_seconds_count") == 50


def test_redelivery_and_poison(spark, tmp_path):
    messages = MessageFolder(str(tmp_path / "bus"))
    for i in range(2):
        messages.write_batch(batch(spark, 20), i)
    spark.createDataFrame([("k", "poison", BASE), ("k", "{}", BASE)], bus.MESSAGES).write.parquet(f"{messages.path}/batch=9")
    table = table_at(spark, tmp_path / "t")
    ingest.start(wire.good(bus.folder_stream(spark, messages.path, most_files=1)), {"table": table.write_batch}, str(tmp_path / "ck"), Metrics(), once=True).awaitTermination()
    assert len(table.query(Q.FlowQuery(**WINDOW)).rows) == 20
    assert wire.quarantined(bus.folder_table(spark, messages.path)).count() == 2


def test_drop_on_error_goes_on(spark, tmp_path):
    messages = MessageFolder(str(tmp_path / "bus"))
    messages.write_batch(batch(spark, 3), 0)

    def broken(df, batch_id):
        raise RuntimeError("always")

    metrics = Metrics()
    ingest.start(wire.good(bus.folder_stream(spark, messages.path)), {"broken": broken}, str(tmp_path / "ck"), metrics, once=True, drop_on_error=True).awaitTermination()
    assert metrics.value("batch_write_errors", sink="broken") == 1


@pytest.mark.parametrize(("good", "dropped", "visible"), [((), 3, 0), (("good",), 0, 3)])
def test_rows_that_no_sink_took_are_dropped(spark, good, dropped, visible):
    def broken(df, batch_id):
        raise RuntimeError("always")

    metrics = Metrics()
    ingest.fan_out({"broken": broken} | {n: lambda df, i: df.count() for n in good}, metrics, drop_on_error=True)(batch(spark, 3), 0)
    assert metrics.value("records_dropped", reason="at_most_once") == dropped and metrics.value("visibility_lag_seconds_count") == visible


def failing_at(monkeypatch, *which):
    """The table refuses its calls of these numbers."""
    stored, calls = FlowTable.write_batch, []

    def refusing(self, *args, **named):
        calls.append(1)
        if len(calls) in which:
            raise RuntimeError("the disk is full")
        return stored(self, *args, **named)

    monkeypatch.setattr(FlowTable, "write_batch", refusing)


def test_stream_dedup_fails_with_its_table(spark, monkeypatch):
    failing_at(monkeypatch, 1)
    with pytest.raises(Exception, match="table failed"):
        registry.queries()["stream_dedup"](spark, SF)


def test_stream_dedup_fails_where_messages_do_not_decode(spark, tmp_path):
    """A flow without a time is a message that is refused, which would be missing from the result."""
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 50")
    events.withColumn("ts", F.when(F.col("event_id") != 7, F.col("ts"))).write.parquet(f"{tmp_path}/events.parquet")
    with pytest.raises(RuntimeError, match="2 didn't decode"):
        registry.queries()["stream_dedup"](spark, str(tmp_path))


@pytest.mark.parametrize("call", [1, 2])
def test_stream_rewind_fails_with_its_table(spark, monkeypatch, call):
    """The table's failure isn't the planned refusal: not beside it in the first run, nor in the second, behind it."""
    failing_at(monkeypatch, call)
    with pytest.raises(Exception, match="table failed"):
        registry.queries()["stream_rewind"](spark, SF)


def test_stream_rewind_fails_without_a_rewind(spark, monkeypatch):
    """A stream that goes on behind the refused batch has lost it for that sink."""
    start = ingest.start
    monkeypatch.setattr(ingest, "start", lambda *args, **named: start(*args, **named | {"drop_on_error": True}))
    with pytest.raises(RuntimeError, match="didn't fail"):
        registry.queries()["stream_rewind"](spark, SF)


def test_streams_without_messages(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert all(registry.queries()[name](spark, str(tmp_path)).count() == 0 for name in ("stream_dedup", "stream_rewind"))


def test_at_most_once_loses_the_begun_batch_alone(spark, tmp_path, monkeypatch):
    """The process fails in its second batch: when it starts again that batch is counted as lost, what follows is taken, and what was taken isn't again."""
    messages, metrics, seen = MessageFolder(str(tmp_path / "bus")), Metrics(), []
    measured, calls = ingest.measured, []

    def failing(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the process fails")
        return measured(df)

    def go():
        sinks = {"sink": lambda df, batch_id: seen.extend(number(r) for r in df.collect())}
        ingest.messages_of(bus.folder_stream(spark, messages.path, most_files=1), sinks, str(tmp_path / "ck"), metrics, str(tmp_path / "q"), once=True, delivery=ingest.AT_MOST_ONCE).awaitTermination()

    monkeypatch.setattr(ingest, "measured", failing)
    for i in range(3):
        messages.write_batch(batch(spark, 4, first=10 * i).coalesce(1), i)
    with pytest.raises(Exception, match="process fails"):
        go()
    taken = len(seen)
    go()
    assert taken == 4 and len(seen) == len(set(seen)) == 8 and metrics.value("records_dropped", reason="at_most_once") == 4
    go()
    assert len(seen) == 8


def test_refused_sinks_lose_a_batch_at_most_once(spark, tmp_path):
    messages, metrics = MessageFolder(str(tmp_path / "bus")), Metrics()
    messages.write_batch(batch(spark, 4), 0)

    def broken(df, batch_id):
        raise RuntimeError("always")

    ingest.messages_of(bus.folder_stream(spark, messages.path), {"broken": broken}, str(tmp_path / "ck"), metrics, str(tmp_path / "q"), once=True, delivery=ingest.AT_MOST_ONCE).awaitTermination()
    assert metrics.value("batch_write_errors", sink="broken") == 1 and metrics.value("source_rewinds", source="bus") == 0


def test_streams_are_watched(spark, tmp_path):
    metrics = Metrics()
    watch = StreamWatch(metrics)
    spark.streams.addListener(watch)
    try:
        messages = MessageFolder(str(tmp_path / "bus"))
        messages.write_batch(batch(spark, 6), 0)
        records = wire.good(bus.folder_stream(spark, messages.path))
        ingest.start(records, {"none": lambda df, i: df.count()}, str(tmp_path / "ck"), metrics, once=True, name="watched").awaitTermination()
        until = time.time() + 20
        while time.time() < until and not metrics.value("stream_batch_seconds", stream="watched"):
            time.sleep(0.1)
        assert metrics.value("stream_batch_seconds", stream="watched") > 0 and "tidewell_stream_rows_per_second{stream=\"watched\"}" in metrics.text()
    finally:
        spark.streams.removeListener(watch)


def test_lag_of_points():
    m = Metrics()
    ingest.count_lag(m, 7, [0, 50_000_000, 100_000_000], 100.0)
    assert m.value("visibility_lag_seconds_count") == 7 and m.value("visibility_lag_seconds_bucket", le=60) == 5 and m.value("visibility_lag_seconds_bucket", le=0.1) == 3


def test_datagram_stream_keeps_templates_over_batches(spark, tmp_path):
    folder, table, metrics = str(tmp_path / "landed"), table_at(spark, tmp_path / "t"), Metrics()
    go = lambda: records_of(spark, folder, {"table": table.write_batch}, str(tmp_path / "ck"), metrics, once=True).awaitTermination()
    landed(spark, v9(data_set()), v9(template_set()), v5(REC_A, REC_B), b"\x05").coalesce(1).write.parquet(f"{folder}/1")
    go()
    landed(spark, v9(data_set(REC_A)), v9(data_set(REC_A))).coalesce(1).write.parquet(f"{folder}/2")
    go()
    rows = table.query(Q.FlowQuery(**WINDOW)).rows
    assert sorted(r.flow_type for r in rows) == ["netflow5", "netflow5", "netflow9", "netflow9"]
    assert metrics.value("decode_errors", source="udp") == 2


def test_buffer_counts_every_offer():
    m = Metrics()
    b = Buffer(8, m)
    assert sum(b.offer(i) for i in range(200)) == 8 and m.value("records_dropped", reason="buffer_full") == 192
    assert [len(b.take(5, 0.01)), len(b.take(5, 0.01)), len(b)] == [5, 3, 0]
    threads = [threading.Thread(target=lambda: [b.offer(i) for i in range(2000)]) for _ in range(8)]
    stop = threading.Event()
    taker = threading.Thread(target=lambda: [b.take(256, 0.01) for _ in iter(stop.is_set, True)])
    for t in (*threads, taker):
        t.start()
    for t in threads:
        t.join()
    stop.set()
    taker.join()
    b.close()
    assert not b.offer(1) and m.value("records_dropped", reason="shutdown") == 1
    assert m.value("records_ingested", source="udp") + m.value("records_dropped", reason="buffer_full") + 1 == 200 + 8 * 2000 + 1


def test_landing_daemon(spark, tmp_path):
    m = Metrics()
    daemon = Landing(str(tmp_path / "l"), m, batch=10, seconds=0.2)
    address = daemon.start("127.0.0.1", 0)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for _ in range(25):
            s.sendto(v5(REC_A), address)
    until = time.time() + 5
    while m.value("records_ingested", source="udp") < 25 and time.time() < until:
        time.sleep(0.05)
    daemon.stop()
    rows = bus.folder_table(spark, str(tmp_path / "l"), "exporter binary, received_at timestamp, arrival bigint, payload binary").collect()
    assert len(rows) == 25 and len({r.arrival for r in rows}) == 25 and {bytes(r.exporter) for r in rows} == {parse_ip("127.0.0.1")}
    assert all(abs(r.received_at - dt.datetime.now(dt.UTC).replace(tzinfo=None)) < dt.timedelta(minutes=1) for r in rows)


def test_collector_over_two_folders(spark, tmp_path):
    """cli.run: two inboxes into one table; what is poison is kept and counted, what comes twice is counted, what is old goes."""
    from tidewell import cli, config

    table, metrics, stop = table_at(spark, tmp_path / "t"), Metrics(), threading.Event()
    for n in range(2):
        MessageFolder(str(tmp_path / f"in{n}")).write_batch(batch(spark, 20, first=10 * n), 0)
    table.write_batch(batch(spark, 3, first=500, at=BASE - dt.timedelta(days=90)), 0)
    spark.createDataFrame([("k", "poison", BASE)], bus.MESSAGES).write.parquet(f"{tmp_path}/in0/more")
    env = {"SOURCES": "folder", "SINKS": "table,folder", "INBOX_PATHS": f"{tmp_path}/in0,{tmp_path}/in1", "TABLE_PATH": table.path, "FOLDER_PATH": f"{tmp_path}/out", "CHECKPOINT_PATH": f"{tmp_path}/ck", "BATCH_SECONDS": "0.2"}
    env["RETENTION_DAYS"] = str((dt.datetime.now(dt.UTC) - BASE).days + 5) if dt.datetime.now(dt.UTC) > BASE else "1"
    settings = config.load({config.PREFIX + k: v for k, v in env.items()}, tmp_path)
    runner = threading.Thread(target=lambda: cli.run(settings, spark, stop, metrics))
    runner.start()
    until = time.time() + 90
    while time.time() < until and (len(table.query(Q.FlowQuery(**WINDOW)).rows) < 30 or metrics.value("decode_errors", source="bus") < 1 or metrics.value("deduped_rows") < 10):
        time.sleep(0.5)
    stop.set()
    runner.join(60)
    assert not runner.is_alive() and len(table.query(Q.FlowQuery(**WINDOW)).rows) == 30
    assert metrics.value("decode_errors", source="bus") == 1 and metrics.value("deduped_rows") == 10
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/ck/quarantine").collect()] == ["poison"]
    assert bus.folder_table(spark, f"{tmp_path}/out").count() == 40
    assert (BASE - dt.timedelta(days=90)).date() not in table.days() and (BASE.date() in table.days())


def test_templates_are_shared_and_come_first(spark, tmp_path):
    """What one collector learns another knows from its start, before any exporter has sent it a template."""
    shared, metrics = EnvelopeFolder(str(tmp_path / "shared")), Metrics()
    landed(spark, v9(template_set())).write.parquet(f"{tmp_path}/a/1")
    templated.share(spark, str(tmp_path / "a"), shared.write_batch, str(tmp_path / "cka"), metrics, once=True).awaitTermination()
    landed(spark, v9(data_set())).write.parquet(f"{tmp_path}/b/2")
    table = table_at(spark, tmp_path / "t")
    records_of(spark, str(tmp_path / "b"), {"table": table.write_batch}, str(tmp_path / "ckb"), metrics, once=True, known=shared.read(spark)).awaitTermination()
    assert [r.flow_type for r in table.query(Q.FlowQuery(**WINDOW)).rows] == ["netflow9"] and metrics.value("decode_errors", source="udp") == 0


def decoded(spark, folder, checkpoint, out, **shared):
    records = templated.decode_stream(bus.folder_stream(spark, str(folder), schema=DATAGRAM_DDL), **shared)
    records.writeStream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out), "parquet").awaitTermination()
    return spark.read.parquet(str(out))


def test_log_compaction(spark, tmp_path):
    """The last value of a key stays, a null one ends it; a reader keeps what its mark covers; a segment that comes again changes nothing."""
    log = EnvelopeFolder(str(tmp_path / "log"))
    log.create(spark)
    at = lambda s: BASE + dt.timedelta(seconds=s)
    tell = lambda n, *rows, source="one": log.write_batch(spark.createDataFrame(rows, bus.MESSAGES), n, source)
    values = lambda df: sorted((r.key, r.value) for r in df.collect())
    assert values(log.read(spark)) == [] and log.compact(spark) == 0
    tell(0, ("a", "1", at(1)), ("b", "1", at(1)))
    tell(0, ("a", "3", at(3)), source="two")
    mark = log.mark(spark)
    tell(1, ("a", "2", at(2)), ("b", None, at(5)), ("c", "9", at(0)))
    assert values(log.read(spark, mark)) == [("a", "1"), ("a", "3"), ("b", "1")]
    before = log.read(spark)
    assert log.compact(spark) == 3 and values(log.read(spark)) == [("a", "3"), ("b", None), ("c", "9")]
    assert before.count() == 6 and log.read(spark, mark).count() == 3
    tell(1, ("a", "2", at(2)), ("b", None, at(5)), ("c", "9", at(0)))
    tell(2, ("c", "10", at(9)), ("b", "late", at(4)))
    assert log.read(spark).count() == 5
    assert log.compact(spark, grace=0) == 3 and values(templates.latest(log.read(spark), "timestamp")) == [("a", "3"), ("c", "10")]
    tell(3, ("d", "1", at(1)))
    assert log.compact(spark, grace=0, forget=at(6)) == 3 and values(log.read(spark)) == [("a", "3"), ("c", "10"), ("d", "1")]


def test_replay_of_templates_has_a_timeout(spark, tmp_path):
    log = EnvelopeFolder(str(tmp_path / "log"))
    log.write_batch(spark.createDataFrame([("k", "1", BASE), ("k", "2", BASE + dt.timedelta(seconds=1))], bus.MESSAGES), 0)
    assert [r.value for r in templated.replayed(lambda: log.read(spark), f"{tmp_path}/known", 60).collect()] == ["2"]
    assert templated.replayed(lambda: time.sleep(2), f"{tmp_path}/slow", 0.1) is None
    assert templated.replayed(lambda: spark.read.parquet(f"{tmp_path}/nowhere"), f"{tmp_path}/none", 60) is None


def raw_set(number, content):
    return struct.pack("!HH", number, 4 + len(content)) + content


#: Source, destination and first time: 12 bytes a record.
SHORT = [(8, 4), (12, 4), (22, 4)]


def test_stream_decodes_as_the_batch_does(spark, tmp_path):
    """Two exporters over several shares, a template that changes, one that comes late, variable fields, a cut-off set, a template without addresses."""
    named = template_set(257, [*SHORT, (82, 65535)]) + raw_set(257, bytes(12) + b"\x03abc" + bytes(12) + b"\x00" + b"cut")
    payloads = [v9(data_set()), v9(template_set()), v9(data_set()), v9(named), v9(template_set(256, SHORT)), v9(raw_set(256, bytes(24))), v9(data_set())[:-3], v9(raw_set(300, b"1234")), v9(template_set(258, [(1, 4)]), raw_set(258, bytes(8)))]
    payloads += [v9(raw_set(256, bytes(12))) for _ in range(30)]
    rows = [(parse_ip(f"192.0.2.{own}"), BASE + dt.timedelta(seconds=i), i * 997, p) for own in (1, 2) for i, p in enumerate(payloads)]
    datagrams = spark.createDataFrame(rows, DATAGRAM_DDL)
    datagrams.repartition(3).write.parquet(f"{tmp_path}/in")
    good, bad = batch_decoder.decode_templated(datagrams)
    found = decoded(spark, tmp_path / "in", tmp_path / "ck", tmp_path / "out")
    plain = lambda df, *c: sorted(str(tuple(r)) for r in df.select(*c).collect())
    assert plain(found.where("reason is null"), *good.columns) == plain(good, *good.columns) and good.count() == 2 * (1 + 1 + 1 + 2 + 30)
    refused = plain(found.where("reason is not null"), "exporter_addr", "arrival", "reason")
    assert refused == plain(bad, "exporter", "arrival", "reason") and len(refused) >= 2 * 4


class Known(dict):
    """A share's map of templates outside Spark."""

    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__


def test_blocks_are_cut_where_the_template_changes(monkeypatch):
    """Sets of one template in few rows: those before a new template take the state's, those of a rejected datagram go, and large blocks are cut."""
    fields = lambda f: json.dumps([[*x, 0] for x in f])
    longer = [*SHORT, (1, 4)]
    rows = [{"arrival": 10 * i, "set_no": 0, "template_id": 256, "content": bytes(8) + i.to_bytes(4) + bytes(12)} for i in range(12)]
    rows.insert(6, {"arrival": 55, "set_no": 0, "template_id": 256, "fields": fields(longer)})
    rows += [{"arrival": 30, "set_no": 1, "template_id": 300, "content": b"1234"}, {"arrival": 33, "set_no": 0, "fault": "set is cut off"}]
    base = {"exporter": parse_ip("192.0.2.7"), "received_at": BASE, "version": 9, "domain": 100, "boot": 0}
    sets = pa.RecordBatch.from_pylist([base | r for r in reversed(rows)], batch_decoder.arrow_schema(batch_decoder.SETS))
    for size, many in ((templated.BLOCK, 2), (48, 7)):
        monkeypatch.setattr(templated, "BLOCK", size)
        known = Known({(256,): (fields(SHORT), 0)})
        blocks = pa.Table.from_batches(templated.blocks_of(sets, batch_decoder.arrow_schema(templated.BLOCKS)))
        assert blocks.filter(pc.is_valid(blocks["content"])).num_rows == many
        matched = list(templated.match_share((base["exporter"], 9, 100, 0), iter([blocks.to_pandas()]), known))
        schema = batch_decoder.arrow_schema(templated.MATCHED)
        found = [r for m in matched for b in templated.block_records(pa.RecordBatch.from_pandas(m, schema, preserve_index=False), batch_decoder.arrow_schema(batch_decoder.RECORD)) for r in b.to_pylist()]
        assert sorted((r["arrival"], r["fault"]) for r in found if r["fault"]) == [(30, "unknown template"), (33, "set is cut off")]
        records = sorted((r["arrival"], r["record_no"], r["first_us"]) for r in found if not r["fault"])
        assert records == sorted([(10 * i, n, 1000 * i if not n else 0) for i in range(6) if i != 3 for n in (0, 1)] + [(10 * i, 0, 1000 * i) for i in range(6, 12)])
        assert json.loads(known[256,][0]) == [[*x, 0] for x in longer] and {r["received_at"].replace(tzinfo=None) for r in found} == {BASE.replace(tzinfo=None)}


def test_templates_of_others_arrive_while_the_stream_runs(spark, tmp_path):
    """A later template of the log replaces the state's, an earlier one doesn't; poison envelopes are passed over."""
    log = EnvelopeFolder(str(tmp_path / "log"))
    log.create(spark)
    envelope = '{"kind":"template","record":%s}' % json.dumps([[*f, 0] for f in SHORT])
    tell = lambda n, *rows: log.write_batch(spark.createDataFrame(rows, bus.MESSAGES), n)
    tell(0, ("192.0.2.7/9/100/256", envelope, BASE), ("poison", envelope, BASE), ("192.0.2.7/9/100/300", "{", BASE))
    go = lambda: decoded(spark, tmp_path / "in", tmp_path / "ck", tmp_path / "out", news=bus.folder_stream(spark, f"{log.path}/{log.UNIT}"))

    def land(n, *payloads):
        rows = [(parse_ip("192.0.2.7"), BASE + dt.timedelta(hours=n), 10 * n + i, p) for i, p in enumerate(payloads)]
        spark.createDataFrame(rows, DATAGRAM_DDL).write.parquet(f"{tmp_path}/in/{n}")

    land(0, v9(raw_set(256, bytes(24))))
    assert go().where("reason is null").count() == 2
    land(1, v9(template_set()))  # the exporter's own, an hour later
    go()
    tell(1, ("192.0.2.7/9/100/256", envelope, BASE + dt.timedelta(minutes=1)))
    land(2, v9(data_set()))
    assert [r.dst_port for r in go().where("arrival = 20").collect()] == [8443]
    tell(2, ("192.0.2.7/9/100/256", envelope, BASE + dt.timedelta(hours=9)))
    land(3, v9(raw_set(256, bytes(36))))
    assert go().where("arrival = 30 and reason is null").count() == 3


def test_drain(spark, tmp_path):
    messages = MessageFolder(str(tmp_path / "bus"))
    messages.write_batch(batch(spark, 3), 0)
    seen = []
    q = ingest.start(wire.good(bus.folder_stream(spark, messages.path)), {"seen": lambda df, i: seen.append(df.count())}, str(tmp_path / "ck"), Metrics(), seconds=0.2)
    q.processAllAvailable()
    assert ingest.drain(q) and not q.isActive and sum(seen) == 3
