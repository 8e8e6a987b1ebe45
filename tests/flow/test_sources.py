"""The data source over landed files and the writer of relational stores."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewell.session import ship
from tidewell.sources import landed
from tidewell.sources.landing import SCHEMA

from tidewell.sinks import sql

from .records import BASE, FIRST_AS, batch, frame, record


def land(folder, first, n):
    os.makedirs(folder, exist_ok=True)
    rows = [(b"x" * 16, BASE + dt.timedelta(seconds=i), first + i, b"payload %d" % i) for i in range(n)]
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA), f"{folder}/{first:020d}-abc.parquet")


@pytest.fixture
def source(spark):
    ship(spark)
    spark.dataSource.register(landed.LandedSource)
    return spark


def run(spark, folder, checkpoint, out, most=2):
    stream = spark.readStream.format("landed").option("path", str(folder)).option("mostFiles", str(most)).load()
    query = stream.writeStream.option("checkpointLocation", str(checkpoint)).start(str(out), "parquet")
    query.processAllAvailable()
    batches = query.lastProgress["batchId"] if query.lastProgress else -1
    query.stop()
    return batches


def test_stream_goes_on_from_its_offset(source, tmp_path):
    """Files of a first run may be gone when it starts again; what was read isn't read twice, and a file being written isn't seen."""
    spark, folder, out = source, str(tmp_path / "l"), tmp_path / "out"
    for first in (10, 20, 30, 40, 50):
        land(folder, first, 3)
    (tmp_path / "l" / "_00000000000000000060-x.parquet").write_bytes(b"part")
    assert run(spark, folder, tmp_path / "ck", out) >= 2  # three batches of two files at most
    for name in sorted(os.listdir(folder))[:3]:
        os.remove(f"{folder}/{name}")
    land(folder, 60, 4)
    run(spark, folder, tmp_path / "ck", out)
    rows = spark.read.parquet(str(out))
    assert sorted(r.arrival for r in rows.collect()) == [a + i for a in (10, 20, 30, 40, 50) for i in range(3)] + [60, 61, 62, 63]
    one = rows.where("arrival = 61").first()
    assert bytes(one.payload) == b"payload 1" and one.received_at.replace(tzinfo=dt.UTC) == BASE + dt.timedelta(seconds=1)


def test_batch_read(source, tmp_path):
    spark = source
    read = lambda: spark.read.format("landed").option("path", str(tmp_path / "l")).load()
    assert read().count() == 0
    land(str(tmp_path / "l"), 0, 5)
    land(str(tmp_path / "l"), 7, 2)
    assert read().count() == 7 and read().columns == ["exporter", "received_at", "arrival", "payload"]


@pytest.fixture
def store(source, tmp_path):
    sink = sql.SqlSink(f"sqlite:{tmp_path}/flows.db")
    sink.migrate()
    sink.migrate()
    sink.ping()
    return sink


def held(sink, table="flows", what="count(*)"):
    con = sql.connect(sink.url)
    try:
        return con.execute(f"SELECT {what} FROM {table}").fetchone()[0]
    finally:
        con.close()


def test_relational_store(spark, store):
    """Keyed rows once, whatever batch brings them; rows without a key once a batch; a batch that comes again changes nothing."""
    write = lambda b, *a: store.write_batch(b, *a)
    assert [write(batch(spark, 10), 1), write(batch(spark, 10), 1), write(batch(spark, 15), 2)] == [10, 10, 5]
    loose = batch(spark, 4, keyed=False)
    assert [write(loose, 3, "s"), write(loose, 3, "s"), write(loose, 4, "s"), write(batch(spark, 0), 5)] == [4, 4, 4, 0]
    assert held(store) == 23 and held(store, "staged_flows") == 0
    twice = frame(spark, [record(50), record(50), record(51)])
    assert write(twice.repartition(3), 6) == 2
    con = sql.connect(store.url)
    got = con.execute("SELECT received_at, src_addr, bytes, next_hop FROM flows WHERE src_as = 4200000002 AND dedup_key IS NOT NULL").fetchall()
    want = dict(zip(sql.DECODED, record(2), strict=True))
    assert got == [((want["received_at"] - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1), want["src_addr"], want["bytes"], want["next_hop"])]
    con.close()


def test_a_failed_task_leaves_nothing(spark, store):
    from pyspark.sql import functions as F

    rows = batch(spark, 40, keyed=False).repartition(4)
    bad = rows.withColumn("src_as", F.when(F.col("src_as") == FIRST_AS + 17, F.raise_error(F.lit("broken row")).cast("bigint")).otherwise(F.col("src_as")))
    with pytest.raises(Exception, match="broken row"):
        store.write_batch(bad, 1)
    # a task that outlives the failure may stage rows after it; they go with the next run of the source
    assert held(store) == held(store, "batches") == 0
    # a run whose driver died between its tasks and the transaction: what it staged isn't taken, and goes with the next run of the source
    con = sql.connect(store.url)
    con.execute("INSERT INTO staged_flows (source, run, task, src_as) VALUES ('direct', 'dead run', 'task', 7)")
    con.close()
    assert store.write_batch(rows, 1) == 40 and held(store) == 40 and held(store, "staged_flows") == 0 and held(store, what="min(src_as)") == FIRST_AS


def test_collector_over_udp(source, tmp_path):
    """cli.run: datagrams over a socket into the table and the relational store, at most once each."""
    import socket
    import threading
    import time

    from tidewell import cli, config
    from tidewell.obs import Metrics

    from .test_decoding import REC_A, REC_B, data_set, template_set, v5, v9

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    env = {"SOURCES": "udp", "SINKS": "table,sql", "UDP_ADDR": f"127.0.0.1:{port}", "LANDING_PATH": f"{tmp_path}/l", "TABLE_PATH": f"{tmp_path}/t", "SQL_URL": f"sqlite:{tmp_path}/f.db", "CHECKPOINT_PATH": f"{tmp_path}/ck", "BATCH_SECONDS": "0.3", "TEMPLATE_PATH": f"{tmp_path}/templates", "DELIVERY": "at_most_once"}
    settings = config.load({config.PREFIX + k: v for k, v in env.items()}, tmp_path)
    metrics, stop = Metrics(), threading.Event()
    runner = threading.Thread(target=lambda: cli.run(settings, source, stop, metrics))
    runner.start()
    try:
        until = time.time() + 90
        sent = False
        sink = sql.SqlSink(settings.sql_url)
        while time.time() < until:
            time.sleep(0.5)
            if not sent and os.path.isdir(f"{tmp_path}/l"):
                time.sleep(1)
                with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                    for payload in (v5(REC_A, REC_B), v9(template_set()), v9(data_set()), b"junk"):
                        s.sendto(payload, ("127.0.0.1", port))
                sent = True
            if sent and held(sink) >= 3 and metrics.value("decode_errors", source="udp") >= 1:
                break
    finally:
        stop.set()
        runner.join(60)
    assert not runner.is_alive() and held(sink) == 3 and metrics.value("decode_errors", source="udp") == 1
    from tidewell.sinks.table import FlowTable

    assert sorted(r.flow_type for r in FlowTable(source, f"{tmp_path}/t").read().collect()) == ["netflow5", "netflow5", "netflow9"]
