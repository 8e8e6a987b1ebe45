"""How often, and in how many parts, inputs are gone over."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.functions import network as N
from tidewell.operators import dedup
from tidewell.plans import registry
from tidewell.plans.flows_view import flows
from tidewell.sinks import messages, sql
from tidewell.sinks.table import FlowTable
from tidewell.sources import bus, templated, wire
from tidewell.sources.datagrams import DATAGRAM_DDL
from tidewell.streaming import templated as streamed

from .records import batch
from .test_decoding import data_set, landed, template_set, v9

SF = "/root/testdata/sf0.001"


def counted(df):
    """The same rows, and a counter of those that were computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_datagrams_are_parsed_once(spark):
    datagrams, seen = counted(landed(spark, v9(template_set()), *[v9(data_set())] * 5, v9(data_set(number=300))))
    good, bad = templated.decode_templated(datagrams)
    assert (good.count(), bad.count()) == (5, 1) and len(good.collect()) == 5
    assert seen.value == 7


def test_streamed_datagrams_are_parsed_once(spark, tmp_path):
    """Also where some are malformed or of unknown template: faults don't take a second reading."""
    landed(spark, v9(template_set()), *[v9(data_set())] * 5, v9(data_set(number=300)), v9(data_set())[:-3]).write.parquet(f"{tmp_path}/in")
    datagrams, seen = counted(bus.folder_stream(spark, f"{tmp_path}/in", schema=DATAGRAM_DDL))
    streamed.decode_stream(datagrams).writeStream.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out", "parquet").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.where("reason is null").count() == 5 and sorted(r.reason for r in found.where("reason is not null").collect()) == ["set is cut off", "unknown template"]
    assert seen.value == 8


def test_the_stream_query_does_not_shuffle_its_records(spark):
    plan = plan_of(registry.v9_stream(spark, SF))
    assert "Aggregate" not in plan and "Deduplicate" not in plan


def test_a_batch_is_computed_once_for_the_table(spark, tmp_path):
    table = FlowTable(spark, str(tmp_path / "t"))
    table.migrate()
    keyed, loose = batch(spark, 30), batch(spark, 7, keyed=False, first=30)
    rows, seen = counted(keyed.unionByName(loose))
    assert table.write_batch(rows, 0) == 37 and seen.value == 37
    assert not spark._jsc.sc().getPersistentRDDs().size()


def test_a_filter_does_not_pack_anew(spark):
    packed = registry._packed_templates(registry._binary(flows(spark, SF)), 256)
    filters = [line for line in plan_of(packed.where(F.length("payload") > 100)).splitlines() if "Filter" in line]
    assert any("payload" in line for line in filters) and not any("lpad" in line for line in filters)


def test_a_good_message_is_decoded_once_for_deduplication(spark):
    sent = wire.encoded(batch(spark, 20))
    good = wire.good(sent.unionByName(sent)).withColumn("n", F.lit(1))
    once = dedup.first_of_each(good, "n")
    assert once.count() == 20 and plan_of(once).count("from_json") == 1


def test_message_files_can_be_dealt_by_row_groups(spark, tmp_path):
    rows = batch(spark, 100).coalesce(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(1000)))).withColumn("bytes", F.col("k").cast("bigint")).drop("k")
    messages.MessageFolder(str(tmp_path)).write_batch(rows, 0)
    groups = [pq.ParquetFile(p).num_row_groups for p in tmp_path.rglob("*.parquet")]
    assert len(groups) == 1 and groups[0] > 1


@pytest.mark.parametrize("text", ["1.2.3.4", "255.0.10.99", "256.1.1.1", "1.2.3", "1.2.3.4.", "1.2.3.4\n", "01.2.3.4", " 1.2.3.4", "1.2.3.4.5", "", "::1", "0.0.0.0", None])
def test_ipv4_text(spark, text):
    try:
        want = N.parse_ip(text) if text and ":" not in text and text == text.strip() else None
    except ValueError:
        want = None
    assert spark.createDataFrame([(text,)], "t string").select(N.ipv4_bytes(F.col("t"))).first()[0] == want


def test_the_relational_store_takes_rows_in_the_order_of_its_index(spark, tmp_path):
    store = sql.SqlSink(f"sqlite:{tmp_path}/flows.db")
    store.migrate()
    rows, seen = counted(batch(spark, 60).orderBy(F.rand(3)).repartition(5))
    assert store.write_batch(rows, 1) == 60
    con = sql.connect(store.url)
    got = [r[0] for r in con.execute("SELECT received_at FROM flows ORDER BY seq")]
    con.close()
    assert got == sorted(got)
    before = seen.value
    assert store.write_batch(rows, 1) == 60 and seen.value == before, "a batch that is noted isn't staged again"
