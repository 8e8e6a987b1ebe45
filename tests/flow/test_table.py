"""The storage contract: what is written is read, once, in order, page by page."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.functions.network import parse_ip
from tidewell.plans import query as Q
from tidewell.schema import DECODED
from tidewell.sinks import snapshots
from tidewell.sinks import table as table_module
from tidewell.sinks.snapshots import Snapshots
from tidewell.sinks.table import FlowTable

from .records import A, B, BASE, WINDOW, batch, frame, number, record, us


@pytest.fixture
def table(spark, tmp_path):
    t = FlowTable(spark, str(tmp_path / "table"))
    t.migrate()
    t.migrate()
    t.ping()
    return t


def stored(t, **more):
    return [r for p in Q.pages(t.read(), Q.FlowQuery(**WINDOW, **more)) for r in p.rows]


def test_round_trip(spark, table):
    assert table.write_batch(batch(spark, 7), 1) == 7
    got = sorted(tuple(bytes(v) if isinstance(v, bytearray) else v.replace(tzinfo=dt.UTC) if isinstance(v, dt.datetime) else v for v in (r[c] for c in DECODED)) for r in stored(table))
    assert got == sorted(record(i) for i in range(7))


def test_keyed_rows_are_stored_once(spark, table):
    assert [table.write_batch(batch(spark, 10), 1), table.write_batch(batch(spark, 10), 2), table.write_batch(batch(spark, 20), 3)] == [10, 0, 10]
    assert len(stored(table)) == 20


def test_rows_without_key_double_but_not_on_replay(spark, table):
    for batch_id in (1, 2, 2, 1):
        table.write_batch(batch(spark, 10, keyed=False), batch_id)
    assert len(stored(table)) == 20


def test_duplicates_within_a_batch(spark, table):
    rows = [record(1), record(1), record(2, keyed=False), record(2, keyed=False)]
    assert table.write_batch(frame(spark, rows), 5) == 3


def test_replay_keeps_seq(spark, table):
    table.write_batch(batch(spark, 30, keyed=False), 4)
    before = {number(r): r.seq for r in stored(table)}
    table.write_batch(batch(spark, 30, keyed=False).repartition(7), 4)
    assert {number(r): r.seq for r in stored(table)} == before
    assert len(set(before.values())) == 30 and min(before.values()) > 0


def test_pages(spark, table):
    table.write_batch(batch(spark, 25), 1)
    got = list(Q.pages(table.read(), Q.FlowQuery(**WINDOW, limit=10)))
    assert [(len(p.rows), p.has_more) for p in got] == [(10, True), (10, True), (5, False)]
    keys = [(r.received_at, r.seq) for p in got for r in p.rows]
    assert keys == sorted(set(keys), reverse=True) and got[-1].next_cursor is None


def test_pages_of_ties(spark, table):
    table.write_batch(frame(spark, [record(i, at=BASE, keyed=False) for i in range(25)]), 1)
    keys = [r.seq for p in Q.pages(table.read(), Q.FlowQuery(**WINDOW, limit=4)) for r in p.rows]
    assert len(keys) == 25 and keys == sorted(set(keys), reverse=True)


def test_half_open(spark, table):
    one = dt.timedelta(microseconds=1)
    start, end = BASE, BASE + dt.timedelta(minutes=1)
    table.write_batch(frame(spark, [record(i, at=t) for i, t in enumerate((start - one, start, end - one, end))]), 1)
    page = table.query(Q.FlowQuery(us(start), us(end)))
    assert [number(r) for r in page.rows] == [2, 1]
    assert table.query(Q.FlowQuery(us(end), us(start))).rows == []
    with pytest.raises(ValueError):
        Q.FlowQuery(None, 1)


def test_filters(spark, table):
    rows = [record(i) for i in range(40)] + [record(41, exporter=B)]
    table.write_batch(frame(spark, rows), 1)
    id_b = next(e.id for e in table.list_exporters() if bytes(e.ip_address) == parse_ip(B))
    n = lambda **f: len(table.query(Q.FlowQuery(**WINDOW, **f)).rows)
    same = lambda name, value: sum(r[DECODED.index(name)] == value for r in rows)
    assert n(exporter_id=id_b) == 1 and n(protocol=0) == 0 and n() == 41
    for name in ("src_addr", "dst_addr", "protocol"):
        for value in sorted({r[DECODED.index(name)] for r in rows})[::8]:
            assert n(**{name: value}) == same(name, value)
    one = dict(zip(DECODED, rows[3], strict=True))
    assert n(src_addr=one["src_addr"], dst_addr=one["dst_addr"], protocol=one["protocol"]) == 1


def test_exporters(spark, table):
    late = BASE + dt.timedelta(minutes=5)
    table.write_batch(frame(spark, [record(0), record(1, exporter=B)]), 1)
    table.write_batch(frame(spark, [record(2, at=late), record(3, at=BASE - dt.timedelta(minutes=1))]), 2)
    found = {bytes(e.ip_address): e for e in table.list_exporters()}
    a = found[parse_ip(A)]
    assert len(found) == 2 and a.first_seen_at == BASE - dt.timedelta(minutes=1) and a.last_seen_at == late
    assert [e.id for e in table.list_exporters()] == sorted(e.id for e in found.values())


def test_empty_and_invalid_batches(spark, table):
    assert table.write_batch(batch(spark, 0), 1) == 0 and table.days() == []
    broken = list(record(1))
    broken[DECODED.index("flow_type")] = "sflow"
    with pytest.raises(ValueError, match="lack"):
        table.write_batch(frame(spark, [tuple(broken)]), 1)


def test_retention_and_compaction(spark, table):
    day = dt.timedelta(days=1)
    for b, shift in enumerate((0, 0, 1, 2)):
        table.write_batch(frame(spark, [record(10 * b + i, at=BASE + shift * day + dt.timedelta(hours=i)) for i in range(4)]), b)
    table.compact(BASE.date())
    everything = Q.FlowQuery(us(BASE) - 10**12, us(BASE) + 10**12)
    assert len(table.query(everything).rows) == 16
    assert table.retain(BASE + day + dt.timedelta(hours=2)) == [BASE.date()]
    assert len(table.query(everything).rows) == 6 and table.retain(BASE - day) == []


def test_sources_keep_their_batches_apart(spark, table):
    """Two streams number their batches from 0; neither overwrites the other, and each may be replayed."""
    for source in ("one", "two", "one"):
        first = 0 if source == "one" else 100
        assert table.write_batch(batch(spark, 10, keyed=False, first=first), 0, source) == 10
    rows = stored(table)
    assert len(rows) == 20 and len({r.seq for r in rows}) == 20
    assert FlowTable(table.spark, table.path).source_number("two") == table.source_number("two") != table.source_number("one")
    # keyed rows of another source are duplicates, the batch's own are not
    assert [table.write_batch(batch(spark, 5, first=200), 7, s) for s in ("one", "one", "two")] == [5, 5, 0]


@pytest.mark.parametrize("step", ["data", "mark"])
def test_a_crash_loses_nothing(spark, table, monkeypatch, step):
    """Merging, folding or a batch stops before its data, or before its mark; what readers see stays as it was."""
    for b in range(3):
        table.write_batch(batch(spark, 5, first=10 * b), b)

    def crash(*_):
        raise RuntimeError("crash")

    for work in (lambda t: t.compact(BASE.date()), lambda t: t.fold_exporters(), lambda t: t.retain(BASE + dt.timedelta(microseconds=12)), lambda t: t.write_batch(batch(spark, 5, first=70, keyed=False), 7)):
        monkeypatch.setattr(Snapshots, "_put" if step == "mark" else "folder", crash)
        with pytest.raises(RuntimeError):
            work(table)
        monkeypatch.undo()
        assert len(stored(table)) == 15 and len(table.list_exporters()) == 1
    again = FlowTable(spark, table.path)
    again.migrate()
    assert again.write_batch(batch(spark, 5, first=70, keyed=False), 7) == 5
    again.compact(BASE.date())
    again.compact(BASE.date())
    again.fold_exporters()
    assert len(stored(again)) == 20 and len(again.list_exporters()) == 1 and again.write_batch(batch(spark, 5), 9) == 0
    again.sweep(0)
    assert len(stored(again)) == 20 and len(again.list_exporters()) == 1
    assert again._names(f"{table.flows_path}/dt={BASE.date()}") == ["source=-1", "source=0"] and [(r.day, r.rows, r.waiting, r.version) for r in again.inspect()] == [(BASE.date(), 20, 1, 1)]


def test_a_crash_between_two_days(spark, table, monkeypatch):
    """A batch over midnight whose first day is marked only: the rest is stored when it comes again, and each row has a seq of its own."""
    rows = [record(i, at=BASE.replace(hour=23, minute=59) + dt.timedelta(seconds=10 * i), keyed=False) for i in range(12)]
    put, calls = Snapshots._put, []

    def second(self, unit, name, text=""):
        if unit.startswith("dt="):
            calls.append(unit)
            if len(calls) == 2:
                raise RuntimeError("crash")
        put(self, unit, name, text)

    monkeypatch.setattr(Snapshots, "_put", second)
    with pytest.raises(RuntimeError):
        table.write_batch(frame(spark, rows), 3)
    monkeypatch.undo()
    assert table.read().count() == 6
    assert [table.write_batch(frame(spark, rows), 3), table.write_batch(frame(spark, rows), 3)] == [12, 12]
    assert table.read().select("seq").distinct().count() == 12 and [r.rows for r in table.inspect()] == [6, 6]


def test_replay_after_merging_changes_nothing(spark, table):
    """The batch comes again when its day is merged, swept, merged again with others, or over two days of which one is merged."""
    table.write_batch(batch(spark, 11, keyed=False), 4, "stream")
    for others in range(3):
        table.compact(BASE.date())
        table.sweep(0)
        assert table.write_batch(batch(spark, 11, keyed=False), 4, "stream") == 11
        assert table.read().where("from_batch = 4").count() == 11
        table.write_batch(batch(spark, 2, first=100 * (others + 1), keyed=False), 5 + others, "stream")
    now = table.flows.at(f"dt={BASE.date()}")
    assert now.held == {0: [[4, 6]]} and list(now.fresh) == [(0, 7)] and table.read().count() == 17
    late = BASE.replace(hour=23, minute=59)
    rows = [record(i, at=late + dt.timedelta(seconds=10 * i), keyed=False) for i in range(12)]
    table.write_batch(frame(spark, rows), 9, "stream")
    table.compact(BASE.date())
    assert table.write_batch(frame(spark, rows), 9, "stream") == 12 and table.read().count() == 29


def test_readers_keep_their_snapshot(spark, table, monkeypatch):
    """At every step of merging and retention, and after them, a reader sees all rows; one that began before goes on."""
    for b in range(3):
        table.write_batch(batch(spark, 5, first=10 * b, keyed=False), b)
    before, seen, put = table.read(), [], Snapshots._put

    def watched(self, unit, name, text=""):
        seen.append(len(stored(table)))
        put(self, unit, name, text)
        seen.append(len(stored(table)))

    monkeypatch.setattr(Snapshots, "_put", watched)
    table.compact(BASE.date())
    table.fold_exporters()
    assert seen == [15] * 4 and before.count() == 15
    after = table.read()
    assert table.retain(BASE + dt.timedelta(microseconds=12)) == [] and seen[4:] == [15, 8]
    assert before.count() == after.count() == 15 and len(stored(table)) == 8
    assert table.retain(BASE + dt.timedelta(days=2)) == [BASE.date()]
    assert before.count() == 15 and stored(table) == [] and table.days() == []
    table.sweep()
    assert after.count() == 15  # the time of grace isn't over
    table.sweep(0)
    assert table.flows.units() == [] and table._names(table.flows_path) == []


def test_a_batch_larger_than_one_numbering(spark, table, monkeypatch):
    """It is stored in slices, once, with keys told apart as ever, and replays know it."""
    monkeypatch.setattr(table_module, "SLICE", 8)
    rows = [record(i % 25, keyed=i % 2 == 0) for i in range(40)]
    wanted = len({(r[0], r[-1]) for r in rows if r[-1]}) + sum(r[-1] is None for r in rows)
    assert [table.write_batch(frame(spark, rows), 1, "big") for _ in range(2)] == [wanted, wanted]
    assert table.read().count() == wanted == table.read().select("seq").distinct().count()


def test_a_table_without_marks_gets_them(spark, table):
    table.write_batch(batch(spark, 5), 0)
    table._fs(table.path)[0].delete(table._fs(f"{table.path}/marks")[1], True)
    spark.createDataFrame([(1,)], "version long").coalesce(1).write.mode("overwrite").json(table.version_path)
    again = FlowTable(spark, table.path)
    again.migrate()
    assert len(stored(again)) == 5 and again.write_batch(batch(spark, 5), 0) == 5 and len(again.list_exporters()) == 1


def test_inspection_is_as_a_scan(spark, table):
    for b, hours in enumerate((0, 30, 1, 31)):
        table.write_batch(batch(spark, 4, first=10 * b, at=BASE + dt.timedelta(hours=hours)), b)
    for step in (lambda: None, lambda: table.compact(BASE.date()), lambda: table.retain(BASE + dt.timedelta(hours=1))):
        step()
        table.spark.catalog.clearCache()
        rows = {r.day: r for r in table.inspect()}
        scan = {r.dt: r for r in table.read().groupBy("dt").agg(F.count("*").alias("n"), F.min(F.unix_micros("received_at")).alias("a"), F.max(F.unix_micros("received_at")).alias("b")).collect()}
        assert {d: (r.rows, r.first, r.last) for d, r in rows.items()} == {d: (r.n, r.a, r.b) for d, r in scan.items()} and len(rows) == 2
        assert all(r.bytes > 1000 for r in rows.values())


def test_ranges():
    assert snapshots.ranges_of([5, 1, 2, 3, 9, 3]) == [[1, 3], [5, 5], [9, 9]]
    assert snapshots.joined([[7, 9], [1, 2], [3, 3], [8, 12]]) == [[1, 3], [7, 12]]


def test_maintenance(spark, table):
    for b in range(3):
        table.write_batch(frame(spark, [record(10 * b + i, at=BASE + dt.timedelta(days=b)) for i in range(3)]), b)
    table.maintain(BASE + dt.timedelta(days=2, hours=5), 1)
    assert [number(r) // 10 for r in table.query(Q.FlowQuery(us(BASE) - 10**12, us(BASE) + 10**12)).rows] == [2, 2, 2]
    assert table.days() == [(BASE + dt.timedelta(days=2)).date()]


def test_the_drivers_zone_plays_no_part(spark, table, monkeypatch):
    import time

    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        late = BASE.replace(hour=23, minute=59)
        rows = [record(i, at=late + dt.timedelta(seconds=10 * i)) for i in range(25)]  # over midnight of UTC
        assert [table.write_batch(frame(spark, rows), b) for b in (1, 2)] == [25, 0]
        got = list(Q.pages(table.read(), Q.FlowQuery(**WINDOW | {"end": us(late) + 10**9}, limit=10)))
        assert [len(p.rows) for p in got] == [10, 10, 5] and got[0].rows[0].received_at == rows[-1][0]
        assert table.list_exporters()[0].last_seen_at == rows[-1][0] and len(table.days()) == 2
    finally:
        monkeypatch.undo()
        time.tzset()


def test_plan_is_pruned_and_bounded(spark, table):
    table.write_batch(batch(spark, 5), 1)
    q = Q.FlowQuery(**WINDOW, protocol=6, cursor=Q.encode_cursor(us(BASE), 99))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = Q.plan(table.read(), q)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "PartitionFilters: [isnotnull(dt" in text and "LessThanOrEqual(received_at" in text and "EqualTo(protocol,6)" in text
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("text", ["", "!!", "e30", "bnVsbA", Q.encode_cursor(1, 2) + "=", Q.encode_cursor(1, -1), Q.encode_cursor(1, 1 << 63)])
def test_bad_cursors(text):
    with pytest.raises(Q.BadCursor):
        Q.decode_cursor(text)


def test_limits():
    assert [Q.clamp(x) for x in (None, 0, -5, 1, 1000, 5000)] == [100, 100, 100, 1, 1000, 1000]
    assert Q.decode_cursor(Q.encode_cursor(1_726_747_200_000_001, 7)) == (1_726_747_200_000_001, 7)
