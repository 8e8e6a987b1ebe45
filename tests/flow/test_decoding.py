"""Datagrams, templates, clocks, addresses, digests and messages against hand-made cases and plain versions."""

import datetime as dt
import hashlib
import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import network as N
from tidewell.schema import u64
from tidewell.sources import datagrams, elements, templated, templates, wire

from .records import A, BASE, batch

UPTIME, UNIX = 86_500, int(BASE.timestamp())
REC_A = ("172.30.4.77", "10.99.7.3", "172.20.0.1", 21, 22, 5, 3100, 4000, 7250, 40999, 8443, 18, 6, 65010, 65020)
REC_B = ("172.30.9.1", "172.30.9.2", "0.0.0.0", 0, 0, 2, 130, 6000, 6000, 123, 123, 0, 17, 0, 0)


def packed(ip):
    return N.parse_ip(ip)[12:]


def v5(*records, sampling=0, count=None):
    head = struct.pack("!HHIIIIBBH", 5, len(records) if count is None else count, UPTIME, UNIX, 0, 1, 0, 0, sampling)
    body = b"".join(packed(r[0]) + packed(r[1]) + packed(r[2]) + struct.pack("!HHIIIIHHBBBBHHBBH", *r[3:11], 0, r[11], r[12], 0, r[13], r[14], 0, 0, 0) for r in records)
    return head + body


def landed(spark, *payloads):
    rows = [(N.parse_ip(A), BASE, i, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, datagrams.DATAGRAM_DDL)


def at(ms):
    return dt.datetime.fromtimestamp(UNIX + (ms - UPTIME) / 1000, dt.UTC).replace(tzinfo=None)


def check(r, rec, sampling=1):
    assert [N.show_ip(r[c]) for c in ("src_addr", "dst_addr")] == list(rec[:2])
    assert (None if r.next_hop is None else N.show_ip(r.next_hop)) == (rec[2] if rec[2] != "0.0.0.0" else None)
    assert (r.input_iface, r.output_iface, r.packets, r.bytes) == rec[3:7] and (r.first_switched, r.last_switched) == (at(rec[7]), at(rec[8]))
    assert (r.src_port, r.dst_port, r.tcp_flags, r.protocol, r.src_as, r.dst_as) == rec[9:15] and r.sampling_rate == sampling


def test_v5(spark):
    rows = datagrams.decode_v5(landed(spark, v5(REC_A, REC_B, sampling=0x4000 | 100), v5(REC_B) + b"tail", v5())).orderBy("arrival", "record_no").collect()
    assert len(rows) == 3
    check(rows[0], REC_A, 100)
    check(rows[1], REC_B, 100)
    check(rows[2], REC_B, 1)


def test_v5_faults(spark):
    bad = datagrams.undecodable(landed(spark, v5(REC_A)[:16], v5(REC_A, count=2), b"\x05", b"", b"\x00\x07" + b"x" * 50, v5(REC_A))).orderBy("arrival").collect()
    assert [r.reason for r in bad] == ["short header", "fewer records than announced", "short datagram", "short datagram", "unknown version"]


FIELDS = [(4, 1), (6, 1), (11, 2), (7, 2), (12, 4), (8, 4), (21, 4), (22, 4), (2, 4), (1, 4), (17, 4), (16, 4), (14, 4), (10, 4)]


def template_set(number=256, fields=FIELDS):
    body = struct.pack("!HH", number, len(fields)) + b"".join(struct.pack("!HH", *f) for f in fields)
    return struct.pack("!HH", 0, 4 + len(body)) + body


def data_set(r=REC_A, number=256):
    body = struct.pack("!BBHH", r[12], r[11], r[10], r[9]) + packed(r[1]) + packed(r[0]) + struct.pack("!8I", r[8], r[7], r[5], r[6], r[14], r[13], r[4], r[3])
    return struct.pack("!HH", number, 4 + len(body)) + body


def v9(*sets):
    return struct.pack("!HHIIII", 9, len(sets), UPTIME, UNIX, 1, 100) + b"".join(sets)


def test_v9_needs_its_template(spark):
    good, bad = templated.decode_templated(landed(spark, v9(data_set()), v9(template_set()), v9(data_set()), v9(template_set(), data_set(), data_set(number=300)), v9(data_set())[:30]))
    rows = good.collect()
    assert [r.arrival for r in rows] == [2]
    check(rows[0], REC_A[:2] + ("0.0.0.0",) + REC_A[3:])
    assert sorted((r.arrival, r.reason) for r in bad.collect()) == [(0, "unknown template"), (3, "unknown template"), (4, "set is cut off")]


def test_templates_carry_over_buckets_and_latest_wins(spark, monkeypatch):
    monkeypatch.setattr(templated, "BUCKET", 2)
    swapped = [*FIELDS[:4], (8, 4), (12, 4), *FIELDS[6:]]
    good, bad = templated.decode_templated(landed(spark, v9(template_set()), *[v9(data_set())] * 4, v9(data_set(), template_set(fields=swapped), data_set()), v9(data_set())))
    rows = good.orderBy("arrival", "set_no").collect()
    assert [N.show_ip(r.src_addr) for r in rows] == [REC_A[0]] * 5 + [REC_A[1]] * 2 and bad.count() == 0
    known = spark.createDataFrame([(N.parse_ip(A), 9, 100, 256, json.dumps([[e, n, 0] for e, n in FIELDS]))], "exporter binary, version int, domain bigint, template_id int, fields string")
    assert templated.decode_templated(landed(spark, v9(data_set())), known)[0].count() == 1


def test_sets_of_whole_batches_equal_sets_one_by_one(spark):
    """Datagrams of data sets only, with templates among them, with other sets, cut off anywhere, and of version 10."""
    other = struct.pack("!HH", 1, 8) + b"none"
    ten = lambda *sets, more=0: struct.pack("!HHIII", 10, 16 + sum(map(len, sets)) + more, UNIX, 1, 7) + b"".join(sets)
    whole = [v9(data_set()), v9(data_set(REC_B), other, data_set()), v9(template_set(), data_set()), v9(), v9(data_set(), b"\0\0"), ten(data_set()), ten(data_set(), data_set(REC_B)), ten(data_set(), more=1), ten(struct.pack("!HH", 3, 3))]
    payloads = whole + [p[:n] for p in (whole[0], whole[1], whole[5]) for n in range(1, len(p), 5)] + [ten(data_set()) + b"behind"]
    want = []
    for i, p in enumerate(payloads):
        try:
            packet = elements.parse(p)
            want += [(i, n, packet.version, packet.domain, packet.boot, t, None if kind == "template" else c, None) for n, (kind, t, c) in enumerate(packet.sets)]
        except elements.Malformed as e:
            want.append((i, 0, None, None, None, None, None, str(e)))
    got = templated.sets_of(landed(spark, *payloads).coalesce(1)).collect()
    assert sorted(((r.arrival, r.set_no, r.version, r.domain, r.boot, r.template_id, None if r.content is None else bytes(r.content), r.fault) for r in got), key=str) == sorted((w for w in want if len(payloads[w[0]]) > 1), key=str)


def test_fixed_templates_equal_records_one_by_one(spark):
    """Fields of every kind, repeated ones, odd widths and padding: whole batches against flow() of each record."""
    fields = [(8, 4), (27, 16), (12, 4), (15, 4), (62, 16), (34, 4), (305, 4), (1, 8), (2, 3), (4, 2), (7, 2), (7, 2), (154, 8), (151, 4), (22, 4), (90, 5), (16, 4), (11, 1)]
    width, body = sum(n for _, n in fields), b""
    for i in range(7):
        body += bytes((i * 37 + k * 11) % 251 for k in range(width)) if i else b"\0" * width
    sets = struct.pack("!HH", 300, 4 + len(body) + 3) + body + b"\0\0\0"
    good, bad = templated.decode_templated(landed(spark, v9(template_set(300, fields)), v9(sets)))
    want = [elements.flow(v, (UNIX * 1000 - UPTIME) * 1000) for v in elements.records(body, [(e, n, 0) for e, n in fields])]
    rows = good.withColumns({c: F.unix_micros(c) for c in ("first_switched", "last_switched")}).orderBy("record_no").collect()
    assert len(rows) == 7 and bad.count() == 0
    for r, w in zip(rows, want):
        assert all((bytes(r[c]) if isinstance(r[c], bytearray) else r[c]) == v for c, v in w.items()), w


def test_ipfix_variable_length_enterprise_and_clocks():
    ntp = struct.pack("!II", UNIX + N.NTP_OFFSET, 1 << 30)
    fields = [(8, 4, 0), (12, 4, 0), (154, 8, 0), (153, 8, 0), (90, elements.VARIABLE, 0), (1, 4, 29305), (1, 8, 0), (34, 4, 0), (305, 4, 0)]
    raw = packed(REC_A[0]) + packed(REC_A[1]) + ntp + struct.pack("!Q", UNIX * 1000 + 7) + b"\x03abc" + b"\0\0\0\x09" + b"\xff" * 8 + struct.pack("!II", 50, 0)
    (values,) = elements.records(raw, fields)
    f = elements.flow(values, 0)
    assert f["first_switched"] == UNIX * 1_000_000 + 250_000 and f["last_switched"] == UNIX * 1_000_000 + 7000
    assert f["bytes"] == -1 and f["sampling_rate"] == 50 and f["next_hop"] is None
    assert elements.flow([(150, 0, struct.pack("!I", 5))], 0)["last_switched"] == 5_000_000


def test_template_keys():
    assert templates.parse_key("2001:db8::1/10/7/300") == ("2001:db8::1", 10, 7, 300)
    assert templates.template_key("2001:db8::1", 10, 7, 300) == "2001:db8::1/10/7/300"
    for key in ("", "a/b", "nope/9/0/256", "1.2.3.4/x/0/256", "1.2.3.4/9/0/70000"):
        with pytest.raises(ValueError):
            templates.parse_key(key)


def test_template_table(spark):
    rows = [("192.0.2.1", 9, 100, 256, "template", "[[8,4,0]]"), ("192.0.2.1", 9, 100, 256, "template", "[[12,4,0]]"), ("::1", 10, 4_000_000_000, 300, "odd", "[]")]
    df = spark.createDataFrame(rows, "exporter_text string, version int, domain bigint, template_id int, kind string, fields string").coalesce(1)
    sent = templates.envelope(df).withColumn("n", F.monotonically_increasing_id())
    got = templates.opened(templates.with_key_parts(templates.latest(sent, "n"))).collect()
    assert [(r.exporter_text, r.version, r.domain, r.template_id, r.fields) for r in got] == [("192.0.2.1", 9, 100, 256, "[[12,4,0]]")]
    assert templates.latest(sent.unionByName(spark.createDataFrame([("192.0.2.1/9/100/256", None, 1 << 40)], "key string, value string, n long")), "n").count() == 1


def test_column_functions_equal_plain_ones(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.randbytes(16), rng.randbytes(8), rng.randint(-(10**15), 10**15), rng.randrange(1 << 16), rng.randrange(256), rng.randbytes(rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a binary, n binary, t long, p int, q int, b binary")
    c = F.col
    out = df.select(
        N.exporter_id(c("a")).alias("id"), N.ntp64_micros(c("n")).alias("ntp"), N.natural_key(c("a"), c("t"), c("a"), c("a"), c("p"), c("p"), c("q")).alias("key"), N.be_uint(c("b")).alias("be"),
        N.be_bytes(c("t"), 5).alias("five"), u64(N.be_uint(c("n"))).alias("wide"), N.narrow(c("t"), 14).alias("low"), N.corrected(N.be_uint(c("n")), c("p").cast("bigint")).alias("est"),
    ).collect()
    for (a, n, t, p, q, b), r in zip(rows, out):
        h = 0xCBF29CE484222325
        for x in a:
            h = (h ^ x) * 1099511628211 % (1 << 64)
        assert r.id == (h % (1 << 63) or 1)
        hi, lo = struct.unpack("!II", n)
        assert r.ntp == (hi - 2_208_988_800) * 10**6 + lo * 10**6 // 2**32
        assert r.key == hashlib.sha256(a + struct.pack("!q", t) + a + a + struct.pack("!HHB", p, p, q)).digest()[:16]
        assert r.be % (1 << 64) == int.from_bytes(b[-8:]) and r.five == (t % (1 << 40)).to_bytes(5) and r.low == t % (1 << 14)
        assert r.wide == int.from_bytes(n) and r.est == int.from_bytes(n) * p


@given(st.ip_addresses())
@settings(max_examples=200)
def test_addresses_round_trip(a):
    raw = N.parse_ip(str(a))
    assert len(raw) == 16 and N.parse_ip(N.show_ip(raw)) == raw


@pytest.mark.parametrize("text", ["", "1.2.3", "01.2.3.4", "::1%eth0", "x"])
def test_bad_addresses(text):
    with pytest.raises(ValueError):
        N.parse_ip(text)


def test_addresses_in_columns(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("::ffff:10.0.0.1",), ("2001:DB8::1",), ("nope",), (None,)], "t string").withColumn("b", N.ip_bytes("t"))
    assert [tuple(r) for r in df.select(N.ip_text("b"), N.ipv4_text(F.col("b"))).collect()] == [("10.0.0.1", "10.0.0.1")] * 2 + [("2001:db8::1", None), (None, None), (None, None)]


MESSAGE = {
    "format": "any", "exporter_addr": "192.0.2.9", "flow_type": "ipfix", "received_at": "2026-03-04T12:00:00.123456789Z", "first_switched": "2026-03-04T11:59:58Z", "last_switched": "2026-03-04T13:59:59.5+02:00",
    "src_addr": "203.0.113.1", "dst_addr": "2001:db8::1", "src_port": 1, "dst_port": 65535, "protocol": 6, "tcp_flags": 255, "packets": 2**64 - 1, "bytes": 5, "sampling_rate": 0,
    "input_iface": 2**32 - 1, "output_iface": 0, "src_as": 1, "dst_as": 2, "next_hop": None, "later_field": {"x": 1},
}


def decode(spark, *bodies, timestamp=BASE):
    rows = [(b if isinstance(b, str) or b is None else json.dumps(b), timestamp) for b in bodies]
    return wire.decoded(spark.createDataFrame(rows, "value string, timestamp timestamp")).collect()


def test_messages(spark):
    full, missing, none = decode(spark, MESSAGE, {k: v for k, v in MESSAGE.items() if k != "received_at"}, MESSAGE | {"next_hop": "10.0.0.1"})
    assert full.reason is missing.reason is none.reason is None
    assert full.received_at == dt.datetime(2026, 3, 4, 12, 0, 0, 123456) and full.last_switched == dt.datetime(2026, 3, 4, 11, 59, 59, 500000)
    assert full.packets == -1 and full.sampling_rate == 1 and full.input_iface == 2**32 - 1 and full.next_hop is None and len(full.dedup_key) == 16
    assert missing.received_at == BASE.replace(tzinfo=None) and N.show_ip(none.next_hop) == "10.0.0.1" and full.dedup_key == none.dedup_key


@pytest.mark.parametrize("change, reason", [
    ("not json", "not a message"), (None, "not a message"), ({"exporter_addr": None}, "no exporter"), ({"flow_type": "sflow"}, "no such flow type"), ({"src_addr": ""}, "no source or destination"),
    ({"src_port": 70000}, "malformed field"), ({"dst_addr": "1.2.3"}, "malformed field"), ({"first_switched": None}, "no first or last time"), ({"last_switched": "soon"}, "malformed field"), ({"packets": -1}, "malformed field"), ({"protocol": "tcp"}, "not a message"),
])
def test_rejected_messages(spark, change, reason):
    (r,) = decode(spark, MESSAGE | change if isinstance(change, dict) else change)
    assert r.reason == reason


def test_no_time_anywhere(spark):
    (r,) = decode(spark, {k: v for k, v in MESSAGE.items() if k != "received_at"}, timestamp=None)
    assert r.reason == "no time of receipt"


def test_message_round_trip(spark):
    rows = batch(spark, 9)
    sent = wire.encoded(rows)
    assert json.loads(sent.first().value)["format"] == wire.FORMAT and sum('"next_hop":null' in r.value for r in sent.collect()) == rows.where("next_hop is null").count() > 0
    drop = lambda df: sorted(map(str, df.drop("dedup_key").collect()))
    assert drop(wire.good(sent)) == drop(rows) and wire.quarantined(sent).count() == 0
