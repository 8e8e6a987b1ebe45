"""Alert expressions against plain versions: rates of counters that are reset, quantiles from buckets, alerts that last."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import alerts, dedup, stats

START = dt.datetime(2026, 3, 4, 10, 0, tzinfo=dt.UTC)


def plain_rate(samples, end, seconds, carry_on):
    """samples: (seconds since START, value) of one series, in order."""
    own = [(t, v) for t, v in samples if end - seconds <= t < end]
    if len(own) < 2:
        return None
    rose = sum(b - a if b >= a else b for (_, a), (_, b) in zip(own, own[1:], strict=False))
    first, last = own[0][0], own[-1][0]
    spanned = last - first
    if not carry_on or not spanned:
        return rose
    mean = spanned / (len(own) - 1)
    edge = lambda away: away if away < mean * 1.1 else mean / 2
    before = edge(first - (end - seconds))
    if rose > 0 and own[0][1] >= 0:
        before = min(before, spanned * own[0][1] / rose)
    return rose * (spanned + before + edge(end - last)) / spanned


@pytest.mark.parametrize(("seconds", "step", "carry_on"), [(300, 300, True), (300, 60, True), (300, 100, False), (60, 60, False)])
def test_counter_rate(spark, seconds, step, carry_on):
    rng, rows, series = random.Random(seconds + step), [], {}
    for sink in ("a", "b", None):
        value, t = 0, rng.uniform(0, 500)
        while t < 3000:
            value = rng.randrange(5) if rng.random() < 0.1 else value + rng.randrange(20)
            series.setdefault(sink, []).append((round(t, 3), value))
            t += rng.choice([5, 15, 40, 700])
        rows += [(sink, START + dt.timedelta(seconds=t), float(v)) for t, v in series[sink]]
    rng.shuffle(rows)
    rows += [("a", None, 1.0), ("b", START, None)]
    got = {(r.sink, (r.window_end.replace(tzinfo=dt.UTC) - START).total_seconds()): r for r in alerts.counter_rate(spark.createDataFrame(rows, "sink string, at timestamp, value double"), ["sink"], seconds, step, carry_on=carry_on).collect()}
    want = {}
    for sink, samples in series.items():
        for end in range(0, 4001, step):
            found = plain_rate(samples, end, seconds, carry_on)
            if found is not None:
                want[sink, float(end)] = found
    assert got.keys() == want.keys() and len(want) > 5
    for key, rose in want.items():
        assert got[key].increase == pytest.approx(rose) and got[key].per_second == pytest.approx(rose / seconds)


def test_counter_rate_of_little(spark):
    frame = lambda *rows: spark.createDataFrame([(START + dt.timedelta(seconds=t), float(v)) for t, v in rows], "at timestamp, value double")
    assert alerts.counter_rate(frame((1, 5)), [], 60).collect() == [] and alerts.counter_rate(frame(), [], 60).collect() == []
    assert [r.increase for r in alerts.counter_rate(frame((1, 5), (1, 7)), [], 60).collect()] == [2.0]  # two samples of one moment
    before = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59, s, tzinfo=dt.UTC), float(s)) for s in (10, 20, 50)], "at timestamp, value double")
    assert [(r.window_end.year, r.increase) for r in alerts.counter_rate(before, [], 60, carry_on=False).collect()] == [(1970, 40.0)]
    with pytest.raises(ValueError, match="multiple"):
        alerts.counter_rate(frame(), [], 60, 7)


def plain_quantile(q, buckets):
    buckets = sorted(buckets)
    high, own = 0.0, []
    for le, n in buckets:
        high = max(high, n)
        own.append((le, high))
    if not own or own[-1][0] != math.inf or not high:
        return None
    if not 0 <= q <= 1:
        return math.copysign(math.inf, q - 0.5)
    i = next(i for i, (_, n) in enumerate(own) if n >= q * high)
    le, n = own[i]
    if le == math.inf:
        return own[i - 1][0] if i else None
    start = own[i - 1][0] if i else min(0.0, le)
    under = own[i - 1][1] if i else 0.0
    return le if n == under or start == le else start + (le - start) * (q * high - under) / (n - under)


@pytest.mark.parametrize("q", [0, 0.25, 0.5, 0.95, 1, -0.1, 1.5])
def test_histogram_quantile(spark, q):
    rng, rows = random.Random(int(q * 100)), []
    for g in range(12):
        n = 0
        for le in [-1.0, 0.5, 1.0, 2.5, 10.0][g % 3 :]:
            n += rng.choice([0, 0, 3, 10])
            rows.append((g, le, float(n)))
        rows.append((g, None if g % 2 else math.inf, float(n + rng.choice([0, 4]))))
    rows += [(20, 1.0, 5.0), (21, None, 0.0), (21, 1.0, 0.0), (22, 1.0, 9.0), (22, 2.0, 7.0), (22, None, 10.0), (23, None, 3.0)]  # no last bucket, nothing, falling counts, only the last
    got = {r.g: r.quantile for r in alerts.histogram_quantile(spark.createDataFrame(rows, "g int, le double, n double"), q, ["g"]).collect()}
    for g in got:
        want = plain_quantile(q, [(math.inf if le is None else le, n) for h, le, n in rows if h == g])
        assert got[g] == (want if want is None else pytest.approx(want)), g


def test_histograms_and_sketches(spark):
    values = spark.range(10_000).selectExpr("id % 4 as g", "id / 100.0d as v")
    one = {(r.g, r.le): r.n for r in stats.histograms(values, values.v, (10, 50), ["g"]).collect()}
    assert one[0, 10.0] == 251 and one[3, 50.0] == 1250 and one[2, None] == 2500
    found = stats.merged_quantile(values.groupBy("g").agg(stats.sketched(values.v).alias("s")), "s", 0.95).first()["quantile"]
    assert abs(found - 95) < 2


def test_firing(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [("a", at(m), 0.6) for m in range(12)] + [("b", at(m), 0.6 if m != 5 else 0.4) for m in range(12)] + [("c", at(2 * m), 9.0) for m in range(9)]
    got = alerts.firing(spark.createDataFrame(rows, "sink string, window_end timestamp, quantile double"), ["sink"], 0.5, 600, 60).collect()
    assert [(r.sink, r.since.replace(tzinfo=dt.UTC), r.until.replace(tzinfo=dt.UTC)) for r in got] == [("a", at(0), at(11))]


def test_collapsed(spark):
    rows = [(START, k, v, n) for n, (k, v) in enumerate([(b"12345678a", 1), (b"12345678b", 2), (b"12345678b", 0), (b"short", 5), (b"short\0", 4), (None, 1), (None, 1), (b"", 3)])]
    df = spark.createDataFrame(rows, "received_at timestamp, dedup_key binary, v int, n int")
    assert sorted(r.n for r in dedup.collapsed(df, "v").collect()) == [1, 3, 5, 6, 7]
    assert [r[0] for r in spark.createDataFrame([(b"\x01\x02",), (b"\xff" * 9,)], "k binary").select(dedup.key_seq(F.col("k"))).collect()] == [513, -1]
