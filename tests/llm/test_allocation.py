"""Sharding and mixing: against DuckDB, plain apportionment and the contract's bounds."""

import collections
import re

import duckdb
import pytest

from tidewell.llm import mixing, sharding

from .corpus import SCHEMA, empty, rows, table


def check_shards(out, limit):
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for shard, members in by.items():
        total = sum(r.row_bytes for r in members)
        assert {r.shard_bytes for r in members} == {total}
        assert total <= limit or len(members) == 1
    plain = sorted(s for s in by if "." not in s)
    assert not any(b.startswith(a) for a, b in zip(plain, plain[1:]))
    return by


@pytest.mark.parametrize("limit", [300, 5_000, 10**9])
def test_shards_equal_duckdb(spark, limit):
    own = table(spark)
    got = sorted(map(tuple, sharding.extendible_shards(own, limit, carry=["doc_id"]).collect()))
    frame = own.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = sorted(con.execute(sharding.oracle(limit)).fetchall())
    assert got == want
    check_shards(sharding.extendible_shards(own, limit).collect(), limit)


def test_shards_of_copies_and_clashing_names(spark):
    own = [(7, "abcdefghij" * 5, "en", "s", None, "a", "b", "c")] * 90 + [(None, None, *[None] * 6)] * 3 + rows()[:9]
    docs = table(spark, own).withColumnRenamed("size", "shard")
    out = sharding.extendible_shards(docs, 200, prefix="new_")
    assert {"shard", "new_shard"} <= set(out.columns)
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(own)
    R = collections.namedtuple("R", "shard row_bytes shard_bytes")
    by = check_shards([R(r["new_shard"], r["new_row_bytes"], r["new_shard_bytes"]) for r in got], 200)
    assert sum(1 for s in by if "." in s) == 23
    assert sharding.extendible_shards(empty(spark), 200).count() == 0


def test_shards_refuse_clashing_names(spark):
    with pytest.raises(ValueError, match="shard would stand twice"):
        sharding.extendible_shards(table(spark).withColumnRenamed("size", "shard"), 200)


def test_shards_at_every_stride(spark, monkeypatch):
    """However many bits are summed up at a time, and with many rows that weigh nothing."""
    own = table(spark, rows() + [(70_000 + i, None, *[None] * 6) for i in range(300)])
    want = sorted(map(str, sharding.extendible_shards(own, 900).collect()))
    monkeypatch.setattr(sharding, "LEVELS", 1)
    monkeypatch.setattr(sharding, "ZEROS", 3)
    assert sorted(map(str, sharding.extendible_shards(own, 900).collect())) == want


def plain_targets(sizes, weights=(1, 2, 3), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = repeats * sizes[s]
        open_ -= over
        rest = sum(sizes.values()) - sum(target.values())
    return target


def sainte_lague(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        got[max(votes, key=lambda s: votes[s] / (2 * got[s] + 1))] += 1
    return got


def test_mix(spark):
    own = rows(300) + [rows()[0]] * 5 + [(None, "a b c", "en", None, None, "", "", ""), (None, "a b c", "en", None, None, "", "", "")]
    own += [(5000 + i, "tiny text", None, "only", None, None, None, None) for i in range(4)]
    out = mixing.mix(table(spark, own)).collect()
    assert len(out) == len(own)
    sizes = collections.Counter()
    for _, t, _, s, *_ in own:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken = plain_targets(sizes), collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 64, s
    again = mixing.mix(table(spark, own[::-1]).repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    monkeypatch.setattr(mixing, "SHELF", 4)
    out = mixing.mix(table(spark, rows(400))).collect()
    target, taken = {}, collections.Counter()
    for r in out:
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.06)


def test_source_seats_are_the_highest_quotients(spark):
    votes = {0: 1000.0, 1: 12.9, 2: 12.9, 3: 5.0, 4: 0.0, 5: 333.3, 6: 70.0, 7: 12.9}
    df = spark.createDataFrame([(k, v) for k, v in votes.items()], "rank long, target double")
    for block in (1, 7, 10, 33):
        got = {r.rank: r.seats for r in mixing._source_seats(df, block).collect()}
        assert got == sainte_lague(votes, round(sum(votes.values()) / block))


def test_shard_quotas_are_the_highest_quotients(spark):
    groups = {1: ([5, 90, 14, 14, 3, 0], 40), 2: ([1000, 1, 1, 1, 1, 1], 1001), 3: ([7], 9), 4: ([4, 4, 4], 1), 5: ([3, 2], 0)}
    data = [(p, c, v, seats) for p, (votes, seats) in groups.items() for c, v in enumerate(votes)]
    out = mixing._apportion(spark.createDataFrame(data, "p long, c long, votes long, seats long"), ["p"], "c").collect()
    got = {(r.p, r.c): r.quota for r in out}
    for p, (votes, seats) in groups.items():
        assert {c: got[p, c] for c in range(len(votes))} == sainte_lague(dict(enumerate(votes)), seats)


def test_mixed_documents_keep_columns(spark):
    docs = table(spark, rows(200))
    out = mixing.mixed_documents(docs)
    assert out.columns == SCHEMA.names
    times = collections.Counter(r.doc_id for r in out.collect())
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for d, r in taken.items():
        assert times[d] == (1 if r.size == 0 else min(3, int(r.taken / r.size + 0.5)))


def test_whole_documents_meet_the_targets(spark):
    """Long documents of sources whose targets are far from a whole multiple of their size."""
    own = []
    for k, (source, long) in enumerate((("a", 60), ("b", 40), ("c", 20), (None, 30))):
        own += [(k * 1000 + i, f"w{k}x{i} " * (200 + 37 * i % 900), "en", source, None, "x", "y", "z") for i in range(long)]
        own += [(k * 1000 + 500 + i, f"s{k}x{i} " * (1 + i % 60), "en", source, None, "x", "y", "z") for i in range(90)]
    own += [own[3]] * 4 + [(None, f"null{i} id" + " more" * 40, "en", "a", None, "x", "y", "z") for i in range(9)] + [(7777 + i, "", "en", "a", None, "x", "y", "z") for i in range(3)]
    sizes, rows_of = collections.Counter(), collections.Counter(own)
    for _, t, _, s, *_ in own:
        sizes[s] += len(t.split())
    target = plain_targets(sizes)
    import corpus_pipeline as P

    out = P.mix_sources(spark, table(spark, own), "")
    assert out.columns == SCHEMA.names
    got = collections.Counter(map(tuple, out.collect()))
    words = collections.Counter()
    for r, times in got.items():
        assert times <= 3 * rows_of[r]
        words[r[3]] += times * len(r[1].split())
    for s in sizes:
        assert abs(words[s] - target[s]) <= 64, (s, words[s], target[s])
    assert all(got[r] == n for r, n in rows_of.items() if not r[1])
    again = mixing.whole_documents(table(spark, own[::-1]).repartition(3))
    assert collections.Counter(map(tuple, again.collect())) == got
    assert mixing.whole_documents(empty(spark)).count() == 0
