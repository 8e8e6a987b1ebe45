"""Operators on embeddings against plain versions: clustering and hard negatives."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import centroids, negatives, vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("cluster", "distance", "vector", "id", "score", "rank", "near"))])
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA)


def awkward(width=8, n=300, seed=5):
    """Groups of near rows, copies, ties, rows that share an id, and all that takes no part."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = i % 10
        v = [m + rng.gauss(0, 0.02 if kind < 6 else 0.6) for m in middles[i % 6]]
        if kind == 7 and rows:
            v = rows[rng.randrange(len(rows))][1]
        rows.append((i * 5, v, rng.randrange(3)))
    rows += [rows[0], rows[0], rows[20], (rows[40][0], rows[41][1], rows[40][2])]  # repeated rows, and one id twice
    rows += [(3, None, 1), (4, [0.1] * (width - 1) + [None], 1), (6, [NAN] + [0.0] * (width - 1), 0), (8, [INF] * width, 2), (9, [0.5] * width, None), (None, [0.25] * width, 1), (None, [0.25] * width, 2)]
    return rows


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(rows, k, rounds, width):
    kept = [(i, whole(v)) for i, v, _ in rows if usable(v) and len(v) == width]
    c = [v for _, v in sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j, v=v: (far(v, c[j]), j)) for _, v in kept]
        if r < rounds:
            own = [[v for (_, v), a in zip(kept, at, strict=True) if a == j] for j in range(len(c))]
            c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c[j] for j, g in enumerate(own)]
    d = [far(v, c[a]) for (_, v), a in zip(kept, at, strict=True)]
    return sorted(
        ((i, a, x, sum(y for y, b in zip(d, at, strict=True) if b == a), sum(d), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d, strict=True)),
        key=str,
    )


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (7, 2), (1, 1), (5, 0), (1000, 1)])
def test_clusters(spark, k, rounds):
    rows = awkward()
    out = centroids.clusters(spark, table(spark, rows), k, rounds, 8)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == plain_clusters(rows, k, rounds, 8)


def test_clusters_of_few_rows(spark):
    assert centroids.clusters(spark, table(spark, []), 4, 2, 8).collect() == []
    assert centroids.clusters(spark, table(spark, awkward()), 4, 2, 99).collect() == []
    same = [(i, [0.5, -0.5], 0) for i in range(5)]
    assert sorted(r[:3] for r in centroids.clusters(spark, table(spark, same), 3, 2, 2).collect()) == [(i, 0, 0) for i in range(5)]
    with pytest.raises(Exception, match="beyond"):
        centroids.clusters(spark, table(spark, [(1, [3e38, 0.0], 0)]), 1, 1, 2).collect()
    with pytest.raises(ValueError, match="no row has an id"):
        centroids.clusters(spark, table(spark, [(None, [0.0, 0.0], 0)]), 1, 1, 2)
    with pytest.raises(ValueError, match="twice"):
        centroids.sort_means(table(spark, same), 1, 1, 2, carry=["vec_id", "vector"])


def test_scan_stops_beyond_twice_the_distance():
    rng = np.random.default_rng(1)
    c = rng.integers(-9, 9, (30, 4))
    c[7] = c[3]  # equal centroids
    x = np.concatenate([c[rng.integers(0, 30, 3000)] + rng.integers(-1, 2, (3000, 4)), rng.integers(-12, 12, (500, 4))])
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    order, between = centroids.orders(c)
    for previous in (np.zeros(len(x), int), every.argmin(1), rng.integers(0, 30, len(x))):
        cluster, distance, computed = centroids.assign(x, previous, c, order, between)
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
        allowed = sum(1 + int((between[p][1:] <= 4 * every[i, p]).sum()) for i, p in enumerate(previous))
        assert computed == allowed  # no more than those within twice the distance
    assert computed < every.size
    assert centroids.assign(x, every.argmin(1), c, order, between)[2] < 0.5 * every.size


def plain_negatives(rows, positives=5, negatives=5):
    kept = [(i, whole(v), (lb + 1) % 10 if i is not None and i % 7 == 0 else lb) for i, v, lb in rows if usable(v) and lb is not None]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (a, v, lb) in enumerate(kept):
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), last(i), i, m == lb) for j, (i, w, m) in enumerate(kept) if j != n), key=lambda s: s[:2])
        for s, _, p, _ in [r for r in scored if r[3]][:positives]:
            hard = [r for r in scored if not r[3] and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(a, p, k + 1, r[2], -s, -r[0]) for k, r in enumerate(hard)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [negatives.BLOCK, 3])
def test_hard_negatives(spark, block, monkeypatch):
    rows = [*awkward(), (700, [0.3, 0.4], 1), (701, [], 1), (800, [], 1), (900, [0.2] * 12, 2)]  # lengths that differ
    monkeypatch.setattr(negatives, "ROWS", 64)
    out = negatives.hard_negatives(table(spark, rows).repartition(3), lambda i: i % 100 == 0, label=negatives.moved_label(), block=block)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == plain_negatives(rows) and len(got) > 100


def test_hard_negatives_of_few_rows(spark):
    none = lambda rows: negatives.hard_negatives(table(spark, rows), lambda i: i % 100 == 0).collect()
    assert none([]) == [] and none([(100, [1.0], 1)]) == [] and none([(100, [1.0], 1), (101, [1.0], 1)]) == []
    assert none([(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert none([(100, [0.0], 1), (101, [0.0], 1), (102, [0.0], 2)]) == [(100, 101, 1, 102, 0, 0)]
    assert none([(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.9], 2)]) == []  # a negative score has no reach
    with pytest.raises(Exception, match="beyond"):
        none([(100, [1e30], 1), (101, [1.0], 1)])


def test_brackets_hold_and_spare_work():
    rng = np.random.default_rng(2)
    middles = rng.integers(-200, 200, (12, 16))
    x = np.sort(rng.integers(0, 12, 4000))
    x = middles[x] + rng.integers(-4, 5, (4000, 16))
    labels, ids, top = rng.integers(0, 4, 4000), np.arange(4000), int((x * x).sum(1).max())
    pivots = negatives.choose_pivots(x[rng.permutation(4000)[:500]], top)
    q = x[::100]
    ask = negatives.Asks(q, labels[::100], ids[::100], pivots.of_anchors(q), np.full((40, 1), negatives.NONE + 1), np.full((40, 1), negatives.NO_ID), True, 6)
    score = q @ x.T
    left = negatives.survivors(ask, np.arange(40), np.sort(score, 1)[:, -6], ask.high[:, 0], pivots.of_rows(x), top)
    assert left is not None and left[score >= np.sort(score, 1)[:, -6:-5]].all() and left.mean() < 0.5
    lists = negatives.Lists(ask)
    for at in range(0, 4000, 1000):
        part = slice(at, at + 1000)
        pairs, computed = negatives.search(ask, lists, x[part], labels[part], ids[part], pivots.of_rows(x[part]), top)
        lists.settle()
    asks, found, best, itself = lists.settle()
    for a in range(40):
        right = np.flatnonzero(labels == ask.label[a])
        order = right[np.lexsort((right, -score[a, right]))][:6]
        assert found[asks == a].tolist() == order.tolist() and (best[asks == a] == score[a, order]).all()
        assert (found[(asks == a) & itself] == ask.ids[a]).all()
    assert computed < pairs


def test_products_are_exact():
    big = np.array([[1 << 26, -(1 << 26) + 1], [3, 5]])
    assert vectors.products(big, big).tolist() == (big.astype(object) @ big.T.astype(object)).tolist()
    assert vectors.products(np.zeros((0, 2), np.int64), big).shape == (0, 2)


def test_quantised(spark):
    row = spark.createDataFrame([([0.5, -0.001, 0.0039, None], [1.0])], "a array<float>, b array<float>").select(vectors.quantised(F.array_compact("a")), vectors.finite(F.col("a")), vectors.finite(F.col("b"))).first()
    assert list(row) == [[128, -1, 0], False, True]
