"""Centroid clustering of integer vectors by sort-means.

Each round orders the other centroids by their distance from each centroid, k orders of k that a task gets as a table. A row scans from
the centroid that it had: let d be its distance to that one. The others come in order of their distance from it, and the
scan stops at the first one strictly beyond 2 d, since by the triangle inequality that one and all behind it are farther from the
row than d. One at just 2 d may tie, so it is looked at. The first round scans from centroid 0.

Rows carry their cluster from round to round in a table in the shared folder, two of which exist at a time; lost executors only
repeat tasks. Rows are assigned by whole Arrow batches in numpy and stay where they are; what is shuffled is a sum a
cluster and task. The driver sees the centroids alone (k vectors). Sums and distances are exact integers.

Defined cases: rows whose vector is null, has another number of components, or a null or non-finite one, are left out. A row without an
id is clustered but doesn't start a centroid. Repeated rows count one by one; rows of one id start centroids in the order
of their components. Ties go to the smaller number; a centroid without rows stays. With fewer eligible rows than k there are
as many centroids; with none, the result is empty. Components beyond 2^26 (of 64; less of
more) are refused, as distances wouldn't fit a long.
Other columns are carried along if named; names that clash are refused.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, discard, stash
from .vectors import LARGEST, SCALE, finite, matrix, products, quantised

OWN = ["cluster", "distance"]


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exactly."""
    return (rows * rows).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * products(rows, centroids)


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids by distance from it, itself first, and those squared distances in that order."""
    between = squared(centroids, centroids)
    np.fill_diagonal(between, -1)  # ahead of equal centroids
    order = np.argsort(between, axis=1, kind="stable")
    between = np.take_along_axis(between, order, 1)
    between[:, 0] = 0
    return order, between


def assign(rows: np.ndarray, previous: np.ndarray, centroids: np.ndarray, order: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row and its squared distance, scanning from the previous one; and the distances computed."""
    cluster, distance, computed = previous.astype(np.int64), np.zeros(len(rows), np.int64), 0
    for start in np.unique(previous):
        own = np.flatnonzero(previous == start)
        first = squared(rows[own], centroids[start : start + 1])[:, 0]
        far = np.argsort(-first, kind="stable")  # those that scan farthest come first
        own, first, x = own[far], first[far], rows[own[far]]
        best, who = first.copy(), np.full(len(own), start)
        # strictly beyond twice the distance, in squares; the limits fall along the rows
        reach = np.searchsorted(-4 * first, -between[start], "right")
        computed += len(own) + int(reach[1:].sum())
        for to in np.unique(reach[1:])[::-1]:
            if not to:
                continue
            beside = np.flatnonzero(reach[1:] == to) + 1
            number = np.sort(order[start, beside])
            d = squared(x[:to], centroids[number])
            at = d.argmin(1)  # the first of equal ones has the smallest number
            near, found = d[np.arange(to), at], number[at]
            better = (near < best[:to]) | (near == best[:to]) & (found < who[:to])
            best[:to][better], who[:to][better] = near[better], found[better]
        cluster[own], distance[own] = who, best
    return cluster, distance, computed


def starting(vectors: DataFrame, k: int, seed: int, id_column: str) -> np.ndarray:
    """The vectors of the k least lowercase-hex SHA-256 of `seed:id`, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    rows = vectors.where(F.col(id_column).isNotNull()).select(hashed.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with their cluster and distance by these centroids, scanned from the cluster that they have (none: 0)."""
    order, between = orders(centroids)
    names, scanned = vectors.columns, "cluster" in vectors.columns
    schema = T.StructType([f for f in vectors.schema if f.name not in OWN] + [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vector"), centroids.shape[1])
            previous = b.column("cluster").to_numpy() if scanned else np.zeros(len(x), np.int64)
            cluster, distance, _ = assign(x, previous, centroids, order, between)
            kept = {n: b.column(n) for n in names if n not in OWN}
            yield pa.RecordBatch.from_pydict(kept | {"cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})

    return bound_batches(vectors).mapInArrow(run, schema)


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its rows' mean, component by component."""
    dims = range(centroids.shape[1])
    sums = [F.sum(F.get("vector", F.lit(i))).alias(f"s{i}") for i in dims]
    out = centroids.copy()
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in dims]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def sort_means(table: DataFrame, k: int, rounds: int, width: int, seed: int = 2, vector: str = "embedding", id_column: str = "vec_id", carry: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """The columns `carry` (by default the id) with `vector` (integers), `cluster` and `distance` (squared); and the final centroids."""
    spark, carry = table.sparkSession, [id_column] if carry is None else carry
    if clash := {"vector", *OWN} & set(carry):
        raise ValueError(f"{', '.join(sorted(clash))} would stand twice")
    if k < 1 or rounds < 0 or width < 1:
        raise ValueError("k and width must be positive and rounds not negative")
    kept = table.where(finite(F.col(vector)) & (F.size(vector) == width))
    names = list(dict.fromkeys([*carry, id_column]))
    rows = stash(kept.select(*names, quantised(F.col(vector), min(LARGEST, math.isqrt((1 << 58) // width))).alias("vector")))
    centroids = starting(rows, k, seed, id_column)
    if not len(centroids):
        if not rows.isEmpty():
            raise ValueError("no row has an id to start a centroid with")
        return rows.select(*carry, "vector", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        after = stash(_assigned(rows, centroids))
        discard(rows)
        rows, centroids = after, moved(after, centroids)
    final = stash(_assigned(rows, centroids))
    discard(rows)
    return final.select(*carry, "vector", *OWN), centroids


def clusters(spark: SparkSession, table: DataFrame, k: int, rounds: int, width: int, **how) -> DataFrame:
    """A row's id, cluster and distance, with the cluster's and the whole inertia and the digest of the final centroid."""
    rows, centroids = sort_means(table, k, rounds, width, **how)
    sums = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    said = [(i, sums.get(i, 0), sum(sums.values()), centroid_digest(c)) for i, c in enumerate(centroids)]
    each = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("vector").join(F.broadcast(each), "cluster").select(*(c for c in rows.columns if c not in ("vector", *OWN)), *OWN, "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int, rounds: int, width: int, seed: int = 2) -> str:
    """DuckDB SQL for clusters() over embeddings: every distance, round by round."""
    nearest = """
n{r} as materialized (
  select vec_id, q, cluster, distance from (
    select v.vec_id, v.q, c.number as cluster, list_sum(list_transform(range(1, {w} + 1), lambda i: (v.q[i] - c.p[i]) * (v.q[i] - c.p[i])))::bigint as distance,
      row_number() over (partition by v.vec_id order by distance, c.number) as place
    from v cross join c{r} c) where place = 1)"""
    means = """
c{s} as materialized (
  select c.number, coalesce(m.p, c.p) as p from c{r} c left join (
    select cluster, list((total - (total % n + n) % n) // n order by i) as p from (
      select cluster, i, sum(q[i])::bigint as total, count(*) as n from n{r} cross join (select unnest(range(1, {w} + 1)) as i) group by cluster, i) group by cluster) m on m.cluster = c.number)"""
    steps = "".join("," + nearest.format(r=r, w=width) + ("," + means.format(r=r, s=r + 1, w=width) if r < rounds else "") for r in range(rounds + 1))
    return f"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q
  from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select row_number() over (order by h) - 1 as number, q as p from (select sha256('{seed}:' || vec_id::varchar) as h, q from v order by h limit {k})){steps}
select vec_id, n.cluster::integer as cluster, distance, sum(distance) over (partition by n.cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(c.p, ',')) as centroid_sha256
from n{rounds} n join c{rounds} c on c.number = n.cluster"""
