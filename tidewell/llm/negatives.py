"""Hard-negative mining by inner product over a pivot table.

Vectors get one more component, sqrt(M^2 - |x|^2) for rows (M: the greatest length of any) and 0 for an anchor q. Then the
distance of the two is |q|^2 + M^2 - 2 q.x, so the greatest inner product is the least distance. A few pivots are chosen far
from each other, and the table stores each row's distances to them. By the triangle inequality, distances to a pivot
bracket the distance of an anchor and a row between their difference and their sum, and so bracket the score. Blocks of rows are bracketed
whole first, by the least and greatest distance of their rows to each pivot, then the rows of the blocks left; a row whose bracket can't
reach what the anchor has found so far is passed over, the survivors' inner products are computed exactly, in integers.
After a few pivots that spare nothing the rest aren't tried for a block.

Anchors are a stated set of queries. They go out in blocks of at most `block` (a broadcast of that size), each of which meets all
rows where those stand: no row is shuffled. Two passes are made, the first for the best rows of the same label, the
second for rows of other labels under each positive's score. A task keeps the best few of each list and
gives only those on; a window over each list merges the tasks'. The limits at the start of a pass come from the scores of the SAMPLE rows
with the least hashes, from which the pivots are chosen too: those rows are part of the table, so a limit is
one that the result reaches, and the sample decides nothing but speed. All rows are in the table and all can be found: the search is exact.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different lengths
are compared as if the shorter one ended in zeros. A row without an id is no anchor, and comes last among equal scores. Repeated rows
are rows of their own, so an anchor's copy can be its positive, and repeated anchors each get their rows. With no positives, or no negatives in
reach, an anchor gives no row; an empty table gives none. Components so large that 100 times a score doesn't fit a long are refused. Columns beside the
id, the label and the vector aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bound_batches, discard, stash
from .vectors import SCALE, finite, matrix, products, quantised

PIVOTS, SAMPLE = 16, 2048
#: Anchors in a broadcast; rows and anchors whose scores are computed at once; pivots tried before a block is given up.
BLOCK, ROWS, ANCHORS, TRIED = 4096, 1024, 512, 4
#: Error of a stored distance, in units of M.
SLACK = 1e-6
NO_ID, NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
FOUND = "ask long, id long, score long, itself boolean"


@dataclass
class Pivots:
    """vectors: the pivots (integers); last: their further component; top: M squared."""

    vectors: np.ndarray
    last: np.ndarray
    top: int

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of augmented rows to the pivots."""
        last = np.sqrt(np.maximum(0.0, self.top - (x * x).sum(1).astype(float)))
        return np.sqrt(np.maximum(0.0, 2.0 * self.top - 2.0 * (products(x, self.vectors) + last[:, None] * self.last)))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (q * q).sum(1)[:, None] + float(self.top) - 2.0 * products(q, self.vectors)))


def choose_pivots(sample: np.ndarray, top: int, n: int = PIVOTS) -> Pivots:
    """Each pivot is the row of the sample that is farthest from those chosen before it; equal rows are chosen once."""
    last = np.sqrt(np.maximum(0.0, top - (sample * sample).sum(1).astype(float)))
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        p = chosen[-1]
        nearest = np.minimum(nearest, 2.0 * top - 2.0 * (products(sample, sample[p : p + 1])[:, 0] + last * last[p]))
        far = int(nearest.argmax())
        if nearest[far] <= 1e-9 * top:
            break
        chosen.append(far)
    return Pivots(sample[chosen], last[chosen], top)


@dataclass
class Asks:
    """Lists to be filled for anchors: of anchor i, those numbered i * per and on.

    same: whether their rows have the anchor's label, or another one; keep: rows a list keeps; low, high: scores that it takes.
    """

    q: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    to_pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    keep: int
    squares: np.ndarray = field(init=False)

    def __post_init__(self):
        self.squares = (self.q * self.q).sum(1)


class Lists:
    """The best rows of each list so far: highest scores first, ties by the smaller id."""

    def __init__(self, asks: Asks):
        self.keep, self.low = asks.keep, asks.low.copy()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, ask: np.ndarray, ids: np.ndarray, score: np.ndarray, itself: np.ndarray) -> None:
        if len(ask):
            self.parts.append((ask, ids, score, itself))
            self.waiting += len(ask)
            if self.waiting > 1 << 16:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(bool)
        ask, ids, score, itself = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, ask))
        ask, ids, score, itself = ask[order], ids[order], score[order], itself[order]
        first = np.flatnonzero(np.r_[True, ask[1:] != ask[:-1]])
        place = np.arange(len(ask)) - np.repeat(first, np.diff(np.r_[first, len(ask)]))
        full, kept = place == self.keep - 1, place < self.keep
        flat = self.low.reshape(-1)
        flat[ask[full]] = np.maximum(flat[ask[full]], score[full])
        self.parts, self.waiting = [(ask[kept], ids[kept], score[kept], itself[kept])], 0
        return self.parts[0]


def survivors(asks: Asks, who: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, top: int) -> np.ndarray | None:
    """Of anchors `who` and rows with these distances to the pivots, the pairs whose brackets meet low..high. None: all of them."""
    slack, near = SLACK * math.sqrt(top), asks.to_pivots[who]
    most = asks.squares[who][:, None] + float(top)
    left: np.ndarray | None = None
    for p in range(rows.shape[1]):
        at, away = near[:, p : p + 1], rows[None, :, p]
        under = np.maximum(0.0, np.abs(at - away) - slack)
        over = at + away + slack
        met = ((most - under * under) / 2 + SLACK * top >= low[:, None]) & ((most - over * over) / 2 - SLACK * top <= high[:, None])
        left = met if left is None else left & met
        share = left.mean()
        if not share:
            break
        if p + 1 == TRIED and share > 0.5:
            return None
    return left


def search(asks: Asks, lists: Lists, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, to_pivots: np.ndarray, top: int) -> tuple[int, int]:
    """Puts rows into the lists. Returns how many pairs of the right labels there were and how many inner products were computed."""
    pairs = computed = 0
    slack, per = SLACK * math.sqrt(top), asks.low.shape[1]
    for r in range(0, len(x), ROWS):
        rows = slice(r, r + ROWS)
        own, least, most = labels[rows], labels[rows].min(), labels[rows].max()
        some = (asks.label >= least) & (asks.label <= most) if asks.same else np.full(len(asks.q), True) if least < most else asks.label != least
        low, high = lists.low.min(1), asks.high.max(1)
        pairs += int(some.sum()) * len(own)
        # the whole block first
        block = to_pivots[rows]
        gap = np.maximum(asks.to_pivots - block.max(0), block.min(0) - asks.to_pivots).max(1, initial=0.0)
        under = np.maximum(0.0, gap - slack)
        who = np.flatnonzero(some & (low <= high) & ((asks.squares + float(top) - under * under) / 2 + SLACK * top >= low))
        for a in range(0, len(who), ANCHORS):
            at = who[a : a + ANCHORS]
            left = survivors(asks, at, low[at], high[at], block, top)
            right = (asks.label[at][:, None] == own) == asks.same
            if left is not None:
                right &= left
                if not right.any():
                    continue
            # few survivors are computed one by one
            if right.mean() < 0.05:
                i, j = np.nonzero(right)
                score = np.einsum("ij,ij->i", asks.q[at[i]], x[rows][j])
                computed += len(i)
            else:
                every = products(asks.q[at], x[rows])
                computed += every.size
                i, j = np.nonzero(right & (every >= low[at][:, None]) & (every <= high[at][:, None]))
                score = every[i, j]
            anchor = at[i]
            itself = (ids[rows][j] == asks.ids[anchor]) & (score == asks.squares[anchor]) & (score == (x[rows] * x[rows]).sum(1)[j]) if asks.same else np.zeros(len(i), bool)
            for k in range(per):
                takes = (score >= lists.low[anchor, k]) & (score <= asks.high[anchor, k])
                lists.add(anchor[takes] * per + k, ids[rows][j[takes]], score[takes], itself[takes])
    return pairs, computed


def pivot_table(table: DataFrame, vector: str = "embedding", label: Column | str = "label", id_column: str = "vec_id") -> tuple[DataFrame, Pivots | None, np.ndarray, np.ndarray]:
    """The rows that take part as id, label, vector (integers) and to_pivots, blocks of near rows together; the pivots; the sample's vectors and labels."""
    label = F.col(label) if isinstance(label, str) else label
    kept = table.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector")).where(F.col("label").isNotNull() & finite(F.col("vector")))
    width = kept.agg(F.max(F.size("vector"))).first()[0]
    rows = stash(kept.select("id", "label", quantised(F.col("vector"), math.isqrt((1 << 55) // max(1, width or 1))).alias("vector")))
    width = max(1, width or 1)
    top = rows.agg(F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda s, v: s + v * v))).first()[0]
    if top is None:
        return rows.withColumn("to_pivots", F.array().cast("array<double>")), None, np.zeros((0, width), np.int64), np.zeros(0, np.int64)
    picked = rows.orderBy(F.xxhash64("id", "vector"), "id", "label", "vector").limit(SAMPLE).collect()
    sample = np.zeros((len(picked), width), np.int64)
    for i, r in enumerate(picked):
        sample[i, : len(r.vector)] = r.vector
    pivots = choose_pivots(sample, top)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = pivots.of_rows(matrix(b.column("vector"), width))
                near = d.argmin(1)
                found = {"to_pivots": pa.array(list(d), pa.list_(pa.float64())), "near": pa.array(near.astype(np.int32)), "away": pa.array(d[np.arange(len(d)), near])}
                yield pa.RecordBatch.from_pydict({n: b.column(n) for n in ("id", "label", "vector")} | found)

    with_distances = bound_batches(rows).mapInArrow(measured, "id long, label long, vector array<long>, to_pivots array<double>, near int, away double")
    out = stash(with_distances.sortWithinPartitions("label", "near", "away").drop("near", "away"))
    discard(rows)
    return out, pivots, sample, np.array([r.label for r in picked], np.int64)


def _passed(table: DataFrame, asks: Asks, width: int, top: int) -> DataFrame:
    """ask, id, score, itself and rank: each list filled from all rows of the table. The caller destroys the broadcast (_sent) once the rows are written."""
    sent = table.sparkSession.sparkContext.broadcast(asks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = sent.value
        lists = Lists(asks)
        for b in batches:
            if b.num_rows:
                ids = b.column("id").fill_null(NO_ID).to_numpy()
                search(asks, lists, matrix(b.column("vector"), width), b.column("label").to_numpy(), ids, matrix_of_floats(b.column("to_pivots")), top)
        ask, ids, score, itself = lists.settle()
        yield pa.RecordBatch.from_pydict({"ask": pa.array(ask), "id": pa.array(ids, mask=ids == NO_ID), "score": pa.array(score), "itself": pa.array(itself)})

    found = bound_batches(table).mapInArrow(run, FOUND)
    best = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= asks.keep)
    out._sent = sent
    return out


def matrix_of_floats(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best_of_sample(scores: np.ndarray, right: np.ndarray, keep: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each anchor and list, the score of the sample's row number `keep` among those that the list takes, or its low."""
    out = low.copy()
    for k in range(low.shape[1]):
        taken = np.where(right & (scores >= low[:, k : k + 1]) & (scores <= high[:, k : k + 1]), scores, NONE)
        if taken.shape[1] >= keep:
            out[:, k] = np.maximum(out[:, k], np.partition(taken, -keep, axis=1)[:, -keep])
    return out


def _block(spark: SparkSession, table: DataFrame, pivots: Pivots, sample: np.ndarray, sample_labels: np.ndarray, anchors: list, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame | None:
    """The rows of one block of anchors."""
    width = sample.shape[1]
    q = np.zeros((len(anchors), width), np.int64)
    for i, r in enumerate(anchors):
        q[i, : len(r.vector)] = r.vector
    label, ids = np.array([r.label for r in anchors], np.int64), np.array([r.id for r in anchors], np.int64)
    scores, same, near = products(q, sample), label[:, None] == sample_labels, pivots.of_anchors(q)
    low, high = np.full((len(q), 1), NONE + 1), np.full((len(q), 1), NO_ID)
    # one more than asked for, as the anchor may be among its own
    first = Asks(q, label, ids, near, _best_of_sample(scores, same, positives + 1, low, high), high, True, positives + 1)
    found = _passed(table, first, width, pivots.top)
    best: dict[int, list] = {}
    for r in found.orderBy("ask", "rank").collect():  # at most positives + 1 an anchor of the block
        best.setdefault(r.ask, []).append(r)
    found._sent.destroy()
    asked = []
    low, high = np.full((len(q), positives), NO_ID), np.full((len(q), positives), NONE + 1)  # takes nothing
    for a, rows in best.items():
        own = next((r for r in rows if r.itself), None)
        for k, r in enumerate([r for r in rows if r is not own][:positives]):
            low[a, k], high[a, k] = -(-share[0] * r.score // share[1]), r.score
            asked.append((a * positives + k, int(ids[a]), r.id, r.score, anchors[a].n))
    if not asked:
        return None
    low = _best_of_sample(scores, ~same, negatives, low, high)
    found = _passed(table, Asks(q, label, ids, near, low, high, False, negatives), width, pivots.top)
    known = F.broadcast(spark.createDataFrame(asked, "ask long, anchor_id long, positive_id long, positive_score long, n long"))
    each = found.join(known, "ask").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    out = each.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out._sent = found._sent
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    table: DataFrame, anchors: Callable[[Column], Column], positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (LOW, HIGH), vector: str = "embedding", label: Column | str = "label", id_column: str = "vec_id", block: int = BLOCK
) -> DataFrame:
    """For each anchor (rows whose id the condition takes) and each of its best `positives` rows of the same label, the best `negatives` rows
    of other labels with share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score."""
    spark = table.sparkSession
    rows, pivots, sample, sample_labels = pivot_table(table, vector, label, id_column)
    if pivots is None:
        return spark.createDataFrame([], RESULT)
    asked = rows.where(anchors(F.col("id"))).groupBy("id", "label", "vector").agg(F.count("*").alias("n"))
    number = asked.count()
    dealt = stash(asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(max(1, math.ceil(number / (0.9 * block)))))))
    parts = []
    for b in range(max(1, math.ceil(number / (0.9 * block)))):
        own = dealt.where(F.col("block") == b).orderBy("id", "vector").collect()  # about 0.9 * block of them
        for i in range(0, len(own), block):
            found = _block(spark, rows, pivots, sample, sample_labels, own[i : i + block], positives, negatives, share)
            if found is not None:
                parts.append(stash(found))
                found._sent.destroy()
    discard(dealt, rows)
    if not parts:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*(p._stash_path for p in parts))


def moved_label(label: str = "label", id_column: str = "vec_id") -> Column:
    """The label; where the id is divisible by 7, the next one of ten."""
    return F.when(F.col(id_column) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))


def oracle(every: int = 100) -> str:
    """DuckDB SQL for the query over embeddings of one length: every pair's score."""
    return f"""
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as materialized (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.q, r.q) as bigint) as score
  from v a join v r on r.vec_id <> a.vec_id where a.vec_id % {every} = 0),
positives as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from scores where same) where k <= {POSITIVES}),
reach as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from positives p join scores n on n.anchor_id = p.anchor_id and not n.same and {LOW} * p.score <= {HIGH} * n.score and n.score <= p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from reach where rank <= {NEGATIVES}"""
