"""Connected components of links between bigint nodes, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import split_join
from .shared import discard, stash

MOST_ROUNDS = 100


def _star(arcs: DataFrame, ends: DataFrame, rows: int) -> DataFrame:
    """Links each arc's far end to the least node next to its near end. arcs: u, v; ends: u, least, n (arcs of u); rows: all arcs."""
    return split_join(arcs, ends, "u", rows, F.col("v")).where("v != least").select(F.col("v").alias("b"), F.col("least").alias("a"))


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node of its component) of every node in links (a, b); self links and repeats are allowed.

    A large star links every greater neighbour of a node to the least of its neighbourhood, a small star every smaller
    one; repeated, each component becomes a star around its least node. A round is two aggregations and two joins, which
    deal a hub's rows over salts. Rounds end when the links don't change.
    """
    now = stash(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        ends = stash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"), F.count("*").alias("n")))
        middle = stash(_star(both.where("v > u"), ends, 2 * state[0]).distinct())
        discard(ends)
        # small star: each node's smaller neighbours, and the node itself, to the least of them
        down = middle.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        ends = stash(down.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")))
        small = _star(down, ends, middle.count()).unionAll(ends.select(F.col("u").alias("b"), F.col("least").alias("a")))
        after = stash(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(now, middle, ends)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    named = now.select(F.col("b").alias("node"), "a").unionAll(now.select(F.col("a").alias("node"), "a"))
    return named.groupBy("node").agg(F.min("a").alias("component"))
