"""Mixing sources to target weights by Sainte-Lague apportionment, then a seeded selection of blocks.

1. A document's size is its number of words [^\\x20\\x09-\\x0D]+. Sources, in order of code points with null last, weigh
   1, 2, 3, repeating, and share the total of all sizes; no target passes REPEATS times its source's size, the excess
   being shared again by weight until none does (a water level, found by a few aggregations over the sources).
2. The total is `block` words times a number of seats. Seats go to sources by the highest quotients target / (2 seats + 1),
   found as the divisor at which the rounded quotients sum up to them.
3. Each source is dealt by a seeded hash of doc_id into shards of about SHARD_WORDS words, the shards into shelves of SHELF. A
   source's seats go to its shelves, and a shelf's to its shards, by highest quotients as well: integer quotas per shard.
4. A shard's documents stand in seeded order, and its quota takes as many whole passes as fit, then the blocks that a
   seeded systematic draw selects. A document's words in them follow in closed form from where it stands.

No group is unbounded: sources are aggregated, a shelf has SHELF shards, a shard about SHARD_WORDS words and SHARD_ROWS
rows. Repeated rows are counted first and parted again at the end. Defined cases: null and empty texts have size 0
and are taken 0 times; a null source is a source; rows with a null doc_id are repeated rows if size and source agree; an empty
table gives an empty result; other columns are ignored by mix() and kept by mixed_documents() and whole_documents(). The
latter tells rows apart by all their columns, and chooses whole copies against the shards' quotas in place of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import split_join
from .shared import discard, stash

REPEATS = 3
SHARD_WORDS, SHARD_ROWS, SHELF = 1 << 16, 1 << 12, 1 << 10


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.expr(f"regexp_count(`{text}`, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources in order of code points, null last, with rank from 0: places in sorted partitions plus the partitions' offsets."""
    placed = stash(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright("__at", 33)).count().collect())  # one a partition
    before, offsets = 0, []
    for part, n in counts:
        offsets.append(F.when(F.shiftright("__at", 33) == part, F.lit(before) - F.lit(part << 33)))
        before += n
    return placed.withColumn("rank", F.col("__at") + F.coalesce(*offsets, F.lit(0))).drop("__at")


def _targets(sources: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """source, rank, source_size, n, target."""
    weighed = stash(_ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, most = 0.0, F.col("source_size") * repeats
    while True:
        capped = F.col("weight") * level > most
        held, free = weighed.agg(F.coalesce(F.sum(F.when(capped, most)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        now = (total - held) / free if free else level
        if now <= level:
            break
        level = now
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), most.cast("double"))).drop("weight")


def _source_seats(sources: DataFrame, block: int) -> DataFrame:
    """Adds seats: highest quotients over all sources, found by narrowing the divisor with 32 trials a pass."""
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    seats = round(total / block)
    rounded = lambda by: F.floor(F.col("target") / F.lit(by) + 0.5)
    if not seats:
        return sources.withColumn("seats", F.lit(0).cast("long"))
    # rounding moves the sum by half a seat a source at most: within these bounds there are enough and too few seats
    n = sources.count()
    low, high = total / (seats + n / 2 + 1), total / (seats - n / 2 - 1) if seats > n / 2 + 1 else total * 2 + block
    while high - low > 1e-12 * high:
        trials = [low + (high - low) * i / 33 for i in range(1, 33)]
        sums = sources.agg(*(F.sum(rounded(x)).alias(f"t{i}") for i, x in enumerate(trials))).first()
        ends = [(low, seats + 1), *zip(trials, sums), (high, -1)]
        i = next(i for i in range(33) if ends[i][1] >= seats > ends[i + 1][1])
        if ends[i][1] == seats:
            return sources.withColumn("seats", rounded(ends[i][0]))
        if (low, high) == (ends[i][0], ends[i + 1][0]):
            break
        low, high = ends[i][0], ends[i + 1][0]
    # equal quotients compete for the last seats: the first sources get them
    short = seats - int(sources.agg(F.sum(rounded(high))).first()[0])
    tied = sources.where(rounded(low) > rounded(high)).orderBy("rank").limit(short).select("rank", F.lit(1).alias("more"))
    return sources.join(tied, "rank", "left").withColumn("seats", rounded(high) + F.coalesce("more", F.lit(0))).drop("more")


def _apportion(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Deals `seats` of each parent to its children by `votes`: adds quota. Groups are the parent's children, a few rows each.

    The divisor lies within n / 2 seats of votes / seats, so only quotients from there compete.
    """
    n, sum_ = F.count("*").over(Window.partitionBy(*parent)), F.sum("votes").over(Window.partitionBy(*parent))
    share = F.col("votes") / F.greatest(F.col("__sum"), F.lit(1))
    lower = F.floor(share * F.greatest(F.lit(0), F.col("seats") - F.col("__n") / 2 - 1) + 0.5)
    upper = F.floor(share * (F.col("seats") + F.col("__n") / 2 + 1) + 0.5) + 1
    ranged = children.withColumns({"__n": n, "__sum": sum_}).withColumns({"__low": F.when(F.col("votes") > 0, lower).otherwise(0), "__up": F.when(F.col("votes") > 0, upper).otherwise(0)})
    ranged = ranged.withColumn("__held", F.sum("__low").over(Window.partitionBy(*parent)))
    open_ = ranged.withColumn("__seat", F.explode(F.expr("sequence(__low, greatest(__low, __up))")))
    order = Window.partitionBy(*parent).orderBy((F.col("votes") / (2 * F.col("__seat") + 1)).desc(), child)
    won = (F.row_number().over(order) <= F.col("seats") - F.col("__held")) & (F.col("votes") > 0)
    names = [c for c in children.columns if c != "seats"]
    return open_.withColumn("__won", won.cast("long")).groupBy(*names, "__low").agg(F.sum("__won").alias("__won")).select(*names, (F.col("__low") + F.col("__won")).alias("quota"))


def _dealt(docs: DataFrame, weights: tuple[int, ...], block: int, seed: int, repeats: int, key: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Distinct rows of docs (source, size and key) with n and their place among the shards, and the shards' quotas and draws."""
    each = stash(docs.groupBy(*key, "source", "size").agg(F.count("*").alias("n")))
    totals = each.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
    sources = stash(_source_seats(_targets(totals, weights, repeats), block))
    count = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS)).cast("long")
    # sources by name, null apart from all names; a hot one is salted
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__named")
    some = sources.select(named, F.col("rows").alias("n"), "rank", "source_size", "target", "seats", "rows")
    joined = split_join(each.withColumnRenamed("n", "__n").select("*", named), some, "__named", each.count(), F.xxhash64(*key, "size"))
    dealt = joined.withColumnRenamed("__n", "n").select(
        *key, "source", "size", "n", "rank", "source_size", "target", "seats",
        F.pmod(F.xxhash64(*key, F.lit(seed)), count).alias("shard"), F.xxhash64(*key, F.lit(seed + 1)).alias("order"),
    )
    shards = dealt.groupBy("rank", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("votes"), F.first("seats").alias("seats")).withColumn("shelf", F.expr(f"shard div {SHELF}"))
    shards = stash(shards)
    shelves = shards.groupBy("rank", "shelf").agg(F.sum("votes").alias("votes"), F.first("seats").alias("seats"))
    shelves = _apportion(shelves, ["rank"], "shelf").select("rank", "shelf", F.col("quota").alias("seats"))
    quotas = _apportion(shards.drop("seats").join(shelves, ["rank", "shelf"]), ["rank", "shelf"], "shard")
    words = F.least(F.col("quota") * block, F.col("votes") * repeats)
    blocks = F.ceil(F.col("votes") / block).cast("long")
    quotas = stash(
        quotas.select("rank", "shard", words.alias("words"), "votes", blocks.alias("blocks"))
        .withColumn("passes", F.when(F.col("votes") > 0, F.expr("words div votes")).otherwise(0))
        .withColumn("drawn", F.when(F.col("votes") > 0, F.least(F.col("blocks"), F.round((F.col("words") - F.col("passes") * F.col("votes")) / block))).otherwise(0).cast("long"))
        .withColumn("start", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("rank", "shard", F.lit(seed + 2)), F.col("blocks"))).otherwise(0))
        .select("rank", "shard", "words", "votes", "blocks", "passes", "drawn", "start")
    )
    discard(shards)
    return dealt, quotas


def _taken(docs: DataFrame, weights: tuple[int, ...], block: int, seed: int, repeats: int) -> DataFrame:
    """Per distinct (doc_id, source, size): n rows, first word in the shard, and the shard's draw. docs: doc_id, source, size."""
    dealt, quotas = _dealt(docs, weights, block, seed, repeats)
    order = Window.partitionBy("rank", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end", F.sum(F.col("size") * F.col("n")).over(order)).join(quotas.drop("words", "votes"), ["rank", "shard"])
    return placed.withColumn("begin", F.col("end") - F.col("size") * F.col("n"))


def _drawn_before(place: str, block: int) -> str:
    """SQL: words that the draw takes of the first `place` words of a shard."""
    k = f"({place} div {block})"
    chosen = lambda i: f"(({i} * drawn + start) div greatest(1, blocks))"
    return f"({block} * {chosen(k)} + ({place} % {block}) * ({chosen(f'({k} + 1)')} - {chosen(k)}))"


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = 32, seed: int = 11, repeats: int = REPEATS) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target (of its source), taken (words, repeats counted)."""
    placed = _taken(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")), weights, block, seed, repeats)
    one = placed.withColumn("__i", F.explode(F.expr("sequence(1L, n)")))
    a, b = "(begin + (__i - 1) * size)", "(begin + __i * size)"
    taken = F.expr(f"passes * size + {_drawn_before(b, block)} - {_drawn_before(a, block)}")
    return one.select("doc_id", "source", "size", "source_size", "target", F.least(taken, F.col("size") * repeats).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = 32, seed: int = 11, repeats: int = REPEATS) -> DataFrame:
    """docs with each row as often as its taken words make it up, rounded; rows with a size that round to 0 go, others stay once.

    Rounding by the row doesn't meet the targets of its source, as long documents all round alike; whole_documents() does.
    """
    keys = {"__id": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__size": word_count()}
    sized = docs.select("*", *(c.alias(k) for k, c in keys.items()))
    placed = _taken(docs.select(keys["__id"].alias("doc_id"), keys["__source"].alias("source"), keys["__size"].alias("size")), weights, block, seed, repeats)
    taken = F.expr(f"passes * size * n + {_drawn_before('end', block)} - {_drawn_before('begin', block)}")
    times = F.when(F.col("size") == 0, 1).otherwise(F.least(F.lit(repeats), F.round(taken / (F.col("size") * F.col("n"))))).cast("int")
    copies = stash(placed.select(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size"), times.alias("__times")).where("__times > 0"))
    same = F.col("__id").eqNullSafe(F.col("k_id")) & F.col("__source").eqNullSafe(F.col("k_source")) & (F.col("__size") == F.col("k_size"))
    # by shuffle at every size, as copies has a row per document
    return sized.join(copies.hint("merge"), same).withColumn("__time", F.explode(F.expr("sequence(1, __times)"))).select(*docs.columns)


def _whole(repeats: int):
    """Copies of a shard's rows: its words are owed evenly along its rows, and what a row takes over or under is carried on."""

    def run(shard: pa.Table) -> pa.Table:
        size, n, order, digest = (shard[c].to_numpy() for c in ("size", "n", "order", "digest"))
        words, votes = shard["words"][0].as_py(), shard["votes"][0].as_py()
        copies = n.copy()
        sizable = np.flatnonzero(size > 0)
        # longest first, in seeded order within a power of two: short rows even out what long ones leave
        sizable = sizable[np.lexsort((size[sizable], digest[sizable], order[sizable], -np.frexp(size[sizable])[1]))]
        place = given = 0
        for i in sizable.tolist():
            each, rows = int(size[i]), int(n[i])
            place += each * rows
            # one of 2^20 steps of a copy decides by seed, so no length is rounded away
            owed = (((words * place // votes - given) << 20) + each * (int(order[i]) & 0xFFFFF)) // (each << 20)
            copies[i] = min(max(owed, 0), repeats * rows)
            given += each * int(copies[i])
        # what is left at the end goes to the longest rows that bring the sum nearer
        for i in sizable.tolist():
            each, rows = int(size[i]), int(n[i])
            now = min(max(int(copies[i]) + (2 * (words - given) + each) // (2 * each), 0), repeats * rows)
            given += each * (now - int(copies[i]))
            copies[i] = now
        return pa.table({"doc_id": shard["doc_id"], "source": shard["source"], "size": shard["size"], "digest": shard["digest"], "n": shard["n"], "copies": copies})

    return run


def whole_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = 32, seed: int = 11, repeats: int = REPEATS) -> DataFrame:
    """docs with each row 0 to `repeats` times, so that the words of each source come near its target; rows of size 0 stay once.

    A shard's rows add up to its quota as nearly as one pass over them can bring it; repeated rows have their copies together.
    """
    told = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # maps and variants have no hash
    keys = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "size": word_count(), "digest": F.xxhash64(*(F.col(f"`{c}`") for c in told))}
    dealt, quotas = _dealt(docs.select(*(c.alias(k) for k, c in keys.items())), weights, block, seed, repeats, key=("doc_id", "digest"))
    shards = dealt.select("doc_id", "source", "size", "digest", "n", "order", "rank", "shard").join(quotas.select("rank", "shard", "words", "votes"), ["rank", "shard"])
    chosen = shards.groupBy("rank", "shard").applyInArrow(_whole(repeats), "doc_id long, source string, size long, digest long, n long, copies long")
    chosen = stash(chosen.where("copies > 0").select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("n").alias("__n"), F.col("copies").alias("__copies")))
    sized = docs.select("*", *(c.alias(f"__{k}") for k, c in keys.items()))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"__{k}").eqNullSafe(F.col(f"__k_{k}"))
    # by shuffle at every size, as chosen has a row per document
    joined = sized.join(chosen.hint("merge"), same)
    if not chosen.where("__n > 1").isEmpty():
        joined = joined.where("__n = 1").unionByName(joined.where("__n > 1").dropDuplicates([f"__{k}" for k in keys]))
    return joined.withColumn("__time", F.explode(F.expr("sequence(1L, __copies)"))).select(*docs.columns)
