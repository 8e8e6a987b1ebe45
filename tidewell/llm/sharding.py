"""Sharding by extendible hashing, with DataFrame functions only.

A row's key columns are hashed to BITS bits. The directory is indexed by the leading bits of the hash; only a bucket whose
bytes are over the limit splits on one more bit, so a shard is a prefix of any length, the shortest within the limit.

Bytes are aggregated once by prefixes long enough for 2^SPARE to a shard, and from there to shorter prefixes, LEVELS bits at
a time, so each step reads a table 2^LEVELS times smaller than the one before. A shard is entered in the directory under
each prefix of full length that it covers. Where a prefix of full length is still over the limit, its rows alone are aggregated again at
STEP bits more, and so on. Partial sums go before each shuffle, so a hot bucket costs one row a task. Rows look their prefix
up by a shuffle on it at every size; the limit bounds the bytes under a prefix, and rows that weigh nothing are dealt over
ZEROS entries of their prefix.

Defined cases: a row over the limit by itself has a shard of its own. Rows that no bit can part (repeated rows) go to
overflow shards: distinct rows are counted, and the copies of each are dealt to shards of as many as the limit takes.
Null keys hash like empty ones; a null text weighs only `overhead` bytes; very long texts are only measured and hashed; an empty
table gives an empty result. The columns of docs stay as they are; `prefix` goes before the names of the new ones, and a
name that clashes is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stash

SPARE = 4
LEVELS = 4
STEP = 8
BITS = 60
ZEROS = 64
HASH, BYTES, PLACE = "__hash", "__bytes", "__place"


def _prefix(bits: Column | int, column: str = HASH) -> Column:
    """The leading bits of the hash, as a number."""
    return F.expr(f"shiftright({column}, {BITS - bits})")


def key_hash(*columns: str) -> Column:
    """The first BITS bits of the MD5 of the columns' texts joined by |."""
    joined = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(joined), 1, BITS // 4), 16, 10).cast("long")


def _directory(sizes: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """The directory's entries: each prefix of `high` bits (__place) with the shard it belongs to; prefixes over the limit have none.

    sizes: __place, __bytes, n of the prefixes that occur.
    """
    now, depth, sums = sizes.select(F.col(PLACE).alias("own"), F.col(BYTES).alias("shard_bytes"), "n"), high, []
    while True:
        least = max(low, depth - LEVELS)
        levels = now.select("shard_bytes", "n", "own", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("depth")).withColumn("own", F.expr(f"shiftright(own, {depth} - depth)"))
        found = stash(levels.groupBy("depth", "own").agg(F.sum("shard_bytes").alias("shard_bytes"), F.sum("n").alias("n")))
        sums.append(found if depth == high else found.where(F.col("depth") < depth))
        if least == low:
            break
        now, depth = found.where(F.col("depth") == least).drop("depth"), least
    every = sums[0]
    for more in sums[1:]:
        every = every.unionByName(more)
    fits = (F.col("shard_bytes") <= limit) | (F.col("n") == 1)
    full = every.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("own").alias("parent"))
    # the shortest that fits: the next shorter prefix is over the limit
    shards = every.where(fits).withColumn("parent", F.expr("shiftright(own, 1)"))
    shards = shards.where(F.col("depth") == low).unionByName(shards.where(F.col("depth") > low).join(full.hint("merge"), ["depth", "parent"], "left_semi"))
    entries = F.expr(f"sequence(shiftleft(own, {high} - depth), shiftleft(own + 1, {high} - depth) - 1)")
    return shards.select(F.explode(entries).alias(PLACE), "depth", "own", "shard_bytes")


def _looked_up(rows: DataFrame, directory: DataFrame, weightless: DataFrame, high: int) -> DataFrame:
    """rows with the entry of their prefix. Rows without bytes, which no limit bounds, are dealt over ZEROS copies of it; only the prefixes
    that hold such rows (`weightless`) are copied."""
    salt = F.when(F.col(BYTES) == 0, F.pmod(F.col(HASH), F.lit(ZEROS))).otherwise(F.lit(-1)).cast("int")
    copies = directory.join(weightless, PLACE, "left_semi").withColumn("__salt", F.explode(F.expr(f"sequence(0, {ZEROS - 1})")))
    salted = directory.withColumn("__salt", F.lit(-1)).unionByName(copies)
    return rows.withColumns({PLACE: _prefix(high), "__salt": salt}).join(salted.hint("merge"), [PLACE, "__salt"]).drop("__salt")


def _overflow(rows: DataFrame, carry: list[str], limit: int) -> DataFrame:
    """Rows that share all bits: each distinct row's copies in shards of their own."""
    each = rows.groupBy(*carry, HASH, BYTES).agg(F.count("*").alias("__n"))
    each = each.withColumn("__per", F.greatest(F.lit(1), F.expr(f"{limit} div greatest(1, {BYTES})")))
    each = each.withColumn("__i", F.explode(F.expr("sequence(1L, __n)"))).withColumn("__k", F.expr("(__i - 1) div __per"))
    name = F.concat(F.lit("b"), F.lpad(F.conv(F.col(HASH).cast("string"), 10, 2), BITS, "0"), F.lit("."), F.hex(F.xxhash64(*carry)), F.lit("."), F.col("__k"))
    return each.select(*carry, BYTES, name.alias("__shard"), F.lit(BITS).alias("__depth"), (F.least("__per", F.expr("__n - __k * __per")) * F.col(BYTES)).alias("__shard_bytes"))


def extendible_shards(docs: DataFrame, limit: int, key: tuple[str, ...] = ("doc_id", "text"), text: str = "text", overhead: int = 0, prefix: str = "", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all by default) with shard, depth, shard_bytes and row_bytes.

    limit: greatest bytes of a shard; a row weighs its text's UTF-8 bytes and overhead. shard: b and the prefix's bits, for
    overflow shards also the row's hash and a number.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    carry = docs.columns if carry is None else carry
    clash = {f"{prefix}{c}" for c in ("shard", "depth", "shard_bytes", "row_bytes")} & set(carry)
    if clash:
        raise ValueError(f"{', '.join(sorted(clash))} would stand twice; give a prefix")
    weight = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(overhead)).cast("long").alias(BYTES)
    rows = docs.select(*carry, key_hash(*key).alias(HASH), weight)
    light = text not in carry
    if light:  # without the texts the rows are small: they are hashed once
        rows = stash(rows)
    keys = rows.select(HASH, BYTES) if light else stash(docs.select(key_hash(*key).alias(HASH), weight))
    rest, total = keys, keys.agg(F.sum(BYTES)).first()[0] or 0
    low, high, out = 0, min(BITS, (-(-total // limit)).bit_length() + SPARE), []
    while True:
        sizes = stash(rest.groupBy(_prefix(high).alias(PLACE)).agg(F.sum(BYTES).alias(BYTES), F.count("*").alias("n"), F.count_if(F.col(BYTES) == 0).alias("zeros")))
        bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("own").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
        found = _directory(sizes.drop("zeros"), low, high, limit)
        found = stash(found.select(PLACE, F.concat(F.lit("b"), bits).alias("__shard"), F.col("depth").alias("__depth"), F.col("shard_bytes").alias("__shard_bytes")))
        weightless = stash(sizes.where("zeros > 0").select(PLACE))
        out.append(_looked_up(rows, found, weightless, high).select(*carry, BYTES, "__shard", "__depth", "__shard_bytes"))
        over = stash(sizes.where((F.col(BYTES) > limit) & (F.col("n") > 1)).select(PLACE))
        discard(sizes)
        if over.isEmpty():
            break
        if high == BITS:
            out.append(_overflow(rows.withColumn(PLACE, F.col(HASH)).join(over, PLACE, "left_semi").drop(PLACE), carry, limit))
            break
        rest = stash(rest.withColumn(PLACE, _prefix(high)).join(over, PLACE, "left_semi").drop(PLACE))
        low, high = high + 1, min(BITS, high + STEP)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select(*carry, F.col("__shard").alias(f"{prefix}shard"), F.col("__depth").cast("int").alias(f"{prefix}depth"), F.col("__shard_bytes").alias(f"{prefix}shard_bytes"), F.col(BYTES).alias(f"{prefix}row_bytes"))


def oracle(limit: int) -> str:
    """DuckDB SQL for the query over documents, for tables of up to 2^24 shards."""
    return f"""
with h as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as row_bytes,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
levels as (select *, d, h >> (60 - d) as own from h, (select unnest(range(0, 25))::integer as d)),
sums as (select d, own, sum(row_bytes)::bigint as shard_bytes, count(*) as n from levels group by d, own),
fitting as (select l.doc_id, l.row_bytes, l.h, l.d, l.own, s.shard_bytes,
              row_number() over (partition by l.doc_id, l.h order by l.d) as k
            from levels l join sums s on s.d = l.d and s.own = l.own where s.shard_bytes <= {limit} or s.n = 1)
select doc_id, 'b' || case when d = 0 then '' else right(lpad(bin(own), 60, '0'), d) end as shard, d as depth, shard_bytes, row_bytes
from fitting where k = 1"""
