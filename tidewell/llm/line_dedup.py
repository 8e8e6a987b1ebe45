"""Line deduplication with DataFrame functions only: lines that stand in many documents go from all of them.

Each row's lines are normalised and hashed (MD5, 128 bits) in one pass over the texts, which leaves a table of a row's key
and its lines' hashes in order. A row's distinct hashes are exploded and counted: each row gives a hash once, so the count is
of documents, and it is combined before the shuffle, so the commonest line costs one row a task. The hashes over the
threshold are looked up again by position (a semi-join, in which Spark splits the partitions of hot hashes), the positions
to drop are gathered per row (no more of them than its lines), and the texts, shuffled once, are put together again from the
other positions in their order.

Defined cases: each row is a document, so repeated rows and rows that share a doc_id count one by one. A null text counts as
one empty line and stays null; an empty text is one empty line. Keys shorter than `shortest` code points are never dropped, so
by default blank lines stay. A text all of whose lines go becomes empty. Very long texts are split within their row by
expressions that are linear in their length; a row must fit into a task. An empty table gives an empty result. Other columns
stay as they are; n_lines and n_dropped are added behind `prefix`, and a name that clashes is refused.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

LEAST, SHORTEST = 10, 1
#: What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
ID = ["__id1", "__id2"]


def _lower(x: Column) -> Column:
    """A-Z in lower case and nothing else. Texts of one byte a character take the faster function."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _identity(docs: DataFrame, text: str) -> list[Column]:
    """128 bits that rows have in common only if their texts, and their other plain columns, are equal."""
    kept = [F.col(c) for c, kind in docs.dtypes if c != text and "map<" not in kind and "variant" not in kind]
    return [F.xxhash64(F.lit(i), F.col(text), *kept).alias(c) for i, c in enumerate(ID)]


def line_hashes(docs: DataFrame, shortest: int = SHORTEST, text: str = "text") -> DataFrame:
    """Each row's key and `hashes`, one for each of its lines in order; null for a line whose key is too short to count.

    The lower case is taken of the whole text, which has the same lines.
    """
    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= shortest, F.md5(key.cast("binary")))

    lowered = F.split(_lower(F.coalesce(F.col(text), F.lit(""))), "\n", -1)
    return docs.select(*_identity(docs, text), F.transform(lowered, hashed).alias("hashes"))


def frequent_lines(hashes: DataFrame, least: int = LEAST) -> DataFrame:
    """hash, n: the lines found in at least `least` documents, and in how many."""
    each = hashes.select(F.explode(F.array_distinct("hashes")).alias("hash")).where("hash is not null")
    return each.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def line_dedup(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, text: str = "text", prefix: str = "") -> DataFrame:
    """docs, with the text that is left and `n_lines` (before dropping) and `n_dropped`."""
    added = {f"{prefix}n_lines", f"{prefix}n_dropped"}
    if clash := added & set(docs.columns):
        raise ValueError(f"{', '.join(sorted(clash))} would stand twice; give a prefix")
    if least < 1:
        raise ValueError("least must be positive")
    hashes = stash(line_hashes(docs, shortest, text))
    frequent = stash(frequent_lines(hashes, least).select("hash"))
    lines = hashes.select(*ID, F.posexplode("hashes").alias("place", "hash")).where("hash is not null")
    drops = lines.join(frequent, "hash", "left_semi").groupBy(*ID).agg(F.collect_set("place").alias("__drop"))
    none = F.array().cast("array<int>")
    with_drops = docs.withColumns(dict(zip(ID, _identity(docs, text), strict=True))).join(drops, ID, "left").withColumn("__drop", F.coalesce("__drop", none))

    def put_together(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.struct(F.size(lines).cast("long").alias("n"), F.array_join(F.transform(kept, lambda i: lines[i]), "\n").alias("text"))

    # the lines are bound to a variable, so that the text is split once
    put = with_drops.withColumn("__put", F.transform(F.array(_lines(text)), put_together)[0])
    out = {text: F.when(F.col(text).isNotNull(), F.col("__put.text"))}
    columns = [out[c].alias(c) if c == text else F.col(c) for c in docs.columns]
    return put.select(*columns, F.col("__put.n").alias(f"{prefix}n_lines"), F.size("__drop").cast("long").alias(f"{prefix}n_dropped"))


def digests(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left (null: of the empty one)."""
    out = line_dedup(docs.select("doc_id", "text"), least, shortest)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle(least: int = LEAST, shortest: int = SHORTEST) -> str:
    """DuckDB SQL for digests() over documents."""
    return f"""
with numbered as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
each_line as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from numbered),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as key from each_line),
frequent as (select key from keyed where length(key) >= {shortest} group by key having count(distinct r) >= {least}),
marked as (select k.*, f.key is not null as dropped from keyed k left join frequent f on f.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '')) as kept_sha256
from marked group by r, doc_id"""
