"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in up to RADIUS = 3 bits meet: each emits the variants of itself within half the radius. As half
of three bits is one and a half, fingerprints with an even number of set bits emit their ball of radius 1 and those with an
odd number also variants two bits away; a pair at distance 3 has one of each parity. Of its three differing bits two lie in
the same half of the word, so only two-bit variants within one half are needed: 65 or 65 + 992 variants.

Variants are shuffled. Whatever meets in a variant is at distance 3 or less from any member that has the variant in its
ball of radius 1 (1 + 2 bits at most), so the least such member gets a link from each other one: no pair within a group is
emitted but with that hub, no hot group grows as its square, and each link is a true one. A variant has at most 1 + 64 +
2016 members. Links are deduplicated, verified by their fingerprints' distance, and merged into components by star contraction with
Spark joins; each round's links are a table in the shared folder.

Defined cases: words are [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case; null, empty and wordless texts have
fingerprint 0 and link like any other; fewer than `shingle` words make one shingle; a bit with exactly half the shingles
is 0; repeated rows each get a row; a null doc_id gets the class of its fingerprint but never names one (2^63-1 stands
for it where nothing else is in the class); different texts under one doc_id are linked by their fingerprints alone, so two
classes may bear one name; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bound_batches, discard, stash, text_blocks
from .substring_dedup import NO_ID, _kept_bytes
from .words import split_words

RADIUS = 3
#: Variants of one task; a task holds them at once, 17 bytes each.
TASK_VARIANTS = 3_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NEAR = [0, *(1 << i for i in range(64))]
FAR = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(shingle: int):
    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            ids = batch["doc_id"]
            for block in text_blocks(batch["text"]):
                block.data = LOWER[block.data]
                words = split_words(block)
                joined, bounds = _kept_bytes(block, words, np.ones(len(words.start), bool))
                raw = joined.tobytes()
                spaces = np.flatnonzero(joined == 0x20)
                size = np.zeros(len(bounds) - 1, np.int64)
                out = np.zeros(len(size), np.uint64)
                for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if a == b:
                        continue
                    gaps = spaces[np.searchsorted(spaces, a) : np.searchsorted(spaces, b)]
                    if len(gaps) + 1 <= shingle:
                        starts, ends = [a], [b]
                    else:
                        starts = [a, *(gaps[: len(gaps) - shingle + 1] + 1).tolist()]
                        ends = [*gaps[shingle - 1 :].tolist(), b]
                    h = np.fromiter([digest(raw[s:e], 42) for s, e in zip(starts, ends)], np.uint64, len(starts))
                    out[r] = majority(h)
                yield pa.RecordBatch.from_arrays([ids.slice(block.start, block.stop - block.start), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def majority(h: np.ndarray) -> np.uint64:
    """The word whose bits are those set in more than half of h."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per row of docs: doc_id and fp, the 64 bits of its fingerprint as a bigint."""
    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _meet(batches):
    """Links of each variant's members to the variant's hub; all rows of a variant are in this task."""
    variant, rep, far = [], [], []
    for b in batches:
        variant.append(b["variant"].to_numpy())
        rep.append(b["rep"].to_numpy())
        far.append(b["far"].to_numpy(zero_copy_only=False))
    if not variant:
        return
    variant, rep, far = map(np.concatenate, (variant, rep, far))
    order = np.argsort(variant)
    met = variant[order[1:]] == variant[order[:-1]]
    order = order[np.r_[False, met] | np.r_[met, False]] if len(order) > 1 else order[:0]
    variant, rep, far = variant[order], rep[order], far[order]
    order = np.lexsort((rep, far, variant))
    variant, rep, far = variant[order], rep[order], far[order]
    if not len(variant):
        return
    begins = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    hub = np.repeat(begins, np.diff(np.r_[begins, len(variant)]))
    linked = ~far[hub] & (rep != rep[hub])
    pairs = np.unique(np.stack([np.minimum(rep, rep[hub])[linked], np.maximum(rep, rep[hub])[linked]]), axis=1)
    for i in range(0, pairs.shape[1], 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0, i : i + 100_000]), pa.array(pairs[1, i : i + 100_000])], ["a", "b"])


def links(reps: DataFrame) -> DataFrame:
    """Links a < b between rows (rep, fp) with distinct fingerprints: enough to connect every two at distance RADIUS or less."""
    n = reps.count()
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * (len(NEAR) + len(FAR) // 2) // TASK_VARIANTS))
    ends = {side: reps.select(F.col("rep").alias(side), F.col("fp").alias(f"fp_{side}")) for side in "ab"}
    reps = reps.repartition(parts, "fp")
    odd = F.expr("bit_count(fp) % 2 = 1")
    masks = lambda of: F.array(*(F.lit(_signed(m)) for m in of))
    near = reps.select("rep", F.explode(masks(NEAR)).alias("mask"), "fp").select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "rep", F.lit(False).alias("far"))
    two = reps.where(odd).select("rep", F.explode(masks(FAR)).alias("mask"), "fp").select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "rep", F.lit(True).alias("far"))
    met = near.unionByName(two).repartition(parts, "variant").mapInArrow(_meet, "a long, b long").distinct()
    return met.join(ends["a"], "a").join(ends["b"], "b").where(F.expr(f"bit_count(fp_a ^ fp_b) <= {RADIUS}")).select("a", "b")


def _classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per fingerprint: fp, least (its doc_id), root (a number of its component), n_spanning_links; per component: root, and the doc_id and fp that come first, null last."""
    # nodes are numbers of the fingerprints, unique whatever the doc_ids are, in an order that doesn't depend on the arrangement
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).orderBy(F.col("least").asc_nulls_last(), "fp")
    reps = stash(least.withColumn("rep", F.monotonically_increasing_id()))
    found = stash(links(reps.select("rep", "fp")))
    ends = found.select(F.col("a").alias("rep")).unionAll(found.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_spanning_links"))
    labels = components(found)
    joined = reps.join(labels, F.col("rep") == F.col("node"), "left").join(ends, "rep", "left")
    classes = stash(joined.select("fp", "least", F.coalesce("component", "rep").alias("root"), F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links")))
    discard(found, reps)
    first = F.min(F.struct(F.col("least").isNull().alias("no_id"), F.col("least").alias("doc_id"), "fp"))
    heads = stash(classes.groupBy("root").agg(first.alias("head")).select("root", "head.doc_id", "head.fp"))
    return classes, heads


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (the least doc_id reachable over links) and n_spanning_links of its fingerprint.

    The latter counts the links to and from hubs that connect a component, not all fingerprints within RADIUS.
    """
    prints = stash(fingerprints(docs, shingle))
    classes, heads = _classes(prints)
    named = stash(classes.join(heads.select("root", F.coalesce("doc_id", F.lit(NO_ID)).alias("component_id")), "root").select("fp", "component_id", "n_spanning_links"))
    discard(classes, heads)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "n_spanning_links")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of docs, with all columns, of each component: the first by doc_id and fingerprint, null last.

    Of repeated rows, and of rows alike in doc_id and fingerprint, one stays.
    """
    prints = stash(fingerprints(docs, shingle))
    _, heads = _classes(prints)
    rows = prints.groupBy("doc_id").agg(F.count("*").alias("rows"))
    heads = stash(heads.join(rows.hint("merge"), heads["doc_id"].eqNullSafe(rows["doc_id"])).select(heads["doc_id"].alias("__id"), heads["fp"].alias("__fp"), "rows"))
    columns = docs.columns
    named = docs.withColumn("__id", F.col("doc_id").cast("long"))
    # by shuffle at every size, as heads has a row per component
    kept = named.join(heads.where("rows = 1 and __id is not null").select("__id").hint("merge"), "__id").select(*columns)
    # rows that their doc_id doesn't tell apart are told by their fingerprints
    many = heads.where("rows > 1 and __id is not null").select("__id").distinct()
    alike = [] if many.isEmpty() else [named.join(many.hint("merge"), "__id", "left_semi").select(*columns)]
    alike += [] if heads.where("__id is null").isEmpty() else [named.where("__id is null").select(*columns)]
    for more in alike:
        kept = kept.unionByName(_first_rows(more, heads.select("__id", "__fp"), shingle))
    return kept


def _first_rows(docs: DataFrame, heads: DataFrame, shingle: int) -> DataFrame:
    """One row of docs for each doc_id and fingerprint of heads (__id, __fp) that it holds."""
    numbered = stash(docs.withColumn("__n", F.monotonically_increasing_id()))
    prints = fingerprints(numbered.select(F.col("__n").alias("doc_id"), "text"), shingle).withColumnRenamed("doc_id", "__n")
    ids = numbered.select("__n", F.col("doc_id").cast("long").alias("__own"))
    told = prints.join(ids, "__n")
    first = told.join(heads, told["__own"].eqNullSafe(heads["__id"]) & (told["fp"] == heads["__fp"])).groupBy("__own", "fp").agg(F.min("__n").alias("__n")).select("__n")
    return numbered.join(first, "__n", "left_semi").select(*docs.columns)
