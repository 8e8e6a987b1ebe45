"""Removal of long repeated passages by a compacted De Bruijn graph over words.

A k-mer is `window` consecutive words of one document. It is an edge from the node of its first window - 1 words to that of
its last ones. All steps are Spark aggregations and joins; rows of hot keys are salted (joins.py).

1. Candidates. The minimizer of a k-mer is the least hash of the GRAM-word runs in it; a document's neighbouring k-mers with
   one minimizer form a piece. Equal k-mers have equal minimizers, so only pieces whose minimizer occurs in different texts
   can hold a repeated edge; they are joined with those minimizers, after a Bloom filter of bounded size has
   spared the shuffle most others. Either all occurrences of an edge are candidates or none is.
2. Degrees. Each node's edges in and out are aggregated over all its occurrences, where the start and end of a text and
   edges that are no candidates count as edges of their own. A node with more than one in or out is branching.
3. Compaction. The branching nodes are joined back to where they occur. Between them, neighbouring edges are glued to one
   nonbranching path: wherever one edge of it occurs the whole path does.
4. Verification. The words of each path are read at its coordinates (document, first word, edges), and their SHA-256 is the
   path's identity from here on, so what the hashes of steps 1 to 3 say is never trusted for equality. An aggregation
   finds the smallest doc_id of each path that is in several documents; a join takes it back to the occurrences.
5. Words are removed where a path's source has a smaller doc_id.

Whole copies (equal word sequences) need no graph: only the smallest doc_id keeps its words. Windows are judged on the
input. Defined cases: null and empty texts have no words; texts shorter than a window keep all; very long texts are worked
on whole; repeated rows with one doc_id don't remove each other; different texts under one doc_id are documents of their
own that don't remove each other; a null doc_id counts as larger than all others (2^63-1 is reserved for it), and rows with one are
told apart by their texts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from .joins import split_join
from .shared import Block, bound_batches, discard, stash, text_blocks
from .words import BASES, SPACE, U, Words, _powers, mix, run_hashes, split_words, word_hashes

GRAM = 5
NO_ID = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch["doc_id"].cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _kept_bytes(block: Block, words: Words, keep: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by one space, end to end, and the rows' bounds.

    The byte before a word that isn't its row's first stands between words, so it serves as the space.
    """
    start, end, row = words.start[keep], words.end[keep], words.row[keep]
    rows = len(block.offsets) - 1
    bounds = np.zeros(rows + 1, np.int64)
    if not len(start):
        return np.zeros(0, np.uint8), bounds
    inner = np.r_[0, row[1:] == row[:-1]]
    step = np.zeros(len(block.data) + 1, np.int8)
    step[end] -= 1
    step[start - inner] += 1
    out = block.data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    out[space[out]] = 0x20
    np.cumsum(np.bincount(row, end - start + inner, rows).astype(np.int64), out=bounds[1:])
    return out, bounds


def _text_hashes(h: np.ndarray, words: Words) -> np.ndarray:
    """A hash of each row's word sequence, from differences of a running polynomial."""
    up, down, _ = _powers(max(1 << 18, 1 << int(len(h)).bit_length()), BASES[1])
    run = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=run[1:])
    count = np.diff(words.first)
    first = words.first[:-1]
    return mix((run[words.first[1:]] - run[first]) * down[first] + count.astype(U))


def _all_words(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray]:
    return _kept_bytes(block, words, np.ones(len(words.start), bool))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of the given size, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _pieces(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each k-mer of the block; of each piece its first word, number of k-mers and minimizer."""
    n = max(0, len(h) - window + 1)
    at = np.flatnonzero(words.row[:n] == words.row[window - 1 :][:n])
    grams = run_hashes(h, GRAM)
    least = grams[:n].copy()
    for j in range(1, window - GRAM + 1):
        np.minimum(least, grams[j : j + n], out=least)
    least, row = least[at], words.row[at]
    begins = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])]) if len(at) else np.zeros(0, np.int64)
    return at, at[begins], np.diff(np.r_[begins, len(at)]), least[begins]


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values))


def _profile(window: int):
    """Of each document: hash and number of its words, the digest of all of them, and its pieces' minimizers."""

    def run(batches):
        for batch in batches:
            ids = _ids(batch)
            for block in text_blocks(batch["text"]):
                words = split_words(block)
                h = word_hashes(block, words)
                _, first, _, least = _pieces(words, h, window)
                joined, bounds = _all_words(block, words)
                raw = memoryview(joined)
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
                rows = block.stop - block.start
                columns = [pa.array(ids[block.start : block.stop]), batch["jid"].slice(block.start, rows), pa.array(_text_hashes(h, words).view(np.int64)), pa.array(np.diff(words.first)), pa.array(sha)]
                yield pa.RecordBatch.from_arrays([*columns, _lists(least.view(np.int64), np.bincount(words.row[first], minlength=rows))], ["doc_id", "jid", "th", "n_words", "sha", "ms"])

    return run


def _candidates(window: int, filters):
    """Pieces whose minimizer may repeat: their nodes, and the edges before, between and behind these (0: end of the text)."""

    def run(batches):
        for batch in batches:
            for block in text_blocks(batch["text"]):
                words = split_words(block)
                h = word_hashes(block, words)
                at, first, count, least = _pieces(words, h, window)
                some = bitfilter.might_contain(filters.value, least)
                first, count, least = first[some], count[some], least[some]
                edges = np.zeros(len(h) + 2, U)
                edges[at + 1] = np.maximum(run_hashes(h, window)[at], U(1))
                row = words.row[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least.view(np.int64)),
                        batch["jid"].slice(block.start).take(pa.array(row)),
                        pa.array(_text_hashes(h, words)[row].view(np.int64)),
                        pa.array((first - words.first[row]).astype(np.int32)),
                        _lists(run_hashes(h, window - 1)[_spread(first, count + 1)].view(np.int64), count + 1),
                        _lists(edges[_spread(first, count + 2)].view(np.int64), count + 2),
                    ],
                    ["m", "jid", "th", "first", "nodes", "edges"],
                )

    return run


def _may_branch(filters):
    """Where nodes stand that may be branching."""

    def run(batches):
        for batch in batches:
            nodes = batch["nodes"]
            size = nodes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = nodes.flatten().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(bitfilter.might_contain(filters.value, flat.view(U)))
            piece = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            own = pa.array(piece[some])
            first = batch["first"].to_numpy(zero_copy_only=False)[piece[some]] + place[some]
            yield pa.RecordBatch.from_arrays([pa.array(flat[some]), batch["jid"].take(own), batch["th"].take(own), pa.array(first.astype(np.int32))], ["node", "jid", "th", "first"])

    return run


def _marks(block: Block, batch: pa.RecordBatch, words: Words, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's rows' marks, as places among its words and numbers of windows; marks of another text with the same jid don't count."""
    own = batch.slice(block.start, block.stop - block.start)
    mine = own["th"].to_numpy(zero_copy_only=False).view(U) == th
    row = np.repeat(np.arange(len(th)), own["marks"].value_lengths().to_numpy(zero_copy_only=False))
    flat = own["marks"].flatten().to_numpy(zero_copy_only=False)
    row, flat = row[mine[row]], flat[mine[row]]
    return words.first[row] + (flat >> 32), flat & 0xFFFFFFFF


def _covered(words: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + size, -1)
    return np.cumsum(step[:-1]) > 0


def _verified(window: int):
    """The nonbranching paths of each document, with the digest of their words. Marks: pieces, and branching nodes with windows 0."""

    def run(batches):
        for batch in batches:
            ids = _ids(batch)
            for block in text_blocks(batch["text"]):
                words = split_words(block)
                th = _text_hashes(word_hashes(block, words), words)
                first, n = _marks(block, batch, words, th)
                edge = _covered(len(words.start), first[n > 0], n[n > 0])
                opens = edge.copy()
                opens[1:] &= ~edge[:-1]
                cut = np.zeros(len(edge), bool)
                cut[first[(n == 0) & (first < len(edge))]] = True
                opens |= edge & cut
                shuts = edge.copy()
                shuts[:-1] &= ~edge[1:] | opens[1:]
                start, last = np.flatnonzero(opens), np.flatnonzero(shuts) + window - 1
                joined, bounds = _all_words(block, words)
                size = words.end - words.start
                inner = np.r_[0, words.row[1:] == words.row[:-1]][: len(size)]
                end = np.cumsum(size + inner)
                raw = memoryview(joined)
                digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip((end - size)[start].tolist(), end[last].tolist())]
                row = words.row[start]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digest, pa.binary()), pa.array(ids[block.start + row]), batch["jid"].slice(block.start).take(pa.array(row)), pa.array(th[row].view(np.int64)),
                        pa.array((start - words.first[row]).astype(np.int32)), pa.array((last - start - window + 2).astype(np.int32)),
                    ],
                    ["path", "doc_id", "jid", "th", "first", "windows"],
                )

    return run


def _only(ids):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(bitfilter.might_contain(ids.value, batch["jid"].to_numpy(zero_copy_only=False).view(U))))

    return run


def _without(window: int):
    """Removes the marked paths from the texts."""

    def run(batches):
        for batch in batches:
            for block in text_blocks(batch["text"]):
                words = split_words(block)
                th = _text_hashes(word_hashes(block, words), words)
                first, n = _marks(block, batch, words, th)
                gone = _covered(len(words.start), first, n + window - 1)
                joined, bounds = _kept_bytes(block, words, ~gone)
                raw = memoryview(joined)
                rows = block.stop - block.start
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["jid"].slice(block.start, rows),
                        pa.array(th.view(np.int64)),
                        pa.array(np.bincount(words.row[gone], minlength=rows).astype(np.int64)),
                        pa.array([bytes(raw[a:b]).decode() for a, b in zip(bounds[:-1], bounds[1:])], pa.large_string()).cast(pa.string()),
                    ],
                    ["jid", "th", "n_removed", "kept"],
                )

    return run


def _with_marks(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, jid, text, th and marks (first << 32 | windows) of the documents that have places (jid, th, first, windows), of repeated rows once."""
    mark = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("windows").cast("long"))
    marks = stash(places.groupBy("jid", "th").agg(F.collect_set(mark).alias("marks")))
    bits = bitfilter.build(marks, "jid", bitfilter.filter_bits(marks.count()))
    some = docs.mapInArrow(_only(docs.sparkSession.sparkContext.broadcast(bits)), "doc_id long, jid long, text string")
    out = some.join(marks, "jid")
    out._marks = marks
    return out


def compacted_paths(docs: DataFrame, profile: DataFrame, window: int = 13) -> DataFrame:
    """Steps 1 to 4: path (digest), doc_id, jid, th, first, windows of each nonbranching path over candidates. docs: doc_id, jid, text."""
    spark = docs.sparkSession
    shared = profile.select("th", F.explode("ms").alias("m")).groupBy("m").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.count("*").alias("n"))
    shared = stash(shared.where("a != b").select("m", "n"))
    keys, rows = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = spark.sparkContext.broadcast(bitfilter.build(shared, "m", bitfilter.filter_bits(keys)))
    found = docs.mapInArrow(_candidates(window, bits), "m long, jid long, th long, first int, nodes array<long>, edges array<long>")
    pieces = stash(split_join(found, shared, "m", rows, F.xxhash64("jid", "first")).select("jid", "th", "first", "nodes", "edges"))
    discard(shared)
    each = pieces.select(F.posexplode("nodes").alias("i", "node"), "edges").select("node", F.expr("edges[i]").alias("into"), F.expr("edges[i + 1]").alias("out"))
    degrees = each.groupBy("node").agg(*(f(c).alias(f"{c}_{n}") for c in ("into", "out") for n, f in (("least", F.min), ("most", F.max))), F.count("*").alias("n"))
    branching = stash(degrees.where("into_least != into_most or out_least != out_most").select("node", "n"))
    keys, rows = branching.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = spark.sparkContext.broadcast(bitfilter.build(branching, "node", bitfilter.filter_bits(keys)))
    cuts = pieces.select("jid", "th", "first", "nodes").mapInArrow(_may_branch(bits), "node long, jid long, th long, first int")
    cuts = split_join(cuts, branching, "node", rows, F.xxhash64("jid", "first")).select("jid", "th", "first", F.lit(0).alias("windows"))
    marked = _with_marks(docs, cuts.unionByName(pieces.select("jid", "th", "first", (F.size("nodes") - 1).alias("windows"))))
    paths = stash(marked.mapInArrow(_verified(window), "path binary, doc_id long, jid long, th long, first int, windows int"))
    discard(pieces, branching, marked._marks)
    return paths


def repeated_paths(paths: DataFrame) -> DataFrame:
    """jid, th, first, windows of the paths that also stand in a document with a smaller doc_id."""
    sources = stash(paths.groupBy("path").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("source < last").select("path", "source", "n"))
    rows = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = split_join(paths, sources, "path", rows, F.xxhash64("jid", "first")).where("doc_id > source").select("jid", "th", "first", "windows")
    again._sources = sources
    return again


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space; null where all or none went), kept_sha256."""
    if window <= GRAM:
        raise ValueError(f"window must be over {GRAM}")
    docs = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("jid"), "text")
    profile = stash(docs.mapInArrow(_profile(window), "doc_id long, jid long, th long, n_words long, sha string, ms array<long>"))
    paths = compacted_paths(docs, profile, window)
    again = repeated_paths(paths)
    marked = _with_marks(docs, again)
    left = marked.mapInArrow(_without(window), "jid long, th long, n_removed long, kept string")
    left = stash(left.where("n_removed > 0").dropDuplicates(["jid", "th"]).withColumn("kept_sha256", F.sha2("kept", 256)))
    discard(paths, again._sources, marked._marks)
    sources = stash(profile.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sha", F.lit(True).alias("source")))
    copy = F.col("source").isNull() & (F.col("n_words") >= window)
    return (
        profile.drop("ms").join(sources, ["doc_id", "sha"], "left").join(left, ["jid", "th"], "left")
        .select(
            F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(~copy, F.col("kept")).alias("kept"),
            F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )
