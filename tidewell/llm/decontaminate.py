"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then overlap of question and answer.

The index is over the items; every passage of every training text is a query. Words are runs of ASCII letters and digits and of bytes
over 0x7F, A-Z in lower case. Passages are windows of 2 * stride words every `stride` words, where stride is at least the longest item
of the index, so each place where an item could stand lies whole in one.

* An item's impact of a term is its BM25 weight over the sum of all its terms' weights, so a score of 1 is an item's whole
  vocabulary. Everything above RETRIEVE is retrieved.
* Block-max WAND: items stand in blocks of BLOCK (larger where there would be over MOST_BLOCKS); a block's bound for a term is the greatest impact in it. The commonest
  terms, whose greatest impacts add up to no more than FREE, never open a block; the others' bounds are added up by passage
  and block, a stretch of CELLS at a time, and only blocks that reach RETRIEVE - FREE are scored: of a term with many postings those
  between the block's bounds are sought and the others passed over. No item above the threshold is missed.
* A retrieved item is verified on its five-word shingles: at least OVERLAP of the question's and of the answer's must be in
  the passage. The answer is what follows the last sentence end, line or `?` inside the item; an item of one sentence is its
  own question and answer. A part of under five words is one shingle, and so is an item of under five words as a whole.

The index of a slice of items goes to all executors; a slice has at most SLICE_BYTES of item text, further slices are scans
of their own, under the weights and the stride of all items together. Defined cases: null and empty texts hold no passages; items without a word (SHORTEST) are left out; equal items
each match; rows repeat as they come; a null doc_id or item_id stays null in the result; other
columns are kept by clean() and ignored by leaks(); empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_scan import LOWER, NOT_WORD
from .shared import Block, bound_batches, text_blocks
from .words import U, run_hashes, split_words, word_hashes

K1, B = 1.2, 0.75
RETRIEVE, FREE = 0.5, 0.2
OVERLAP = 0.8
SHINGLE, SHORTEST, BLOCK, STRIDE = 5, 1, 2, 64
MOST_BLOCKS = 2048
#: Window strides times blocks whose bounds are held at once, whatever the length of a text.
CELLS = 1 << 18
#: A search for a block's bounds among a term's postings costs as much as so many postings.
SEEK = 8
SLICE_BYTES = 8 << 20
SENTENCE_END = re.compile(rb"[.!?\n]\s+")


def tokens(block: Block):
    """Words of a block and their hashes."""
    low = Block(block.start, block.stop, LOWER[block.data], block.offsets)
    words = split_words(low, NOT_WORD)
    return words, word_hashes(low, words)


def _shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(run_hashes(h, min(SHINGLE, len(h))))


@dataclass
class Index:
    """Postings by term: terms (sorted hashes) from begin[t] to begin[t + 1] in item, impact; sought is term * items + item; the same by block in block_*."""

    ids: np.ndarray
    nameless: np.ndarray
    parts: list[tuple[np.ndarray, int, np.ndarray, int]]
    stride: int
    terms: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    sought: np.ndarray
    impact: np.ndarray
    opening: np.ndarray
    block_begin: np.ndarray
    block: np.ndarray
    block_impact: np.ndarray
    filter: np.ndarray
    blocks: int
    size: int


@dataclass
class Totals:
    """What weights depend on over all items: how many, their words, the longest's words, and each term's items."""

    n: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


def totals(texts: pa.Array) -> Totals:
    length, terms = [], []
    for block in text_blocks(texts):
        words, h = tokens(block)
        for a, b in zip(words.first[:-1], words.first[1:]):
            if b - a >= SHORTEST:
                length.append(int(b - a))
                terms.append(np.unique(h[a:b]))
    found, df = np.unique(np.concatenate(terms), return_counts=True) if terms else (np.zeros(0, U), np.zeros(0, np.int64))
    return Totals(len(length), sum(length), max(length, default=0), found, df)


def _together(a: Totals, b: Totals) -> Totals:
    terms, place = np.unique(np.concatenate([a.terms, b.terms]), return_inverse=True)
    df = np.bincount(place, np.concatenate([a.df, b.df]), len(terms)).astype(np.int64)
    return Totals(a.n + b.n, a.words + b.words, max(a.longest, b.longest), terms, df)


def build(ids: np.ndarray, texts: pa.Array, nameless: np.ndarray | None = None, over: Totals | None = None) -> Index | None:
    """The index of a slice of items, of which `nameless` have no id; None without any that is long enough. over: of all slices."""
    over = over or totals(texts)
    nameless = np.zeros(len(ids), bool) if nameless is None else nameless
    kept, bags, parts = [], [], []
    for block in text_blocks(texts):
        words, h = tokens(block)
        for r in range(block.stop - block.start):
            a, b = words.first[r], words.first[r + 1]
            if b - a < SHORTEST:
                continue
            raw = block.data[block.offsets[r] : block.offsets[r + 1]].tobytes()
            cuts = [m.end() + block.offsets[r] for m in SENTENCE_END.finditer(raw)]
            places = np.unique(np.searchsorted(words.start[a:b], cuts))
            places = places[(places > 0) & (places < b - a)]
            cut = int(places[-1]) if len(places) and b - a >= SHINGLE else 0
            question, answer = (h[a : a + cut], h[a + cut : b]) if cut else (h[a:b], h[a:b])
            parts.append((_shingles(question), min(SHINGLE, len(question)), _shingles(answer), min(SHINGLE, len(answer))))
            bags.append(np.unique(h[a:b], return_counts=True))
            kept.append(block.start + r)
    if not kept:
        return None
    n, length = len(kept), np.array([c.sum() for _, c in bags])
    term = np.concatenate([t for t, _ in bags])
    tf = np.concatenate([c for _, c in bags]).astype(float)
    item = np.repeat(np.arange(n), [len(t) for t, _ in bags])
    terms, number = np.unique(term, return_inverse=True)
    df = over.df[np.searchsorted(over.terms, terms)]
    idf = np.log(1 + (over.n - df + 0.5) / (df + 0.5))
    weight = idf[number] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / (over.words / over.n)))
    impact = weight / np.bincount(item, weight)[item]
    order = np.lexsort((item, number))
    number, item, impact = number[order], item[order], impact[order]
    begin = np.searchsorted(number, np.arange(len(terms) + 1))
    greatest = np.maximum.reduceat(impact, begin[:-1])
    # commonest first, as long as together they stay within FREE
    by = np.lexsort((np.arange(len(terms)), -df))
    free = np.cumsum(greatest[by]) <= FREE
    opening = np.ones(len(terms), bool)
    opening[by[free]] = False
    size = max(BLOCK, -(-n // MOST_BLOCKS))
    blocks = -(-n // size)
    pair, inverse = np.unique(number * blocks + item // size, return_inverse=True)
    bound = np.zeros(len(pair))
    np.maximum.at(bound, inverse, impact)
    filter_ = np.zeros(1 << 20, bool)
    filter_[(terms >> U(44)).astype(np.int64)] = True
    return Index(
        ids[kept], nameless[kept], parts, max(STRIDE, over.longest), terms, begin, item, number * n + item, impact, opening,
        np.searchsorted(pair // blocks, np.arange(len(terms) + 1)), pair % blocks, bound, filter_, blocks, size,
    )


def _expand(begin: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of term its postings: which entry of term, which posting."""
    return _between(begin[term], begin[term + 1])


def _between(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start to before its stop: of which entry, which number."""
    size = stop - start
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _retrieve(index: Index, stride_of: np.ndarray, t: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """window * items + item, and its score, of all that reach RETRIEVE. Term t stands in stride stride_of; a window is the strides head and head + 1."""
    n, strides = len(index.terms), head[-1] + 2
    # bounds by stride and block, each term once a stride
    opener = index.opening[t]
    key = np.unique(stride_of[opener] * n + t[opener])
    of, post = _expand(index.block_begin, key % n)
    bound = np.bincount((key // n)[of] * index.blocks + index.block[post], index.block_impact[post], strides * index.blocks).reshape(strides, index.blocks)
    open_ = bound[head] + bound[head + 1] >= RETRIEVE - FREE
    place, block_ = np.nonzero(open_)
    # a word is in the window that begins with its stride and in the one before; each term counts once a window
    wanted = np.zeros(len(head), bool)
    wanted[place] = True
    window = np.full(strides + 1, -1)  # the last entry stands for the stride before the first
    window[head[wanted]] = np.flatnonzero(wanted)
    own = np.concatenate([window[stride_of], window[stride_of - 1]])
    key = np.unique(own[own >= 0] * n + np.concatenate([t, t])[own >= 0])
    at_window, term = key // n, key % n
    blocks = np.bincount(place, minlength=len(head))
    seek = blocks[at_window] * SEEK < index.begin[term + 1] - index.begin[term]
    # terms with many postings: those between an open block's bounds are sought, the others passed over
    of, cell = _between(*np.searchsorted(place, np.stack([at_window[seek], at_window[seek] + 1])))
    start = term[seek][of] * len(index.ids) + block_[cell] * index.size
    stop = np.minimum(start + index.size, (term[seek][of] + 1) * len(index.ids))
    found, post = _between(*np.searchsorted(index.sought, np.stack([start, stop])))
    # terms with few: each posting is looked up among the open blocks
    whole, listed = _expand(index.begin, term[~seek])
    whole = at_window[~seek][whole]
    inside = open_[whole, index.item[listed] // index.size]
    post = np.concatenate([post, listed[inside]])
    of = np.concatenate([place[cell][found], whole[inside]])
    if len(found):  # terms in one order, so that sums don't depend on how they were found
        order = np.argsort(post, kind="stable")
        post, of = post[order], of[order]
    pair, inverse = np.unique(of * len(index.ids) + index.item[post], return_inverse=True)
    score = np.bincount(inverse, index.impact[post], len(pair))
    return pair[score >= RETRIEVE], score[score >= RETRIEVE]


def search(block: Block, index: Index):
    """Verified matches: row, item, score, question overlap, answer overlap, first word of the passage. One per row and item, the best."""
    words, h = tokens(block)
    stride, rows = index.stride, len(block.offsets) - 1
    count = np.diff(words.first)
    passages = np.maximum(1, -(-count // stride) - 1)  # windows of two strides; the last may be short
    base = np.r_[0, np.cumsum(passages)]
    at = np.flatnonzero(index.filter[(h >> U(44)).astype(np.int64)])
    t = np.searchsorted(index.terms, h[at])
    t[t == len(index.terms)] = 0
    hit = index.terms[t] == h[at]
    at, t = at[hit], t[hit]
    row = words.row[at]
    step = (at - words.first[row]) // stride
    under = np.r_[0, np.cumsum(passages + 1)]
    stride_of = under[row] + step
    head = np.arange(base[-1]) + np.repeat(np.arange(rows), passages)  # each window's first stride
    pair, score = [np.zeros(0, np.int64)], [np.zeros(0)]
    width = max(1, CELLS // index.blocks)
    for a in range(0, len(head), width):
        part = head[a : a + width]
        lo, hi = np.searchsorted(stride_of, (part[0], part[-1] + 2))
        p, s = _retrieve(index, stride_of[lo:hi] - part[0], t[lo:hi], part - part[0])
        pair.append(p + a * len(index.ids))
        score.append(s)
    pair, score = np.concatenate(pair), np.concatenate(score)
    best: dict[tuple[int, int], tuple] = {}
    shingled: dict[tuple[int, int], np.ndarray] = {}
    for key, s in zip(pair.tolist(), score.tolist()):
        p, i = divmod(key, len(index.ids))
        r = int(np.searchsorted(base, p, "right")) - 1
        first = words.first[r] + (p - base[r]) * stride
        last = min(words.first[r + 1], first + 2 * stride)
        overlap = []
        question, q, answer, a = index.parts[i]
        for part, size in ((question, q), (answer, a)):
            if (p, size) not in shingled:
                shingled = {k: v for k, v in shingled.items() if k[0] == p}
                shingled[p, size] = np.sort(run_hashes(h[first:last], size))
            have = shingled[p, size]
            place = np.minimum(np.searchsorted(have, part), max(0, len(have) - 1))
            overlap.append(float((have[place] == part).mean()) if len(have) else 0.0)
        if min(overlap) >= OVERLAP:
            found = (r, i, min(1.0, s), *overlap, int(first - words.first[r]))
            old = best.get((r, i))
            if old is None or (found[2:5], -found[5]) > (old[2:5], -old[5]):
                best[r, i] = found
    return np.array([best[k] for k in sorted(best)], float).reshape(-1, 6)


def indexes(items: DataFrame) -> list[Index]:
    """One index per slice of items. items: item_id, text."""
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-total // SLICE_BYTES)

    def part(i: int) -> pa.Table:
        return (sized if slices == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i)).toArrow().sort_by("item_id")

    over = reduce(_together, (totals(part(i)["text"]) for i in range(slices))) if slices > 1 else None
    out = []
    for i in range(slices):
        table = part(i)
        named = table["item_id"].combine_chunks()
        built = build(named.fill_null(0).to_numpy(), table["text"], np.asarray(named.is_null()), over)
        if built:
            out.append(built)
    return out


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word: each item that a row's text holds, its best passage."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    spark = docs.sparkSession
    own = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for index in indexes(items):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                for block in text_blocks(batch["text"]):
                    found = search(block, sent.value)
                    row, item = found[:, 0].astype(np.int64), found[:, 1].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(block.start).take(pa.array(row)), pa.array(sent.value.ids[item], mask=sent.value.nameless[item]), *(pa.array(np.round(found[:, c], 9)) for c in (2, 3, 4)), pa.array(found[:, 5].astype(np.int64))],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                    )

        found.append(own.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose texts hold no item."""
    spark = docs.sparkSession
    for index in indexes(items):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for block in text_blocks(batch["text"]):
                    keep[block.start + search(block, sent.value)[:, 0].astype(np.int64)] = False
                yield batch.filter(pa.array(keep))

        docs = bound_batches(docs).mapInArrow(run, docs.schema)
    return docs
