"""Language identification of mixed texts: script ranges, word scores, and Viterbi over words.

Each word (whitespace apart) gets the script of its first letter. Languages that the training texts don't show in that
script are no candidates for it (a script of no language leaves all of them). A candidate's score is the sum of the
smoothed log-probabilities of the word's byte 3-grams, edges included, less the least candidate's. Words without letters
score 0 everywhere. The best path through all words, a switch costing SWITCH within a document, labels spans; a
document's language is the one with the most letters of its words, its score their share.

Blocks of texts run at once: each run of STRIDE words becomes a matrix of best scores from any entry to any exit
language; the matrices are chained, and all runs are then traced together. A document start costs no switch.

Learning counts 3-grams over a bounded sample of documents with a known language: MOST_A_LANGUAGE each in expectation, or
fewer of each alike where that would pass MOST_TRAINING, so a rare language is learned among many; sampling.MOST_BYTES of text. Defined cases: `und` with score 0 for texts that are null or without letters, and
where nothing was learned; rows repeat as they come; a null doc_id is neither held out nor learned from; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import crc_remainder, sample_texts
from .shared import Block, bound_batches, text_blocks
from .words import split_words

BUCKETS = 1 << 16
MOST_A_LANGUAGE = 1000
#: The bound of the training sample, in rows.
MOST_TRAINING = 8000
SMOOTHING = 0.5
SWITCH = 14.0
STRIDE = 64
BLOCK_BYTES = 1 << 18
UNDETERMINED = "und"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# First code points of ranges of scripts, in order, and the script's number (0: common or rare ones).
RANGES = [
    (0x0000, 0), (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6),
    (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 0), (0x0E00, 10), (0x0E80, 0), (0x10A0, 11), (0x1100, 12),
    (0x1200, 13), (0x1380, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 14), (0x3100, 0), (0x3130, 12), (0x3190, 0), (0x3400, 15),
    (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 15), (0xFB00, 1), (0xFB13, 0), (0xFF21, 1), (0xFF66, 14), (0xFFA0, 0), (0x20000, 15), (0x32000, 0),
]
SCRIPTS = 16


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


@dataclass
class Units:
    """The words of a block: start in the padded bytes, end, row, letters, script of the first letter; grams' buckets by place."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    grams: np.ndarray


def units(block: Block) -> Units:
    rows = len(block.offsets) - 1
    words = split_words(block)
    # a blank before and after each text, so that no gram reaches into a neighbour
    data = np.full(len(block.data) + rows + 1, 0x20, np.uint8)
    shift = np.repeat(np.arange(1, rows + 1), np.diff(block.offsets))
    data[np.arange(len(block.data)) + shift] = LOWER[block.data]
    start, end = words.start + words.row + 1, words.end + words.row + 1
    h = np.zeros(len(data) - 2, np.uint32)
    for j in range(3):
        h *= np.uint32(0x01000193)
        h ^= np.where(data[j : j + len(h)] < 0x21, np.uint8(0x20), data[j : j + len(h)])
    h *= np.uint32(0x9E3779B1)
    heads = np.flatnonzero((block.data & 0xC0) != 0x80)
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    place = heads[is_letter]
    lo, hi = np.searchsorted(place, words.start), np.searchsorted(place, words.end)
    bounds, numbers = np.array([r[0] for r in RANGES]), np.array([r[1] for r in RANGES])
    script = np.zeros(len(start), np.int64)
    some = hi > lo
    script[some] = numbers[np.searchsorted(bounds, points[is_letter][lo[some]], "right") - 1]
    return Units(start, end, words.row, hi - lo, script, h >> np.uint32(16))


@dataclass
class Model:
    """languages, the log-probability of each bucket in each, and which scripts each is written in."""

    languages: list[str]
    weight: np.ndarray
    candidates: np.ndarray

    def word_scores(self, u: Units) -> np.ndarray:
        run = np.zeros((len(u.grams) + 1, len(self.languages)))
        np.cumsum(self.weight[u.grams], axis=0, out=run[1:])
        out = run[np.minimum(u.end, len(u.grams))] - run[np.maximum(u.start - 1, 0)]
        # script 0 and scripts that no language shows leave all candidates
        out[~self.candidates[u.script]] = -np.inf
        out -= np.where(np.isinf(out), np.inf, out).min(1, keepdims=True) if out.size else 0
        out[np.isinf(out)] = -60.0
        out[u.letters == 0] = 0
        return np.round(out, 6)


def train(texts: pa.Array, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    scripts = np.zeros((SCRIPTS, len(languages)))
    number = np.array([languages.index(x) for x in labels], np.int64)
    for block in text_blocks(texts, BLOCK_BYTES):
        u = units(block)
        own = number[block.start + u.row]
        np.add.at(scripts, (u.script, own), u.letters)
        of = np.full(len(u.grams), -1)
        size = u.end - u.start
        at = np.repeat(u.start - 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
        of[at[at < len(of)]] = np.repeat(own, size)[at < len(of)]
        np.add.at(counts, (u.grams[of >= 0], of[of >= 0]), 1)
    weight = np.log(counts / counts.sum(0))
    shown = scripts > 0.01 * scripts.sum(0)
    shown[0] = True
    shown[~shown.any(1)] = True
    return Model(languages, weight.astype(np.float32), shown)


def fit(docs: DataFrame, each: int = MOST_A_LANGUAGE, most: int = MOST_TRAINING, seed: int = 9) -> Model:
    """Learns from documents with a language whose crc32(doc_id) mod 5 is not 0."""
    known = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label")).where(F.col("label").isNotNull() & (crc_remainder("doc_id", 5) != 0))
    counts = known.groupBy("label").agg(F.count("*").alias("n"))
    each = min(each, most // max(1, counts.count()))
    # a uniform hash under each / n keeps about `each` rows of a language without ordering any group
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    kept = known.join(counts, "label").where(unit < F.lit(float(each)) / F.col("n")).select("doc_id", "label")
    table = sample_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kept, 2 * most, seed + 1)
    return train(table["text"], table["label"].to_pylist())


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. scores: (words, labels); starts: whether a word begins a document, where no switch costs."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // STRIDE)
    s = np.zeros((rows * STRIDE, k))
    s[:n] = scores
    cost = np.full(rows * STRIDE, switch)
    cost[:n][starts] = 0
    s, cost = s.reshape(rows, STRIDE, k).transpose(1, 0, 2).copy(), cost.reshape(rows, STRIDE).T.copy()
    matrix = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(rows, 0)
    for own, c in zip(s, cost):
        matrix = np.maximum(matrix, matrix.max(2, keepdims=True) - c[:, None, None]) + own[:, None, :]
    entry = np.zeros((rows, k))
    for r in range(rows - 1):
        after = (entry[r][:, None] + matrix[r]).max(0)
        entry[r + 1] = after - after.max()
    stay = np.empty((STRIDE, rows, k), bool)
    best = np.empty((STRIDE, rows), np.int64)
    now = entry
    for j, (own, c) in enumerate(zip(s, cost)):
        best[j] = now.argmax(1)
        moved = now.max(1) - c
        stay[j] = now >= moved[:, None]
        now = np.maximum(now, moved[:, None]) + own
    each = np.arange(rows)
    back = np.tile(np.arange(k), (rows, 1))
    for j in range(STRIDE - 1, -1, -1):
        back = np.where(np.take_along_axis(stay[j], back, 1), back, best[j][:, None])
    exits = np.empty(rows, np.int64)
    exits[-1] = now[-1].argmax()
    for r in range(rows - 1, 0, -1):
        exits[r - 1] = back[r, exits[r]]
    out = np.empty((STRIDE, rows), np.int64)
    state = exits
    for j in range(STRIDE - 1, -1, -1):
        out[j] = state
        state = np.where(stay[j][each, state], state, best[j])
    return out.T.ravel()[:n]


def _identify(model, spans: bool):
    def run(batches):
        m = model.value
        for batch in batches:
            for block in text_blocks(batch["text"], BLOCK_BYTES):
                rows = block.stop - block.start
                u = units(block)
                k = len(m.languages)
                total = np.zeros((rows, max(1, k)))
                label = np.zeros(len(u.row), np.int64)
                if k and len(u.row):
                    label = viterbi(m.word_scores(u), np.r_[True, u.row[1:] != u.row[:-1]])
                    total = np.bincount(u.row * k + label, u.letters, rows * k).reshape(rows, k)
                letters = total.sum(1)
                first = total.argmax(1)
                named = [m.languages[i] if n else UNDETERMINED for i, n in zip(first.tolist(), letters.tolist())]
                share = np.where(letters > 0, total.max(1) / np.maximum(letters, 1), 0.0)
                columns = [batch["doc_id"].slice(block.start, rows), pa.array(named, pa.string()), pa.array(share)]
                names = ["doc_id", "lang_pred", "score"]
                if spans:
                    begins = np.flatnonzero(np.r_[True, (u.row[1:] != u.row[:-1]) | (label[1:] != label[:-1])]) if len(label) else label
                    base = np.searchsorted(u.row, np.arange(rows + 1))
                    size = np.diff(np.r_[begins, len(label)])
                    lang = [m.languages[i] if k else UNDETERMINED for i in label[begins].tolist()]
                    items = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(begins - base[u.row[begins]], pa.int64()), pa.array(size, pa.int64())], ["lang", "first_word", "n_words"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, base), pa.int32()), items))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, and with `spans` the labelled spans of words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<lang string, first_word long, n_words long>>" if spans else "")
    out = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_identify(sent, spans), schema)
    held = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), *out.columns[1:])
