"""A quality classifier: supervised subword embeddings.

A text's features are its words and pairs of neighbouring words (whitespace apart, case kept), the shape of each SHAPE
neighbouring words (which of them are equal), and the 3- and 4-grams of its characters, all hashed into BUCKETS. Shapes are there
because an average of word and character vectors alone can't see that a text repeats words that it never learned. A vector is learned for each bucket; a document is the average of its features'
vectors, and a softmax over them gives the label. Training is stochastic gradient descent in numpy on the driver, over at most MOST_TRAINING labelled rows (those
with the least hash of doc_id) and sampling.MOST_BYTES of text, so it takes the same time at any size. As the average is linear, the output weights are
folded into the vectors for scoring: one number a bucket, 256 KB to broadcast.

Defined cases: null and empty texts get the score that the biases give; labels that are null or of absent documents
teach nothing; with labels of fewer than two kinds the score is the share of label 1 (1 without labels); rows repeat as
they come; a null doc_id is not held out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import crc_remainder, sample_texts
from .shared import Block, bound_batches, text_blocks
from .words import U, mix, run_hashes, split_words, word_hashes

BUCKETS = 1 << 16
ORDERS = (3, 4)
SHAPE = 4
DIMENSIONS = 8
#: The bound of the training sample, in rows.
MOST_TRAINING = 4000
EPOCHS = 6
RATE = 2.0
THRESHOLD = 0.7


def _gram_buckets(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the characters i..i+order-1 for each i."""
    n = max(0, len(points) - order + 1)
    h = np.full(n, order, np.uint32)
    for j in range(order):
        h *= np.uint32(0x01000193)
        h ^= points[j : j + n]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BUCKETS.bit_length() + 1)


def features(block: Block):
    """For words, their pairs and each order of grams: buckets, and each row's bounds in them."""
    words = split_words(block)
    h = word_hashes(block, words)
    first, last = words.first[:-1], words.first[1:]
    top = U(64 - BUCKETS.bit_length() + 1)
    yield (h >> top).astype(np.int64), first, last
    pairs = run_hashes(h, 2)
    first = np.minimum(first, len(pairs))
    yield (pairs >> top).astype(np.int64), first, np.maximum(first, np.minimum(last - 1, len(pairs)))
    # the shapes of word n-grams: which of SHAPE neighbouring words are equal, whatever the words are
    n = max(0, len(h) - SHAPE + 1)
    shape = np.full(n, 1, U)
    for i in range(SHAPE):
        for j in range(i):
            shape = shape << U(1) | (h[i : i + n] == h[j : j + n])
    first = np.minimum(words.first[:-1], n)
    yield (mix(shape) >> top).astype(np.int64), first, np.maximum(first, np.minimum(last - SHAPE + 1, n))
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.searchsorted(np.flatnonzero((block.data & 0xC0) != 0x80), block.offsets)
    for order in ORDERS:
        first = bounds[:-1]
        yield _gram_buckets(points, order), first, np.maximum(first, bounds[1:] - order + 1)


@dataclass
class Model:
    """weight: what each feature adds before averaging; bias: the rest of the difference of the two outputs."""

    weight: np.ndarray
    bias: float

    def scores(self, block: Block) -> np.ndarray:
        total = np.zeros(len(block.offsets) - 1)
        count = np.zeros(len(total))
        for buckets, first, last in features(block):
            run = np.zeros(len(buckets) + 1)
            np.cumsum(self.weight[buckets], out=run[1:])
            total += run[last] - run[first]
            count += last - first
        margin = total / np.maximum(count, 1) + self.bias
        return np.round(1 / (1 + np.exp(-margin)), 9)


def gradients(mean: np.ndarray, out: np.ndarray, bias: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the loss -log softmax(out @ mean + bias)[label], by the output weights, the biases and the average."""
    z = out @ mean + bias
    p = np.exp(z - z.max())
    error = p / p.sum()
    error[label] -= 1
    return np.outer(error, mean), error, error @ out


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """labels: 0 or 1."""
    if len(np.unique(labels)) < 2:
        share = labels.mean() if len(labels) else 1.0
        return Model(np.zeros(BUCKETS), float(np.clip(np.log(share + 1e-9) - np.log(1 - share + 1e-9), -9, 9)))
    bags = []
    for block in text_blocks(texts):
        parts = list(features(block))
        for r in range(block.stop - block.start):
            bucket, n = np.unique(np.concatenate([b[first[r] : last[r]] for b, first, last in parts]), return_counts=True)
            bags.append((bucket.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)[:, None]))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out, bias = rng.uniform(-0.5, 0.5, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            bucket, share = bags[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            by_out, error, back = gradients((vectors[bucket] * share).sum(0), out, bias, labels[i])
            out -= rate * by_out
            bias -= np.float32(0.1) * rate * error
            # shares are small, so a bucket's step is scaled up to the size of its part in the average
            vectors[bucket] -= rate * back * share * 10
    change = out[1] - out[0]
    return Model((vectors @ change).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, seed: int = 5) -> Model:
    """Learns from labels (doc_id, label 0 or 1) of documents; the caller leaves held-out rows out of labels."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    table = sample_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen, most, seed)
    return train(table["text"], table["label"].to_numpy().astype(np.int64), seed=seed)


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labels.quality from the rows that are not held out."""
    known = labels.where(crc_remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    return fit(docs, known)


def _score(model):
    def run(batches):
        for batch in batches:
            for block in text_blocks(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(block.start, block.stop - block.start), pa.array(model.value.scores(block))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(sent), "doc_id long, score double")
    held = F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that the model doesn't reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = [sent.value.scores(block) for block in text_blocks(batch["text"])]
            yield batch.filter(pa.array(np.concatenate(score) >= threshold)) if score else batch

    return bound_batches(docs).mapInArrow(run, docs.schema)
