"""A Bloom filter of fixed greatest size, built by Spark and broadcast to Python workers.

It only spares rows that can't matter from a shuffle: a false positive is a wasted row, never a wrong result. Its size
is bounded by MOST_BITS whatever the data are; beyond the keys it serves well it spares fewer rows, and the exact join
that follows takes more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, mix

#: 32 MB: the greatest size of one broadcast filter.
MOST_BITS = 1 << 28
BITS_PER_KEY = 12
PROBES = 4


def filter_bits(n_keys: int) -> int:
    return min(MOST_BITS, max(1 << 16, 1 << int(n_keys * BITS_PER_KEY - 1).bit_length() if n_keys else 0))


def _positions(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return mix(keys + U(0x632BE59BD9B4E019 * (probe + 1) % (1 << 64))) & U(bits - 1)


def might_contain(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for probe in range(PROBES):
        at = _positions(keys, len(words) * 64, probe)
        found &= (words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
    return found


def build(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter's 64-bit words over a bigint column; executors OR masks before and after the shuffle."""

    def masks(batches):
        for b in batches:
            k = b[column].to_numpy(zero_copy_only=False).view(U)
            at = np.concatenate([_positions(k, bits, p) for p in range(PROBES)])
            at.sort()
            word = (at >> U(6)).astype(np.int64)
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
            mask = np.bitwise_or.reduceat(U(1) << (at & U(63)), begins) if len(word) else at
            yield pa.RecordBatch.from_arrays([pa.array(word[begins]), pa.array(mask.view(np.int64))], ["word", "mask"])

    found = keys.select(column).mapInArrow(masks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, U)
    out[found["word"].to_numpy()] = found["mask"].to_numpy().view(U)
    return out
