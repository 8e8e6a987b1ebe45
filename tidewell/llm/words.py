"""Words of whole blocks of texts at once: bounds, hashes of words and of runs of words.

A word is a run of bytes other than 0x20 and 0x09-0x0D, the class [^\\x20\\x09-\\x0D]+ on UTF-8.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .shared import Block

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U = np.uint64
#: Odd multipliers of the two independent families of hashes.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each input bit over all 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, U), np.full(n, inverse, U)
    up[:1] = down[:1] = 1
    symbols = mix(np.arange(1, 257, dtype=U) * U(base))
    return np.multiply.accumulate(up), np.multiply.accumulate(down), symbols


@dataclass
class Words:
    """start, end: byte bounds of each word in the block; row: its row; first: words before each row (one more entry than rows)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def split_words(block: Block, space: np.ndarray = SPACE) -> Words:
    """space: of each byte value, whether it stands between words."""
    n, rows = len(block.data), len(block.offsets) - 1
    solid = np.zeros(n + 2, bool)
    np.logical_not(space[block.data], out=solid[1:-1])
    opens = solid[1:-1] & ~solid[:-2]
    shuts = solid[1:-1] & ~solid[2:]
    inner = block.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]  # a word doesn't run on into the next text
    opens[inner] = solid[1:-1][inner]
    shuts[inner - 1] = solid[1:-1][inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    first = np.searchsorted(start, block.offsets)
    return Words(start, end, np.repeat(np.arange(rows), np.diff(first)), first)


def word_hashes(block: Block, words: Words, family: int = 0, stretch: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from differences of a running polynomial over stretches of the block."""
    out = np.empty(len(words.start), U)
    at = 0
    while at < len(out):
        base = words.start[at]
        to = max(at + 1, int(np.searchsorted(words.end, base + stretch, "right")))
        start, end = words.start[at:to] - base, words.end[at:to] - base
        n = int(end[-1])
        up, down, symbols = _powers(max(stretch, 1 << n.bit_length()), BASES[family])
        run = np.zeros(n + 1, U)
        np.cumsum(symbols[block.data[base : base + n]] * up[:n], out=run[1:])
        out[at:to] = mix((run[end] - run[start]) * down[start] + (end - start).astype(U))
        at = to
    return out


def run_hashes(h: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """A hash of the words i..i+k-1 for every i; the caller drops runs that leave a text."""
    n = max(0, len(h) - k + 1)
    total = np.zeros(n, U)
    for i in range(k):
        total *= U(BASES[1 - family])
        total += h[i : i + n]
    return mix(total)
