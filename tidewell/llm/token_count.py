"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers run one after the other.

* The splitter reads classes of code points and has 11 states; a transition is annotated with the bounds it settles
  (before this code point, before the last one), which is all the look-ahead that the split pattern
  `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` needs. Texts of a block are cut into
  chunks of CHUNK code points regardless of words. Each chunk yields its state map (entry state -> exit state); the maps
  compose, which is associative, so a parallel prefix scan gives every chunk's entry state, and all chunks then run at once.
* The merger reads the bytes of one piece. A state holds, for each place from which a vocabulary entry could still run
  on, that place in the vocabulary's trie, the last token before it, and its count less the current one. A transition's
  annotation is the change of the number of emitted tokens; their sum over a piece is its number of tokens. Equal short pieces of a block are counted once. States are
  compiled when first reached (as in lazy determinisation) and dropped once MOST_TRANSITIONS are held, so memory is bounded
  whatever the texts are. That the last token of a prefix is the one that forms a valid pair with the last token
  before it is what makes the machine deterministic.

Defined cases: null and empty texts have 0 tokens; a special string inside a text is one token, and what stands on either
side is split as texts of their own, as the library does by default; other columns are ignored; rows repeat as they come.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, text_blocks

CHUNK = 256
#: Transitions and pieces that a worker keeps compiled.
MOST_TRANSITIONS = 300_000
MOST_PIECES = 400_000

# Classes of code points.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, ALONE, THEN_E, ELL, E, END = range(11)
LETTERS = (LETTER, ALONE, THEN_E, ELL, E)
# States of the splitter.
FRESH, ONE_SPACE, RUN_SPACE, ONE_BLANK, RUN_BLANK, WORD, DIGITS, SIGNS, QUOTED, QUOTED_R, QUOTED_L = range(11)
STATES = 11
HERE, BACK = 1, 2  # bounds before this code point, before the last one


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """The state after and the marks of (class, state), flat at class * STATES + state."""
    after, marks = np.zeros((11, STATES), np.uint8), np.zeros((11, STATES), np.uint8)
    opens = {SPACE: ONE_SPACE, BLANK: ONE_BLANK, NUMBER: DIGITS, OTHER: SIGNS, QUOTE: QUOTED, END: FRESH} | dict.fromkeys(LETTERS, WORD)
    attached = {NUMBER: DIGITS, OTHER: SIGNS, QUOTE: SIGNS} | dict.fromkeys(LETTERS, WORD)  # what a space before it belongs to
    for c in range(11):
        for s in range(STATES):
            to, mark = opens[c], HERE
            if s in (ONE_SPACE, RUN_SPACE, ONE_BLANK, RUN_BLANK) and c in (SPACE, BLANK):
                to, mark = (RUN_SPACE if c == SPACE else RUN_BLANK), 0
            elif s == ONE_SPACE and c in attached:
                to, mark = attached[c], 0
            elif s == RUN_SPACE and c in attached:
                to, mark = attached[c], BACK
            elif s == RUN_BLANK and c != END:
                mark = HERE | BACK
            elif s == WORD and c in LETTERS or s == DIGITS and c == NUMBER or s == SIGNS and c in (OTHER, QUOTE):
                to, mark = s, 0
            elif s == QUOTED and c in (OTHER, QUOTE):
                to, mark = SIGNS, 0
            elif s == QUOTED and c in (ALONE, THEN_E, ELL):
                to, mark = {ALONE: FRESH, THEN_E: QUOTED_R, ELL: QUOTED_L}[c], 0
            elif s == QUOTED_R and c == E or s == QUOTED_L and c == ELL:
                to, mark = FRESH, 0
            elif s in (QUOTED_R, QUOTED_L):
                to, mark = (WORD, BACK) if c in LETTERS else (opens[c], HERE | BACK)
            after[c, s], marks[c, s] = to, mark
    return after.ravel(), marks.ravel()


AFTER, MARKS = _splitter()


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    # fixed values: the code points of Unicode's White_Space property
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[0x20], out[0x27] = SPACE, QUOTE
    for letters, kind in (("stmd", ALONE), ("rv", THEN_E), ("l", ELL), ("e", E)):
        out[[ord(x) for x in letters]] = kind
    return out


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan under composition: row i of the result maps a state through chunks 0..i. maps: (chunks, states)."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.int64), 1)
        step *= 2
    return out


def chunk_maps(at: np.ndarray) -> np.ndarray:
    """The state map of each chunk. at: class * STATES by place in the chunk, then by chunk.

    A map whose values have met stays constant, so from then on one state is run for its chunk instead of all.
    """
    chunks = at.shape[1]
    out = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, 1)
    open_ = np.arange(chunks)
    for j in range(0, len(at), 8):
        if len(open_):
            now = out[:, open_]
            for column in at[j : j + 8, open_]:
                now = AFTER.take(column + now)
            out[:, open_] = now
        met = np.ones(chunks, bool)
        met[open_] = False
        if met.any():
            single = out[0, met]
            for column in at[j : j + 8, met]:
                single = AFTER.take(column + single)
            out[:, met] = single
        open_ = open_[(out[:, open_] != out[0, open_]).any(0)]
    return out.T


def split_marks(classes: np.ndarray) -> np.ndarray:
    """The marks at each code point; the stream starts fresh."""
    n = len(classes)
    rows = max(1, -(-n // CHUNK))
    padded = np.full(rows * CHUNK, END, np.uint8)
    padded[:n] = classes
    at = np.ascontiguousarray(padded.reshape(rows, CHUNK).T).astype(np.int64) * STATES
    state = np.zeros(rows, np.uint8)
    state[1:] = compose_scan(chunk_maps(at))[:-1, FRESH]
    out = np.empty((CHUNK, rows), np.uint8)
    for j, column in enumerate(at):
        key = column + state
        MARKS.take(key, out=out[j])
        state = AFTER.take(key)
    return out.T.ravel()[:n]


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The transducer over one piece's bytes, compiled as it runs. Tokens are numbered from 1; 0 stands before the first."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)
        names = _byte_names()
        spell = lambda token: bytes(names[c] for c in token)
        self.specials = [t["content"] for t in model.get("added_tokens", [])]
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        tokens = {bytes([b]) for b in range(256)}
        for i, pair in enumerate(model["model"]["merges"]):
            a, b = map(spell, pair if isinstance(pair, list) else pair.split(" "))
            self.ranks[a, b] = i
            tokens.add(a + b)
        self.tokens = [b"", *sorted(tokens)]
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token, self.inner = [0], [True]  # of a node: the token it ends, whether it runs on
        for number, t in enumerate(self.tokens[1:], 1):
            node = 0
            for b in t:
                self.inner[node] = True
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(0)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = number
        self.valid: dict[int, bool] = {}
        self.pieces: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [((0, 0, 0),)]
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """The merges applied to a short text by rank, leftmost first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _pair(self, before: int, after: int) -> bool:
        """Whether token `after` may follow `before` (or start a piece where that is 0)."""
        if len(self.valid) >= MOST_TRANSITIONS:
            self.valid.clear()
        a, b = self.tokens[before], self.tokens[after]
        found = self.valid[before << 20 | after] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        child, token, inner, valid = self.child, self.token, self.inner, self.valid
        last, change, moved = 0, 0, []
        for node, before, rel in self.states[state]:
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if not last and (t := token[to]):
                ok = valid.get(before << 20 | t)
                if self._pair(before, t) if ok is None else ok:
                    last, change = t, rel + 1
            if inner[to]:
                moved.append((to, before, rel))
        after = (*((to, before, rel - change) for to, before, rel in moved), (0, last, 0))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        self.step[state << 8 | byte] = (number, change)
        return number, change

    def count(self, piece: bytes) -> int:
        """Tokens of a piece: the sum of the annotations along its path."""
        found = self.pieces.get(piece)
        if found is not None:
            return found
        if len(self.step) >= MOST_TRANSITIONS:
            self._clear()
        state = total = 0
        get, compile_ = self.step.get, self._compile
        for byte in piece:
            state, change = get(state << 8 | byte) or compile_(state, byte)
            total += change
        if len(self.pieces) >= MOST_PIECES:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = total
        return total


def _segments(block, special: re.Pattern | None):
    """The stretches between special strings: bytes end to end, bounds, rows; special strings of each row."""
    rows = len(block.offsets) - 1
    raw = block.data.tobytes()
    if special is None or not special.search(raw):
        return raw, block.offsets, np.arange(rows), np.zeros(rows, np.int64)
    parts, row, extra = [], [], np.zeros(rows, np.int64)
    for r in range(rows):
        own = special.split(raw[block.offsets[r] : block.offsets[r + 1]])
        parts += own
        row += [r] * len(own)
        extra[r] = len(own) - 1
    return b"".join(parts), np.cumsum([0, *map(len, parts)]), np.array(row), extra


def block_counts(block, merger: Merger, special: re.Pattern | None) -> np.ndarray:
    raw, bounds, row, out = _segments(block, special)
    data = np.frombuffer(raw, np.uint8)
    # code points, an END after each stretch, and each one's first byte
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.searchsorted(heads, bounds[1:])
    classes = np.insert(_classes()[points], ends, END)
    where = np.insert(heads, ends, bounds[1:])
    marks = split_marks(classes)
    start = np.zeros(len(classes) + 1, bool)
    start[:-1] = marks & HERE > 0
    start[:-2] |= marks[1:] & BACK > 0
    at = np.flatnonzero(start[:-1])
    real = classes[at] != END
    first, last = where[at], np.append(where[at[1:]], len(raw))
    first, last, at = first[real], last[real], at[real]
    n = _piece_counts(data, raw, first, last, merger)
    stretch = np.searchsorted(ends + np.arange(len(ends)), at)
    np.add.at(out, row, np.bincount(stretch, n, len(row)).astype(np.int64))
    return out


def _piece_counts(data: np.ndarray, raw: bytes, first: np.ndarray, last: np.ndarray, merger: Merger) -> np.ndarray:
    """Tokens of each piece raw[first:last]. Short pieces are told apart as numbers, so that equal ones are counted once a block."""
    get, count = merger.pieces.get, merger.count
    out = np.zeros(len(first), np.int64)
    size = last - first
    short = size < 8
    # the bytes of a short piece as a number, its length in the top byte
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = size[short].astype(np.uint64)
    key, which = np.unique(eight[first[short]] & (np.uint64(1) << length * np.uint64(8)) - np.uint64(1) | length << np.uint64(56), return_inverse=True)
    spelled = key.astype("<u8").tobytes()
    ends = np.arange(len(key)) * 8 + (key >> np.uint64(56)).astype(np.int64)
    once = [get(p := spelled[a:b]) or count(p) for a, b in zip(range(0, 8 * len(key), 8), ends.tolist())]
    out[short] = np.array(once, np.int64)[which]
    out[~short] = [get(p := raw[a:b]) or count(p) for a, b in zip(first[~short].tolist(), last[~short].tolist())]
    return out


_merger: dict[int, Merger] = {}


def _count(vocabulary):
    def run(batches):
        key = hash(vocabulary.value)
        if key not in _merger:
            _merger[key] = Merger(vocabulary.value)
        merger = _merger[key]
        special = re.compile(b"|".join(re.escape(s.encode()) for s in merger.specials)) if merger.specials else None
        for batch in batches:
            for block in text_blocks(batch["text"]):
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(block.start, block.stop - block.start), pa.array(np.diff(block.offsets)), pa.array(block_counts(block, merger, special))],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. vocabulary: path on the driver of a byte-level BPE tokenizer.json (some MB; it is broadcast)."""
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    out = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(sent), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
