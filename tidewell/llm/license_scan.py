"""License scans: Aho-Corasick over whole texts for notice phrases and identifier tags, and a parser of license expressions.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case. One automaton finds all phrases where their
words stand consecutively, whatever separates them. After an identifier tag the rest of its line is read as an expression
of identifiers joined by AND, OR and WITH (in either case, with brackets), put into postfix order by the shunting-yard
method and evaluated: OR takes the freer side, AND both (the stricter decides), WITH relaxes a copyleft license by its
exception. The labels of an expression are the families of its identifiers; `bound` are those that one is left with after
every OR's choice, and `freedom` tells how free these leave one, over all of a text's expressions.

The score is the strength of the evidence: 1 for a tag with an expression that parses, 0.9 for a phrase of a license's own
text or of the base list, 0.5 for a tag that doesn't parse, 0 without any. Defined cases: null and empty texts have no
words; positions are null where no base phrase stands, `freedom` is null without an expression; very long texts are scanned
whole, in time that grows with their length; rows repeat as they come; a null doc_id stays null; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, text_blocks
from .substring_dedup import _kept_bytes
from .words import split_words

# The base phrases with their labels, then phrases of well-known licenses' notices.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by": "cc-by",
    "licensed under cc0": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: How free the licenses of a family are, by the start of an identifier; the longest start decides. Fixed values.
FREEDOM = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "0bsd": 1.0, "apache": 0.9, "bsl": 0.9, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 0.8,
    "cc-by-sa": 0.5, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "proprietary": 0.0,
}
UNKNOWN = 0.4
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9.+:-]+))")

NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def to_postfix(expression: str) -> list[str] | None:
    """The expression in postfix order (shunting-yard), None where it doesn't parse."""
    out: list[str] = []
    held: list[str] = []
    at, operand = 0, True  # whether an operand must come next
    text = expression.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        token = m[1] or m[2]
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif low in PRECEDENCE:
            if operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def family(identifier: str) -> str:
    """The longest known start of an identifier, else the identifier itself in lower case."""
    low = identifier.lower().rstrip("+")
    return max((f for f in FREEDOM if low == f or low.startswith(f + "-")), key=len, default=low)


def evaluate(postfix: list[str]) -> tuple[float, set[str], set[str]] | None:
    """How free the expression leaves one, its families, and those one is bound by; None where WITH has no exception's name after it.

    Of sides that are equally free OR takes the first.
    """
    stack: list[tuple[float, set[str], set[str], str | None]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            f = family(token)
            stack.append((FREEDOM.get(f, UNKNOWN), {f}, {f}, token))
            continue
        (fa, la, ba, na), (fb, lb, bb, nb) = stack[-2:]
        if token == "with":
            if na is None or nb is None:
                return None
            result = (min(1.0, fa + 0.3), la, ba, None)
        elif token == "or":
            result = (max(fa, fb), la | lb, ba if fa >= fb else bb, None)
        else:
            result = (min(fa, fb), la | lb, ba | bb, None)
        stack[-2:] = [result]
    return stack[0][:3]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        spelled = f" {phrase} "
        found.add_word(spelled, (phrase, len(spelled)))
    found.make_automaton()
    return found


def _scan(batches):
    machine = automaton()
    for batch in batches:
        for block in text_blocks(batch["text"]):
            raw = block.data
            block.data = LOWER[raw]
            words = split_words(block, NOT_WORD)
            joined, bounds = _kept_bytes(block, words, np.ones(len(words.start), bool), NOT_WORD)
            rows = len(bounds) - 1
            count = np.diff(words.first)
            # each row as " word word \\n": no phrase runs on into the next row
            flat = np.full(len(joined) + 3 * rows, 0x20, np.uint8)
            shift = 3 * np.arange(rows) + 1
            flat[np.arange(len(joined)) + np.repeat(shift, np.diff(bounds))] = joined
            flat[bounds[1:] + shift + 1] = 0x0A
            starts = bounds[:-1] + shift - 1
            text = flat.tobytes().decode("latin-1")
            base = [[] for _ in range(rows)]
            labels = [set() for _ in range(rows)]
            bound = [set() for _ in range(rows)]
            score, freedom, lines = np.zeros(rows), [None] * rows, None
            expressions: list[list[str]] = [[] for _ in range(rows)]
            hits = [(end - size + 1, phrase) for end, (phrase, size) in machine.iter(text)]
            if hits:
                spaces = np.flatnonzero(flat == 0x20)
                at = np.array([a for a, _ in hits])
                row = np.searchsorted(starts, at, "right") - 1
                # a row's words follow its spaces: the n-th space precedes word n
                index = np.searchsorted(spaces, at) - np.searchsorted(spaces, starts[row])
                for r, i, (_, phrase) in zip(row.tolist(), index.tolist(), hits):
                    if phrase == TAG:
                        last = words.first[r] + i + 2
                        if lines is None:
                            lines = np.flatnonzero(raw == 0x0A)
                        ends = np.searchsorted(lines, words.end[last])
                        end = min(block.offsets[r + 1], lines[ends] if ends < len(lines) else len(raw))
                        tail = bytes(raw[words.end[last] : end]).decode(errors="replace")
                        parsed = to_postfix(tail[1:].strip().rstrip("*/-># ")) if tail.startswith(":") else None
                        result = evaluate(parsed) if parsed else None
                        if result:
                            expressions[r].append(" ".join(parsed))
                            labels[r] |= result[1]
                            bound[r] |= result[2]
                            freedom[r] = result[0] if freedom[r] is None else min(freedom[r], result[0])
                        score[r] = max(score[r], 1.0 if result else 0.5)
                        continue
                    if phrase in BASE:
                        base[r].append((i, BASE[phrase]))
                    labels[r].add(BASE.get(phrase) or NOTICES[phrase])
                    score[r] = max(score[r], 0.9)
            own = batch["doc_id"].slice(block.start, block.stop - block.start)
            join = lambda x: ",".join(sorted(x))
            yield pa.RecordBatch.from_arrays(
                [
                    own, pa.array(count.astype(np.int64)), pa.array([len(b) for b in base], pa.int64()),
                    pa.array([min((i for i, _ in b), default=None) for b in base], pa.int64()), pa.array([max((i for i, _ in b), default=None) for b in base], pa.int64()),
                    pa.array([join({x for _, x in b}) for b in base], pa.string()), pa.array(list(map(join, labels)), pa.string()), pa.array(score), pa.array(expressions, pa.list_(pa.string())), pa.array(freedom, pa.float64()), pa.array(list(map(join, bound)), pa.string()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "freedom", "bound"],
            )


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: words, base places, labels, score, the tags' expressions in postfix order, their freedom (0 to 1) and the families one is bound by."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, freedom double, bound string"
    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, schema)
