"""Substring dedup, SimHash and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidewell.llm import bitfilter, joins, simhash
from tidewell.llm import substring_dedup as S
from tidewell.llm.components import components
from tidewell.llm.shared import text_blocks
from tidewell.llm.words import split_words, word_hashes

from .corpus import SCHEMA, empty, rows, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(own, window=13):
    key = lambda d: S.NO_ID if d is None else d
    first, out = {}, []
    split = [(d, WORDS.findall(t or "")) for d, t, *_ in own]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, S.NO_ID), key(d))
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["plain", "null ids", "repeated rows", "same id other text"])
def test_substring_dedup(spark, case):
    own = rows()
    if case == "null ids":
        own += [(None, own[4][1], *own[4][2:]), (None, own[16][1], *own[16][2:])]
    elif case == "repeated rows":
        own += own[3:9]
    elif case == "same id other text":
        own += [(own[4][0], own[16][1] + " more", *own[4][2:])]
    got = sorted(map(tuple, S.substring_dedup(table(spark, own)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    want = brute_substrings(own)
    assert got == want
    assert sum(1 for x in want if 0 < x[2] < x[1]) > 5


@pytest.mark.parametrize("setting", ["useless filters", "every key hot", "nothing glued"])
def test_substring_dedup_is_alike_at_every_setting(spark, monkeypatch, setting):
    """Neither a filter that spares nothing nor salts on every key change a row."""
    if setting == "useless filters":
        monkeypatch.setattr(bitfilter, "filter_bits", lambda n: 64)
    elif setting == "every key hot":
        monkeypatch.setattr(joins, "HOT", 1 << 20)
    else:
        monkeypatch.setattr(bitfilter, "filter_bits", lambda n: 1 << 22)
    got = S.substring_dedup(table(spark)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_substrings(rows())


def plain_paths(own, window=13):
    """The nonbranching paths over candidate edges, by a plain walk: document's place, first word, edges."""
    texts = [WORDS.findall(t or "") for _, t, *_ in own]
    pieces = []
    for d, w in enumerate(texts):
        block = next(text_blocks(pa.array([" ".join(w)])))
        split = split_words(block)
        _, first, count, least = S._pieces(split, word_hashes(block, split), window)
        pieces += [(d, f, c, m) for f, c, m in zip(first.tolist(), count.tolist(), least.tolist())]
    where = {}
    for d, _, _, m in pieces:
        where.setdefault(m, set()).add(tuple(texts[d]))
    edges = {(d, f + i) for d, f, c, m in pieces if len(where[m]) > 1 for i in range(c)}
    node = lambda d, p: tuple(texts[d][p : p + window - 1])
    word = lambda d, p: texts[d][p] if 0 <= p < len(texts[d]) else None
    into, out = {}, {}
    for d, p in {(d, p + i) for d, p in edges for i in (0, 1)}:
        into.setdefault(node(d, p), set()).add(word(d, p - 1))
        out.setdefault(node(d, p), set()).add(word(d, p + window - 1))
    found = {}
    for d, p in sorted(edges):
        glued = (d, p - 1) in edges and len(into[node(d, p)]) == len(out[node(d, p)]) == 1
        start = start if glued else p  # noqa: F821
        found[d, start] = p - start + 1
    return sorted((d, p, n) for (d, p), n in found.items())


def test_compacted_paths_equal_a_plain_walk(spark):
    own = [(i, t, *r) for i, (_, t, *r) in enumerate(rows())]
    docs = table(spark, own).selectExpr("doc_id", "xxhash64(doc_id, text) as jid", "text")
    profile = docs.mapInArrow(S._profile(13), "doc_id long, jid long, th long, n_words long, sha string, ms array<long>")
    got = S.compacted_paths(docs, profile).collect()
    assert sorted((r.doc_id, r["first"], r.windows) for r in got) == plain_paths(own)
    for r in got:
        assert bytes(r.path) == hashlib.sha256(" ".join(WORDS.findall(own[r.doc_id][1])[r["first"] : r["first"] + r.windows + 12]).encode()).digest()
    assert max(r.windows for r in got) > 40


def test_substring_dedup_of_long_looping_and_nameless_texts(spark):
    """A text of over 2 MB, loops in the graph, one line that most documents repeat, and many rows without doc_id."""
    rng = random.Random(31)
    make = lambda k: " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randrange(99)) for _ in range(k))
    line = make(14)
    long = " ".join(make(2000) for _ in range(250))
    assert len(long) > 2 << 20
    texts = [(9, long), (3, long[1_000_000:1_004_000]), (5, "la " * 400), (4, "x la la " + "la " * 30), (6, "pim pam " * 50), (7, "pam pim " * 20 + "end")]
    texts += [(100 + i, f"{make(3)} {line} {make(2)} {line} {line}") for i in range(60)] + [(None, f"{make(20)} {line}") for _ in range(60)] + [(None, texts[1][1])]
    own = [(d, t, *[None] * 6) for d, t in texts]
    out = S.substring_dedup(table(spark, own))
    got = sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute_substrings(own)


def test_substring_dedup_empty(spark):
    assert S.substring_dedup(empty(spark)).count() == 0


def brute_simhash(own):
    prints = []
    for _, t, *_ in own:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    return prints


def brute_classes(ids, prints):
    least = dict.fromkeys(range(len(ids)))
    group = list(range(len(ids)))
    arr = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            a, b = group[i], group[j]
            if a != b:
                group = [a if g == b else g for g in group]
    for g in set(group):
        least[g] = min(d for d, x in zip(ids, group) if x == g)
    return [least[g] for g in group]


def test_simhash(spark):
    own = rows()
    own += own[:3]
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(table(spark, own)).collect())
    prints = brute_simhash(own)
    ids = [r[0] for r in own]
    assert got == sorted(zip(ids, prints, brute_classes(ids, prints)))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_of_shared_and_null_ids(spark):
    """Null-id texts near two documents don't merge them, nor do different texts under one doc_id; each clean text stays."""
    from .corpus import SCHEMA as schema

    rng = random.Random(12)
    text = lambda k=400: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k))
    five, nine, shared, other, lone, lost = (text() for _ in range(6))

    def near(t):
        more = (t + "".join(f" end{i}x{j}" for j in range(1 + i % 6)) for i in range(99))
        return next(x for x in more if 0 < (brute_simhash([(0, x)])[0] ^ brute_simhash([(0, t)])[0]).bit_count() <= 3)

    own = [(5, five), (9, nine), (None, near(five)), (None, near(nine)), (20, shared), (20, other), (30, near(other)), (None, lone), (None, lost), (None, lost)]
    docs = spark.createDataFrame([(d, t, *[None] * 6) for d, t in own], schema)
    component = dict.fromkeys([five, own[2][1]], 5) | dict.fromkeys([nine, own[3][1]], 9) | dict.fromkeys([shared, other, own[6][1]], 20) | dict.fromkeys([lone, lost], S.NO_ID)
    want = sorted(((d, p, component[t]) for (d, t), p in zip(own, brute_simhash(own))), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str) == want
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, five), (9, nine), (20, shared), (20, other), (None, lone), (None, lost)], key=str)


def test_ball_links_reach_every_distance(spark):
    """Random words with planted neighbours at 1 to 4 bits: the links' components are those of all pairs at 3 or less."""
    rng = random.Random(4)
    prints = {}
    for i in range(120):
        x = rng.getrandbits(64)
        prints[x] = len(prints)
        for n in (1, 2, 3, 4):
            if rng.random() < 0.5:
                y = x
                for b in rng.sample(range(64), n):
                    y ^= 1 << b
                prints.setdefault(y, len(prints))
    reps = spark.createDataFrame([(i, simhash._signed(x)) for x, i in prints.items()], "rep long, fp long")
    found = simhash.links(reps)
    by = {i: x for x, i in prints.items()}
    assert all((by[r.a] ^ by[r.b]).bit_count() <= 3 for r in found.collect())
    label = {r.node: r.component for r in components(found).collect()}
    ids = list(by)
    assert [label.get(i, i) for i in ids] == brute_classes(ids, [by[i] for i in ids])


def test_links_are_verified_and_named(spark, monkeypatch):
    """A pair that is too far apart isn't a link, wherever it comes from; the column says which links it counts."""
    import pyarrow as pa

    def far_too(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([1, 1] * (b.num_rows > 0), pa.int64()), pa.array([2, 3] * (b.num_rows > 0), pa.int64())], ["a", "b"])

    monkeypatch.setattr(simhash, "_meet", far_too)
    reps = spark.createDataFrame([(1, 0), (2, 7), (3, 15)], "rep long, fp long")
    assert [tuple(r) for r in simhash.links(reps).collect()] == [(1, 2)]
    assert simhash.near_duplicates(empty(spark)).columns == ["doc_id", "fp", "component_id", "n_spanning_links"]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 90)] + [(700, 700), (900, 901), (901, 900)]
    edges += [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(201)) and all(out[500 + i] == 500 for i in range(90)) and out[901] == 900 and 700 not in out
    parent = {}
    for a, b in edges:
        if a != b:
            parent.setdefault(a, {a}).update(parent.setdefault(b, {b}))
            for x in parent[b]:
                parent[x] = parent[a]
            parent[a] |= parent[b]
            for x in list(parent[a]):
                parent[x] = parent[a]
    assert out == {x: min(g) for x, g in parent.items()}


def test_clashing_columns():
    assert {"size", "th", "variant"} <= set(SCHEMA.names)
