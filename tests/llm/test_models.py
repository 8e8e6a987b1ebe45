"""Decontamination, quality and language against brute force and held-out accuracy; the pipeline's stages."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import decontaminate as D
from tidewell.llm import language as G
from tidewell.llm import quality as Q
from tidewell.llm.shared import text_blocks

from .corpus import SCHEMA, empty, rows, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def items_table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_leaks(spark):
    rng = random.Random(8)
    make = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(k))
    texts = [f"{make(rng.randint(6, 30)).capitalize()}? {make(rng.randint(3, 12))}." for _ in range(40)] + [None, "", "too short", make(30)]
    own = rows()
    planted = {}
    for i in range(0, 40, 3):
        text = (own[i][1] or "") + "\n" + texts[i].upper() + " " + make(400)
        own[i] = (own[i][0], text, *own[i][2:])
        planted[own[i][0]] = i
    own.append((9_000, " ".join(make(9) + " " + t for t in texts if t), *[None] * 6))
    half = texts[1].split()
    own.append((9_001, make(50) + " ".join(half[: len(half) // 2]) + make(50), *[None] * 6))
    got = {(r.doc_id, r.item_id): r for r in D.leaks(table(spark, own), items_table(spark, texts)).collect()}
    want = set()
    for (d, t, *_), (i, x) in itertools.product(own, enumerate(texts)):
        w = words(x)
        if len(w) >= D.SHORTEST and f" {' '.join(w)} " in f" {' '.join(words(t))} ":
            want.add((d, i))
    assert set(got) == want and {(d, i) for d, i in planted.items()} <= want
    assert all(r.question_overlap == r.answer_overlap == 1 and 0.5 <= r.score <= 1 for r in got.values())
    kept = D.clean(table(spark, own), items_table(spark, texts))
    assert kept.columns == SCHEMA.names
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in own} - {d for d, _ in want}
    assert D.leaks(empty(spark), items_table(spark, texts)).count() == 0
    assert D.leaks(table(spark), items_table(spark, [])).count() == 0


def test_wand_misses_nothing_above_the_threshold(monkeypatch):
    """Without verification: every window and item whose plain score reaches the threshold."""
    monkeypatch.setattr(D, "OVERLAP", 0.0)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [make(rng.randint(5, 25)) for _ in range(50)]
    docs = [make(rng.randint(0, 500)) for _ in range(40)]
    for i in range(30):
        part = items[i].split()
        docs[i % 40] += " " + " ".join(rng.sample(part, max(1, int(len(part) * rng.random()))))
    index = D.build(np.arange(50), pa.array(items))
    got = set()
    for block in text_blocks(pa.array(docs), 3000):
        got |= {(block.start + int(r[0]), int(r[1])) for r in D.search(block, index)}
    # stretches of few windows, and every posting sought or none
    whole = list(text_blocks(pa.array(docs)))
    for cells, seek in ((1, 0), (1, 1 << 40), (300, 0), (300, 1)):
        monkeypatch.setattr(D, "CELLS", cells)
        monkeypatch.setattr(D, "SEEK", seek)
        assert {(block.start + int(r[0]), int(r[1])) for block in whole for r in D.search(block, index)} == got
    impact = [dict(zip(index.terms[np.searchsorted(index.begin, k, "right") - 1].tolist(), index.impact[k])) for k in (np.flatnonzero(index.item == i) for i in range(50))]
    want = set()
    for block in text_blocks(pa.array(docs)):
        w, h = D.tokens(block)
        for r in range(len(docs)):
            own = h[w.first[r] : w.first[r + 1]].tolist()
            for p in range(max(1, -(-len(own) // index.stride) - 1)):
                seen = set(own[p * index.stride : (p + 2) * index.stride])
                want |= {(r, i) for i in range(50) if sum(x for t, x in impact[i].items() if t in seen) >= D.RETRIEVE}
    assert got == want and len(want) > 20


def test_slices_of_the_index(spark, monkeypatch):
    texts = [f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}" for i in range(20)]
    own = [(i, f"some words {texts[i]} more words", *[None] * 6) for i in range(20)]
    monkeypatch.setattr(D, "SLICE_BYTES", 300)
    assert len(D.indexes(items_table(spark, texts))) > 1
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(table(spark, own), items_table(spark, texts)).collect()) == [(i, i) for i in range(20)]


def test_slices_score_like_one_index(spark, monkeypatch):
    """Scores and passages don't depend on how many slices the items make."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 120))) for _ in range(30)]
    own = [(i, " ".join(rng.choice(vocabulary) for _ in range(150)) + f" {t} tail" if i % 2 else " ".join(t.split()[:-1]), *[None] * 6) for i, t in enumerate(texts)]
    found = lambda: sorted(map(tuple, D.leaks(spark.createDataFrame(own, SCHEMA), items_table(spark, texts)).collect()))
    whole = found()
    monkeypatch.setattr(D, "SLICE_BYTES", 3000)
    assert len(D.indexes(items_table(spark, texts))) > 2
    sliced = found()
    assert len(whole) >= 25 and [r[:2] + r[3:] for r in sliced] == [r[:2] + r[3:] for r in whole]
    assert [r[2] for r in sliced] == pytest.approx([r[2] for r in whole], abs=1e-8) and min(r[2] for r in whole) < 1


def test_short_and_nameless_items(spark):
    """Items of one to four words are found word for word, and an item without item_id as any other."""
    items = spark.createDataFrame([(1, "Zebra quagga okapi."), (2, "Why? Because."), (3, "xylem"), (None, "one two three four five six seven"), (4, " .")], "item_id long, text string")
    texts = ["so a zebra, quagga OKAPI came", "zebra okapi quagga", "and why because", "because of that, why", "the xylem", "zero one two three four five six seven eight", "none of it"]
    docs = spark.createDataFrame([(i, t, *[None] * 6) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()), key=str) == [(0, 1), (2, 2), (4, 3), (5, None)]
    assert sorted(r.doc_id for r in D.clean(docs, items).collect()) == [1, 3, 6]


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = Q.quality_model(docs, labels)
    out = {r.doc_id: r for r in Q.score_quality(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(out[r.doc_id].held_out for r in held)
    assert np.mean([out[r.doc_id].predicted == r.quality for r in held]) > 0.93
    kept = Q.keep_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, r in out.items() if r.predicted}


def test_quality_awkward_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.quality_model(table(spark), none)
    out = Q.score_quality(table(spark), model).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == 1 for r in out)
    odd = spark.createDataFrame([(1, 0), (4, 1), (7, None), (None, 1), (10, 1), (10, 1), (13, 0), (99_999, 1)], "doc_id long, quality int")
    model = Q.quality_model(table(spark), odd)
    assert all(0 <= r.score <= 1 for r in Q.score_quality(table(spark), model).collect())
    assert Q.score_quality(empty(spark), model).count() == 0 and Q.keep_quality(empty(spark), model).count() == 0


def test_score_does_not_depend_on_neighbours():
    texts = pa.array([t for _, t, *_ in rows()])
    rng = np.random.default_rng(1)
    model = Q.Model(rng.normal(size=Q.BUCKETS), 0.1)
    together = np.concatenate([model.scores(b) for b in text_blocks(texts)])
    alone = np.concatenate([model.scores(b) for b in text_blocks(texts, 1)])
    assert np.allclose(together, alone, atol=1e-8)


def test_features_and_forward_pass_equal_plain(monkeypatch):
    """Scores from features counted one by one, and gradients against differences of the loss."""
    from tidewell.llm.words import U, mix, split_words, word_hashes

    rng = np.random.default_rng(2)
    model = Q.Model(rng.normal(size=Q.BUCKETS), -0.2)
    hashed = lambda w: int(word_hashes(b := next(text_blocks(pa.array([w]))), split_words(b))[0])
    bases = 0xC2B2AE3D27D4EB4F | 1

    def run(hs):
        total = 0
        for h in hs:
            total = (total * bases + h) % (1 << 64)
        return int(mix(np.array([total], U))[0])

    def gram(chars):
        h = len(chars)
        for c in chars:
            h = (h * 0x01000193 % (1 << 32)) ^ ord(c)
        return (h * 0x9E3779B1 % (1 << 32)) >> 16

    for text in [t for _, t, *_ in rows() if t and len(t) < 400][:12] + ["", "é", "na na na na nb", "日本語 ñandú", "ein Wort"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        h = [hashed(x) for x in w]
        buckets = [x >> 48 for x in h] + [run(h[i : i + 2]) >> 48 for i in range(len(h) - 1)]
        for i in range(len(h) - 3):
            shape = 1
            for a in range(4):
                for b in range(a):
                    shape = shape << 1 | (w[i + a] == w[i + b])
            buckets.append(int(mix(np.array([shape], U))[0]) >> 48)
        buckets += [gram(text[i : i + n]) for n in Q.ORDERS for i in range(len(text) - n + 1)]
        margin = sum(model.weight[b] for b in buckets) / max(1, len(buckets)) + model.bias
        (score,) = model.scores(next(text_blocks(pa.array([text])))) if text else model.scores(next(text_blocks(pa.array([None], pa.string()))))
        assert score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-8), text
    mean, out, bias = rng.normal(size=5), rng.normal(size=(2, 5)), rng.normal(size=2)
    loss = lambda m, o, b, y: -np.log(np.exp(o @ m + b)[y] / np.exp(o @ m + b).sum())
    for y in (0, 1):
        got = Q.gradients(mean, out, bias, y)
        for k, x in enumerate((out, bias, mean)):
            for i in np.ndindex(x.shape):
                step = np.zeros(x.shape)
                step[i] = 1e-6
                args = [[out, bias, mean][j] + (step if j == k else 0) for j in range(3)]
                less = [[out, bias, mean][j] - (step if j == k else 0) for j in range(3)]
                slope = (loss(args[2], args[0], args[1], y) - loss(less[2], less[0], less[1], y)) / 2e-6
                assert got[k][i] == pytest.approx(slope, abs=1e-6)


def test_samples_are_bounded_in_bytes(spark):
    from tidewell.llm.sampling import sample_texts

    docs = spark.createDataFrame([(i, "x" * 100 if i else "y" * 5000) for i in range(50)] + [(3, "x" * 100)], "doc_id long, text string")
    chosen = docs.selectExpr("doc_id", "1 as label")
    assert sample_texts(docs, chosen, 1000, 1).num_rows == 50 and sample_texts(docs, chosen, 7, 1).num_rows == 7
    some = sample_texts(docs, chosen, 1000, 1, 1000)
    assert some.num_rows == 10 and set(some["label"].to_pylist()) == {1} and sample_texts(docs, chosen.limit(0), 9, 1).num_rows == 0


def test_awkward_rows_of_models(spark):
    """Null ids, repeated rows and a text of 2 MB get a row each."""
    long = "ein zwei drei " * 150_000
    own = [(d, t, "de", "s", None, None, None, None) for d, t in [(None, "abc def"), (None, "abc def"), (2, long), (2, long), (3, None)]]
    docs = table(spark, own)
    model = Q.quality_model(docs, spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int"))
    assert sorted((str(r.doc_id), r.held_out) for r in Q.score_quality(docs, model).collect() if r.doc_id is None) == [("None", False)] * 2
    assert Q.score_quality(docs, model).count() == 5
    out = G.identify(docs, G.fit(docs)).collect()
    assert len(out) == 5 and all(not r.held_out for r in out if r.doc_id is None) and {r.lang_pred for r in out if r.doc_id == 2} == {"de"}


def plain_viterbi(scores, starts, switch):
    best, back = None, []
    for s, start in zip(scores, starts):
        if best is None:
            best = s.copy()
            continue
        cost = 0 if start else switch
        top = best.argmax()
        moved = best[top] - cost
        back.append([i if best[i] >= moved else top for i in range(len(s))])
        best = np.maximum(best, moved) + s
    path = [int(best.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("n", [1, 5, 64, 65, 700])
def test_viterbi_equals_plain(n):
    rng = np.random.default_rng(n)
    scores = rng.normal(size=(n, 3)) * 3
    starts = rng.random(n) < 0.05
    starts[0] = True
    assert G.viterbi(scores, starts, 4.0).tolist() == plain_viterbi(scores, starts, 4.0)


def test_language_held_out_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = G.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    truth = {r.doc_id: r for r in docs.collect()}
    out = G.identify(docs, model).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.98
    for r in out:
        assert 0 <= r.score <= 1 and sum(s.n_words for s in r.spans) == len(re.findall(r"[^\x20\x09-\x0D]+", truth[r.doc_id].text))
    de, fr = (next(t.text for t in truth.values() if t.lang == x and len(t.text) > 1500)[:1500] for x in ("de", "fr"))
    mixed = spark.createDataFrame([(1, f"{de} {fr}"), (2, None), (3, "12 34 !?"), (4, ""), (5, "Привет мир")], "doc_id long, text string")
    got = {r.doc_id: r for r in G.identify(mixed, model).collect()}
    assert [s.lang for s in got[1].spans] == ["de", "fr"]
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4)) and got[5].lang_pred in model.languages


def test_language_awkward_tables(spark):
    model = G.fit(empty(spark))
    assert {r.lang_pred for r in G.identify(table(spark), model).collect()} == {"und"}
    assert G.identify(empty(spark), G.fit(table(spark))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    numbers = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        numbers.append(docs.count())
    assert numbers[0] > numbers[1] > numbers[2] >= numbers[3] > 0
    last = P.run(spark, SF)
    assert last.count() == numbers[-1] and {"doc_id", "shard", "shard_bytes"} <= set(last.columns)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_keep_one_of_each_component(spark):
    from tidewell.llm import simhash

    own = rows() + rows()[:4] + [(None, "quite another text", *[None] * 6)] * 2 + [(None, rows()[0][1], *[None] * 6)]
    found = simhash.near_duplicates(table(spark), 3).collect()
    kept = [r.doc_id for r in simhash.keep_one(table(spark, own)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({r.component_id for r in found})
    assert kept.count(None) == 1


def test_pipeline_equals_plain(spark):
    """run() against a plain version, given the classifier's choice: the documents that come out, and each source's words against its target."""
    import collections

    import corpus_pipeline as P

    from .test_allocation import check_shards, plain_targets
    from .test_duplicates import brute_classes, brute_simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = [(r.doc_id, r.text, r.source) for r in P.keep_quality(spark, docs, SF).collect()]
    heads = brute_classes([r[0] for r in own], brute_simhash(own))
    own = [r for r, head in zip(own, heads) if r[0] == head]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    cut = lambda x: [m.end() for m in re.finditer(r"[.!?\n]\s+", x) if words(x[: m.end()]) and words(x[m.end() :])]
    halves = [(x[: cut(x)[-1]], x[cut(x)[-1] :]) if cut(x) else (x, x) for x in items]
    shingles = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    parts = [[(len(w[:5]), shingles(w, len(w[:5]))) for w in map(words, pair)] for pair in halves]
    stride = max(64, *(len(words(x)) for x in items))

    def leaks(text):
        w = words(text)
        for p in range(max(1, -(-len(w) // stride) - 1)):
            have = {k: shingles(w[p * stride : (p + 2) * stride], k) for k in range(1, 6)}
            if any(all(len(s & have[k]) >= 0.8 * len(s) for k, s in pair) for pair in parts):
                return True
        return False

    clean = {r[0]: (len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), r[2]) for r in own if not leaks(r[1])}
    out = P.run(spark, SF).collect()
    check_shards(out, P.SHARD_BYTES)
    times = collections.Counter(r.doc_id for r in out)
    assert set(times) <= set(clean) and max(times.values()) <= 3 and all(times[d] == 1 for d, (n, _) in clean.items() if not n)
    sizes, got = collections.Counter(), collections.Counter()
    for d, (n, source) in clean.items():
        sizes[source] += n
        got[source] += n * times[d]
    target = plain_targets(sizes)
    # no copy of a document more or less brings its source nearer, but for the block that a quota is rounded to
    for d, (n, source) in clean.items():
        off = got[source] - target[source]
        for step in [-1] * (times[d] > 0) + [1] * (times[d] < 3):
            assert not n or abs(off + step * n) >= abs(off) - 64, (source, off, n)
