"""Line deduplication against a plain version."""

import hashlib
import random
import re

import pytest

from tidewell.llm import line_dedup

from . import corpus


def plain(texts, least, shortest=1):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    count = {}
    for lines in split:
        for k in {key(x) for x in lines}:
            count[k] = count.get(k, 0) + 1
    gone = {k for k, n in count.items() if n >= least and len(k) >= shortest}
    kept = [[x for x in lines if key(x) not in gone] for lines in split]
    return [(len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(split, kept, strict=True)]


def texts(n=160, seed=4):
    rng = random.Random(seed)
    common = ["Share this page", "  share THIS page\t", "©É Accept cookies", "©é Accept cookies", "", "  ", "\x0bx\x0c", "K", "k"]
    out = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"line {rng.randrange(400)} of {rng.choice('ABCÀßé')}" for _ in range(rng.randint(1, 12))]
        out.append("\n".join(lines) if i % 9 else rng.choice([None, "", "\n", "\n\nend\n", "a\r\nb", "Share this page"]))
    return out + [out[1], out[1]]


@pytest.mark.parametrize(("least", "shortest"), [(10, 1), (2, 0), (3, 5), (1, 1), (10**9, 1)])
def test_line_dedup(spark, least, shortest):
    own = texts()
    docs = corpus.table(spark, [(i // 2 if i % 3 else None, t, "en", "s", None, "x", "y", "z") for i, t in enumerate(own)])
    out = line_dedup.line_dedup(docs, least, shortest).collect()
    assert sorted((r.n_lines, r.n_dropped, r.text or "") for r in out) == sorted(plain(own, least, shortest))
    assert sum(r.text is None for r in out) == sum(t is None for t in own)
    assert sorted(map(str, (r.doc_id for r in out))) == sorted(str(r.doc_id) for r in docs.collect())


def test_digests_and_long_texts(spark):
    rng = random.Random(1)
    long = "\n".join(rng.choice(["Common line", f"own {i}", "É common", ""]) for i in range(60_000))  # some 700 kB
    wide = "w" * 3_000_000 + " " * 500_000 + "\n" + " " * 500_000  # blanks inside and at the end
    own = [long, wide, *["common LINE\nother"] * 9, None]
    docs = corpus.table(spark, [(i, t, "en", "s", None, "x", "y", "z") for i, t in enumerate(own)])
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in enumerate(plain(own, 10))]
    assert sorted(map(tuple, line_dedup.digests(docs).collect())) == want


def test_defined_cases(spark):
    assert line_dedup.digests(corpus.empty(spark)).collect() == []
    clash = corpus.table(spark).withColumnRenamed("size", "n_lines")
    with pytest.raises(ValueError, match="prefix"):
        line_dedup.line_dedup(clash)
    out = line_dedup.line_dedup(clash, prefix="x_")
    assert out.columns == [*clash.columns, "x_n_lines", "x_n_dropped"] and out.count() == clash.count()
    with pytest.raises(ValueError, match="positive"):
        line_dedup.line_dedup(clash, 0, prefix="x_")
    same = [(7, "a\nb", "en", "s", None, "x", "y", "z")] * 10  # each repeated row is a document
    assert [r.text for r in line_dedup.line_dedup(corpus.table(spark, same)).collect()] == [""] * 10


def test_no_python_in_the_plan(spark):
    plan = line_dedup.digests(corpus.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
