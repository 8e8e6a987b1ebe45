"""A small corpus with the awkward cases: nulls, empty and long texts, ties, copies, clashing extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("size", T.StringType()), ("th", T.StringType()), ("variant", T.StringType()))])


def rows(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["th", "er", "on", "an", "re", "hé", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, out = sentence(60), []
    for i in range(n):
        kind = i % 12
        text = sentence(rng.randint(1, 90))
        if kind == 3 and out:
            text = out[rng.randrange(len(out))]
        elif kind == 4:
            text = f"{sentence(20)}\n{passage}\t{sentence(15)}"
        elif kind == 5:
            text = (sentence(70) + " ") + (out[4] or "x" if len(out) > 4 else "")
        elif kind == 6 and out:
            text = (out[-2] or "a b c").replace(" ", "  ", 1) + " end"
        elif kind == 7:
            text = rng.choice([None, "", "  \n", "one", "two words", "MIT License and the Apache  License.", "SPDX-License-Identifier: (MIT OR GPL-2.0) AND BSD-3-Clause\nmit license"])
        elif kind == 8:
            text = "na " * rng.randint(1, 60)
        out.append(text)
    out.append(" ".join(sentence(200) for _ in range(40)))
    return [(i * 3 + 1, t, "en", f"src{i % 3}" if i % 7 else None, None, "x", "y", "z") for i, t in enumerate(out)]


def table(spark, own=None):
    return spark.createDataFrame(own if own is not None else rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
