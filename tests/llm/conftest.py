"""Small tables for the operators of the subpackage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def docs(texts, ids=None, lang="en"):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return docs


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty, blank, repeated, very long and non-ASCII texts, and columns of other names and clashing ones."""
    long = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40_000))
    texts = [None, "", "   \n\t ", "word", "word", "é ß ñ 漢字 🙂", long, "x" * 50_000, None, "!!! ???"]
    rows = make_docs(texts, [0, 1, 2, 3, 3, 4, 5, 6, None, None])
    extra = {name: F.lit(None).cast("string") for name in ("label", "score", "items", "ranges", "fp", "row", "pack", "ids")}
    return rows.withColumns(extra)


@pytest.fixture(scope="session")
def corpus():
    """Invented texts with copies, near copies and shared passages."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passages = [text(60) for _ in range(3)]
    out = [text(rnd.randrange(1, 250)) for _ in range(60)]
    out += [out[0], out[0], out[3] + " more", out[5].replace(" ", "  ", 3)]
    for i in range(20):
        out.append(f"{text(rnd.randrange(0, 40))} {passages[i % 3]} {text(rnd.randrange(0, 40))}")
    out += ["ab " * 300, "ab " * 299 + "cd", "", "one", "Ünïcode " * 40, "zz" * 400]
    near = out[7].split()
    for i in range(6):
        near = [*near]
        near[(7 * i) % len(near)] = "changed"
        out.append(" ".join(near))
    return out
