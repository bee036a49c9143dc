"""Language identification with averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import ddl, map_texts, record_batch, stored
from tagweave.llm.quality import fold

BUCKETS = 1 << 14
DIMENSIONS = 16
#: Bytes in a subword; words stand between spaces, which count as a byte at either end.
SIZES = (2, 3, 4)
#: Bounds of the sample: expected number of learned documents for a language, drawn by a hash of the id, and of all languages together.
PER_LANGUAGE = 500
LEARNED = 20_000
EPOCHS, RATE, SEED = 8, 2.0, 7
#: Share of wrong answers allowed among accepted ones, on the calibration documents (each fifth).
ACCEPTED_ERROR = 0.01
UNDETERMINED = "und"

#: ASCII letters stay and become small, bytes beyond ASCII stay, all others become a space.
_LETTER_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))
#: Bytes of text hashed at once.
_CHUNK = 1 << 20


def subwords(raw: bytes | None) -> np.ndarray:
    """How often each bucket occurs in a text; all zero for a text without letters."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if not raw or not has_letter(raw):
        return counts
    joined = b" " + b" ".join(raw.translate(_LETTER_BYTES).split()) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    for at in range(0, len(data), _CHUNK):
        part = data[at : at + _CHUNK + max(SIZES) - 1]
        wide, space = part.astype(np.uint32) + np.uint32(1), part == 32
        for size in SIZES:
            n = min(_CHUNK, len(part) - size + 1)
            if n <= 0:
                continue
            mixed = np.full(n, size, dtype=np.uint32)
            inside = np.zeros(n, dtype=bool)
            for i in range(size):
                mixed = (mixed ^ wide[i : i + n]) * _MIX[i]
                if 0 < i < size - 1:
                    inside |= space[i : i + n]
            buckets = mixed >> np.uint32(18)
            counts += np.bincount(buckets[~inside], minlength=BUCKETS)
    return counts


def has_letter(raw: bytes) -> bool:
    """Whether a text has a letter of any script."""
    letters = raw.translate(None, bytes(b for b in range(128) if not chr(b).isalpha()))
    if not letters:
        return False
    return letters.translate(None, bytes(range(128, 256))) != b"" or any(c.isalpha() for c in letters.decode())


@dataclass
class SubwordModel:
    """``table`` holds, for each bucket, what it adds to the scores: embeddings times output weights."""

    languages: list[str]
    table: np.ndarray
    temperature: float
    accept_from: float

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        """The likeliest language and its calibrated probability."""
        total = counts.sum()
        if not total or not self.languages:
            return UNDETERMINED, 0.0
        p = _softmax((counts @ self.table) / total / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[list[int], list[int], str]]) -> SubwordModel:
    """Stochastic gradient descent over ``(buckets, counts, language)``, then calibration on each fifth row."""
    languages = sorted({row[2] for row in rows})
    data = []
    for buckets, counts, language in rows:
        weights = np.array(counts, dtype=np.float64)
        data.append((np.array(buckets, dtype=np.int64), weights / weights.sum(), languages.index(language)))
    learned = [x for i, x in enumerate(data) if i % 5] or data
    held = data[::5]
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    output = np.zeros((DIMENSIONS, len(languages)))
    steps, step = EPOCHS * len(learned), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learned)).tolist():
            buckets, weights, label = learned[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = weights @ embedding[buckets]
            error = _softmax(mean @ output)
            error[label] -= 1
            down = output @ error
            output -= rate * np.outer(mean, error)
            # Embeddings move as fast as one that stood alone would: weights are small in long texts.
            embedding[buckets] -= (rate / weights.max()) * weights[:, None] * down[None, :]
    model = SubwordModel(languages, embedding @ output, 1.0, 0.0)
    if held and len(languages) > 1:
        raw = np.array([weights @ model.table[buckets] for buckets, weights, _ in held])
        labels = np.array([label for _, _, label in held])
        own = np.arange(len(labels))
        temperatures = np.geomspace(0.05, 20, 61)
        losses = [-np.log(_softmax(raw / t)[own, labels] + 1e-12).mean() for t in temperatures]
        model.temperature = float(temperatures[int(np.argmin(losses))])
        p = _softmax(raw / model.temperature)
        order = np.argsort(-p.max(axis=1), kind="stable")
        wrong = (p.argmax(axis=1) != labels)[order]
        rates = np.cumsum(wrong) / np.arange(1, len(wrong) + 1)
        good = np.nonzero(rates <= ACCEPTED_ERROR)[0]
        model.accept_from = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame, folds: int, held_out: int, per_language: int) -> list[tuple[list[int], list[int], str]]:
    """Subwords of learned documents: all of a rare language, ``per_language`` expected of another one, fewer where there are very many languages; of each at least one."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null")
    known = known.where(fold("doc_id", folds) != held_out)
    draw = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    totals = stored(known.groupBy("lang").agg(F.count("*").alias("total"), F.min(draw).alias("least")), "languages")
    expected = max(1, min(per_language, LEARNED // max(1, totals.count())))
    drawn = known.join(totals, "lang").where((draw * F.col("total") < expected) | (draw == F.col("least")))
    fields = {"doc_id": "long", "lang": "string", "buckets": "array<int>", "counts": "array<int>"}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [subwords(raw.as_py()) for raw in batch.column(2)]
            used = [np.nonzero(c)[0] for c in counts]
            values = [c[u].astype(np.int32) for c, u in zip(counts, used, strict=True)]
            yield record_batch(fields, [batch.column(0), batch.column(1), [u.astype(np.int32) for u in used], values])

    rows = drawn.select("doc_id", "lang", F.col("text").cast("binary")).mapInArrow(features, ddl(fields))
    found = rows.where(F.size("buckets") > 0).orderBy(F.xxhash64("doc_id", "lang"), "doc_id").toArrow()
    columns = (found.column(name) for name in ("buckets", "counts", "lang"))
    return [(b.values.to_numpy(), c.values.to_numpy(), lang.as_py()) for b, c, lang in zip(*columns, strict=True)]


def identify_languages(
    docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document.

    Learned are documents with a language whose id does not fall in the fold ``held_out``: an expected
    ``per_language`` of each language, fewer if all together were more than ``LEARNED``, but at least one of each, which bounds what reaches the driver. Predictions use the whole text and nothing
    else. ``score`` is the calibrated probability; ``rejected`` marks scores below the
    least one at which the accepted calibration documents were right to 99 %. A text that is null or has no letter
    is ``und`` with score 0 and rejected, and so is every text if nothing could be learned. A null id
    is not held out; repeated rows are kept.
    """
    model = train(sample(docs, folds, held_out, per_language))

    def prepare():
        def work(raw):
            language, score = model.predict(subwords(raw))
            return language, score, language == UNDETERMINED or score < model.accept_from

        return work

    found = map_texts(docs, prepare, {"lang_pred": "string", "score": "double", "rejected": "boolean"})
    out = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    return found.select("doc_id", out, "lang_pred", "score", "rejected")
