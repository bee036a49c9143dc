"""Text quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import ddl, extend, fresh_name, map_texts, record_batch, stored

#: Share of the pooled covariance, and of its mean variance on the diagonal, in each class covariance.
TO_POOLED = 0.2
TO_SPHERE = 0.05

FEATURES = (
    "length", "word_length", "spread", "upper", "digits", "marks", "bars", "ends", "distinct_words", "lines",
    "repeated_lines", "beyond_ascii",
)

_UPPER = np.arange(65, 91)
_DIGITS = np.arange(48, 58)
_LETTERS = np.concatenate([_UPPER, np.arange(97, 123)])
_MARKS = np.frombuffer(b"!#$%&*+/<=>@^_`{}~\\", dtype=np.uint8)
_ENDS = np.frombuffer(b".,;:?", dtype=np.uint8)


#: Cases of the usual share that are added to each share, so that a text of few words looks usual rather than extreme.
_PRIOR_CASES = 20


def _logit(part: float, whole: float, usual: float) -> float:
    """Log odds of a share, smoothed towards the usual share."""
    part = min(part, whole)
    return float(np.log((part + _PRIOR_CASES * usual) / (whole - part + _PRIOR_CASES * (1 - usual))))


def statistics(raw: bytes | None) -> list[float]:
    """``FEATURES`` of a text: logs of lengths and log odds of shares; a null text is an empty one."""
    raw = raw or b""
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, letters = len(words), int(count[_LETTERS].sum())
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1, dtype=np.int64)
    return [
        float(np.log1p(n)),
        float(np.log1p((sizes.sum() + 5 * _PRIOR_CASES) / (n + _PRIOR_CASES))),
        float(np.log1p(np.sqrt(((sizes - sizes.mean()) ** 2).sum() / (n + _PRIOR_CASES)))),
        _logit(int(count[_UPPER].sum()), letters, 0.03),
        _logit(int(count[_DIGITS].sum()), len(raw), 0.01),
        _logit(int(count[_MARKS].sum()), len(raw), 0.01),
        _logit(int(count[124]), n, 0.02),
        _logit(int(count[_ENDS].sum()), n, 0.15),
        _logit(len(set(words)), n, 0.75),
        float(np.log1p(n / max(1, len(lines)))),
        _logit(len(lines) - len(set(lines)), len(lines), 0.05),
        _logit(int(count[128:].sum()), len(raw), 0.03),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every document, in one pass over whole texts."""
    return map_texts(docs, lambda: lambda raw: (statistics(raw),), {"features": "array<double>"})


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1."""

    means: list[np.ndarray]
    whiteners: list[np.ndarray]
    constants: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic function of the difference of log densities."""
        logs = []
        for mean, whitener, constant in zip(self.means, self.whiteners, self.constants, strict=True):
            distance = (((x - mean) @ whitener.T) ** 2).sum(axis=1)  # Mahalanobis, squared
            logs.append(constant - distance / 2)
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def fit(moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant | float:
    """The model from ``{class: (n, sums, sums of products)}``; one class or none gives its share as a constant."""
    if len(moments) < 2:
        return {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(moments)]
    total = sum(n for n, _, _ in moments.values())
    means, scatters = [], []
    for label in (0, 1):
        n, sums, products = moments[label]
        means.append(sums / n)
        scatters.append(products - np.outer(sums, sums) / n)
    pooled = sum(scatters) / total
    whiteners, constants = [], []
    for label in (0, 1):
        n = moments[label][0]
        own = (1 - TO_POOLED) * scatters[label] / n + TO_POOLED * pooled
        size = max(float(np.trace(own)) / len(own), 1e-6)
        own = (1 - TO_SPHERE) * own + TO_SPHERE * size * np.eye(len(own))
        factor = np.linalg.cholesky(own)
        whiteners.append(np.linalg.inv(factor))
        constants.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, whiteners, constants)


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Sums over all rows of ``features, label``, added up in the tasks first."""
    fields = {"label": "int", "place": "int", "value": "double"}
    d = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            labels = batch.column(1).to_numpy()
            for label in np.unique(labels).tolist():
                own = x[labels == label]
                new = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                sums[label] = sums.get(label, 0) + new
        for label, values in sums.items():
            places = np.arange(len(values), dtype=np.int32)
            yield record_batch(fields, [[label] * len(values), pa.array(places), pa.array(values)])

    summed = rows.select("features", F.col("label").cast("int")).mapInArrow(partial, ddl(fields))
    out: dict[int, np.ndarray] = {}
    for row in summed.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        out.setdefault(row["label"], np.zeros(1 + d + d * d))[row["place"]] = row["value"]
    return {label: (int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for label, v in sorted(out.items())}


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def learn(features: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Discriminant | float:
    """The model of all labelled rows outside the fold ``held_out``; ``features`` is ``document_statistics``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("label in (0, 1)").where(fold("doc_id", folds) != held_out)
    return fit(_moments(features.join(known, "doc_id").select("features", "label")))


def _scores(model: Discriminant | float, x: np.ndarray) -> np.ndarray:
    return model.scores(x) if isinstance(model, Discriminant) else np.full(len(x), model)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1; other rows are left out); documents whose id falls in the
    fold ``held_out`` are not learned from. Class means and covariances are sums over all other labelled
    rows; repeated labels count as often as they stand. Only the text decides a score. With one class
    among the labels the score is that class, with none it is 0.5. Null and empty texts are scored as texts without words. A
    null id is not held out; repeated rows are kept.
    """
    features = stored(document_statistics(docs), "statistics")
    model = learn(features, labels, folds, held_out)
    fields = {"doc_id": "long", "score": "double"}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield record_batch(fields, [batch.column(0), pa.array(_scores(model, x))])

    scored = features.mapInArrow(score, ddl(fields))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """The documents with a score of at least 0.5, with all their columns, whatever their names.

    Statistics are computed once and stored beside the rows.
    """
    features = fresh_name(docs, "features")
    rows = stored(extend(docs, lambda: lambda raw: (statistics(raw),), {features: "array<double>"}), "statistics")
    known = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(features).alias("features"))
    model = learn(known, labels, folds, held_out)

    @F.pandas_udf("double")
    def score(own: pd.Series) -> pd.Series:
        return pd.Series(_scores(model, np.stack(own.to_numpy())) if len(own) else [], dtype="float64")

    return rows.where(score(F.col(features)) >= 0.5).select(*[F.col(f"`{name}`") for name in docs.columns])
