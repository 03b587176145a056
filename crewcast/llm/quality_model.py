"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text becomes a vector of transformed statistics. The labelled training rows give a mean and
a covariance per class, summed by Spark; covariances are shrunk towards their mean variance. The
score is the logistic value of the difference of the two classes' log densities, each from a
Mahalanobis distance through a Cholesky factor that is computed once.
"""

from __future__ import annotations

import operator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.llm.words import binary_column, slices

#: Labelled rows the classes are fitted on at most: those of the smallest hash of their id.
MOST_LABELLED = 40_000
#: Share of the mean variance in a class covariance.
SHRINKAGE = 0.05
THRESHOLD = 0.3

# Bytes of each kind whose share is a statistic.
_KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>~^_=+@\\/{}[]", b"!?", b".,;:", b" \t\n\x0b\x0c\r",
)
_KIND_OF = np.zeros((len(_KINDS), 256))
for _n, _kind in enumerate(_KINDS):
    _KIND_OF[_n, list(_kind)] = 1
STATISTICS = len(_KINDS) + 9


def statistics(text: bytes) -> np.ndarray:
    """The statistics of a whole text; an empty text has zeros."""
    values = np.zeros(STATISTICS)
    words = text.split()
    if not words:
        return values
    count, size = len(words), len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = seen / size
    values[: len(_KINDS)] = np.sqrt(_KIND_OF @ shares)
    lines = [line for line in text.split(b"\n") if line.strip()]
    held = shares[shares > 0]
    lengths = np.fromiter(map(len, words), np.int64, count)
    values[len(_KINDS) :] = (
        np.log1p(count),
        np.log(lengths.mean()),
        np.log1p(lengths.std()),
        np.sqrt(np.mean(lengths == 1)),
        len(set(words)) / count,
        np.sqrt(sum(map(operator.eq, words, words[1:])) / count),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        -(held * np.log(held)).sum(),
        np.sqrt(shares[128:].sum()),
    )
    return values


class QualityModel(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    #: Per class 0 and 1: mean, inverse Cholesky factor, log density constant with the prior.
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]


def _sum_rows(batches):
    """quality, text -> quality, i, j, value: sums of 1, x and x xᵀ of the rows, as a matrix."""
    sums = {q: np.zeros((STATISTICS + 1, STATISTICS + 1)) for q in (0, 1)}
    for whole in batches:
        for batch in slices(whole, "text"):
            for quality, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                x = np.append(statistics(text or b""), 1.0)
                sums[quality] += np.outer(x, x)
    i, j = np.indices((STATISTICS + 1, STATISTICS + 1)).reshape(2, -1)
    for quality, matrix in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), quality, np.int32)), pa.array(i), pa.array(j), pa.array(matrix.ravel())],
            names=["quality", "i", "j", "value"],
        )


def model_of(sums: dict[int, np.ndarray]) -> QualityModel | None:
    """The model of two sum matrices; None unless both classes have rows."""
    if any(sums[q][-1, -1] < 1 for q in (0, 1)):
        return None
    both = sums[0] + sums[1]
    total = both[-1, -1]
    centre = both[:-1, -1] / total
    spread = np.sqrt(np.maximum(np.diag(both)[:-1] / total - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    classes = []
    for quality in (0, 1):
        count = sums[quality][-1, -1]
        mean = sums[quality][:-1, -1] / count
        covariance = (sums[quality][:-1, :-1] / count - np.outer(mean, mean)) / np.outer(scale, scale)
        level = max(float(np.trace(covariance)) / STATISTICS, 1e-3)
        covariance = (1 - SHRINKAGE) * (covariance + covariance.T) / 2 + SHRINKAGE * level * np.eye(STATISTICS)
        factor = np.linalg.cholesky(covariance)
        constant = float(np.log(count / total) - np.log(np.diag(factor)).sum())
        classes.append(((mean - centre) / scale, np.linalg.inv(factor), constant))
    return QualityModel(centre, scale, tuple(classes))


def scores(model: QualityModel | None, rows: np.ndarray) -> np.ndarray:
    """Probability of class 1; 0.5 without a model."""
    if model is None:
        return np.full(len(rows), 0.5)
    standard = (rows - model.centre) / model.scale
    low, high = (
        constant - 0.5 * (((standard - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, constant in model.classes
    )
    return 1 / (1 + np.exp(np.clip(low - high, -500, 500)))


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """Learns from labelled rows outside the held-out fifth; a row with both labels counts as bad."""
    sample = (
        labels.filter("quality in (0, 1) and doc_id is not null")
        .filter("crc32(cast(doc_id as string)) % 5 <> 0")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MOST_LABELLED)
    )
    learned = docs.join(F.broadcast(sample), "doc_id").select("quality", "text")
    sums = {q: np.zeros((STATISTICS + 1, STATISTICS + 1)) for q in (0, 1)}
    parts = learned.mapInArrow(_sum_rows, "quality int, i bigint, j bigint, value double")
    # Rounded, so that the order in which partial sums meet does not matter.
    for row in parts.groupBy("quality", "i", "j").agg(F.round(F.sum("value"), 6).alias("value")).collect():
        sums[row["quality"]][row["i"], row["j"]] = row["value"]
    return model_of(sums)


def _score_rows(model: QualityModel | None):
    def rows(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = binary_column(batch, "text")
                found = scores(model, np.array([statistics(t or b"") for t in texts]).reshape(len(texts), STATISTICS))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    return rows


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null, empty and blank texts have zero statistics and get a score like any other. A null doc_id
    has held_out null. Without training rows of both classes all scores are 0.5. Other columns are
    ignored. Runs jobs while it is built.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = fit_quality(docs, labels)
    return docs.mapInArrow(_score_rows(model), "doc_id bigint, score double").select(
        "doc_id",
        (F.expr("crc32(cast(doc_id as string)) % 5") == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
