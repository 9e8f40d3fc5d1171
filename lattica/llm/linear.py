"""Logistic regression on sparse rows, and scoring of whole tables in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_logistic(indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int, ridge: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise logistic loss with a ridge (accelerated gradient steps on all rows).

    With one class only, or without rows, the weights are 0 and the intercept gives the smoothed share of label 1.
    """
    n, positive = len(labels), float(labels.sum())
    prior = np.log((positive + 0.5) / (n - positive + 0.5))
    if positive in (0.0, float(n)):
        return np.zeros(width), float(prior)
    row = np.repeat(np.arange(n), np.diff(indptr))
    weights, intercept = np.zeros(width), float(prior)
    ahead, ahead_b, momentum = weights.copy(), intercept, 1.0
    # the largest curvature: a power iteration on X'X
    v = np.ones(width)
    for _ in range(12):
        v = np.bincount(indices, values * np.bincount(row, values * v[indices], n)[row], width)
        norm = np.linalg.norm(v)
        v /= norm or 1.0
    step = 1.0 / (0.25 * (norm + n) + ridge)
    for _ in range(rounds):
        slope = sigmoid(np.bincount(row, values * ahead[indices], n) + ahead_b) - labels
        new = ahead - step * (np.bincount(indices, values * slope[row], width) + ridge * ahead)
        new_b = ahead_b - step * slope.sum()
        after = 0.5 * (1 + np.sqrt(1 + 4 * momentum * momentum))
        ahead, ahead_b = new + (momentum - 1) / after * (new - weights), new_b + (momentum - 1) / after * (new_b - intercept)
        weights, intercept, momentum = new, new_b, after
    return weights, float(intercept)


def with_scores(docs: DataFrame, columns: Sequence[str], model: Callable[[], Callable[[list[str]], np.ndarray]], name: str, size: int = 256) -> DataFrame:
    """``columns`` of every row and a double column ``name`` from the row's whole text (null: empty).

    ``model`` is called once per task and gives the function from texts to scores; ``size`` texts are scored at a time.
    """
    kept = docs.select(*columns) if "text" in columns else docs.select(*columns, "text")
    schema = T.StructType([*[kept.schema[c] for c in columns], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(np.asarray(score(texts), np.float64))], [*columns, name])

    return kept.mapInArrow(run, schema)


def usable_labels(labels: DataFrame, label: str, held_out: int = 2) -> DataFrame:
    """doc_id and label of all ids but those whose CRC-32 modulo 4 is ``held_out`` and without null ids or labels. A repeated
    id counts once, with its largest label."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != held_out)
    return usable.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(labels: DataFrame, label: str, most: int, held_out: int = 2) -> DataFrame:
    """At most ``most`` of the usable labels for fitting, the first by a hash."""
    return usable_labels(labels, label, held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
