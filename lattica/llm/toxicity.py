"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stored, text_of
from lattica.llm.linear import fit_logistic, labelled_sample, sigmoid, with_scores

GRAMS = (4, 5, 6)
BITS = 20
SAMPLE = 12_000  # labelled documents used to fit
FEATURES = 8_192
SMOOTHING = 1.0
THRESHOLD = 0.3
# Lower-case ASCII letters stay, upper-case ones become lower, other ASCII counts as a space.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def grams_of(text: str, last: np.ndarray) -> np.ndarray:
    """Hashed character n-grams that the text holds, each once. ``last`` is scratch space of 2**BITS integers."""
    raw = FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    found = []
    rolling = raw
    for n in range(2, max(GRAMS) + 1):
        if len(raw) < n:
            break
        rolling = rolling[:-1] * np.uint32(0x01000193) + raw[n - 1 :]
        if n in GRAMS:
            mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            found.append(mixed >> np.uint32(32 - BITS))
    if not found:
        return np.empty(0, np.uint32)
    all_grams = np.concatenate(found)
    places = np.arange(len(all_grams), dtype=np.int32)
    last[all_grams] = places
    return all_grams[last[all_grams] == places]


@dataclass
class Model:
    weight: np.ndarray  # by hashed n-gram: classifier weight times log-count ratio
    intercept: float

    def scorer(self):
        last = np.zeros(1 << BITS, np.int32)
        return lambda texts: sigmoid(np.array([self.weight[grams_of(t, last)].sum(dtype=np.float64) + self.intercept for t in texts]))


def _counts(sample: DataFrame) -> DataFrame:
    """Documents of the sample that hold each n-gram, by label: combined in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << BITS, np.int32)
        held = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                held[label, grams_of(text, last)] += 1
        some = np.flatnonzero(held.any(axis=0))
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[0, part].astype(np.int64)), pa.array(held[1, part].astype(np.int64))], ["gram", "without", "with"])

    return sample.mapInArrow(run, "gram long, without long, with long").groupBy("gram").agg(F.sum("without").alias("q"), F.sum("with").alias("p"))


def _rows(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Chosen features of each document of the sample."""
    chosen = np.sort(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << BITS, np.int32)
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                at = place[grams_of(text, last)]
                rows.append(at[at >= 0].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    return sample.mapInArrow(run, "doc_id long, label int, features binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out quarter.

    Without labelled documents of both labels every text scores the smoothed share of label 1. Only the counts of the
    best FEATURES n-grams and the bounded sample's features reach the driver.
    """
    wanted = F.broadcast(labelled_sample(labels, label, most))  # at most ``most`` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sample = stored(texts.join(wanted, "doc_id").withColumn("label", (F.col("label") > 0).cast("int")), "toxicity-sample")
    sizes = {row[0]: row[1] for row in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not (n0 and n1):
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    p, q = (F.col("p") + SMOOTHING) / (n1 + 2 * SMOOTHING), (F.col("q") + SMOOTHING) / (n0 + 2 * SMOOTHING)
    pooled = (F.col("p") + F.col("q") + 2 * SMOOTHING) / (n0 + n1 + 4 * SMOOTHING)
    apart = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    best = _counts(sample).select("gram", F.log(p / q).alias("ratio"), apart.alias("apart")).orderBy(F.desc("apart"), "gram").limit(FEATURES).toPandas().sort_values("gram")
    chosen, ratio = best["gram"].to_numpy(np.int64), best["ratio"].to_numpy()
    rows: pd.DataFrame = _rows(sample, chosen).toPandas().sort_values(["doc_id", "features"])
    held = [np.frombuffer(x, "<u2") for x in rows["features"]]
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    indices = np.concatenate(held).astype(np.int64)
    weights, intercept = fit_logistic(indptr, indices, ratio[indices], rows["label"].to_numpy(np.float64), len(chosen))
    table = np.zeros(1 << BITS, np.float32)
    table[chosen] = weights * ratio
    return Model(table, intercept)


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` and the score (0 to 1) of every whole text; the empty and the null text get the intercept's score.

    Equal texts score alike. Columns that aren't asked for are left out, so their names can't clash.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the data
    return with_scores(docs, columns, lambda: sent.value.scorer(), "score")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document: doc_id, held_out, score, predicted."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(ids, fit(docs, labels), ["doc_id"]).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
