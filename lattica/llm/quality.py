"""Quality by hierarchical empirical Bayes: the text's evidence, the site's and the path's posteriors.

The site of a document is its ``source``, its path within the site ``lang``. Both posteriors come from grouped sums of
evidence over all documents; a sparse path is drawn to its site, a sparse site to the whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stored, text_of
from lattica.llm.linear import fit_logistic, labelled_sample, sigmoid, usable_labels, with_scores

SAMPLE = 12_000  # labelled documents used to fit
THRESHOLD = 0.3
LOGIT_LIMIT = 8.0
SIGNS = b"!?.,;:*%#$&|<>=+-_/\\\"'()[]{}@~^`"


def features(texts: list[str]) -> np.ndarray:
    """Style of each text: shares of kinds of characters, of repeated and upper-case words, of short and repeated lines."""
    out = np.zeros((len(texts), 2 * (len(SIGNS) + 13)))
    half = out.shape[1] // 2
    for row, text in zip(out, texts):
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        total = max(1, raw.sum())
        words = text.split()
        count = max(1, len(words))
        lines = text.split("\n")
        row[: len(SIGNS)] = raw[list(SIGNS)] / total
        row[len(SIGNS) : half] = (
            raw[65:91].sum() / total,
            raw[97:123].sum() / total,
            raw[48:58].sum() / total,
            raw[128:].sum() / total,
            raw[32] / total,
            raw[10] / total,
            np.log1p(len(words)) / 10,
            len(set(words)) / count,
            sum(map(str.__eq__, words, words[1:])) / count,
            sum(map(str.isupper, words)) / count,
            sum(map(str.isalnum, words)) / count,
            len(set(lines)) / len(lines),
            np.log1p(total / count) / 5,
        )
    out[:, half:] = np.sqrt(np.abs(out[:, :half]))
    return out


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def scorer(self):
        return lambda texts: sigmoid(np.clip(features(texts) @ self.weights + self.intercept, -LOGIT_LIMIT, LOGIT_LIMIT))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """The document classifier, fitted on at most ``most`` labelled documents.

    Without documents of both labels every text scores the smoothed share of label 1.
    """
    wanted = stored(labelled_sample(labels, label, most), "quality-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sample = texts.join(F.broadcast(wanted), "doc_id")  # at most ``most`` rows

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = features(part.column("text").to_pylist()).astype("<f4")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "label", "features"])

    found = sample.mapInArrow(run, "doc_id long, label int, features binary").toPandas().sort_values(["doc_id", "features"])
    width = features([""]).shape[1]
    if found.empty or found["label"].nunique() < 2:
        good = float((found["label"] > 0).sum())
        return Model(np.zeros(width), float(np.log((good + 0.5) / (len(found) - good + 0.5))))
    x = np.frombuffer(b"".join(found["features"]), "<f4").reshape(len(found), width).astype(np.float64)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-6] = np.inf
    x = (x - mean) / spread
    n = len(x)
    weights, intercept = fit_logistic(np.arange(n + 1) * width, np.tile(np.arange(width), n), x.ravel(), (found["label"] > 0).to_numpy(np.float64), width, ridge=1.0, rounds=300)
    weights = weights / spread
    return Model(weights, intercept - float(mean @ weights))


def _strength(groups: DataFrame, centre: Column, total: str = "n", good: str = "good") -> float:
    """Prior sample size of rates that vary around ``centre``: their variance beyond sampling, by moments."""
    mean = F.col(good) / F.col(total)
    row = groups.agg(
        F.sum(F.col(total) * F.pow(mean - centre, 2)).alias("between"),
        F.sum(centre * (1 - centre)).alias("noise"),
        F.sum(total).alias("n"),
        F.sum(F.pow(F.col(total), 2)).alias("squares"),
        F.sum(F.col(total) * centre * (1 - centre)).alias("spread"),
        F.count("*").alias("groups"),
    ).first()
    if not row["groups"] or row["groups"] < 2:
        return 1.0
    variance = (row["between"] - row["noise"]) / max(1.0, row["n"] - row["squares"] / row["n"])
    inner = row["spread"] / row["n"]
    return float(min(1e6, max(1.0, inner / max(variance, 1e-9) - 1.0)))


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """Posterior rates by site and path from rows of (site, path, good): site, path, site_rate, path_rate; and the
    global rate. Null sites and paths are groups of their own. Grouped sums only, combined before the shuffle."""
    paths = stored(evidence.groupBy("site", "path").agg(F.sum("good").alias("good"), F.count("*").cast("double").alias("n")), "quality-paths")
    sites = paths.groupBy("site").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    row = paths.agg(F.sum("good"), F.sum("n")).first()
    overall = ((row[0] or 0.0) + 0.5) / ((row[1] or 0.0) + 1.0)
    kappa = _strength(sites, F.lit(overall))
    sites = stored(sites.select("site", ((F.col("good") + kappa * overall) / (F.col("n") + kappa)).alias("site_rate")), "quality-sites")
    joined = paths.alias("p").join(sites.alias("s"), F.col("p.site").eqNullSafe(F.col("s.site"))).select("p.site", "p.path", "p.good", "p.n", "s.site_rate")
    inner = _strength(joined, F.col("site_rate"))
    return joined.select("site", "path", "site_rate", ((F.col("good") + inner * F.col("site_rate")) / (F.col("n") + inner)).alias("path_rate")), overall


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def scored(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every document with document_score, site_rate, path_rate and score (0 to 1, higher is better).

    Null and empty texts are scored by their (empty) style; null sources and languages are groups of their own; equal
    rows score alike. A labelled document outside the held-out quarter adds its label to its site's evidence, any other
    one its document score. Columns that aren't asked for are left out, so their names can't clash.
    """
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*[F.col(c).alias(f"kept_{c}") for c in columns if c != "text"], F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("site"), F.col("lang").cast("string").alias("path"))
    single = stored(with_scores(own.select("doc_id", "site", "path", "text"), ["doc_id", "site", "path"], lambda: sent.value.scorer(), "document_score"), "quality-evidence")
    evidence = single.select("doc_id", "site", "path", "document_score").join(usable_labels(labels, "quality"), "doc_id", "left").select("site", "path", F.coalesce((F.col("label") > 0).cast("double"), F.col("document_score")).alias("good"))
    rates, overall = posteriors(evidence)
    rates = stored(rates, "quality-rates")
    if columns == ["doc_id"]:
        rows = single.withColumn("kept_doc_id", F.col("doc_id"))
    else:
        rows = with_scores(own, [c for c in own.columns if c != "text" or "text" in columns], lambda: sent.value.scorer(), "document_score")
    joined = rows.alias("d").join(rates.alias("r"), F.col("d.site").eqNullSafe(F.col("r.site")) & F.col("d.path").eqNullSafe(F.col("r.path")))
    score = _logit(F.col("document_score")) + _logit(F.col("path_rate")) - F.lit(float(np.log(overall / (1 - overall))))
    return joined.select(
        *[F.col("d.text") if c == "text" else F.col(f"d.kept_{c}").alias(c) for c in columns],
        *[F.col(c).alias(f"quality_{c}") for c in ("document_score", "site_rate", "path_rate")],
        (1 / (1 + F.exp(-score))).alias("quality_score"),
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every document: doc_id, document_score, site_rate, path_rate, score, keep."""
    out = scored(docs, labels, ["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"quality_{c}").alias(c) for c in ("document_score", "site_rate", "path_rate", "score")], (F.col("quality_score") >= THRESHOLD).cast("int").alias("keep"))
