"""Ordering, top-k and representative rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica import constants as C
from lattica.operators.quantiles import linear_quantile, medians


def ordered_by(df: DataFrame, order: dict[str, Sequence[str]], tie: Sequence[str] = ()) -> DataFrame:
    """Sort by configured value orders; values that are not listed come last."""
    ranks = [F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)), F.lit(0)), F.lit(len(values) + 1)) for c, values in order.items()]
    return df.orderBy(*ranks, *tie)


def top_k(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], k: int = 10) -> DataFrame:
    """The k largest rows per key with their rank (Spark limits each task to k rows before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(F.col(value).desc(), *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return packed.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _centres(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    scales = df.groupBy(*keys).agg(*[F.greatest(F.coalesce(F.stddev_samp(m), F.lit(0.0)), F.lit(C.SCALE_FLOOR)).alias(f"_s_{m}") for m in metrics])
    return scales.join(medians(df, keys, metrics).select(*keys, *[F.col(m).alias(f"_m_{m}") for m in metrics]), list(keys))


def _deviation(metrics: Sequence[str]):
    total = F.lit(0.0)
    for m in metrics:
        total = total + F.abs(F.col(m) - F.col(f"_m_{m}")) / F.col(f"_s_{m}")
    return total


def _tie_term():
    return F.lit(C.TIE_WEIGHT_PER_US) * F.abs(F.col("time_us") - F.lit(C.TIE_PREFERENCE_US))


def representative(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], tie: Sequence[str] = ("replicate", "frame")) -> DataFrame:
    """Row nearest the pooled medians in units of SD, with a weak preference for the middle of the run."""
    scored = df.join(_centres(df, keys, metrics), list(keys)).withColumn("selection_score", _deviation(metrics) + _tie_term())
    rest = [c for c in [*df.columns, "selection_score"] if c not in keys]
    best = scored.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("selection_score", *tie)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def matched_representative(df: DataFrame, arm: str, arms: Sequence[str], metrics: Sequence[str], match: Sequence[str] = ("replicate", "frame")) -> DataFrame:
    """One match key present in every arm with the least summed deviation; returns its row from each arm."""
    match = list(match)
    chosen = df.where(F.col(arm).isin(list(arms)))
    scored = chosen.join(_centres(chosen, [arm], metrics), arm).withColumn("_d", _deviation(metrics))
    per = (
        scored.groupBy(*match)
        .agg(F.sum("_d").alias("_d"), F.count_distinct(arm).alias("_n"), F.min(_tie_term()).alias("_t"))
        .where(F.col("_n") == len(arms))
        .select(*match, (F.col("_d") + F.col("_t")).alias("selection_score"))
    )
    best = per.orderBy("selection_score", *match).limit(1)
    return chosen.join(best, match)


def nearest_to_median(df: DataFrame, keys: Sequence[str], metric: str, tie: Sequence[str] = ("replicate", "frame"), time_weight: float = 0.01) -> DataFrame:
    """Row nearest the median of one metric (not scaled), with a weak time preference."""
    scored = df.join(linear_quantile(df, keys, metric, 0.5, out="_m"), list(keys)).withColumn(
        "selection_score", F.abs(F.col(metric) - F.col("_m")) + F.lit(time_weight) * F.abs(F.col("time_us") - F.lit(C.TIE_PREFERENCE_US))
    )
    return first_per_key(scored.drop("_m"), keys, ["selection_score", *tie])
