"""Radial histograms: pooled over frames, or normalised frame by frame first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica import constants as C
from lattica.functions.scalars import radial_bin, ratio


def _bin_edges(high: float, bins: int):
    width = high / bins
    end = F.when(F.col("bin") > bins, F.lit(float("inf"))).otherwise(F.col("bin") * width)
    return ((F.col("bin") - 1) * width).alias("bin_start_nm"), end.alias("bin_end_nm")


def _dense(groups: DataFrame, bins: int) -> DataFrame:
    return groups.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins + 1).cast("long"))).alias("bin"))


def pooled_histogram(df: DataFrame, keys: Sequence[str], value: str = "distance", high: float = C.HISTOGRAM_MAX_NM, bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Share of all values per bin and its running total; every bin is present."""
    keys = list(keys)
    counts = df.groupBy(*keys, radial_bin(value, high, bins).alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    dense = _dense(totals, bins).join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    running = F.sum("n").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return dense.select(
        *keys, "bin", *_bin_edges(high, bins), F.col("n").alias("count"), ratio("n", "total").alias("probability"), ratio(running, "total").alias("cumulative_probability")
    )


def frame_normalised_histogram(
    df: DataFrame, frames: DataFrame, keys: Sequence[str], value: str = "distance", weight: str | None = None, high: float = C.HISTOGRAM_MAX_NM, bins: int = C.HISTOGRAM_BINS
) -> DataFrame:
    """Per frame, the weight of a bin over the frame's total; then the mean over frames that have any weight.

    The mean count instead divides by all ``frames(keys, frame)``, and the running total is that of the mean
    probability.
    """
    keys = list(keys)
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    per = df.groupBy(*keys, "frame", radial_bin(value, high, bins).alias("bin")).agg(w.alias("w"))
    totals = per.groupBy(*keys, "frame").agg(F.sum("w").alias("total")).where("total > 0")
    valid = totals.groupBy(*keys).agg(F.count("*").alias("valid_frames"))
    sampled = frames.groupBy(*keys).agg(F.count_distinct("frame").alias("n_frames"))
    summed = per.join(totals, [*keys, "frame"], "left").groupBy(*keys, "bin").agg(F.sum("w").alias("w"), F.sum(F.col("w") / F.col("total")).alias("p"))
    dense = _dense(sampled.join(valid, keys, "left"), bins).join(summed, [*keys, "bin"], "left")
    p = F.when(F.col("valid_frames") > 0, F.coalesce("p", F.lit(0.0)) / F.col("valid_frames"))
    out = dense.select(
        *keys,
        "bin",
        *_bin_edges(high, bins),
        (F.coalesce("w", F.lit(0.0)) / F.col("n_frames")).alias("frame_mean_count"),
        p.alias("frame_mean_probability"),
        F.coalesce("valid_frames", F.lit(0)).alias("valid_frames"),
    )
    running = F.sum("frame_mean_probability").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("cumulative_probability", running)


def rebin(df: DataFrame, trajectory: Sequence[str], groups: Sequence[str], value: str, width: float = 1.0) -> DataFrame:
    """Fine bins summed to ``width`` within each trajectory, then averaged over trajectories. The overflow bin stays apart."""
    coarse = F.floor(F.col("bin_start_nm") / width) * width
    summed = df.groupBy(*trajectory, coarse.alias("bin_start_nm")).agg(F.sum(value).alias("_v"))
    return summed.groupBy(*groups, "bin_start_nm").agg(F.avg("_v").alias(value))
