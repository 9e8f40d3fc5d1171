"""Two-level statistics: frames -> trajectories -> systems. Missing values are NULL and are skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import close, production_block


def metric_columns(df: DataFrame, identifiers: Sequence[str]) -> list[str]:
    """All columns that are not identifiers (decided while the plan is built, without reading data)."""
    return [c for c in df.columns if c not in set(identifiers)]


def trajectory_means(frames: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def two_level_stats(repeats: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample SD and number of non-missing values per group."""
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"), F.count(m).alias(f"{m}_n")]
    return repeats.groupBy(*groups).agg(*out)


def frames_to_groups(frames: DataFrame, metrics: Sequence[str], system: Sequence[str] = ("system",), replicate: str = "replicate") -> DataFrame:
    return two_level_stats(trajectory_means(frames, [*system, replicate], metrics), list(system), metrics)


def block_means(frames: DataFrame, metrics: Sequence[str], cutoff: float | None = None) -> DataFrame:
    """Trajectory means per production block, at one cutoff when the table has several."""
    if cutoff is not None:
        frames = frames.where(close("cutoff_nm", cutoff))
    return trajectory_means(frames.withColumn("production_block", production_block("frame")), ["system", "replicate", "production_block"], metrics)


def degree_means(histogram: DataFrame) -> DataFrame:
    """Mean probability of a degree over the frames in which it occurs (absent degrees count for nothing)."""
    return histogram.groupBy("system", "replicate", "degree").agg(F.avg("probability").alias("probability"))


def to_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    casted = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return casted.unpivot(list(ids), list(metrics), name, value)


def numerical_summary(sources: dict[str, DataFrame], metrics: dict[str, Sequence[str]]) -> DataFrame:
    """One long table ``(source, system, metric, mean, sd, n_trajectories, n_frames)`` from several frame tables."""
    out = None
    for source, frames in sources.items():
        names = metrics[source]
        long = to_long(frames, ["system", "replicate", "frame"], names)
        repeat = long.groupBy("system", "replicate", "metric").agg(F.avg("value").alias("value"), F.count("value").alias("frames"))
        part = repeat.groupBy("system", "metric").agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("sd"),
            F.count("value").alias("n_trajectories"),
            F.sum("frames").alias("n_frames"),
        )
        part = part.select(F.lit(source).alias("source"), "system", "metric", "mean", "sd", "n_trajectories", "n_frames")
        out = part if out is None else out.unionByName(part)
    return out


def ratio_to_design(group: DataFrame, design: DataFrame, value: str, constant: str, out: str) -> DataFrame:
    """A group mean divided by a constant of the design table."""
    return group.join(design.select("system", F.col(constant).alias("_k")), "system").withColumn(
        out, F.when(F.col("_k") != 0, F.col(value) / F.col("_k"))
    ).drop("_k")


def align_replicates(df: DataFrame, systems: DataFrame, replicates: Sequence[str]) -> DataFrame:
    """One row per system and expected replicate; what is missing stays missing."""
    each = F.explode(F.array(*[F.lit(r) for r in replicates])).alias("replicate")
    return systems.select("system").distinct().select("system", each).join(df, ["system", "replicate"], "left")
