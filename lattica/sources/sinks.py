"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV of a result table, as many files as it has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_trajectories(df: DataFrame, path: str, keys=("system", "replicate")) -> None:
    """Replace only the trajectories present in ``df``.

    Rows are rebalanced by key: small groups share a file, and a group too large for one task is split.
    """
    spread = [*keys, "frame"] if "frame" in df.columns else list(keys)
    out = df.hint("rebalance", *[F.col(c) for c in spread])
    if "frame" in df.columns:
        out = out.sortWithinPartitions(*keys, "frame")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
