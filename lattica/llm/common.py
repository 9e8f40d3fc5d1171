"""Helpers of the operators: stored intermediates and gapless numbering without a single-task sort."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.session import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within the block, shuffle files go as soon as the write that made them has ended."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, Arrow batches hold at most ``rows`` rows, for rows that carry whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; its shuffle files are freed."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for the frames, once nothing that is still to be computed reads it."""
    for df in frames:
        if df is not None and hasattr(df, "stored_path"):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: Sequence[Column], index: str, name: str, total: str | None = None, before: str = "_before") -> DataFrame:
    """Rows of ``df`` (read from storage) with a gapless number from 0 in the given order; with ``total``, also the sum of
    that column over all rows before.

    A range sort lays the rows out, each partition counts and sums its own rows, and one row per partition carries the
    offsets. No task holds more than a range. Rows equal in every order column follow their place in storage, so a run of
    repeated rows is split as well.
    """
    spark = df.sparkSession
    laid = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    laid = stored(laid, name)
    amount = F.coalesce(F.sum(total or F.lit(0)), F.lit(0)).alias("_amount")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_part").agg(F.count("*").alias("_rows"), amount).select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_amount_before"),
    )
    out = laid.join(F.broadcast(offsets), "_part").withColumn(index, F.col("_rows_before") + F.col("_pos"))  # one row per shuffle partition
    if total:
        inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, F.col("_amount_before") + F.coalesce(F.sum(total).over(inside), F.lit(0)))
    return out.drop("_part", "_pos", "_rows_before", "_amount_before")
