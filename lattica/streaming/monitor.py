"""Health monitor of running simulations: a stateless stream over their state reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import schema


def unhealthy(max_temperature: float) -> Column:
    """A reported value is missing or not finite, or the temperature is above the limit."""
    bad = F.lit(False)
    for c in ("potential_kj_mol", "kinetic_kj_mol", "temperature_k"):
        v = F.col(c)
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return bad | (F.col("temperature_k") > max_temperature)


def alerts(reports: DataFrame, max_temperature: float) -> DataFrame:
    """Alert rows of a batch or a stream of state reports."""
    return reports.where(unhealthy(max_temperature)).withColumn("threshold_k", F.lit(float(max_temperature)))


def report_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema.STATE_REPORT).option("header", True).option("maxFilesPerTrigger", max_files).csv(folder)
