"""Registry of checked queries: each has a Spark builder, output columns and, where possible, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables of one folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _columns(spec: str) -> list[tuple[str, str]]:
    """``"system:s frame:i value:f"`` -> names and kinds. f is rounded to 6 digits, f3 to 3 and so on."""
    return [tuple(part.split(":")) for part in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        quoted = f'"{name}"'
        if kind == "s":
            out.append(f"CAST({quoted} AS VARCHAR) AS {quoted}")
        elif kind == "i":
            out.append(f"CAST({quoted} AS BIGINT) AS {quoted}")
        elif kind == "b":
            out.append(f"CAST({quoted} AS BOOLEAN) AS {quoted}")
        else:
            out.append(f"ROUND(CAST({quoted} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS {quoted}")
    return f"SELECT {', '.join(out)} FROM ({body}) AS q"


def query(name: str, spec: str, sql: str | None = None, ctes: str = ""):
    """Register a builder ``(tables) -> DataFrame`` under ``name``; ``ctes`` precede the SQL body."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape(build(Tables(spark, sf_dir)), spec)

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = (f"WITH RECURSIVE {ctes.strip().rstrip(',')} " if ctes else "") + shape_sql(sql.strip().rstrip(";"), spec)
        return build

    return register
