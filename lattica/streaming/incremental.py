"""Incremental recomputation: only trajectories whose signature changed are computed again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import materialise
from lattica.sources.sinks import write_trajectories

KEYS = ("system", "replicate")


class StaleResults(RuntimeError):
    """Stored results are missing or out of date where only stored results may be used."""


def signatures(inputs: DataFrame, columns: Sequence[str], version: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Digest of the version and every input that a result depends on."""
    body = F.to_json(F.struct(F.lit(version).alias("version"), *[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    return inputs.select(*keys, F.sha2(body, 256).alias("signature"))


def changed(current: DataFrame, stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys without a stored row of the same signature."""
    return current.join(stored.select(*keys, "signature"), [*keys, "signature"], "left_anti")


def refresh(current: DataFrame, stored: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Compute the changed trajectories and replace just their partitions. Returns the keys that were computed."""
    todo = materialise(changed(current, stored, keys), "todo")
    result = compute(todo).join(todo.select(*keys, "signature"), list(keys))
    write_trajectories(result, path, keys)
    return todo


def require_fresh(current: DataFrame, stored: DataFrame, keys: Sequence[str] = KEYS) -> None:
    """For runs that only aggregate: fail if anything is missing or stale."""
    missing = changed(current, stored, keys)
    if not missing.isEmpty():
        raise StaleResults(f"missing or stale results, for example {missing.first().asDict()}")


def refresh_arrivals(
    arrivals: DataFrame, history: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: Sequence[str] = KEYS
):
    """Streaming form: process the files that have arrived since the last run, then stop.

    A trajectory whose files arrive in several batches is computed again from all of them: a batch only tells which keys to
    renew, and ``history`` reads everything that has arrived. The ledger beside the checkpoint holds each batch's keys by
    epoch; a batch that is repeated after a failure writes the same entry and the same partitions again.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        entry = f"{checkpoint}-ledger/epoch={epoch}"
        df.select(*keys).distinct().write.mode("overwrite").parquet(entry)
        due = df.sparkSession.read.schema(df.select(*keys).schema).parquet(entry)
        write_trajectories(compute(history().join(due, list(keys), "left_semi")), path, keys)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
