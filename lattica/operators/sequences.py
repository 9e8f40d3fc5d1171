"""Ordered-sequence operators that never need a whole sequence in one task.

A sequence is given by ``keys`` and a dense integer position. Windows run inside fixed chunks of positions: what a
chunk needs from its neighbours is either copied in (a halo of a few rows) or carried over as one number per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.session import materialise

CHUNK = 65536


def _before(order):
    return order.rowsBetween(W.unboundedPreceding, -1)


def ranged_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos", parts: int | None = None) -> DataFrame:
    """Zero-based rank by ``order`` from one range sort, whatever the length of a sequence.

    Rows are laid out in ranges of (keys, order) and written; a row's place in its range, less the place where its sequence
    begins there, plus the sequence's rows in earlier ranges is its position. One carry per sequence and range is all that
    meets. Rows with equal keys and order keep their order in ``df`` and may be split. Null keys are sequences of their own.
    """
    keys = list(keys)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie").drop("_tie")
    laid = materialise(laid.selectExpr("*", "spark_partition_id() AS _range", "monotonically_increasing_id() & 8589934591L AS _row"), "ranges")
    pieces = laid.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = F.coalesce(F.sum("_n").over(_before(W.partitionBy(*keys).orderBy("_range"))), F.lit(0))
    carry = pieces.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_at"), (earlier - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return laid.join(carry, same).withColumn(out, F.col("_row") + F.col("_shift")).drop("_range", "_row", "_at", "_shift", *[f"_k_{k}" for k in keys])


def dense_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, out: str = "pos") -> DataFrame:
    """Zero-based rank by ``order``. ``block`` is a column that never decreases along the order and bounds the rows that share
    it: rows are numbered inside a block, and each block starts after the rows of the blocks before it. Where no such
    column exists, ``ranged_position`` cuts the order itself."""
    keys = list(keys)
    counts = df.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(_before(W.partitionBy(*keys).orderBy(block))), F.lit(0))
    offsets = counts.select(*keys, block, start.alias("_start"))
    local = F.row_number().over(W.partitionBy(*keys, block).orderBy(*order)) - 1
    return df.withColumn("_local", local).join(offsets, [*keys, block]).withColumn(out, (F.col("_start") + F.col("_local")).cast("long")).drop("_local", "_start")


def _with_halo(df: DataFrame, pos: str, reach: int, chunk: int) -> DataFrame:
    chunk = max(chunk, reach)
    places = f"array_distinct(array(floor(({pos} - {reach}) / {chunk}), floor({pos} / {chunk}), floor(({pos} + {reach}) / {chunk})))"
    return df.selectExpr("*", f"explode({places}) AS _chunk", f"floor({pos} / {chunk}) AS _home")


def shifted(df: DataFrame, keys: Sequence[str], pos: str, columns: dict[str, tuple[str, int]], chunk: int = CHUNK) -> DataFrame:
    """Values of rows before (negative offset) or after. ``columns`` maps a new name to (column, offset)."""
    reach = max(abs(o) for _, o in columns.values())
    w = W.partitionBy(*keys, "_chunk").orderBy(pos)
    out = _with_halo(df, pos, reach, chunk)
    for name, (source, offset) in columns.items():
        out = out.withColumn(name, F.lag(source, -offset).over(w) if offset < 0 else F.lead(source, offset).over(w))
    return out.where("_chunk = _home").drop("_chunk", "_home")


def moving_average(df: DataFrame, keys: Sequence[str], pos: str, value: str, radius: int = 10, out: str = "smooth", chunk: int = CHUNK) -> DataFrame:
    """Centred average over ``2 * radius + 1`` rows; at the ends of a sequence over the rows that exist."""
    w = W.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(-radius, radius)
    return _with_halo(df, pos, radius, chunk).withColumn(out, F.avg(value).over(w)).where("_chunk = _home").drop("_chunk", "_home")


def running_sum(df: DataFrame, keys: Sequence[str], pos: str, columns: dict[str, str], chunk: int = CHUNK, inclusive: bool = True, from_first: bool = False) -> DataFrame:
    """Prefix sums in two levels: inside a chunk, plus the total of all earlier chunks. They begin at 0, or if ``from_first`` at the first value (null before it)."""
    keys = list(keys)
    begun = (lambda c: c) if from_first else (lambda c: F.coalesce(c, F.lit(0)))
    tagged = df.selectExpr("*", f"floor({pos} / {chunk}) AS _chunk")
    totals = tagged.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in columns.items()])
    earlier = _before(W.partitionBy(*keys).orderBy("_chunk"))
    carry = totals.select(*keys, "_chunk", *[begun(F.sum(f"_t_{n}").over(earlier)).alias(f"_b_{n}") for n in columns])
    w = W.partitionBy(*keys, "_chunk").orderBy(pos)
    frame = w.rowsBetween(W.unboundedPreceding, 0) if inclusive else _before(w)
    out = tagged
    for n, c in columns.items():
        out = out.withColumn(f"_i_{n}", begun(F.sum(c).over(frame)))
    out = out.join(carry, [*keys, "_chunk"])
    for n in columns:
        inside, before = F.col(f"_i_{n}"), F.col(f"_b_{n}")
        out = out.withColumn(n, F.coalesce(inside + before, inside, before) if from_first else inside + before)
    return out.drop("_chunk", *[f"_i_{n}" for n in columns], *[f"_b_{n}" for n in columns])


def islands(df: DataFrame, keys: Sequence[str], pos: str, state: str, out: str = "island", chunk: int = CHUNK) -> DataFrame:
    """Number the runs of equal ``state`` along a sequence (0, 1, 2, ...); also the running chain index."""
    prev = shifted(df, keys, pos, {"_prev": (state, -1)}, chunk)
    change = F.when((F.col(pos) == 0) | F.col("_prev").eqNullSafe(F.col(state)), 0).otherwise(1)
    return running_sum(prev.withColumn("_change", change), keys, pos, {out: "_change"}, chunk).drop("_prev", "_change")


def pairs_within_island(pairs: DataFrame, runs: DataFrame, keys: Sequence[str], pos: str, a: str = "a1", b: str = "a2", states: Sequence[str] | None = None) -> DataFrame:
    """Keep a pair only if every position between its ends has one state, i.e. both ends lie in one run."""
    keys = list(keys)
    chosen = runs if states is None else runs.where(F.col("state").isin(list(states)))
    ends = chosen.select(*keys, F.col(pos).alias("_p"), "island")
    first = pairs.join(ends.withColumnRenamed("_p", a).withColumnRenamed("island", "_ia"), [*keys, a])
    both = first.join(ends.withColumnRenamed("_p", b).withColumnRenamed("island", "_ib"), [*keys, b])
    return both.where("_ia = _ib").select(*pairs.columns)


def interval_breaks(intervals: DataFrame, keys: Sequence[str], pos: str, start: str, stop: str, chunk: int = CHUNK) -> DataFrame:
    """Half-open intervals in order that do not start where the one before stopped, or are empty."""
    prev = shifted(intervals, keys, pos, {"_prev": (stop, -1)}, chunk)
    expected = F.coalesce("_prev", F.when(F.col(pos) == 0, F.lit(0)))
    return prev.withColumn("expected_start", expected).where((F.col(start) != F.col("expected_start")) | (F.col(stop) <= F.col(start))).drop("_prev")


def running_offsets(df: DataFrame, keys: Sequence[str], pos: str, length: str, chunk: int = CHUNK) -> DataFrame:
    """Start and stop of consecutive pieces laid end to end."""
    return running_sum(df, keys, pos, {"start": length}, chunk, inclusive=False).withColumn("stop", F.col("start") + F.col(length))


def expand_interval(df: DataFrame, start: str, stop: str, out: str = "bead", residue_start: str | None = None) -> DataFrame:
    """Molecule interval -> one row per bead, with the zero-based residue index."""
    shift = f"{residue_start} - 1" if residue_start else "0"
    return (
        df.where(f"{stop} > {start}")
        .selectExpr("*", f"posexplode(sequence({start}, {stop} - 1)) AS (_k, {out})")
        .selectExpr("*", f"CAST({shift} + _k AS BIGINT) AS residue")
        .drop("_k")
    )
