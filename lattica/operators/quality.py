"""Data-quality checks. A check yields one ledger row ``(check, value, required, passed)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica import constants as C


class QualityError(RuntimeError):
    """At least one check of a ledger failed."""


def ledger_row(df: DataFrame, check: str, value: Column, required: str, passed: Column) -> DataFrame:
    return df.agg(value.cast("string").alias("value"), passed.alias("passed")).select(
        F.lit(check).alias("check"), "value", F.lit(required).alias("required"), F.coalesce("passed", F.lit(False)).alias("passed")
    )


def ledger(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def enforce(table: DataFrame) -> DataFrame:
    """Run the checks once; raise with the names of those that failed (a ledger has a few rows)."""
    failed = [r["check"] for r in table.where("NOT passed").select("check").collect()]
    if failed:
        raise QualityError("; ".join(failed))
    return table


def sampling_report(frames: DataFrame, groups: Sequence[str], first: int = C.FIRST_FRAME, last: int = C.LAST_FRAME, step: int = C.FRAME_STEP, frame: str = "frame") -> DataFrame:
    """Per group: rows, distinct frames, frames off the grid, and whether the grid is met exactly."""
    expected = len(range(first, last + 1, step))
    f = F.col(frame)
    on = (f >= first) & (f <= last) & ((f - first) % step == 0)
    return (
        frames.groupBy(*groups)
        .agg(F.count("*").alias("n_rows"), F.count_distinct(frame).alias("n_frames"), F.count_if(~on).alias("off_grid"))
        .withColumn("passed", (F.col("n_rows") == expected) & (F.col("n_frames") == expected) & (F.col("off_grid") == 0))
    )


def exact_sampling(frames: DataFrame, groups: Sequence[str], **grid) -> DataFrame:
    report = sampling_report(frames, groups, **grid)
    return ledger_row(report, "exact sampling grid", F.count_if(~F.col("passed")), "0 groups off the grid", F.count_if(~F.col("passed")) == 0)


def block_counts(frames: DataFrame, groups: Sequence[str], replicate: str, frame: str, repeats: int, per_block: int) -> DataFrame:
    """Per group: its replicates, the fewest and most distinct frames of one, and whether all numbers are as required.
    Rows without a replicate or a frame count for nothing."""
    blocks = frames.groupBy(*groups, replicate).agg(F.count_distinct(frame).alias("_n"))
    out = blocks.groupBy(*groups).agg(F.count(replicate).alias("n_replicates"), F.min(F.when(F.col(replicate).isNotNull(), F.col("_n"))).alias("fewest"), F.max(F.when(F.col(replicate).isNotNull(), F.col("_n"))).alias("most"))
    exact = (F.col("n_replicates") == repeats) & (F.col("fewest") == per_block) & (F.col("most") == per_block)
    return out.withColumn("passed", F.coalesce(exact, F.lit(False)))


def missing_frames(frames: DataFrame, groups: Sequence[str], first: int, last: int, step: int, frame: str = "frame") -> DataFrame:
    """Grid frames that a group lacks."""
    grid = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(step).cast("long")))
    wanted = frames.select(*groups).distinct().select(*groups, grid.alias(frame))
    return wanted.join(frames.select(*groups, frame).distinct(), [*groups, frame], "left_anti")


def max_gap(df: DataFrame, check: str, left: Column, right: Column, tolerance: float) -> DataFrame:
    """Largest absolute difference of two columns within a tolerance."""
    gap = F.max(F.abs(left - right))
    return ledger_row(df, check, F.round(gap, 9), f"<= {tolerance}", gap <= tolerance)


def within(df: DataFrame, check: str, value: str, low: float, high: float) -> DataFrame:
    lo, hi = F.min(value), F.max(value)
    return ledger_row(df, check, F.concat_ws("..", F.round(lo, 6).cast("string"), F.round(hi, 6).cast("string")), f"{low}..{high}", (lo >= low) & (hi <= high))


def integral(df: DataFrame, check: str, value: str) -> DataFrame:
    bad = F.count_if(F.col(value) != F.rint(value))
    return ledger_row(df, check, bad, "0 fractional values", bad == 0)


def constant_value(df: DataFrame, check: str, value: str, expected) -> DataFrame:
    lo, hi = F.min(value), F.max(value)
    return ledger_row(df, check, lo, f"= {expected}", (lo == expected) & (hi == expected))


def unique_key(df: DataFrame, check: str, keys: Sequence[str]) -> DataFrame:
    """Duplicates are found by counting per key, which combines before the shuffle."""
    per = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    dup = F.count_if(F.col("_n") > 1)
    return ledger_row(per, check, dup, "0 duplicate keys", dup == 0)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """Keys present on one side only; both sides must hold the same set."""
    sides = left.select(*keys).withColumn("_s", F.lit(1)).unionByName(right.select(*keys).withColumn("_s", F.lit(2)))
    per = sides.groupBy(*keys).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    odd = F.count_if(F.col("_a") == F.col("_b"))
    return ledger_row(per, check, odd, "0 keys on one side", odd == 0)


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the child whose key the parent lacks."""
    return child.join(parent.select(*on).distinct(), list(on), "left_anti")


def no_orphans(child: DataFrame, parent: DataFrame, on: Sequence[str], check: str) -> DataFrame:
    return ledger_row(orphans(child, parent, on), check, F.count("*"), "0 orphans", F.count("*") == 0)


def complete_arms(df: DataFrame, value: str, check: str) -> DataFrame:
    missing = F.count("*") - F.count(value)
    return ledger_row(df, check, missing, "0 missing values", missing == 0)


def matched_fields(df: DataFrame, key: str, parent: str, fields: Sequence[str]) -> DataFrame:
    """Child rows whose listed fields differ from those of the row they name as parent."""
    p = df.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    joined = df.where(F.col(parent).isNotNull()).join(p, F.col(parent) == F.col("_k"))
    wrong = [F.when(~F.col(f).eqNullSafe(F.col(f"_p_{f}")), F.lit(f)) for f in fields]
    return joined.select(key, parent, F.array_compact(F.array(*wrong)).alias("changed")).where(F.size("changed") > 0)


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails when a key repeats on either side."""
    keys = list(keys)

    def guarded(df, name):
        n = df.groupBy(*keys).agg(F.count("*").alias(f"_n_{name}"))
        return df.join(n, keys).withColumn(f"_n_{name}", F.when(F.col(f"_n_{name}") > 1, F.raise_error(F.lit(f"repeated key on the {name}"))).otherwise(1))

    return guarded(left, "left").join(guarded(right, "right"), keys).where("_n_left = 1 AND _n_right = 1").drop("_n_left", "_n_right")


def agreement(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, groups: Sequence[str], tolerance: float) -> DataFrame:
    """Do two analyses give one quantity? Per group: rows on both sides, rows on one side only, the largest gap, and
    whether it is within the tolerance with no row missing. A value that is NULL on one side counts as one-sided."""
    on = [*groups, *keys]
    both = left.select(*on, F.col(value).alias("_l")).join(right.select(*on, F.col(value).alias("_r")), on, "full")
    gap = F.abs(F.col("_l") - F.col("_r"))
    single = F.count_if(F.col("_l").isNull() != F.col("_r").isNull())
    out = both.groupBy(*groups).agg(F.count(gap).alias("n_both"), single.alias("one_sided"), F.max(gap).alias("gap"))
    return out.withColumn("passed", (F.col("one_sided") == 0) & (F.coalesce("gap", F.lit(0.0)) <= tolerance))


def frame_map_problems(maps: DataFrame, schema: str, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Selected-frame maps that are not usable: wrong tag, not sorted and unique, out of range, or of the wrong length."""
    a = F.col("source_frames_one_based")
    problems = F.array_compact(
        F.array(
            F.when(~F.col("schema").eqNullSafe(F.lit(schema)), F.lit("schema")),
            F.when(a.isNull(), F.lit("missing")),
            F.when(F.array_sort(F.array_distinct(a)) != a, F.lit("order")),
            F.when(~F.forall(a, lambda v: (v >= 1) & (v <= F.col("source_frame_count"))), F.lit("range")),
            F.when(F.size(a) != F.col("stored_frames"), F.lit("length")),
        )
    )
    return maps.join(stored, list(keys)).select(*keys, problems.alias("problems")).where(F.size("problems") > 0)


def refuse_purpose(df: DataFrame, forbidden: str) -> DataFrame:
    """Fail, when the rows are read, on data tagged for another purpose."""
    bad = F.raise_error(F.lit(f"data tagged {forbidden} cannot be analysed"))
    return df.withColumn("purpose", F.when(F.col("purpose") == forbidden, bad).otherwise(F.col("purpose")))


def digest_mismatches(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Files of a checksum list that are missing or differ: ``(path, reason)``."""
    joined = listed.select("path", F.col("sha256").alias("_want")).join(actual.select("path", F.col("sha256").alias("_have")), "path", "left")
    reason = F.when(F.col("_have").isNull(), "missing").when(F.lower("_have") != F.lower("_want"), "mismatch")
    return joined.select("path", reason.alias("reason")).where("reason IS NOT NULL")
