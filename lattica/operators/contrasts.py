"""Matched contrasts between arms. Inputs are replicate tables in long form: one row per key and metric.

Arms meet by conditional aggregation on the matching key, which combines before the shuffle and needs one exchange
for any number of arms; a key without all its arms is dropped, as an inner join would do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arms_wide(long: DataFrame, keys: Sequence[str], arm: str, arms: dict[str, str], value: str = "value", complete: bool = True) -> DataFrame:
    """One column per arm. ``arms`` maps the arm's label to the column name."""
    wide = long.where(F.col(arm).isin(list(arms))).groupBy(*keys).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(c) for a, c in arms.items()])
    if complete:
        for c in arms.values():
            wide = wide.where(F.col(c).isNotNull())
    return wide


def paired_difference(long: DataFrame, pairs: DataFrame, keys: Sequence[str], system: str = "system", value: str = "value") -> DataFrame:
    """With minus without, for every comparison, matched on ``keys``. ``pairs(comparison, without, with)`` is small."""
    roles = pairs.select("comparison", F.explode(F.array(F.struct(F.col("without").alias(system), F.lit("without_DNA").alias("role")), F.struct(F.col("with").alias(system), F.lit("with_DNA").alias("role")))).alias("_r"))
    tagged = long.join(roles.select("comparison", f"_r.{system}", "_r.role"), system)
    wide = arms_wide(tagged, ["comparison", *keys], "role", {"without_DNA": "without_DNA", "with_DNA": "with_DNA"}, value)
    return wide.withColumn("delta_with_minus_without", F.col("with_DNA") - F.col("without_DNA"))


def arm_differences(long: DataFrame, keys: Sequence[str], arm: str, full: str = "Full", splits: Sequence[str] = ("Split-2", "Split-4"), value: str = "value", reverse: bool = False) -> DataFrame:
    """Full minus each split arm (or the reverse) in one row per key."""
    names = {a: a.replace("-", "_") for a in (full, *splits)}
    wide = arms_wide(long, keys, arm, names, value)
    for s in splits:
        a, b = names[full], names[s]
        out = (f"{b}_minus_{a}", F.col(b) - F.col(a)) if reverse else (f"{a}_minus_{b}", F.col(a) - F.col(b))
        wide = wide.withColumn(*out)
    return wide


def difference_in_differences(effects: DataFrame, keys: Sequence[str], condition: str, effect: str, without: str, with_: str) -> DataFrame:
    """The effect under ``with_`` minus the effect under ``without``, per key."""
    wide = arms_wide(effects, keys, condition, {without: f"{effect}_without_DNA", with_: f"{effect}_with_DNA"}, effect)
    return wide.withColumn("difference_in_differences", F.col(f"{effect}_with_DNA") - F.col(f"{effect}_without_DNA"))


def mask_transfer(repeat: DataFrame, ids: Sequence[str], masks: dict[str, str], value: str = "residue_LCC_fraction") -> DataFrame:
    """Wide mask columns to one row per mask. ``masks`` maps a column to its mask label."""
    labels = F.create_map(*[F.lit(v) for kv in masks.items() for v in kv])
    long = repeat.select(*ids, *masks).unpivot(list(ids), list(masks), "_c", value)
    return long.withColumn("covalent_mask", labels[F.col("_c")]).drop("_c")


def mask_decomposition(transfer: DataFrame, keys: Sequence[str], ensemble: str, mask: str, value: str, full: str = "Full", splits: Sequence[str] = ("Split-2", "Split-4")) -> DataFrame:
    """Total effect = effect of the mask on full coordinates + effect of the coordinates under the fragment mask."""
    cell = lambda e, m: F.max(F.when((F.col(ensemble) == e) & (F.col(mask) == m), F.col(value)))
    contrasts = [
        F.struct(F.lit(f"{full}-{s}").alias("contrast"), cell(full, full).alias("ff"), cell(full, s).alias("fs"), cell(s, s).alias("ss")) for s in splits
    ]
    rows = transfer.groupBy(*keys).agg(F.array(*contrasts).alias("_c")).select(*keys, F.explode("_c").alias("_c")).select(*keys, "_c.*")
    return rows.selectExpr(
        *keys,
        "contrast",
        "ff - ss AS total_diagonal_effect",
        "ff - fs AS direct_mask_effect",
        "fs - ss AS coordinate_ensemble_effect",
        "(ff - ss) - (ff - fs) - (fs - ss) AS additivity_error",
    )


def arm_range(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Largest minus smallest value over the arms."""
    return long.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("range_across_definitions"))


def partners_per_chain(repeat: DataFrame, edges: str, chains: str, out: str = "partners_per_chain") -> DataFrame:
    return repeat.withColumn(out, F.when(F.col(chains) > 0, F.lit(2.0) * F.col(edges) / F.col(chains)))


def absolute_count(repeat: DataFrame, design: DataFrame, fraction: str, constant: str, out: str) -> DataFrame:
    """Fraction times a constant of the system design."""
    return repeat.join(design.select("system", F.col(constant).alias("_k")), "system").withColumn(out, F.col(fraction) * F.col("_k")).drop("_k")
