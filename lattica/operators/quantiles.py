"""Exact quantiles of groups of any size.

Spark's exact percentile keeps all distinct values of a group in one task. Here values are first combined to
(value, weight). Borders from a mergeable quantile sketch cut each group into buckets of about equally many distinct values,
whatever their spread; bucket sums say which bucket the answer lies in, and only that bucket is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.operators import frames

# A running sum may miss its goal by rounding, since buckets and values are added in different orders.
TOLERANCE = 1e-12


def _inside(pre: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pre.join(target, list(keys)).where("v >= lo AND v <= hi")


def _crossings(pre: DataFrame, goals: DataFrame, keys: Sequence[str], rounds: int, buckets: int) -> DataFrame:
    """For each goal: the smallest value whose cumulative weight reaches it. ``goals(keys, tag, goal, lo, hi)``.

    ``buckets`` is a power of two. After each round, the interval holds about one in ``buckets`` of its distinct values.
    """
    keys = list(keys)
    at = W.partitionBy(*keys, "tag")
    reached = F.col("_c") >= F.col("goal") - F.abs("goal") * TOLERANCE
    target = goals.withColumn("before", F.lit(0.0))
    steps = []
    while buckets > 1:
        buckets //= 2
        steps.append(str(buckets))
    shares = [(i + 1) / 2 ** len(steps) for i in range(2 ** len(steps) - 1)]
    place = f"aggregate(array({', '.join(steps)}), 0, (i, s) -> if(_cuts[i + s - 1] < v, i + s, i))"
    for _ in range(rounds):
        inside = _inside(pre, target, keys)
        cuts = inside.groupBy(*keys, "tag").agg(F.percentile_approx("v", shares, 4 * len(shares)).alias("_cuts"))
        sums = inside.join(cuts, [*keys, "tag"]).selectExpr("*", f"{place} AS _b").groupBy(*keys, "tag", "_b").agg(
            F.sum("w").alias("_w"), F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.first("goal").alias("goal"), F.first("before").alias("before")
        )
        cum = sums.withColumn("_c", F.col("before") + F.sum("_w").over(at.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
        target = (
            cum.where(reached)
            .groupBy(*keys, "tag")
            .agg(F.min(F.struct("_b", "goal", "_lo", "_hi", (F.col("_c") - F.col("_w")).alias("before"))).alias("_m"))
            .selectExpr(*keys, "tag", "_m.goal AS goal", "_m._lo AS lo", "_m._hi AS hi", "_m.before AS before")
        )
    running = F.col("before") + F.sum("w").over(at.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    return _inside(pre, target, keys).withColumn("_c", running).where(reached).groupBy(*keys, "tag").agg(F.min("v").alias("value"))


def weighted_step_quantile(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, q: float = 0.9, *, out: str = "quantile", rounds: int = 1, buckets: int = 256
) -> DataFrame:
    """Smallest value whose cumulative weight is at least ``q`` of the total; no interpolation."""
    keys = list(keys)
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    pre = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(w.alias("w"))
    goals = pre.groupBy(*keys).agg((F.lit(q) * F.sum("w")).alias("goal"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("tag", F.lit(0))
    return _crossings(pre, goals, keys, rounds, buckets).select(*keys, F.col("value").alias(out))


def linear_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, *, out: str = "quantile", rounds: int = 1, buckets: int = 256) -> DataFrame:
    """Quantile interpolated between the two neighbouring order statistics (``q=0.5`` is the median)."""
    keys = list(keys)
    pre = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("w"))
    spread = pre.groupBy(*keys).agg((F.lit(q) * (F.sum("w") - 1)).alias("h"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("tag"), (F.floor("h") + 1.0).alias("goal")), F.struct(F.lit(1).alias("tag"), (F.ceil("h") + 1.0).alias("goal"))))
    goals = spread.select(*keys, "lo", "hi", ranks.alias("_g")).select(*keys, "_g.tag", "_g.goal", "lo", "hi")
    found = _crossings(pre, goals, keys, rounds, buckets).groupBy(*keys).agg(
        F.max(F.when(F.col("tag") == 0, F.col("value"))).alias("_a"), F.max(F.when(F.col("tag") == 1, F.col("value"))).alias("_b")
    )
    share = F.col("h") - F.floor("h")
    return found.join(spread.select(*keys, "h"), keys).select(*keys, (F.col("_a") + share * (F.col("_b") - F.col("_a"))).alias(out))


def medians(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Median of every metric (columns of the same names) per key: one quantile over all metrics in long form."""
    keys = list(keys)
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select(*keys, "_m.*")
    found = linear_quantile(long, [*keys, "metric"], "value", 0.5)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("quantile"))).alias(m) for m in metrics])


def distance_summary(df: DataFrame, keys: Sequence[str], value: str = "distance", weight: str | None = None, q: float = 0.9, prefix: str = "") -> DataFrame:
    """Count, total weight, weighted mean and step quantile of the distances of every group."""
    keys = list(keys)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.groupBy(*keys).agg(
        F.count(value).alias(f"{prefix}count"), F.sum(w).alias(f"{prefix}total_weight"), (F.sum(F.col(value) * w) / F.sum(w)).alias(f"{prefix}mean_nm")
    )
    return base.join(weighted_step_quantile(df, keys, value, weight, q, out=f"{prefix}q90_nm"), keys)


def _summaries(df: DataFrame, keys: Sequence[str], value: str, weight: str | None, q: float, kind: str | None) -> DataFrame:
    """Count, total weight, weighted mean, step quantile and interpolated quantile (without weights) of groups that fit into a
    task; with ``kind``, for all rows of a group and for those of each kind, as column ``_kind``."""
    keys = list(keys)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), w.alias("_w"), *([F.col(kind).alias("_kind")] if kind else []))
    rows = rows.where(F.col("_v").isNotNull() & F.col("_w").isNotNull())

    def run(table: pa.Table, code: np.ndarray) -> pa.Table:
        v, w, place = table["_v"].to_numpy(), table["_w"].to_numpy(), np.arange(table.num_rows)
        group, names = code, [None]
        if kind:
            kinds = table["_kind"].combine_chunks().dictionary_encode()
            names = ["all", *kinds.dictionary.to_pylist()]
            group = np.concatenate([code * len(names), code * len(names) + 1 + kinds.indices.to_numpy()])
            v, w, place = np.tile(v, 2), np.tile(w, 2), np.tile(place, 2)
        order = np.lexsort((v, group))
        v, w, group, place = v[order], w[order], group[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out = []
        for a, b in zip(start, [*start[1:], len(group)]):
            values, weights = v[a:b], w[a:b]
            total = weights.sum()
            running = np.cumsum(weights)
            goal = q * total
            at = min(int(np.searchsorted(running, goal - abs(goal) * TOLERANCE)), b - a - 1)
            h = q * (b - a - 1)
            low, high = values[int(np.floor(h))], values[int(np.ceil(h))]
            out.append((b - a, total, (values * weights).sum() / total if total else None, values[at], low + (h - np.floor(h)) * (high - low)))
        columns = [pa.array([o[k] for o in out], pa.int64() if k == 0 else pa.float64()) for k in range(5)]
        own = [pa.array([names[g % len(names)] for g in group[start]])] if kind else []
        return pa.table([*[table[k].take(place[start]) for k in keys], *own, *columns], names=[*keys, *(["_kind"] if kind else []), "_n", "_total", "_mean", "_step", "_linear"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = [f"`{k}` {types[k]}" for k in keys] + (["_kind string"] if kind else []) + ["_n bigint"] + [f"{c} double" for c in ("_total", "_mean", "_step", "_linear")]
    return frames.by_frame(rows, keys, run, ", ".join(schema))


def _parted(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that fit into a task, and those of larger groups if there are any."""
    large = frames.large_frames(df.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    return (df, None) if large is None else (df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi"))


def stored_linear_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, *, out: str = "quantile") -> DataFrame:
    """``linear_quantile`` of a written table without missing keys: groups that fit into a task are sorted there, after one exchange."""
    keys = list(keys)
    small, rest = _parted(df, keys)
    found = _summaries(small, keys, value, None, q, None).select(*keys, F.col("_linear").alias(out))
    return found if rest is None else found.unionByName(linear_quantile(rest, keys, value, q, out=out))


def stored_distance_summary(df: DataFrame, keys: Sequence[str], value: str = "distance", weight: str | None = None, q: float = 0.9, kind: str | None = None, out: str = "kind") -> DataFrame:
    """``distance_summary`` of a written table without missing keys, values and weights. With ``kind``, a group has a row for
    all (``out`` is ``all``) and one for each kind."""
    keys = list(keys)
    small, rest = _parted(df, keys)
    own = [out] if kind else []
    found = _summaries(small, keys, value, weight, q, kind)
    found = (found.withColumnRenamed("_kind", out) if kind else found).selectExpr(*keys, *own, "_n AS count", "_total AS total_weight", "_mean AS mean_nm", "_step AS q90_nm")
    if rest is None:
        return found
    if kind:
        rest = rest.withColumn(out, F.explode(F.array(F.lit("all"), F.col(kind))))
    return found.unionByName(distance_summary(rest, [*keys, *own], value, weight, q).select(*found.columns))


def parent_weights(df: DataFrame, keys: Sequence[str], parent: str = "parent", out: str = "weight") -> DataFrame:
    """Weight 1 / (rows of the same parent): every parent counts once."""
    keys = list(keys)
    counts = df.groupBy(*keys, parent).agg((F.lit(1.0) / F.count("*")).alias(out))
    return df.join(counts, [*keys, parent])
