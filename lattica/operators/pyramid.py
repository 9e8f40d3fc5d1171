"""Nearest targets through a pyramid of occupied cells, for targets that are clumped.

The box is halved along every axis from level to level; a cell with more than LEAF targets is divided, and only cells that
hold targets exist. Queries descend level by level: the distance to a target of each cell met so far is an upper bound, the
distance to a cell's bounding box a lower one, and cells beyond the upper bound are left. What a query meets depends on the
cells near its nearest target, not on how many targets lie elsewhere or how they are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import discard, materialise

LEAF = 8
DEPTH = 20  # last level: 2**20 cells per axis; what is still together there is one leaf
SLACK = 1.000000001


def _code(level: str) -> str:
    """Cell of a point at a level, from its place on each axis at the last level."""
    place = [f"shiftright(_p{a}, {DEPTH} - {level})" for a in "xyz"]
    return f"(shiftleft({place[0]}, 40) | shiftleft({place[1]}, 20) | {place[2]})"


def _parent(code: str) -> str:
    axis = [f"((shiftright({code}, {shift}) & 1048575L) div 2)" for shift in (40, 20, 0)]
    return f"(shiftleft({axis[0]}, 40) | shiftleft({axis[1]}, 20) | {axis[2]})"


def build(targets: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cells and leaves of ``targets(keys, _x, _y, _z, _box)``, whose coordinates lie in the box; both are written.

    Cells: keys, level, code, n, bounding box, one target (``_rx``, ``_ry``, ``_rz``), leaf. Leaves: a row per target with the
    level and code of its leaf. Targets at the same place count once.
    """
    keys = list(keys)
    last = f"{(1 << DEPTH) - 1}L"
    points = targets.select(*keys, "_x", "_y", "_z", "_box").distinct()
    points = points.selectExpr(*keys, *[f"_{a} AS _t{a}" for a in "xyz"], *[f"greatest(least(CAST(_{a} / _box * {1 << DEPTH}L AS BIGINT), {last}), 0L) AS _p{a}" for a in "xyz"])
    every = points.selectExpr("*", f"explode(sequence(0, {DEPTH})) AS level").selectExpr(*keys, "level", f"{_code('level')} AS code", "_tx", "_ty", "_tz")
    cells = every.groupBy(*keys, "level", "code").agg(
        F.count("*").alias("n"),
        *[f(f"_t{a}").alias(f"_{name}{a}") for a in "xyz" for f, name in ((F.min, "lo"), (F.max, "hi"))],
        F.min(F.struct("_tx", "_ty", "_tz")).alias("_r"),
    )
    cells = materialise(cells.selectExpr(*keys, "level", "code", "n", *[f"_{e}{a}" for a in "xyz" for e in ("lo", "hi")], *[f"_r._t{a} AS _r{a}" for a in "xyz"]), "cells")
    divided = cells.where(f"n > {LEAF} AND level < {DEPTH}").selectExpr(*keys, "level + 1 AS level", "code AS _above")
    kept = cells.where("level > 0").withColumn("_above", F.expr(_parent("code"))).join(divided, [*keys, "level", "_above"], "left_semi").drop("_above")
    kept = kept.unionByName(cells.where("level = 0")).withColumn("leaf", F.expr(f"n <= {LEAF} OR level = {DEPTH}"))
    tree = materialise(kept, "pyramid")
    leaves = materialise(every.join(tree.where("leaf").select(*keys, "level", "code"), [*keys, "level", "code"]), "leaves")
    discard(cells)
    return tree, leaves


def _lower() -> str:
    """Distance from a query to a cell's bounding box, over the nearest periodic image on each axis."""
    parts = []
    for a in "xyz":
        images = [f"greatest(_lo{a} - _{a} {s}, _{a} {t} - _hi{a}, 0D)" for s, t in (("", ""), ("- _box", "+ _box"), ("+ _box", "- _box"))]
        parts.append(f"pow(least({', '.join(images)}), 2)")
    return f"sqrt({' + '.join(parts)})"


def _apart(kind: str) -> str:
    parts = [f"pow(_{kind}{a} - _{a} - _box * rint((_{kind}{a} - _{a}) / _box), 2)" for a in "xyz"]
    return f"sqrt({' + '.join(parts)})"


def descend(queries: DataFrame, tree: DataFrame, keys: Sequence[str], id: str, carry: Sequence[str]) -> DataFrame:
    """The leaves that may hold each query's nearest target: query columns, level, code, n. ``queries`` have coordinates in the
    box as ``_x``, ``_y``, ``_z`` and ``_box``. One written round per level; queries without targets leave at the first."""
    keys = list(keys)
    own = [*keys, id, "_x", "_y", "_z", "_box", *carry]
    best = Window.partitionBy(*keys, id, "_x", "_y", "_z")
    met = queries.select(*own).withColumn("_best", F.lit(float("inf"))).withColumn("code", F.lit(0).cast("long"))
    rounds: list[DataFrame] = []
    deepest = tree.agg(F.max("level")).first()[0]
    for level in range((-1 if deepest is None else deepest) + 1):
        here = tree.where(F.col("level") == level).drop("level")
        seen = met.join(here, [*keys, "code"]).selectExpr(*own, "code", "n", "leaf", f"{_lower()} AS _lower", f"least(_best, {_apart('r')}) AS _up")
        seen = seen.withColumn("_best", F.min("_up").over(best)).where(f"_lower <= _best * {SLACK!r}D").drop("_up")
        rounds.append(materialise(seen.withColumn("level", F.lit(level)), "descent"))
        # A cell's eight halves: occupied ones are found by the next join.
        bits = [f"shiftleft(2 * (shiftright(code, {shift}) & 1048575L) + (shiftright(_e, {k}) & 1), {shift})" for k, shift in enumerate((40, 20, 0))]
        met = rounds[-1].where("NOT leaf").selectExpr(*own, "_best", "code", "explode(array(0L, 1L, 2L, 3L, 4L, 5L, 6L, 7L)) AS _e")
        met = met.selectExpr(*own, "_best", " | ".join(bits) + " AS code")
    if not rounds:
        return queries.select(*own, F.lit(0).alias("level"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("n")).where("false")
    found = rounds[0].where("leaf")
    for r in rounds[1:]:
        found = found.unionByName(r.where("leaf"))
    found = found.withColumn("_best", F.min("_best").over(best)).where(f"_lower <= _best * {SLACK!r}D")
    out = materialise(found.select(*own, "level", "code", "n"), "descent")
    discard(*rounds)
    return out


def nearest(queries: DataFrame, targets: DataFrame, keys: Sequence[str], id: str, carry: Sequence[str] = ()) -> DataFrame:
    """keys, id, ``distance`` to the nearest target of the frame, and carried columns. Both sides have coordinates in the box as
    ``_x``, ``_y``, ``_z`` and ``_box``."""
    keys = list(keys)
    tree, leaves = build(targets, keys)
    near = descend(queries, tree, keys, id, carry)
    discard(tree)
    return (
        near.join(leaves, [*keys, "level", "code"])
        .selectExpr(*keys, id, *carry, f"{_apart('t')} AS _d")
        .groupBy(*keys, id)
        .agg(F.min("_d").alias("distance"), *[F.first(c).alias(c) for c in carry])
    )
