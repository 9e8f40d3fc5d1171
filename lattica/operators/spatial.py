"""Distance joins over particle coordinates.

A frame is identified by ``keys``; every particle has an id and three coordinates. Frames of up to ``frames.LARGE`` particles
are searched in tasks: one exchange brings a frame's rows together, cells as wide as the radius find the pairs. Larger
frames go through joins. Spark has no spatial join, so space is cut into blocks a few search radii wide. A particle is stored in its own block and sent to every block that its
search sphere touches (under five of them on average), and the two meet in an ordinary equi-join on frame and block. A hot frame
is thereby spread over its blocks, and adaptive skew handling splits a hot block. Sending particles to all 14 or 27
neighbour cells of one radius instead would move three to six times as many rows.

Expressions are written as SQL text: one parse instead of thousands of calls into the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import frames, pyramid
from lattica.operators.frames import ragged
from lattica.session import materialise

# Block edge in search radii, and a hair of slack so that rounding cannot hide a pair at exactly the radius.
BLOCK_RADII = 3.0
SLACK = 1.000000001
# Targets that a frame searched as one block can have; a frame with more in any block is searched through a pyramid.
CROWDED = 216


def _number(box) -> str:
    """SQL text for a box edge: a column name or a number."""
    return box if isinstance(box, str) else f"{float(box)!r}D"


def _distance(right: str, left: str, box: str | None) -> str:
    parts = []
    for a in "xyz":
        d = f"({right}{a} - {left}{a})"
        if box:
            d = f"({d} - {box} * rint({d} / {box}))"
        parts.append(f"{d} * {d}")
    return f"sqrt({' + '.join(parts)})"


def _touched(df: DataFrame, kind: str) -> DataFrame:
    """One row per block that the sphere of a particle touches, from its first and last block on each axis.

    A sphere narrower than a block touches at most two blocks per axis, hence eight corners; a corner that repeats
    another (same block on that axis) is left out. Corners are numbered instead of listed to keep the generated code
    of this stage small enough to be compiled by the JVM.
    """
    corners = df.selectExpr("*", "explode(array(0, 1, 2, 3, 4, 5, 6, 7)) AS _e")
    fresh = " AND ".join(f"NOT (_e & {bit} <> 0 AND _{a}0 = _{a}1)" for a, bit in zip("xyz", (1, 2, 4)))
    return corners.where(fresh).selectExpr("*", *[f"CAST(if(_e & {bit} = 0, _{a}0, _{a}1) AS {kind}) AS _b{a}" for a, bit in zip("xyz", (1, 2, 4))])


def _packed(carry: Sequence[str]) -> list[str]:
    """Carried columns as one struct: the join then moves one value per row, whatever their number."""
    return [f"named_struct({', '.join(f'{c!r}, {c}' for c in carry)}) AS _c"] if carry else []


def _meet(probe: DataFrame, build: DataFrame, on: Sequence[str], keys: Sequence[str], box: str | None, radius: float, carry: Sequence[str], strict: bool) -> DataFrame:
    """Pairs of probe and stored rows of one block within the radius, each taken once by id order."""
    names = [f"l_c.{c} AS {c}_i, r_c.{c} AS {c}_j".split(", ") for c in carry]
    return (
        probe.join(build, list(on))
        .where("l_id < r_id")
        .selectExpr("*", f"{_distance('r_', 'l_', box)} AS d")
        .where(f"d {'<' if strict else '<='} {float(radius)!r}D")
        .selectExpr(*keys, "l_id AS i", "r_id AS j", "d", *[n for pair in names for n in pair])
    )


def radius_pairs(
    points: DataFrame,
    keys: Sequence[str],
    box,
    radius: float,
    *,
    id: str = "bead",
    carry: Sequence[str] = (),
    strict: bool = False,
    sizes: DataFrame | None = None,
    clustered: bool = False,
) -> DataFrame:
    """All pairs within ``radius`` under the minimum-image convention of a cubic box.

    ``box`` is a number or the name of a column. Result: keys, ``i`` < ``j``, ``d`` and, for every carried column,
    ``<name>_i`` and ``<name>_j``. ``sizes(keys, n)`` has the particles of each frame, if that is known; ``clustered`` says that
    every frame's rows are in one partition.
    """
    keys = list(keys)
    points = points.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, id, *"xyz"]))
    large = frames.large_frames(points.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes, keys)
    if large is None:
        return _pairs_in_frames(points, keys, box, radius, id, carry, strict, clustered)
    small = points.join(large, keys, "left_anti")
    return _pairs_in_frames(small, keys, box, radius, id, carry, strict, False).unionByName(
        _pairs_in_blocks(points.join(large, keys, "left_semi"), keys, box, radius, id=id, carry=carry, strict=strict)
    )


CANDIDATES = 1 << 20  # distances that a task computes at once


def _cells(code: np.ndarray, xyz: np.ndarray, side: np.ndarray, radius: float):
    """Cells per axis of each particle's frame, its cell on each axis, and the first cell number of its frame. Cells are at least
    as wide as the radius, and a frame has at most about eight for each of its particles."""
    count = np.bincount(code)
    edge = np.zeros(len(count))
    edge[code] = side
    n = np.maximum(np.minimum(np.floor(edge / (radius * SLACK)), np.ceil(2 * np.cbrt(count))), 1).astype("int64")
    first = np.concatenate([[0], np.cumsum(n**3)])
    nb = n[code]
    place = np.clip((xyz * nb[:, None] / side[:, None]).astype("int64"), 0, nb[:, None] - 1)
    return nb, place, first[code], int(first[-1])


def _pairs_in_frames(points: DataFrame, keys: list[str], box, radius: float, id: str, carry: Sequence[str], strict: bool, clustered: bool) -> DataFrame:
    """The search in tasks, on batches of whole frames. A particle looks into its own cell and those around it, each once even
    if a frame has one or two cells on an axis; the particle with the smaller id reports the pair."""
    side = _number(box)
    rows = points.selectExpr(*keys, f"{id} AS _id", *[f"{c} AS _c_{c}" for c in carry], *[f"{a} - {side} * floor({a} / {side}) AS _{a}" for a in "xyz"], f"CAST({side} AS DOUBLE) AS _box")
    rows = rows.where("NOT (isnan(_x) OR isnan(_y) OR isnan(_z))")

    def run(table: pa.Table, code: np.ndarray) -> pa.Table:
        ids, side = table["_id"].to_numpy(), table["_box"].to_numpy()
        xyz = np.stack([table[f"_{a}"].to_numpy() for a in "xyz"], axis=1)
        nb, place, base, cells = _cells(code, xyz, side, radius)
        own = base + (place[:, 0] * nb + place[:, 1]) * nb + place[:, 2]
        order = np.argsort(own, kind="stable")
        bound = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=cells))])
        found = []
        for offset in np.ndindex(3, 3, 3):
            asks, at = np.ones(len(nb), bool), []
            for k, o in enumerate(offset):
                o -= 1
                asks &= (o == 0) | (nb >= 3) | ((nb == 2) & (o == 1))
                at.append((place[:, k] + o) % nb)
            cell = base + (at[0] * nb + at[1]) * nb + at[2]
            who = np.flatnonzero(asks & (bound[cell + 1] > bound[cell]))
            counts = bound[cell[who] + 1] - bound[cell[who]]
            total = np.cumsum(counts)
            part = 0
            while part < len(who):
                stop = max(int(np.searchsorted(total, (total[part - 1] if part else 0) + CANDIDATES, "right")), part + 1)
                left, right = ragged(bound[cell[who[part:stop]]], counts[part:stop])
                left, right = who[part:stop][left], order[right]
                first = ids[left] < ids[right]
                left, right = left[first], right[first]
                square = 0.0
                for k in range(3):
                    d = xyz[right, k] - xyz[left, k]
                    d = d - side[left] * np.rint(d / side[left])
                    square = square + d * d
                d = np.sqrt(square)
                near = d < radius if strict else d <= radius
                found.append((left[near], right[near], d[near]))
                part = stop
        left, right, d = (np.concatenate([f[k] for f in found]) if found else np.empty(0, float if k == 2 else "int64") for k in range(3))
        by = np.argsort(left, kind="stable")
        left, right, d = left[by], right[by], d[by]
        out = [table[k].take(left) for k in keys] + [table["_id"].take(left), table["_id"].take(right), pa.array(d)]
        names = [*keys, "i", "j", "d"]
        for c in carry:
            out += [table[f"_c_{c}"].take(left), table[f"_c_{c}"].take(right)]
            names += [f"{c}_i", f"{c}_j"]
        return pa.table(out, names=names)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = [f"`{k}` {kind[k]}" for k in keys] + [f"i {kind['_id']}", f"j {kind['_id']}", "d double"]
    schema += [f"`{c}_{end}` {kind[f'_c_{c}']}" for c in carry for end in "ij"]
    return frames.by_frame(rows, keys, run, ", ".join(schema), clustered)


def _pairs_in_blocks(points: DataFrame, keys: Sequence[str], box, radius: float, *, id: str, carry: Sequence[str], strict: bool) -> DataFrame:
    """The search by a join on frame and block. Each pair appears once: the particle with the smaller id looks for the other, and
    the blocks it is sent to are distinct even in boxes of one or two blocks."""
    keys = list(keys)
    side = _number(box)
    r = f"{float(radius) * SLACK!r}D"
    wrapped = points.selectExpr(
        *keys,
        f"{id} AS _id",
        *_packed(carry),
        *[f"{a} - {side} * floor({a} / {side}) AS _{a}" for a in "xyz"],
        f"{side} AS _box",
        f"CAST(greatest(floor({side} / {float(radius) * BLOCK_RADII!r}D), 1) AS INT) AS _nb",
    )
    at = "(CAST(floor(({x}) * _nb / _box) AS INT) + _nb) % _nb"
    payload = ["_id", *(["_c"] if carry else []), "_x", "_y", "_z"]
    own = "({0} * _nb + {1}) * _nb + {2}".format(*[at.format(x=f"_{a}") for a in "xyz"])
    build = wrapped.selectExpr(*keys, f"{own} AS _block", *[f"{p} AS r{p}" for p in payload])
    ends = [f"{at.format(x=f'_{a} {sign} {r}')} AS _{a}{k}" for a in "xyz" for k, sign in enumerate("-+")]
    probe = _touched(wrapped.selectExpr("*", *ends), "INT").selectExpr(
        *keys, *[f"{p} AS l{p}" for p in payload], "_box", "(_bx * _nb + _by) * _nb + _bz AS _block"
    )
    return _meet(probe, build, [*keys, "_block"], keys, "_box", radius, carry, strict)


def radius_pairs_open(
    points: DataFrame, keys: Sequence[str], radius: float, *, id: str = "bead", carry: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """All pairs within ``radius`` without periodic images (blocks are unbounded in every direction)."""
    keys = list(keys)
    r, w = f"{float(radius) * SLACK!r}D", f"{float(radius) * BLOCK_RADII!r}D"
    payload = ["_id", *(["_c"] if carry else []), "_x", "_y", "_z"]
    base = points.selectExpr(*keys, f"{id} AS _id", *_packed(carry), *[f"{a} AS _{a}" for a in "xyz"])
    build = base.selectExpr(*keys, *[f"floor(_{a} / {w}) AS _b{a}" for a in "xyz"], *[f"{p} AS r{p}" for p in payload])
    ends = [f"floor((_{a} {sign} {r}) / {w}) AS _{a}{k}" for a in "xyz" for k, sign in enumerate("-+")]
    probe = _touched(base.selectExpr("*", *ends), "BIGINT").selectExpr(*keys, *[f"{p} AS l{p}" for p in payload], "_bx", "_by", "_bz")
    return _meet(probe, build, [*keys, "_bx", "_by", "_bz"], keys, None, radius, carry, strict)


def nearest_target_distance(
    queries: DataFrame,
    targets: DataFrame | str,
    keys: Sequence[str],
    box,
    *,
    id: str = "bead",
    carry: Sequence[str] = (),
    clustered: bool = False,
) -> DataFrame:
    """Distance from each query point to the nearest target of its frame, periodic and without a search limit.

    ``targets`` is a table or a condition: the rows of ``queries`` that meet it are the targets of the others. ``clustered`` says
    that every frame's rows are in one partition then. Frames with up to TARGETS targets and ``frames.LARGE`` points are settled in
    tasks, by all distances; others by rounds of joins. Frames without targets give no rows.
    """
    keys = list(keys)
    side = _number(box)

    def located(df, target, own):
        given = ", ".join(f"{c!r}, {c}" for c in [id, *carry])
        held = f"named_struct({given})" if own else None
        out = df.selectExpr(*keys, f"{target} AS _target", *[f"{a} - {side} * floor({a} / {side}) AS _{a}" for a in "xyz"], f"CAST({side} AS DOUBLE) AS _box", *([f"{held} AS _c"] if held else []))
        return out.where(" AND ".join([f"{k} IS NOT NULL" for k in keys] + [f"_{a} IS NOT NULL AND NOT isnan(_{a})" for a in "xyz"]))

    marked = isinstance(targets, str)
    if marked:
        rows = located(queries, f"coalesce({targets}, false)", True)
    else:
        rows = located(queries, "false", True).unionByName(located(targets, "true", False), allowMissingColumns=True)
    sizes = rows.groupBy(*keys).agg(F.count_if("_target").alias("_t"), F.count("*").alias("n"))
    large = frames.large_frames(sizes.selectExpr(*keys, f"if(_t > {TARGETS}, greatest(n, {frames.LARGE + 1}), n) AS n"), keys)
    small = rows if large is None else rows.join(large, keys, "left_anti")
    done = _nearest_in_frames(small, keys, clustered and marked and large is None).selectExpr(*keys, f"_c.{id} AS {id}", "distance", *[f"_c.{c} AS {c}" for c in carry])
    if large is None:
        return done
    queries, targets = (queries.where(f"NOT coalesce({targets}, false)"), queries.where(targets)) if marked else (queries, targets)
    queries, targets = (df.join(large, keys, "left_semi") for df in (queries, targets))
    return done.unionByName(_nearest_by_rounds(queries, targets, keys, box, id=id, carry=carry))


TARGETS = 4096  # targets of a frame that each of its points is compared with


def _nearest_in_frames(rows: DataFrame, keys: list[str], clustered: bool) -> DataFrame:
    def run(table: pa.Table, code: np.ndarray) -> pa.Table:
        target = table["_target"].to_numpy()
        xyz, side = np.stack([table[f"_{a}"].to_numpy() for a in "xyz"], axis=1), table["_box"].to_numpy()
        goals = np.flatnonzero(target)
        held = np.bincount(code[goals], minlength=code[-1] + 1)
        start = np.cumsum(held) - held
        asks = np.flatnonzero(~target & (held[code] > 0))
        counts = held[code[asks]]
        total = np.cumsum(counts)
        best, part = np.empty(len(asks)), 0
        while part < len(asks):
            stop = max(int(np.searchsorted(total, (total[part - 1] if part else 0) + CANDIDATES, "right")), part + 1)
            who, goal = ragged(start[code[asks[part:stop]]], counts[part:stop])
            who, goal = asks[part:stop][who], goals[goal]
            square = 0.0
            for k in range(3):
                d = xyz[goal, k] - xyz[who, k]
                d = d - side[who] * np.rint(d / side[who])
                square = square + d * d
            best[part:stop] = np.sqrt(np.minimum.reduceat(square, np.cumsum(counts[part:stop]) - counts[part:stop]))
            part = stop
        # Rows of a frame with the same id count once, with the least distance.
        held_id = table["_c"].combine_chunks().take(pa.array(asks)).field(0)
        names = [c.dictionary_encode("encode").indices.to_numpy() for c in (held_id.flatten() if pa.types.is_struct(held_id.type) else [held_id])]
        order = np.lexsort((best, *names, code[asks]))
        fresh = np.ones(len(order), bool)
        if len(order):
            fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in (code[asks], *names)], axis=0)
        kept = order[fresh]
        asks, best = asks[kept], best[kept]
        return pa.table([*[table[k].take(asks) for k in keys], pa.array(best), table["_c"].take(asks)], names=[*keys, "distance", "_c"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in keys] + ["distance double", f"_c {kind['_c']}"])
    return frames.by_frame(rows, keys, run, schema, clustered)


def _nearest_by_rounds(queries: DataFrame, targets: DataFrame, keys: Sequence[str], box, *, id: str, carry: Sequence[str]) -> DataFrame:
    """The search radius starts at the mean spacing of the frame's targets. A query meets the targets of the blocks that its
    search sphere touches; one whose nearest target lies beyond the radius tries again with twice the radius, until the
    block is the whole box. A frame with few targets is one block from the start. Each further radius is a written round of
    the points that are left. Frames whose targets are clumped, with more than CROWDED in one of the first blocks, are
    searched through a pyramid of occupied cells instead.
    """
    keys = list(keys)
    side = _number(box)
    counts = targets.groupBy(*keys).agg(F.count("*").alias("_n"))

    def located(df, extra):
        out = df.selectExpr(*keys, *extra, *[f"{a} - {side} * floor({a} / {side}) AS _{a}" for a in "xyz"], f"{side} AS _box")
        return out.join(counts, keys)

    def blocks(widen: int) -> str:
        return f"CAST(greatest(floor(cbrt(_n) / {BLOCK_RADII * widen!r}D), 1) AS INT)"

    at = "(CAST(floor(({x}) * _nb / _box) AS INT) + _nb) % _nb"
    own = "({0} * _nb + {1}) * _nb + {2}".format(*[at.format(x=f"_{a}") for a in "xyz"])
    goal = located(targets, [])
    left = located(queries, [id, *carry])
    held = goal.withColumn("_nb", F.expr(blocks(1))).groupBy(*keys, F.expr(own).alias("_block")).agg(F.count("*").alias("_held"), F.first("_n").alias("_n"))
    frames = materialise(held.groupBy(*keys).agg(F.max("_held").alias("_held"), F.first("_n").alias("_n")), "crowds")
    crowded = F.col("_held") > CROWDED
    clumped, densest = frames.agg(F.count_if(crowded), F.max(F.when(~crowded, F.col("_n")))).first()
    done, widen = None, 1
    if clumped:
        some = frames.where(crowded).select(*keys)
        done = pyramid.nearest(left.join(some, keys, "left_semi"), goal.join(some, keys, "left_semi"), keys, id, carry).select(*keys, id, "distance", *carry)
        if densest is None:
            return done
        goal, left = (df.join(some, keys, "left_anti") for df in (goal, left))
    while True:
        last = not densest or float(densest) ** (1 / 3) / (BLOCK_RADII * widen) < 2
        reach = f"_box / (_nb * {BLOCK_RADII * SLACK!r}D)"
        build = goal.withColumn("_nb", F.expr(blocks(widen))).selectExpr(*keys, f"{own} AS _block", *[f"_{a} AS _t_{a}" for a in "xyz"])
        probe = left.withColumn("_nb", F.expr(blocks(widen)))
        probe = probe.selectExpr("*", *[f"{at.format(x=f'_{a} {sign} {reach}')} AS _{a}{k}" for a in "xyz" for k, sign in enumerate("-+")])
        probe = _touched(probe, "INT").withColumn("_block", F.expr("(_bx * _nb + _by) * _nb + _bz"))
        kept = [*carry, *([] if last else ["_x", "_y", "_z", "_box", "_n", "_nb"])]
        found = (
            probe.join(build, [*keys, "_block"], "inner" if last else "left")
            .selectExpr(*keys, id, *kept, f"{_distance('_t_', '_', '_box')} AS _d")
            .groupBy(*keys, id)
            .agg(F.min("_d").alias("distance"), *[F.first(c).alias(c) for c in kept])
        )
        if last:
            found = found.select(*keys, id, "distance", *carry)
            return found if done is None else done.unionByName(found)
        found = materialise(found, "nearest")
        near = F.expr(f"_nb = 1 OR distance <= {reach}")
        settled = found.where(near).select(*keys, id, "distance", *carry)
        done = settled if done is None else done.unionByName(settled)
        left = found.where(~F.coalesce(near, F.lit(False))).select(*keys, id, *carry, "_x", "_y", "_z", "_box", "_n")
        widen *= 2
