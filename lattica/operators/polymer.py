"""Chain geometry: unwrapping across the periodic boundary, shape and centres."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import frames
from lattica.operators.sequences import CHUNK, ranged_position, running_sum, shifted


def unwrap_chain(points: DataFrame, keys: Sequence[str], pos: str, box: float, chunk: int = CHUNK) -> DataFrame:
    """Continuous coordinates ``ux, uy, uz``: the first bead is wrapped, every step is the shortest image. A missing coordinate adds nothing,
    and the next bead adds its own; before the first known one they are null."""
    b = f"{float(box)!r}D"
    wrapped = points.selectExpr("*", *[f"{a} - {b} * floor({a} / {b}) AS _w{a}" for a in "xyz"])
    prev = shifted(wrapped, keys, pos, {f"_p{a}": (f"_w{a}", -1) for a in "xyz"}, chunk)
    step = prev.selectExpr("*", *[f"coalesce(_w{a} - _p{a} - {b} * rint((_w{a} - _p{a}) / {b}), _w{a}) AS _s{a}" for a in "xyz"])
    out = running_sum(step, keys, pos, {f"u{a}": f"_s{a}" for a in "xyz"}, chunk, from_first=True)
    return out.drop(*[f"_{k}{a}" for k in "wps" for a in "xyz"])


def unwrapped(code: np.ndarray, chain: np.ndarray, order: np.ndarray, at: np.ndarray, box: float, missing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of beads by frame, chain and ``order``, ties by place; their continuous coordinates in it; where these are unknown. ``at``
    are wrapped; a ``missing`` coordinate (if not given: NaN) adds nothing, and the next bead adds its own, as in ``unwrap_chain``."""
    missing = np.isnan(at) if missing is None else missing
    by = np.lexsort((*at.T[::-1], order, chain, code))
    at, missing, code, chain = at[by], missing[by], code[by], chain[by]
    step = np.diff(at, axis=0, prepend=at[:1])
    step = step - box * np.rint(step / box)
    step = np.where(missing | np.concatenate([missing[:1], missing[:-1]]), at, step)
    unknown = missing.copy()
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (chain[1:] != chain[:-1])]))
    length = np.diff(np.append(first, len(code)))
    longest = np.argsort(-length, kind="stable")
    first, length = first[longest], length[longest]
    # All chains take their next step together, so sums are added in the chain's order.
    for k in range(1, int(length[0])):
        here = first[: int(np.searchsorted(-length, -k))] + k
        before, more, none = at[here - 1], step[here], unknown[here - 1]
        at[here] = np.where(none, more, np.where(missing[here], before, before + more))
        unknown[here] &= none
    return by, at, unknown


def _in_tasks(
    points: DataFrame, keys: list[str], own: list[str], box: float, run: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], tuple], added: str, sizes: DataFrame | None, clustered: bool
) -> tuple[DataFrame, DataFrame | None]:
    """Frames of up to ``frames.LARGE`` beads unwrapped by ``run(rows, frame numbers, wrapped coordinates, which are missing)``: keys, ``own``,
    ``added`` and ``ux, uy, uz``; and the beads of larger frames, if any, with what puts beads that share a number in order by place."""
    b = f"{float(box)!r}D"
    wrapped = points.selectExpr(*keys, *own, *"xyz", *[f"{a} - {b} * floor({a} / {b}) AS _w{a}" for a in "xyz"])
    large = frames.large_frames(points.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes, keys)
    small = (wrapped if large is None else wrapped.join(large, keys, "left_anti")).drop(*"xyz")

    def work(table: pa.Table, code: np.ndarray) -> pa.Table:
        at = np.stack([table[f"_w{a}"].to_numpy() for a in "xyz"], axis=1)
        missing = np.stack([table[f"_w{a}"].is_null().to_numpy() for a in "xyz"], axis=1)
        by, more, at, unknown = run(table, code, at, missing)
        table = table.take(by)
        columns = [pa.array(at[:, k].copy(), mask=unknown[:, k].copy()) for k in range(3)]
        return pa.table([*[table[c] for c in [*keys, *own]], *more.values(), *columns], names=[*keys, *own, *more, "ux", "uy", "uz"])

    kind = {f.name: f.dataType.simpleString() for f in small.schema.fields}
    schema = ", ".join([f"`{c}` {kind[c]}" for c in [*keys, *own]] + [added] * bool(added) + ["ux double", "uy double", "uz double"])
    done = frames.by_frame(small, keys, work, schema, clustered and large is None)
    if large is None:
        return done, None
    last = [f"coalesce(_w{a}, double('NaN')) AS _t{a}" for a in "xyz"]
    return done, wrapped.join(large, keys, "left_semi").selectExpr(*keys, *own, *"xyz", *last)


def unwrap_frames(points: DataFrame, keys: Sequence[str], chain: str, order: str, box: float, carry: Sequence[str] = (), sizes: DataFrame | None = None, clustered: bool = False) -> DataFrame:
    """``unwrap_chain`` of all chains of a frame at once: keys, ``chain``, ``order``, ``ux, uy, uz`` and carried columns.

    ``order`` is a number; beads that share it follow each other by place. Beads without a key, chain or order are left out. Frames of up to ``frames.LARGE`` beads are unwrapped in tasks, after one
    exchange or none; larger ones get positions from a range sort and go through chunks. ``sizes`` and ``clustered`` as in ``spatial.radius_pairs``.
    """
    keys = list(keys)
    own = [chain, order, *[c for c in carry if c not in (chain, order)]]
    points = points.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, chain, order]))

    def run(table: pa.Table, code: np.ndarray, at: np.ndarray, missing: np.ndarray) -> tuple:
        by, at, unknown = unwrapped(code, table[chain].to_numpy(), table[order].to_numpy(), at, box, missing)
        return by, {}, at, unknown

    done, rest = _in_tasks(points, keys, own, box, run, "", sizes, clustered)
    if rest is None:
        return done
    placed = ranged_position(rest, [*keys, chain], [order, "_tx", "_ty", "_tz"], "_pos")
    return done.unionByName(unwrap_chain(placed, [*keys, chain], "_pos", box).select(*done.columns))


def unwrap_two_strand_frames(points: DataFrame, keys: Sequence[str], order: str, box: float, carry: Sequence[str] = (), sizes: DataFrame | None = None, clustered: bool = False) -> DataFrame:
    """``unwrap_two_strands`` of the one molecule of every frame, its first half by ``order`` being strand 1: keys, ``order``, carried columns,
    ``pos``, the molecule's length ``n`` and ``ux, uy, uz``. The rest is as in ``unwrap_frames``; ``sizes`` may count other beads, too."""
    keys = list(keys)
    own = [order, *[c for c in carry if c != order]]
    points = points.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, order]))

    def run(table: pa.Table, code: np.ndarray, at: np.ndarray, missing: np.ndarray) -> tuple:
        by = np.lexsort((*at.T[::-1], table[order].to_numpy(), code))
        row, length = np.arange(len(by)), np.bincount(code)
        first = np.cumsum(length) - length
        pos, n = row - first[code], length[code]
        second = pos >= n // 2
        _, at, unknown = unwrapped(code, second, pos, at[by], box, missing[by])
        # per axis, the last known place of strand 1 and the first of strand 2
        end = np.maximum.reduceat(np.where(second[:, None] | unknown, -1, row[:, None]), first)
        start = np.minimum.reduceat(np.where(second[:, None] & ~unknown, row[:, None], len(row)), first)
        lone = (end < 0) | (start == len(row))
        gap = np.take_along_axis(at, np.where(lone, 0, start), 0) - np.take_along_axis(at, np.where(lone, 0, end), 0)
        move = np.where(lone, 0.0, -box * np.rint(gap / box))
        return by, {"pos": pa.array(pos), "n": pa.array(n)}, np.where(second[:, None], at + move[code], at), unknown

    done, rest = _in_tasks(points, keys, own, box, run, "pos bigint, n bigint", sizes, clustered)
    if rest is None:
        return done
    placed = ranged_position(rest, keys, [order, "_tx", "_ty", "_tz"], "pos")
    placed = placed.join(placed.groupBy(*keys).agg(F.count("*").alias("n")), keys).withColumn("_half", F.expr("n div 2"))
    return done.unionByName(unwrap_two_strands(placed, keys, "pos", "_half", box).select(*done.columns))


def unwrap_two_strands(points: DataFrame, keys: Sequence[str], pos: str, half: str, box: float, chunk: int = CHUNK) -> DataFrame:
    """Each strand is unwrapped on its own; strand 2 then moves rigidly to the image next to the end of strand 1.

    ``half`` is a column with the number of beads per strand; positions run over both strands.
    """
    keys = list(keys)
    b = f"{float(box)!r}D"
    split = points.selectExpr("*", f"if({pos} < {half}, 0, 1) AS _strand", f"if({pos} < {half}, {pos}, {pos} - {half}) AS _spos")
    whole = unwrap_chain(split, [*keys, "_strand"], "_spos", box, chunk)
    ends = whole.groupBy(*keys).agg(
        *[F.max_by(f"u{a}", F.when((F.col("_strand") == 0) & F.col(f"u{a}").isNotNull(), F.col("_spos"))).alias(f"_e{a}") for a in "xyz"],
        *[F.min_by(f"u{a}", F.when((F.col("_strand") == 1) & F.col(f"u{a}").isNotNull(), F.col("_spos"))).alias(f"_f{a}") for a in "xyz"],
    )
    ends = ends.selectExpr(*keys, *[f"coalesce(-{b} * rint((_f{a} - _e{a}) / {b}), 0D) AS _m{a}" for a in "xyz"])
    kept = [c for c in whole.columns if c not in ("ux", "uy", "uz", "_strand", "_spos")]
    return whole.join(ends, keys).selectExpr(*kept, *[f"u{a} + if(_strand = 1, _m{a}, 0D) AS u{a}" for a in "xyz"])


def chain_shape(whole: DataFrame, keys: Sequence[str], pos: str, n: str, cap: int = 5) -> DataFrame:
    """Radius of gyration, end-to-end distance between the mean end caps, and relative shape anisotropy.

    The anisotropy needs no eigenvalues: with gyration tensor trace t and the sum m of its principal 2x2 minors it
    is 1 - 3 m / t^2. ``n`` is a column with the number of beads of the two-strand molecule.
    """
    keys = list(keys)
    end_a = f"({pos} < {cap} OR {pos} >= {n} - {cap})"
    end_b = f"({pos} >= {n} div 2 - {cap} AND {pos} < {n} div 2 + {cap})"
    aggs = [F.expr(f"var_pop(u{a})").alias(f"_v{a}") for a in "xyz"]
    aggs += [F.expr(f"covar_pop(u{a}, u{b})").alias(f"_c{a}{b}") for a, b in ("xy", "xz", "yz")]
    aggs += [F.expr(f"avg(if({end_b}, u{a}, NULL)) - avg(if({end_a}, u{a}, NULL))").alias(f"_e{a}") for a in "xyz"]
    trace = "(_vx + _vy + _vz)"
    minors = "(_vx * _vy - _cxy * _cxy + _vx * _vz - _cxz * _cxz + _vy * _vz - _cyz * _cyz)"
    return whole.groupBy(*keys).agg(*aggs).selectExpr(
        *keys,
        f"sqrt({trace}) AS Rg_nm",
        "sqrt(_ex * _ex + _ey * _ey + _ez * _ez) AS Ree_nm",
        f"if({trace} > 0, 1 - 3 * {minors} / ({trace} * {trace}), NULL) AS asphericity",
    )


def weighted_rg(points: DataFrame, keys: Sequence[str], mass: str, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Mass-weighted radius of gyration from weighted first and second moments about a nearby origin."""
    keys = list(keys)
    origin = points.groupBy(*keys).agg(*[F.avg(a).alias(f"_o{a}") for a in axes])
    rel = points.join(origin, keys).selectExpr(*keys, f"{mass} AS _m", *[f"{a} - _o{a} AS _r{a}" for a in axes])
    second = " + ".join(f"_r{a} * _r{a}" for a in axes)
    sums = rel.groupBy(*keys).agg(F.sum("_m").alias("_M"), F.sum(F.expr(f"_m * ({second})")).alias("_S"), *[F.sum(F.expr(f"_m * _r{a}")).alias(f"_q{a}") for a in axes])
    first = " + ".join(f"pow(_q{a} / _M, 2)" for a in axes)
    return sums.selectExpr(*keys, f"sqrt(greatest(_S / _M - ({first}), 0D)) AS Rg_mass_nm")


def centres(whole: DataFrame, keys: Sequence[str], box: float) -> DataFrame:
    """Centre of unwrapped chains or blocks, moved back into the box."""
    b = f"{float(box)!r}D"
    mean = whole.groupBy(*keys).agg(*[F.avg(f"u{a}").alias(f"_m{a}") for a in "xyz"])
    return mean.selectExpr(*keys, *[f"_m{a} - {b} * floor(_m{a} / {b}) AS {a}" for a in "xyz"])
