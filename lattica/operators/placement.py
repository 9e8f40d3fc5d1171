"""Placement of connected chains next to each other across the periodic boundary.

Every contact says by how many box lengths its two chains are apart. Summed along a spanning forest, those steps give one
whole-box shift per chain, in rounds that grow with the logarithm of a component's depth. Only where contacts form a closed loop
through the box does the path matter: such components are walked breadth first from their root.

That is for frames with more than ``frames.LARGE`` rows. Others are unwrapped, and all their components walked, in tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import frames
from lattica.operators.forest import _least_labels, potentials
from lattica.operators.frames import ragged
from lattica.operators.polymer import unwrap_chain, unwrapped
from lattica.operators.sequences import ranged_position
from lattica.session import discard, materialise


def image_steps(anchors: DataFrame, beads: DataFrame, keys: Sequence[str], box: float) -> DataFrame:
    """Whole-box steps of every contact: how far the partner's bead lies from its nearest image."""
    keys = list(keys)
    b = f"{float(box)!r}D"
    at = lambda end: beads.select(*keys, F.col("bead").alias(f"bead_{end}"), *[F.col(f"u{a}").alias(f"_{a}_{end}") for a in "xyz"])
    joined = anchors.join(at("lo"), [*keys, "bead_lo"]).join(at("hi"), [*keys, "bead_hi"])
    return joined.selectExpr(*keys, "lo", "hi", *[f"CAST(rint((_{a}_hi - _{a}_lo) / {b}) AS INT) AS s{a}" for a in "xyz"])


def chain_steps(points: DataFrame, anchors: DataFrame, keys: Sequence[str], chain: str, order: str, box: float, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Centres of the unwrapped chains (keys, node, x, y, z), and ``image_steps`` of the anchors (keys, lo, hi, sx, sy, sz).

    Beads (``order``, also their ids) and anchors of a frame come together once and are worked off in a task, written once;
    frames with more than ``frames.LARGE`` rows go through chunks and joins. ``sizes``: keys, n (beads and anchors, or more).
    """
    keys = list(keys)
    b = f"{float(box)!r}D"
    points = points.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, chain, order]))
    anchors = anchors.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "lo", "hi", "bead_lo", "bead_hi"]))
    if sizes is None:
        sizes = points.select(*keys).unionAll(anchors.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    large = frames.large_frames(sizes, keys)
    kept = lambda df: df if large is None else df.join(large, keys, "left_anti")
    ends = lambda *names: [f"CAST({c} AS BIGINT) AS {to}" for c, to in zip(names, ("lo", "hi", "a", "b"))]
    rows = kept(points).selectExpr(*keys, *ends(chain, chain, order, order), *[f"{a} - {b} * floor({a} / {b}) AS {a}" for a in "xyz"], "false AS contact")
    rows = rows.unionByName(kept(anchors).selectExpr(*keys, *ends("lo", "hi", "bead_lo", "bead_hi"), *[f"CAST(NULL AS DOUBLE) AS {a}" for a in "xyz"], "true AS contact"))

    def run(table: pa.Table, code: np.ndarray) -> pa.Table:
        lo, hi, one, two = (table[c].to_numpy() for c in ("lo", "hi", "a", "b"))
        contact = table["contact"].to_numpy()
        beads, pairs = np.flatnonzero(~contact), np.flatnonzero(contact)
        if not len(beads):
            empty = pa.array([], pa.int32())
            return pa.table([*[table[c].slice(0, 0) for c in [*keys, "lo", "hi"]], *[empty] * 3, *[table[a].slice(0, 0) for a in "xyz"]], names=[*keys, "lo", "hi", "sx", "sy", "sz", *"xyz"])
        by, at, _ = unwrapped(code[beads], lo[beads], one[beads], np.stack([table[a].to_numpy() for a in "xyz"], axis=1)[beads], box)
        beads = beads[by]
        first = np.flatnonzero(np.concatenate([[True], (code[beads][1:] != code[beads][:-1]) | (lo[beads][1:] != lo[beads][:-1])]))
        known = np.add.reduceat((~np.isnan(at)).astype(float), first, axis=0)
        centre = np.add.reduceat(np.nan_to_num(at), first, axis=0) / np.where(known > 0, known, np.nan)
        # an anchor's bead is every row with its id
        names, place = np.unique(np.concatenate([one, two]), return_inverse=True)
        id_one, id_two = code * len(names) + place[: len(code)], code * len(names) + place[len(code) :]
        order_ = np.argsort(id_one[beads], kind="stable")
        sorted_ = id_one[beads][order_]
        found = lambda x: ragged(np.searchsorted(sorted_, x), np.searchsorted(sorted_, x, "right") - np.searchsorted(sorted_, x))
        owner, low = found(id_one[pairs])
        again, high = found(id_two[pairs][owner])
        owner, low, high = pairs[owner[again]], order_[low[again]], order_[high]
        step = np.rint((at[high] - at[low]) / box)
        n, m = len(first), len(owner)
        at_rows = np.concatenate([beads[first], owner])
        none = np.arange(n + m) < n
        columns = [pa.array(np.where(none, 0, hi[at_rows]), mask=none)]
        for k in range(3):
            s = np.concatenate([np.zeros(n), step[:, k]])
            columns.append(pa.array(np.nan_to_num(s).astype(np.int32), mask=none | np.isnan(s)))
        columns += [pa.array(np.concatenate([centre[:, k], np.full(m, np.nan)]), from_pandas=True) for k in range(3)]
        return pa.table([*[table[k].take(pa.array(at_rows)) for k in keys], pa.array(lo[at_rows]), *columns], names=[*keys, "lo", "hi", "sx", "sy", "sz", *"xyz"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in keys] + ["lo bigint", "hi bigint", "sx int", "sy int", "sz int", "x double", "y double", "z double"])
    done = materialise(frames.by_frame(rows, keys, run, schema), "steps")
    node, lo = points.schema[chain].dataType, anchors.schema["lo"].dataType
    centres = done.where("hi IS NULL").select(*keys, F.col("lo").cast(node).alias("node"), *"xyz")
    steps = done.where("hi IS NOT NULL").select(*keys, F.col("lo").cast(lo).alias("lo"), F.col("hi").cast(lo).alias("hi"), "sx", "sy", "sz")
    if large is None:
        return centres, steps
    rest = ranged_position(points.join(large, keys, "left_semi").select(*keys, chain, order, *"xyz"), [*keys, chain], [order], "_pos")
    whole = materialise(unwrap_chain(rest, [*keys, chain], "_pos", box).select(*keys, chain, F.col(order).alias("bead"), "ux", "uy", "uz"), "whole")
    mid = whole.groupBy(*keys, F.col(chain).alias("node")).agg(*[F.avg(f"u{a}").alias(a) for a in "xyz"])
    more = image_steps(anchors.join(large, keys, "left_semi"), whole, keys, box)
    return centres.unionByName(mid), steps.unionByName(materialise(more, "steps"))


def place_components(steps: DataFrame, labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shift of every node (``nx, ny, nz`` boxes) that makes its contacts to earlier nodes contiguous; roots stay."""
    return placed_components(steps, labelled, keys).drop("label")


def placed_components(steps: DataFrame, nodes: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """``place_components`` with ``label``, the smallest node of the component, and carried columns of the nodes. Nodes are numbers
    (others are placed in rounds whatever the frame's size)."""
    keys, carry = list(keys), list(carry)
    if nodes.schema["node"].dataType.simpleString() not in ("int", "bigint"):
        return _with_columns(_placed_in_rounds(steps, nodes, keys), nodes, keys, carry)
    both = nodes.select(*keys, "node").unionAll(steps.select(*keys, "lo"))
    large = frames.large_frames(both.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")), keys)
    if large is None:
        return _placed_in_tasks(steps, nodes, keys, carry)
    placed = _placed_in_tasks(steps.join(large, keys, "left_anti"), nodes.join(large, keys, "left_anti"), keys, carry)
    many = nodes.join(large, keys, "left_semi")
    return placed.unionByName(_with_columns(_placed_in_rounds(steps.join(large, keys, "left_semi"), many, keys), many, keys, carry))


def _with_columns(placed: DataFrame, nodes: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    return placed.join(nodes.select(*keys, "node", *carry), [*keys, "node"]) if carry else placed


def _placed_in_tasks(steps: DataFrame, nodes: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """All components of whole frames, walked breadth first from their smallest node; a node follows its smallest neighbour of the
    distance before."""
    kind = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    steps = steps.where("lo <> hi").selectExpr(*keys, "CAST(lo AS BIGINT) AS lo", "CAST(hi AS BIGINT) AS hi", "sx", "sy", "sz", *[f"CAST(NULL AS {kind[c]}) AS `{c}`" for c in carry])
    rows = nodes.where("node IS NOT NULL").selectExpr(*keys, "CAST(node AS BIGINT) AS lo", "CAST(node AS BIGINT) AS hi", "0 AS sx", "0 AS sy", "0 AS sz", *carry).unionByName(steps)
    rows = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))

    def run(table: pa.Table, code: np.ndarray) -> pa.Table:
        lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
        s = np.stack([table[f"s{a}"].to_numpy() for a in "xyz"], axis=1).astype(np.int64)
        names, place = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        at, own = np.unique(np.concatenate([code, code]) * len(names) + place, return_inverse=True)
        u, v = own[: len(code)], own[len(code) :]
        given = np.flatnonzero(u == v)
        contact = np.flatnonzero(u != v)
        part = _least_labels(np.arange(len(at)), u[contact], v[contact])
        root = np.full(len(at), len(at))
        np.minimum.at(root, part[u[given]], u[given])
        root = root[part]  # the smallest node that is given, of each component
        src, dst, step = np.concatenate([u[contact], v[contact]]), np.concatenate([v[contact], u[contact]]), np.concatenate([s[contact], -s[contact]])
        by = np.lexsort((*step.T[::-1], dst, src))
        src, dst, step = src[by], dst[by], step[by]
        start = np.searchsorted(src, np.arange(len(at) + 1))
        shift = np.zeros((len(at), 3), np.int64)
        done = root == np.arange(len(at))
        front = np.flatnonzero(done)
        while len(front):
            _, e = ragged(start[front], start[front + 1] - start[front])
            e = e[~done[dst[e]]]
            front, first = np.unique(dst[e], return_index=True)  # of the smallest source, as edges are sorted by it
            e = e[first]
            shift[front] = shift[src[e]] - step[e]
            done[front] = True
        node, picked = u[given], pa.array(given)
        columns = [*[table[k].take(picked) for k in keys], pa.array(lo[given]), pa.array(names[at[root[node]] % len(names)])]
        columns += [pa.array(shift[node, k].astype(np.int32)) for k in range(3)] + [table[c].take(picked) for c in carry]
        return pa.table(columns, names=[*keys, "node", "label", "nx", "ny", "nz", *carry])

    schema = ", ".join([f"`{k}` {kind[k]}" for k in keys] + ["node bigint", "label bigint", "nx int", "ny int", "nz int"] + [f"`{c}` {kind[c]}" for c in carry])
    return frames.by_frame(rows, keys, run, schema).withColumns({c: F.col(c).cast(kind["node"]) for c in ("node", "label")})


def _placed_in_rounds(steps: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    moved = potentials(steps.selectExpr(*keys, "lo", "hi", "sx AS nx", "sy AS ny", "sz AS nz"), nodes, keys, ["nx", "ny", "nz"])
    placed = materialise(moved.selectExpr(*keys, "node", "label", *[f"CAST(n{a} AS INT) AS n{a}" for a in "xyz"]), "placed")
    loops = materialise(_met(steps, placed, keys).where("NOT whole").select(*keys, "label").distinct(), "loops")
    if loops.isEmpty():
        return placed
    inside = materialise(placed.join(loops, [*keys, "label"]).select(*keys, "node", "label"), "looped")
    walked = _walked(steps.join(inside.select(*keys, F.col("node").alias("lo")), [*keys, "lo"], "left_semi"), inside, keys)
    return placed.join(loops, [*keys, "label"], "left_anti").unionByName(walked.join(inside, [*keys, "node"]))


def _walked(steps: DataFrame, labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The shifts of components with loops, from a walk outward that ends when no contact leads to a new node.

    Each round writes only the nodes it has placed, and a round needs no more than the two before it: a step from a node leads
    to its own distance from the root, or one less or more.
    """
    both = materialise(
        steps.selectExpr(*keys, "lo AS a", "hi AS b", "sx", "sy", "sz").unionByName(steps.selectExpr(*keys, "hi AS a", "lo AS b", "-sx AS sx", "-sy AS sy", "-sz AS sz")),
        "steps",
    )
    frontier = materialise(labelled.where("node = label").selectExpr(*keys, "node", "0 AS nx", "0 AS ny", "0 AS nz"), "frontier")
    rounds, recent = [frontier], frontier
    while True:
        reach = both.join(frontier.withColumnRenamed("node", "a"), [*keys, "a"]).join(recent.select(*keys, F.col("node").alias("b")), [*keys, "b"], "left_anti")
        nearest = reach.groupBy(*keys, F.col("b").alias("node")).agg(F.min(F.struct("a", "nx", "ny", "nz", "sx", "sy", "sz")).alias("_m"))
        new = materialise(nearest.selectExpr(*keys, "node", *[f"_m.n{a} - _m.s{a} AS n{a}" for a in "xyz"]), "frontier")
        if new.isEmpty():
            discard(both)
            return functools.reduce(DataFrame.unionByName, rounds)
        rounds.append(new)
        frontier, recent = new, frontier.unionByName(new)


def _met(steps: DataFrame, placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contacts with ``whole``: whether the placed chains lie as the contact says; columns of ``placed`` at lo are kept."""
    other = [c for c in placed.columns if c not in (*keys, "node", "nx", "ny", "nz")]
    at = lambda end, more: placed.select(*keys, F.col("node").alias(end), *[F.col(f"n{a}").alias(f"_{a}_{end}") for a in "xyz"], *more)
    joined = steps.join(at("lo", other), [*keys, "lo"]).join(at("hi", []), [*keys, "hi"])
    return joined.withColumn("whole", F.expr(" AND ".join(f"_{a}_hi + s{a} = _{a}_lo" for a in "xyz")))


def broken_contacts(steps: DataFrame, placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contacts per frame that still cross the boundary after placement (closed loops through the box)."""
    keys = list(keys)
    return _met(steps, placed, keys).groupBy(*keys).agg(F.count_if(~F.col("whole")).alias("broken"), F.count("*").alias("contacts"))


def shift_to_reference(centres: DataFrame, reference: DataFrame, keys: Sequence[str], box: float) -> DataFrame:
    """Move whole components to the image nearest the reference point of their frame (half-open box)."""
    b = f"{float(box)!r}D"
    joined = centres.join(reference.select(*keys, *[F.col(a).alias(f"_r{a}") for a in "xyz"]), list(keys))
    return joined.selectExpr(*[c for c in centres.columns if c not in "xyz"], *[f"_r{a} + ({a} - _r{a}) - {b} * floor(({a} - _r{a}) / {b} + 0.5D) AS {a}" for a in "xyz"])


def placed_centres(centres: DataFrame, placed: DataFrame, keys: Sequence[str], box: float) -> DataFrame:
    """Centres of chains (keys, node, x, y, z) moved by their whole-box shifts."""
    return centres.join(placed, [*keys, "node"]).selectExpr(*keys, "node", *[f"{a} + {float(box)!r}D * n{a} AS {a}" for a in "xyz"])


def component_shifts(centres: DataFrame, labelled: DataFrame | None, keys: Sequence[str], box: float) -> DataFrame:
    """Whole-box shift of every component to the image nearest the centre of its frame's largest one: keys, label, nodes and
    ``bx, by, bz``. ``centres`` are placed, and have labels if ``labelled`` isn't given; a component's centre is the mean of its chains'. Ties go to the smaller label.
    """
    keys = list(keys)
    parts = (centres if labelled is None else centres.join(labelled.select(*keys, "node", "label"), [*keys, "node"])).groupBy(*keys, "label")
    parts = materialise(parts.agg(F.count("*").alias("nodes"), *[F.avg(a).alias(a) for a in "xyz"]), "components")
    largest = parts.groupBy(*keys).agg(F.max(F.struct("nodes", (-F.col("label")).alias("_n"), "x", "y", "z")).alias("_m")).select(*keys, "_m.x", "_m.y", "_m.z")
    moved = shift_to_reference(parts, largest, keys, box).withColumnsRenamed({a: f"_{a}" for a in "xyz"})
    joined = moved.join(parts.select(*keys, "label", "x", "y", "z"), [*keys, "label"])
    return joined.selectExpr(*keys, "label", "nodes", *[f"CAST(rint((_{a} - {a}) / {float(box)!r}D) AS INT) AS b{a}" for a in "xyz"])
