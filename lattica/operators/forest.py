"""Spanning forests by contraction, and what follows from one: components of nested graphs, and values carried along trees.

Graphs are nested when each one adds edges to the one before: larger cutoffs, or masks that keep more bonds. An edge has the
``level`` of the first graph that holds it. Levels are worked off in rising order (as a minimum spanning tree takes its
edges), each on the graph that the levels below have contracted, so an edge is looked at in one level only.

A round lets every node hook to the neighbour of least rank if that ranks before itself. Ranks are hashes, so hooks are
short whatever the ids' order, and a round leaves at most half of the nodes that still have edges. Components without
further edges take no part any more.

That is for frames with more than ``frames.LARGE`` edges. The edges of others come together in a task, which needs one exchange
instead of several a round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import frames
from lattica.session import discard, materialise

JUMPS = 3  # steps of hooks that a round follows beyond the first


def _rank(node: str) -> Column:
    return F.struct(F.xxhash64(node), F.col(node))


def _moved(df: DataFrame, maps: DataFrame, keys: Sequence[str], column: str, values: Sequence[str] = (), sign: int = 1) -> DataFrame:
    """``column`` replaced by where the map leads, if anywhere; the map's values are then added to the row's, or taken from them."""
    lead = maps.select(*keys, F.col("node").alias(column), F.col("to").alias("_to"), *[F.col(v).alias(f"_{v}") for v in values])
    change = {v: F.col(v) + sign * F.coalesce(f"_{v}", F.lit(0)) for v in values}
    return df.join(lead, [*keys, column], "left").withColumns({column: F.coalesce("_to", column), **change}).drop("_to", *[f"_{v}" for v in values])


def _contract(edges: DataFrame, keys: Sequence[str], values: Sequence[str] = ()) -> list[DataFrame]:
    """Maps (node, to) of the rounds that contract the edges (u, v, lo, hi) until none is left; lo and hi are the edge that a
    node hooked along.

    ``values`` are differences along edges: of v from u, taken from u's. A map's values are what a node has more than the one
    that it goes to.
    """
    maps: list[DataFrame] = []
    current = edges
    kept = ["lo", "hi", *values]
    while not current.isEmpty():
        turned = current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"), "lo", "hi", *[(-F.col(v)).alias(v) for v in values])
        both = current.select(*keys, "u", "v", *kept).unionByName(turned)
        least = both.groupBy(*keys, "u").agg(F.min(F.struct(_rank("v").alias("rank"), "v", *kept)).alias("m"))
        hooks = least.where(F.col("m.rank") < _rank("u")).select(*keys, F.col("u").alias("node"), F.col("m.v").alias("to"), *[f"m.{c}" for c in kept])
        jumped = hooks
        for _ in range(JUMPS):
            jumped = _moved(jumped, hooks, keys, "to", values)
        jumped = materialise(jumped, "hooks")
        after = _moved(_moved(current, jumped, keys, "u", values, -1), jumped, keys, "v", values).where("u <> v")
        after = after.withColumns({v: F.when(F.col("u") > F.col("v"), -F.col(v)).otherwise(F.col(v)) for v in values}) if values else after
        after = after.groupBy(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct(*kept)).alias("e"))
        after = materialise(after.select(*keys, "u", "v", *[f"e.{c}" for c in kept]), "contracted")
        discard(current)
        current = after
        maps.append(jumped)
    discard(current)
    return maps


def _levelled(edges: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    ends = edges.where(F.col("lo") != F.col("hi")).groupBy(*keys, F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    return materialise(ends.agg(F.min("level").alias("level")).where(F.col("level") < levels), "levels")


def _roots(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], levels: int) -> tuple[list[DataFrame], list[DataFrame], list[int]]:
    """For every level, the root of every node (node, root); the rounds' maps with the trees' edges, and their levels."""
    own = _levelled(edges, keys, levels)
    total = materialise(nodes.select(*keys, "node", F.col("node").alias("root")), "roots")
    out, trees, own_level = [], [], []
    for level in range(levels):
        at = own.where(F.col("level") == level).withColumn("u", F.col("lo")).withColumn("v", F.col("hi"))
        if level:
            lead = total.select(*keys, "node", F.col("root").alias("to"))
            at = _moved(_moved(at, lead, keys, "u"), lead, keys, "v").where("u <> v")
            at = materialise(at.select(*keys, "u", "v", "lo", "hi"), "contracted")
        maps = _contract(at, keys)
        after = total
        for m in maps:
            after = _moved(after, m, keys, "root")
        total = materialise(after, "roots") if maps else total
        out.append(total)
        trees += maps
        own_level += [level] * len(maps)
    discard(own)
    return out, trees, own_level


def _least_labels(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the edges a-b joined what they connect: the least place of each component. ``parent`` are labels before. A round
    hooks roots to smaller ones and points every place to its root, so roots with edges at least halve."""
    while True:
        u, v = parent[a], parent[b]
        apart = u != v
        if not apart.any():
            return parent
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _star_labels(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for a single graph, by alternating large-star and small-star steps until nothing moves."""
    n = len(parent)
    edges = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    while True:
        lo, hi = np.divmod(edges, n)
        least = np.arange(n)
        np.minimum.at(least, hi, lo)
        lo, hi = np.divmod(np.unique(least[lo] * n + hi), n)
        least = np.arange(n)
        np.minimum.at(least, hi, lo)
        below = lo[lo != least[hi]], least[hi][lo != least[hi]]
        moved = np.unique(np.concatenate([below[1] * n + below[0], least[hi] * n + hi]))
        if np.array_equal(moved, edges):
            labels = parent.copy()
            labels[edges % n] = edges // n
            return labels
        edges = moved


def _frame_components(edges: DataFrame, keys: Sequence[str], levels: int, join=_least_labels) -> DataFrame:
    """(keys, node, labels): for every node with edges its label in each of the nested graphs, found in tasks."""

    def run(table: pa.Table, code: np.ndarray) -> pa.Table:
        ends = np.concatenate([table["lo"].to_numpy(), table["hi"].to_numpy()]).astype("int64")
        level = table["level"].to_numpy()
        names, place = np.unique(ends, return_inverse=True)
        at, own = np.unique(np.concatenate([code, code]) * len(names) + place, return_inverse=True)
        node = names[at % len(names)]
        labels, a, b = np.arange(len(at)), own[: len(code)], own[len(code) :]
        columns = []
        for k in range(levels):
            labels = join(labels, a[level == k], b[level == k])
            columns.append(node[labels])
        flat = pa.array(np.stack(columns, axis=1).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype="int32") * levels), flat)
        first = np.searchsorted(code, at // len(names))
        return pa.table([*[table[k].take(first) for k in keys], pa.array(node), lists], names=[*keys, "node", "labels"])

    kind = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in keys] + ["node bigint", "labels array<bigint>"])
    return frames.by_frame(edges, keys, run, schema)


def nested_components(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], levels: int = 1) -> DataFrame:
    """``nodes`` once for each of the nested graphs 0 to ``levels`` - 1, with ``level`` and ``label``, the smallest node id of the
    component in that graph. ``edges``: keys, lo, hi, level; an edge belongs to the graphs from its level up. Nodes are numbers
    (other types are contracted whatever the frame's size)."""
    keys = list(keys)
    if nodes.schema["node"].dataType.simpleString() not in ("int", "bigint"):
        return _contracted_components(edges, nodes, keys, levels)
    own = _levelled(edges, keys, levels)
    large = frames.large_frames(own.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    small = own if large is None else own.join(large, keys, "left_anti")
    few = nodes if large is None else nodes.join(large, keys, "left_anti")
    kind = nodes.schema["node"].dataType
    found = _frame_components(small, keys, levels).withColumn("node", F.col("node").cast(kind))
    alone = F.array_repeat(F.col("node").cast("long"), levels)
    out = few.join(found, [*keys, "node"], "left").select(*nodes.columns, F.posexplode(F.coalesce("labels", alone)).alias("level", "label")).withColumn("label", F.col("label").cast(kind))
    if large is None:
        return out
    many = _contracted_components(own.join(large, keys, "left_semi"), nodes.join(large, keys, "left_semi"), keys, levels)
    return out.unionByName(many)


def _contracted_components(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    roots, trees, _ = _roots(edges, nodes, keys, levels)
    discard(*trees)
    labels = roots[0].withColumn("level", F.lit(0))
    for level, r in enumerate(roots[1:], 1):
        labels = labels.unionByName(r.withColumn("level", F.lit(level)))
    least = labels.groupBy(*keys, "level", "root").agg(F.min("node").alias("label"))
    named = labels.join(least, [*keys, "level", "root"]).drop("root")
    return nodes.join(named, [*keys, "node"])


def spanning_forest(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], levels: int = 1) -> DataFrame:
    """A spanning forest with the smallest levels: keys, lo, hi, level. The first n levels' edges span graph n's components."""
    keys = list(keys)
    out = None
    _, trees, own_level = _roots(edges, nodes, keys, levels)
    for tree, level in zip(trees, own_level):
        tree = tree.select(*keys, "lo", "hi", F.lit(level).alias("level"))
        out = tree if out is None else out.unionByName(tree)
    return edges.select(*keys, "lo", "hi", "level").limit(0) if out is None else out


def potentials(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Differences along edges summed up along a spanning forest: keys, node, label and the ``values`` of every node.

    An edge (keys, lo, hi, values) says that hi has that much less than lo. Every component's smallest node has 0. Offsets are
    composed while the components are contracted, so the rounds grow with the logarithm of a chain's length. Where
    edges contradict each other around a loop, those outside the forest are not met.
    """
    keys = list(keys)
    own = edges.where(F.col("lo") != F.col("hi")).select(*keys, F.col("lo").alias("u"), F.col("hi").alias("v"), "lo", "hi", *values)
    maps = _contract(materialise(own, "contracted"), keys, values)
    at = nodes.select(*keys, "node", F.col("node").alias("root"), *[F.lit(0).cast("long").alias(v) for v in values])
    for m in maps:
        at = _moved(at, m, keys, "root", values)
    at = materialise(at, "offsets")
    discard(*maps)
    zero = at.groupBy(*keys, "root").agg(F.min(F.struct("node", *values)).alias("_z"))
    return at.join(zero, [*keys, "root"]).select(*keys, "node", F.col("_z.node").alias("label"), *[(F.col(v) - F.col(f"_z.{v}")).alias(v) for v in values])
