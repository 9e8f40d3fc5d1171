"""Operators against hand-computed answers and brute force."""

import itertools
import json
import struct

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.operators import contrasts, forest, frames, graph, placement, polymer, pyramid, quality, quantiles, selection, sequences, spatial, topology
from lattica.sources import tables as sources
from lattica.sources.trajectory import TrajectoryDataSource
from lattica.plans import queries_sequences, roles
from lattica.plans.registry import Tables
from lattica.session import discard
from lattica.streaming import incremental, monitor

L = 10.0


def cloud(n=150, frames=2, seed=3, box=L):
    rng = np.random.default_rng(seed)
    return [(f, i, *map(float, rng.uniform(-box, 2 * box, 3))) for f in range(frames) for i in range(n)]


def points(spark, rows):
    return spark.createDataFrame(rows, "frame int, bead int, x double, y double, z double")


def brute(rows, radius, box):
    out = {}
    for a, b in itertools.combinations(rows, 2):
        if a[0] != b[0]:
            continue
        d = np.array(a[2:]) - np.array(b[2:])
        if box:
            d -= box * np.round(d / box)
        r = float(np.sqrt((d * d).sum()))
        if r <= radius:
            out[(a[0], min(a[1], b[1]), max(a[1], b[1]))] = r
    return out


@pytest.mark.parametrize("radius", [1.4, 2.9, 4.0, 6.0])
def test_radius_pairs_match_brute_force(spark, radius):
    """Boxes of many blocks down to a single one: every pair once, none missing."""
    rows = cloud(90)
    got = [(r.frame, r.i, r.j, r.d) for r in spatial.radius_pairs(points(spark, rows), ["frame"], L, radius).collect()]
    want = brute(rows, radius, L)
    assert len(got) == len(want)
    assert {g[:3] for g in got} == set(want)
    assert all(abs(g[3] - want[g[:3]]) < 1e-9 for g in got)


def test_radius_pairs_box_column_and_hot_block(spark):
    """The box may differ per row, and nearly all particles may share one block."""
    rows = [(0, i, 0.01 * i, 0.0, 9.99) for i in range(60)] + [(1, 0, 5.0, 5.0, 5.0), (1, 1, 5.5, 5.0, 5.0)]
    df = points(spark, rows).withColumn("box", F.when(F.col("frame") == 0, 10.0).otherwise(8.0))
    assert spatial.radius_pairs(df, ["frame"], "box", 1.0).count() == 60 * 59 // 2 + 1


def test_open_pairs_match_brute_force(spark):
    rows = cloud(120)
    got = {(r.frame, r.i, r.j) for r in spatial.radius_pairs_open(points(spark, rows), ["frame"], 4.0).collect()}
    assert got == set(brute(rows, 4.0, None))


def test_nearest_target_matches_brute_force(spark):
    rows = cloud(120, frames=2, seed=5)
    q, t = [r for r in rows if r[1] >= 7], [r for r in rows if r[1] < 7 and r[0] == 0 or r[1] == 0]
    got = {(r.frame, r.bead): r.distance for r in spatial.nearest_target_distance(points(spark, q), points(spark, t), ["frame"], L).collect()}
    assert len(got) == len(q)
    for f, b, *xyz in q:
        d = np.array([x[2:] for x in t if x[0] == f]) - np.array(xyz)
        d -= L * np.round(d / L)
        assert abs(got[(f, b)] - np.sqrt((d * d).sum(1)).min()) < 1e-9


def test_nearest_distance_over_several_radii(spark):
    """Dense targets in a corner and empty space elsewhere: far queries need wider searches; a frame without targets drops out."""
    rng = np.random.default_rng(9)
    targets = [(0, i, *map(float, rng.uniform(0, 2, 3))) for i in range(1500)] + [(1, 0, 5.0, 5.0, 5.0)]
    near = [(0, 10_000 + i, *map(float, rng.uniform(0, 2, 3))) for i in range(40)]
    far = [(f, 20_000 + i, *map(float, rng.uniform(0, L, 3))) for f in range(3) for i in range(40)]
    found = spatial.nearest_target_distance(points(spark, near + far), points(spark, targets), ["frame"], L)
    assert "_qc" not in found.columns
    got = {(r.frame, r.bead): r.distance for r in found.collect()}
    assert set(got) == {(f, b) for f, b, *_ in near + far if f < 2}
    for f, b, *xyz in near + far:
        if f < 2:
            d = np.array([x[2:] for x in targets if x[0] == f]) - np.array(xyz)
            d -= L * np.round(d / L)
            assert abs(got[(f, b)] - np.sqrt((d * d).sum(1)).min()) < 1e-9
    assert spatial.nearest_target_distance(points(spark, near), points(spark, []), ["frame"], L).count() == 0


def test_clumped_targets_through_the_pyramid(spark):
    """10,000 targets in a corner, one frame of even targets and repeated positions: exact, and few targets met per query."""
    rng = np.random.default_rng(12)
    targets = [(0, i, *map(float, rng.uniform(0, L / 10, 3))) for i in range(10_000)] + [(1, i, *map(float, rng.uniform(0, L, 3))) for i in range(60)]
    targets += [(2, i, 1.0, 2.0, 3.0) for i in range(500)] + [(2, 500 + i, 1.0, 2.0, 3.0 + i / 1000) for i in range(40)]
    asked = [(f, i, *map(float, rng.uniform(0, L, 3))) for f in range(4) for i in range(60)] + [(0, 100 + i, *map(float, rng.uniform(0, L / 10, 3))) for i in range(60)]
    got = {(r.frame, r.bead): r.distance for r in spatial.nearest_target_distance(points(spark, asked), points(spark, targets), ["frame"], L).collect()}
    assert set(got) == {(f, b) for f, b, *_ in asked if f < 3}
    for f, b, *xyz in asked:
        if f < 3:
            d = np.array([x[2:] for x in targets if x[0] == f]) - np.array(xyz)
            d -= L * np.round(d / L)
            assert got[(f, b)] == pytest.approx(np.sqrt((d * d).sum(1)).min(), abs=1e-9)
    placed = lambda rows: points(spark, rows).selectExpr("frame", "bead", "x AS _x", "y AS _y", "z AS _z", f"{L}D AS _box")
    tree, _ = pyramid.build(placed(targets), ["frame"])
    met = pyramid.descend(placed(asked), tree, ["frame"], "bead", []).groupBy("frame", "bead").agg(F.sum("n").alias("n"))
    assert met.agg(F.max("n")).first()[0] < 100


def union_find(n, edges):
    label = list(range(n))
    for a, b in edges:
        lo, hi = sorted((label[a], label[b]))
        label = [lo if v == hi else v for v in label]
    return label


@pytest.mark.parametrize("method", ["fold", "star", "contract"])
def test_components_match_union_find(spark, method):
    rng = np.random.default_rng(1)
    n, edges = 70, {f: {tuple(sorted(map(int, rng.choice(70, 2, replace=False)))) for _ in range(k)} for f, k in ((0, 40), (1, 90), (2, 1))}
    edges[3] = {(i, i + 1) for i in range(69)}  # a path: the longest chain of labels
    e = spark.createDataFrame([(f, *p) for f, es in edges.items() for p in es], "frame int, lo int, hi int")
    v = spark.createDataFrame([(f, i) for f in edges for i in range(n)], "frame int, node int")
    got = graph.connected_components(e, v, ["frame"], method=method)
    for f, es in edges.items():
        rows = sorted((r.node, r.label) for r in got.where(F.col("frame") == f).collect())
        assert [r[1] for r in rows] == union_find(n, es)


def bridge(spark):
    nodes = spark.createDataFrame([(0, 0, "MED1", 1, 0), (0, 1, "OCT4", 1, 1), (0, 2, "MED1", 1, 2), (0, 3, "DNA", 1, -1)], "frame int, node int, species string, length int, parent int")
    return spark.createDataFrame([(0, 0, 1), (0, 1, 3), (0, 2, 3)], "frame int, lo int, hi int"), nodes


def test_anchor_does_not_bridge_proteins(spark):
    edges, nodes = bridge(spark)
    got = {r.node: r.label for r in graph.species_components(edges, nodes, ["frame"]).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    augmented = graph.augmented_metrics(graph.connected_components(edges, nodes, ["frame"]), ["frame"]).first()
    assert augmented.augmented_largest_protein_fraction == 1.0
    assert {r.node: r.hop for r in graph.hop_classes(edges, nodes, ["frame"]).collect()} == {0: "second", 1: "direct", 2: "direct"}
    assert [r.node for r in graph.indirect_associates(edges, nodes, ["frame"]).collect()] == [0]


def test_long_path_is_one_component(spark):
    n = 5000
    order = np.random.default_rng(3).permutation(n)
    edges = spark.createDataFrame([(0, *sorted((int(a), int(b)))) for a, b in zip(order, order[1:])], "frame int, lo int, hi int")
    nodes = spark.createDataFrame([(0, i) for i in range(n)], "frame int, node int")
    labels = graph.connected_components(edges, nodes, ["frame"]).groupBy("label").count().collect()
    assert [(r.label, r["count"]) for r in labels] == [(0, n)]


def test_nested_components_and_forest(spark):
    rng = np.random.default_rng(8)
    n, levels = 60, 3
    edges = {(f, *sorted(map(int, rng.choice(n, 2, replace=False)))): int(rng.integers(levels)) for f in (0, 1) for _ in range(60)}
    e = spark.createDataFrame([(*k, v) for k, v in edges.items()], "frame int, lo int, hi int, level int")
    v = spark.createDataFrame([(f, i, "x") for f in (0, 1, 2) for i in range(n)], "frame int, node int, kind string")
    got = {(r.frame, r.level, r.node): r.label for r in forest.nested_components(e, v, ["frame"], levels).collect()}
    tree = [tuple(r) for r in forest.spanning_forest(e, v, ["frame"], levels).collect()]
    assert len(set(tree)) == len(tree) and all(edges[t[:3]] == t[3] for t in tree)
    for f in (0, 1, 2):
        for level in range(levels):
            want = union_find(n, [k[1:] for k, at in edges.items() if k[0] == f and at <= level])
            assert [got[f, level, i] for i in range(n)] == want
            assert union_find(n, [t[1:3] for t in tree if t[0] == f and t[3] <= level]) == want
            assert sum(t[0] == f and t[3] <= level for t in tree) == n - len(set(want))
    assert forest.spanning_forest(e.limit(0), v, ["frame"], levels).count() == 0


@pytest.mark.parametrize("count", [5, 100])
def test_binding_categories_count_all_pairs(spark, count):
    rng = np.random.default_rng(2)
    n = 14
    windows = {i: set(map(int, rng.choice(count, rng.integers(0, 4), replace=False))) for i in range(n)}
    edges = {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(30)}
    want = {}
    for a, b in itertools.combinations(range(n), 2):
        wa, wb = windows[a], windows[b]
        c = "neither_bound" if not wa and not wb else "only_one_bound" if not wa or not wb else "shared_window" if wa & wb else "both_bound_different_windows"
        e, o = want.get(c, (0, 0))
        want[c] = (e + ((a, b) in edges), o + 1)
    v = spark.createDataFrame([(0, i) for i in range(n)], "frame int, node int")
    e = spark.createDataFrame([(0, *p) for p in edges], "frame int, lo int, hi int")
    c = spark.createDataFrame([(0, i, w) for i, ws in windows.items() for w in ws], "frame int, node int, window int")
    got = {r.binding_category: (r.edges, int(r.opportunities)) for r in graph.binding_categories(e, v, c, ["frame"]).collect()}
    assert got == {k: want.get(k, (0, 0)) for k in got} and len(got) == 4


def test_shape_is_invariant_under_periodic_translation(spark):
    box = 75.0
    z = np.arange(200) * 0.34
    first = np.stack([np.zeros(200), np.zeros(200), z], 1)
    second = np.stack([np.full(200, 1.0), np.zeros(200), z[::-1]], 1)
    whole = np.vstack([first, second])
    moved = np.mod(whole + np.array([74.2, 30.0, 50.0]), box)
    rows = [(k, i, *map(float, p)) for k, c in enumerate((whole, moved)) for i, p in enumerate(c)]
    df = spark.createDataFrame(rows, "frame int, pos int, x double, y double, z double").withColumn("half", F.lit(200)).withColumn("n", F.lit(400))
    shape = polymer.chain_shape(polymer.unwrap_two_strands(df, ["frame"], "pos", "half", box, chunk=64), ["frame"], "pos", "n")
    a, b = sorted(shape.collect())
    centred = whole - whole.mean(0)
    ev = np.linalg.eigvalsh(centred.T @ centred / 400)
    assert abs(a.Rg_nm - np.sqrt(ev.sum())) < 1e-9
    want = ((ev[0] - ev[1]) ** 2 + (ev[1] - ev[2]) ** 2 + (ev[2] - ev[0]) ** 2) / (2 * ev.sum() ** 2)
    assert abs(a.asphericity - want) < 1e-9
    assert all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))


def test_split_removes_only_the_cut_covalent_edge(spark):
    cols = "frame int, parent int, block_index int, node int, molecule int"
    full = spark.createDataFrame([(0, 0, b, b, 0) for b in range(4)], cols)
    cut = spark.createDataFrame([(0, 0, b, b, b // 2) for b in range(4)], cols)
    assert sorted((r.lo, r.hi) for r in graph.covalent_edges(full, ["frame"]).collect()) == [(0, 1), (1, 2), (2, 3)]
    assert sorted((r.lo, r.hi) for r in graph.covalent_edges(cut, ["frame"]).collect()) == [(0, 1), (2, 3)]
    masks = graph.mask_edges(cut, ["frame"], {"Full": [0, 1, 2], "Split-2": [0, 2], "Split-4": []})
    assert {r["mask"]: r["count"] for r in masks.groupBy("mask").count().collect()} == {"Full": 3, "Split-2": 2}


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_quantiles_with_outliers(spark, rounds):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=300).round(2), [1e9, -1e9]])
    w = rng.integers(1, 5, len(v)).astype(float)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(v, w)], "k string, v double, w double")
    order = np.argsort(v, kind="stable")
    cum = np.cumsum(w[order])
    want = v[order][np.searchsorted(cum, 0.9 * cum[-1])]
    assert quantiles.weighted_step_quantile(df, ["k"], "v", "w", 0.9, rounds=rounds, buckets=16).first().quantile == want
    for q in (0.0, 0.5, 0.9, 1.0):
        got = quantiles.linear_quantile(df, ["k"], "v", q, rounds=rounds, buckets=16).first().quantile
        assert got == pytest.approx(np.quantile(v, q), rel=1e-9)


def test_last_bucket_is_small_under_heavy_tails(spark, monkeypatch):
    """Values over 600 orders of magnitude: after one round the sorted bucket holds a small share of the group."""
    df = spark.range(20_000).selectExpr("'k' AS k", "pow(10D, (id % 20000) * 0.03D - 300) AS v")
    held = []
    inside = quantiles._inside

    def counted(pre, target, keys):
        out = inside(pre, target, keys)
        held.append(out)
        return out

    monkeypatch.setattr(quantiles, "_inside", counted)
    got = quantiles.linear_quantile(df, ["k"], "v", 0.5, buckets=64).first().quantile
    assert got == pytest.approx(np.quantile(10.0 ** (np.arange(20_000) * 0.03 - 300), 0.5), rel=1e-9)
    assert held[-1].groupBy("tag").count().agg(F.max("count")).first()[0] <= 20_000 / 64 * 2


def test_step_quantile_on_a_boundary(spark):
    """Weights 1/k that add up to the goal exactly, in whatever order they are added."""
    rows = [("k", float(i), 1.0 / 7) for i in range(70)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    for q in (0.1, 0.3, 0.5, 0.9):
        for buckets in (4, 16, 64):
            assert quantiles.weighted_step_quantile(df.repartition(5), ["k"], "v", "w", q, buckets=buckets).first().quantile == round(70 * q) - 1


def test_chunked_sequences_equal_whole_ones(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=57)
    s = rng.integers(0, 2, 57)
    df = spark.createDataFrame([(1, i, float(a), int(b)) for i, (a, b) in enumerate(zip(v, s))], "k int, pos int, v double, s int")
    ones = np.ones(21)
    smooth = np.convolve(v, ones, "same") / np.convolve(np.ones(57), ones, "same")
    got = [r.smooth for r in sequences.moving_average(df, ["k"], "pos", "v", 10, chunk=11).orderBy("pos").collect()]
    assert np.allclose(got, smooth)
    total = [r.c for r in sequences.running_sum(df, ["k"], "pos", {"c": "v"}, chunk=7).orderBy("pos").collect()]
    assert np.allclose(total, np.cumsum(v))
    runs = [r.island for r in sequences.islands(df, ["k"], "pos", "s", chunk=5).orderBy("pos").collect()]
    assert runs == list(np.cumsum(np.r_[0, s[1:] != s[:-1]]))
    third = [r.n for r in sequences.shifted(df, ["k"], "pos", {"n": ("pos", 3)}, chunk=4).orderBy("pos").collect()]
    assert third == [*range(3, 57), None, None, None]


def test_sampling_grid(spark):
    frames = list(range(1001, 5001, 4))
    make = lambda fs: spark.createDataFrame([("a", "r", f) for f in fs], "system string, replicate string, frame int")
    ok = quality.sampling_report(make(frames[::-1]), ["system", "replicate"]).first()
    assert ok.passed
    assert not quality.sampling_report(make(frames[1:]), ["system", "replicate"]).first().passed
    assert not quality.sampling_report(make([*frames, frames[0]]), ["system", "replicate"]).first().passed
    quality.enforce(quality.exact_sampling(make(frames), ["system", "replicate"]))
    with pytest.raises(quality.QualityError):
        quality.enforce(quality.exact_sampling(make(frames[1:]), ["system", "replicate"]))


def test_frame_map(spark):
    frames = list(range(1001, 5001, 4))
    maps = spark.createDataFrame([("a", "r", "tag", 5000, frames)], "system string, replicate string, schema string, source_frame_count int, source_frames_one_based array<int>")
    got = {r.frame: r.stored_index for r in sources.stored_indices(maps, [1001, 4997, 1002]).collect()}
    assert sources.stored_indices(maps, range(1001, 5001, 4)).where("stored_index IS NULL").count() == 0
    assert got == {1001: 0, 4997: 999, 1002: None}
    stored = spark.createDataFrame([("a", "r", 1000)], "system string, replicate string, stored_frames int")
    assert quality.frame_map_problems(maps, "tag", stored, ["system", "replicate"]).count() == 0
    twice = maps.withColumn("source_frames_one_based", F.array(F.lit(1001), F.lit(1001)))
    assert quality.frame_map_problems(twice, "tag", stored, ["system", "replicate"]).first().problems == ["order", "length"]


def test_one_to_one_and_purpose_guards(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    b = spark.createDataFrame([(1, 5)], "k int, w int")
    with pytest.raises(Exception, match="repeated key"):
        quality.one_to_one(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="cannot be analysed"):
        quality.refuse_purpose(spark.createDataFrame([("snapshots",)], "purpose string"), "snapshots").collect()


def test_decomposition_is_additive(spark):
    cells = {("Full", "Full"): 0.9, ("Full", "Split-2"): 0.7, ("Split-2", "Split-2"): 0.4, ("Full", "Split-4"): 0.5, ("Split-4", "Split-4"): 0.1}
    df = spark.createDataFrame([("r", e, m, v) for (e, m), v in cells.items()], "replicate string, e string, m string, v double")
    rows = {r.contrast: r for r in contrasts.mask_decomposition(df, ["replicate"], "e", "m", "v").collect()}
    assert rows["Full-Split-2"].total_diagonal_effect == pytest.approx(0.5)
    assert rows["Full-Split-2"].direct_mask_effect == pytest.approx(0.2)
    assert all(abs(r.additivity_error) < 1e-12 for r in rows.values())


def test_representative_ties(spark):
    df = spark.createDataFrame([("a", "r", f, 1.0, 3.0) for f in (5, 3, 4)], "system string, replicate string, frame int, m double, time_us double")
    assert selection.representative(df, ["system"], ["m"]).first().frame == 3


def test_placement_makes_contacts_contiguous(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(5)], "frame int, node int")
    steps = spark.createDataFrame([(0, 0, 1, 1, 0, 0), (0, 1, 2, 0, -1, 0), (0, 2, 3, 0, 0, 0)], "frame int, lo int, hi int, sx int, sy int, sz int")
    labelled = graph.connected_components(steps.select("frame", "lo", "hi"), nodes, ["frame"])
    placed = placement.place_components(steps, labelled, ["frame"])
    assert {r.node: (r.nx, r.ny, r.nz) for r in placed.collect()} == {0: (0, 0, 0), 1: (-1, 0, 0), 2: (-1, 1, 0), 3: (-1, 1, 0), 4: (0, 0, 0)}
    assert placement.broken_contacts(steps, placed, ["frame"]).first().broken == 0


def test_long_chain_is_placed_in_few_rounds(spark, monkeypatch):
    n, rng = 2000, np.random.default_rng(2)
    step = rng.integers(-1, 2, (n - 1, 3))
    steps = spark.createDataFrame([(0, i, i + 1, *map(int, step[i])) for i in range(n - 1)], "frame int, lo int, hi int, sx int, sy int, sz int")
    nodes = spark.createDataFrame([(0, i, 0) for i in range(n)], "frame int, node int, label int")
    rounds = []
    plain = forest.materialise
    monkeypatch.setattr(forest, "materialise", lambda df, name: (rounds.append(name), plain(df, name))[1])
    got = {r.node: (r.nx, r.ny, r.nz) for r in placement.place_components(steps, nodes, ["frame"]).collect()}
    assert got == {i: tuple(-step[:i].sum(axis=0)) for i in range(n)}
    assert rounds.count("hooks") <= 15


def test_closed_loop_is_walked_from_its_root(spark):
    steps = spark.createDataFrame([(0, 0, 1, 0, 0, 0), (0, 1, 2, 0, 0, 0), (0, 2, 3, 0, 0, 0), (0, 0, 3, 1, 0, 0), (0, 5, 6, 1, 1, 0)], "frame int, lo int, hi int, sx int, sy int, sz int")
    nodes = spark.createDataFrame([(0, i) for i in range(7)], "frame int, node int")
    labelled = graph.connected_components(steps.select("frame", "lo", "hi"), nodes, ["frame"])
    placed = placement.place_components(steps, labelled, ["frame"])
    want = {i: (0, 0, 0) for i in range(7)} | {3: (-1, 0, 0), 6: (-1, -1, 0)}
    assert {r.node: (r.nx, r.ny, r.nz) for r in placed.collect()} == want
    assert placement.broken_contacts(steps, placed, ["frame"]).first().broken == 1


def test_shadowed_contact_is_dropped(spark):
    pairs = spark.createDataFrame([(0, 1, 3, 1.0, True), (0, 1, 2, 0.5, False), (0, 2, 3, 0.5, False)], "f int, i int, j int, d double, candidate boolean")
    assert topology.shadow_contacts(pairs, ["f"], None, 0.1, 0.05).count() == 0
    wide = spark.createDataFrame([(0, 1, 3, 1.0, True), (0, 1, 2, 0.9, False), (0, 2, 3, 0.9, False)], "f int, i int, j int, d double, candidate boolean")
    assert topology.shadow_contacts(wide, ["f"], None, 0.1, 0.05).count() == 1


def test_complementary_pairs(spark):
    atoms = spark.createDataFrame([("t", 0, "A"), ("t", 1, "T"), ("t", 2, "C"), ("t", 3, "T")], "template string, atom int, name string")
    got = sorted((r.a1, r.a2) for r in topology.complementary_pairs(atoms, {"A": "T", "C": "G"}).collect())
    assert got == [(0, 1), (0, 3)]


def test_arrivals_in_several_batches_lose_nothing(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "system string, replicate string, frame int, v double"
    compute = lambda df: df.groupBy("system", "replicate").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    history = lambda: spark.read.schema(schema).parquet(folder)
    batches = ([("a", "r1", 1, 1.0), ("b", "r1", 1, 2.0)], [("a", "r1", 2, 4.0)], [("c", "r1", 1, 8.0), ("a", "r1", 3, 16.0)])
    for rows in batches:  # every run is a restart from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        incremental.refresh_arrivals(spark.readStream.schema(schema).parquet(folder), history, compute, out, state).awaitTermination()
        got = sorted((r.system, r.n, r.v) for r in spark.read.parquet(out).collect())
        assert got == sorted((r.system, r.n, r.v) for r in compute(history()).collect())
    assert sorted((r.epoch, r.system) for r in spark.read.parquet(f"{state}-ledger").collect()) == [(0, "a"), (0, "b"), (1, "a"), (2, "a"), (2, "c")]


def test_contacts_follow_changed_files(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    folder = str(tmp_path)
    source.where("l_suppkey < 3").write.parquet(f"{folder}/lineitem.parquet")
    few = roles.contacts(Tables(spark, folder))
    assert roles.contacts(Tables(spark, folder)) is few
    n = few.count()
    source.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    all_ = roles.contacts(Tables(spark, folder))
    assert all_.count() > n > 0
    discard(all_)
    assert roles.contacts(Tables(spark, folder)).count() > n


def test_incremental_refresh(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "system string, replicate string, size int")
    path = str(tmp_path / "results")
    compute = lambda todo: todo.select("system", "replicate").withColumn("metric", F.lit(1))
    first = incremental.signatures(make([("a", "r", 1), ("b", "r", 1)]), ["size"], "v1")
    empty = first.limit(0)
    assert incremental.refresh(first, empty, compute, path).count() == 2
    second = incremental.signatures(make([("a", "r", 1), ("b", "r", 2)]), ["size"], "v1")
    stored = spark.read.parquet(path)
    with pytest.raises(incremental.StaleResults):
        incremental.require_fresh(second, stored)
    assert [r.system for r in incremental.refresh(second, stored, compute, path).collect()] == ["b"]
    incremental.require_fresh(second, spark.read.parquet(path))


def test_health_alerts(spark):
    rows = [("t", 1, 1.0, 1.0, 300.0), ("t", 2, float("nan"), 1.0, 300.0), ("t", 3, 1.0, float("inf"), 300.0), ("t", 4, 1.0, 1.0, 900.0)]
    df = spark.createDataFrame(rows, "task_id string, step long, potential_kj_mol double, kinetic_kj_mol double, temperature_k double")
    assert sorted(r.step for r in monitor.alerts(df, 400.0).collect()) == [2, 3, 4]


def write_dcd(path, frames):
    n = frames.shape[1]
    control = [len(frames)] + [0] * 19
    with open(path, "wb") as f:
        f.write(struct.pack("<i4s20ii", 84, b"CORD", *control, 84))
        f.write(struct.pack("<ii80si", 84, 1, b"x", 84))
        f.write(struct.pack("<iii", 4, n, 4))
        for frame in frames:
            for axis in range(3):
                f.write(struct.pack("<i", 4 * n) + frame[:, axis].astype("<f4").tobytes() + struct.pack("<i", 4 * n))


def test_trajectory_source(spark, tmp_path):
    folder = tmp_path / "work" / "sys"
    folder.mkdir(parents=True)
    frames = np.arange(7 * 4 * 3, dtype=float).reshape(7, 4, 3)
    write_dcd(folder / "output.dcd", frames)
    spark.dataSource.register(TrajectoryDataSource)
    df = spark.read.format("dcd").option("path", str(tmp_path)).option("frames", "2:7:2").option("frames_per_task", "3").load()
    rows = {(r.frame, r.bead): (r.x, r.y, r.z) for r in df.collect()}
    assert {f for f, _ in rows} == {2, 4, 6} and df.first().system == "sys" and df.first().replicate == "work"
    assert np.allclose(rows[(4, 1)], frames[3, 1] / 10)
    (folder / "trajectory_frames.json").write_text(json.dumps({"source_frames_one_based": [1, 5, 9, 13, 17, 21, 25]}))
    df = spark.read.format("dcd").option("path", str(tmp_path)).option("frames", "5:21:8").option("frames_per_task", "2").load()
    rows = {(r.frame, r.bead): (r.x, r.y, r.z) for r in df.collect()}
    assert {f for f, _ in rows} == {5, 13, 21} and np.allclose(rows[(13, 1)], frames[3, 1] / 10)
    (folder / "trajectory_frames.json").write_text(json.dumps({"source_frames_one_based": [1, 5]}))
    with pytest.raises(Exception, match="stored records"):
        spark.read.format("dcd").option("path", str(tmp_path)).load().collect()


def test_trajectory_filters(spark, tmp_path):
    """Conditions choose files and frames before they are read; a folder may be a URI; excluded files are not even opened."""
    for replicate in ("r1", "r2"):
        folder = tmp_path / replicate / "sys"
        folder.mkdir(parents=True)
        write_dcd(folder / "output.dcd", np.arange(40 * 4 * 3, dtype=float).reshape(40, 4, 3))
    (tmp_path / "r3" / "sys").mkdir(parents=True)
    (tmp_path / "r3" / "sys" / "output.dcd").write_bytes(b"broken")
    spark.dataSource.register(TrajectoryDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda root: spark.read.format("dcd").option("path", root).option("frames_per_task", "5").option("pushdown", "true").load()
        df = load(f"file://{tmp_path}").where("replicate = 'r2' AND frame > 10 AND frame <= 20")
        assert df.rdd.getNumPartitions() == 2
        rows = {(r.replicate, r.frame) for r in df.collect()}
        assert rows == {("r2", f) for f in range(11, 21)}
        some = load(str(tmp_path)).where("replicate IN ('r1', 'r2') AND frame IN (3, 39) AND bead = 2")
        assert some.count() == 4 and some.rdd.getNumPartitions() == 2
        assert load(str(tmp_path)).where("replicate = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_ranged_positions(spark, tmp_path):
    """One long sequence of one day spreads over all ranges; ties, null keys and repeated rows are numbered as well."""
    df = spark.range(200_000).selectExpr("if(id % 50 = 0, 7, 1) AS user", "CAST(xxhash64(id) AS BIGINT) AS at")
    out = sequences.ranged_position(df, ["user"], ["at"], parts=8)
    w = Window.partitionBy("user").orderBy("at")
    assert out.withColumn("plain", F.row_number().over(w) - 1).where("pos <> plain").count() == 0 and out.count() == 200_000
    rows = spark.createDataFrame([(None, 1), (None, 1), ("a", None), ("a", 2), ("a", 2)], "k string, at int")
    got = sorted((r.k or "", r.pos) for r in sequences.ranged_position(rows, ["k"], ["at"]).collect())
    assert got == [("", 0), ("", 1), ("a", 0), ("a", 1), ("a", 2)]
    laid = df.repartitionByRange(8, "user", "at").groupBy(F.spark_partition_id()).count()
    assert laid.agg(F.max("count")).first()[0] < 60_000


def test_region_index_against_brute_force(spark):
    rng = np.random.default_rng(4)
    regions = [("t", int(lo), int(lo + n)) for lo, n in zip(rng.integers(0, 500, 60), rng.integers(0, 40, 60))]
    pairs = [("t", *map(int, rng.integers(0, 560, 2))) for _ in range(400)] + [("u", 1, 2)]
    p, r = spark.createDataFrame(pairs + pairs[:5], "template string, a int, b int"), spark.createDataFrame(regions, "template string, lo int, hi int")
    holds = lambda x, y: any(lo <= x < hi and lo <= y < hi for _, lo, hi in regions)
    for between in (False, True):
        want = [x for x in pairs + pairs[:5] if x[0] == "t" and (holds(x[1], x[1]) and holds(x[2], x[2]) if between else holds(x[1], x[2]))]
        assert sorted(map(tuple, topology.within_region_table(p, r, ["template"], "a", "b", between).select("template", "a", "b").collect())) == sorted(want)


def test_region_index_meets_few(spark):
    """100,000 regions of one template: each lies in one bin, and no bin holds two of them."""
    r = spark.range(100_000).selectExpr("1 AS template", "id * 10 AS lo", "id * 10 + 7 AS hi")
    p = spark.range(20_000).selectExpr("1 AS template", "id * 50 AS a", "id * 50 + id % 9 AS b")
    assert topology.within_region_table(p, r, ["template"], "a", "b").where("a % 10 < 7").count() == p.where("b - a < 7").count()
    bins = r.selectExpr("if(lo = hi - 1, 0, length(bin(lo ^ (hi - 1)))) AS level", "lo").selectExpr("level", "shiftright(lo, level) AS bin")
    assert bins.distinct().count() == 100_000 and bins.select("level").distinct().count() <= 21


def test_banded_partners(spark):
    rng = np.random.default_rng(6)
    atoms = [(0, i, "ATCG"[rng.integers(4)], int(rng.integers(-20, 20))) for i in range(120)]
    df = spark.createDataFrame(atoms, "template int, atom int, name string, residue int")
    got = sorted((r.a1, r.a2) for r in topology.complementary_pairs(df, {"A": "T", "C": "G"}, band=("residue", 3)).collect())
    mates = {("A", "T"), ("C", "G")}
    assert got == sorted({(min(x[1], y[1]), max(x[1], y[1])) for x in atoms for y in atoms if (x[2], y[2]) in mates and abs(x[3] - y[3]) <= 3})


def test_file_sources(spark, tmp_path):
    task = tmp_path / "tasks" / "work" / "S1"
    task.mkdir(parents=True)
    for name in ("DONE", "start.pdb", "output.dcd"):
        (task / name).write_text("x")
    (task / "molecule_map.tsv").write_text(
        "molecule_id\tmolecule_type\tparent_med1\tfragment\tparticle_start\tparticle_stop_exclusive\tresidue_start\tresidue_stop_inclusive\n"
        "m1\tMED1\t1\t1\t0\t3\t1\t3\nm2\tMED1\t1\t2\t3\t5\t4\t5\n"
    )
    (task / "run_metadata.json").write_text('{"run_parameters": {"timestep_fs": 5.0}, "start_pdb_sha256": "a"}')
    root = str(tmp_path / "tasks")
    present = sources.present_tasks(spark, root)
    assert [(r.system, r.replicate, r.available) for r in present.collect()] == [("S1", "work", True)]
    beads = sources.bead_table(sources.molecule_maps(spark, root))
    assert [(r.bead, r.molecule, r.residue, r.parent) for r in beads.orderBy("bead").collect()] == [(0, 0, 0, 0), (1, 0, 1, 0), (2, 0, 2, 0), (3, 3, 3, 0), (4, 3, 4, 0)]
    tasks = spark.createDataFrame([("S1", "work", 500, 100), ("S2", "work", 500, 100)], "system string, replicate string, total_steps long, output_interval long")
    from lattica import schema

    params = sources.run_parameters(sources.json_per_task(spark, root, "run_metadata.json", schema.RUN_METADATA), tasks)
    explicit = spark.createDataFrame([("S1", "work")], "system string, replicate string")
    got = {r.system: (r.timestep_fs, r.inclusion_basis, r.analysis_included) for r in sources.include_tasks(params, present, explicit).collect()}
    assert got == {"S1": (5.0, "explicit_third_repeat", True), "S2": (10.0, "unavailable", False)}


def test_atom_records_and_checksums(spark, tmp_path):
    pdb = tmp_path / "pdb"
    pdb.mkdir()
    line = "ATOM      1  CA  ALA A  12      11.104   6.134  -6.504  1.00 87.50           C  "
    (pdb / "a.pdb").write_text("HEADER\n" + line + "\nTER\n")
    r = sources.atom_records(spark, str(pdb)).first()
    assert (r.name, r.res_name, r.chain, r.res_seq, r.x, r.z, r.temp_factor, r.element) == ("CA", "ALA", "A", 12, 11.104, -6.504, 87.5, "C")
    import hashlib

    digest = hashlib.sha256((pdb / "a.pdb").read_bytes()).hexdigest()
    (tmp_path / "sums").write_text(f"{digest}  *a.pdb\n{'0' * 64}  b.pdb\n")
    bad = quality.digest_mismatches(sources.checksum_list(spark, str(tmp_path / "sums")), sources.file_digests(spark, str(pdb)))
    assert [(x.path, x.reason) for x in bad.collect()] == [("b.pdb", "missing")]


def test_differences_are_located_by_descent(spark):
    from lattica.operators import digests

    rows = [(k, i, i * 3, "a") for k in (1, 2) for i in range(40)]
    changed = [(k, i, v + (k == 2 and i == 17), s) for k, i, v, s in rows if (k, i) != (2, 30)] + [(2, 41, 0, None)]
    left, right = (spark.createDataFrame(x, "k int, pos long, v long, s string").repartition(3) for x in (rows, changed))
    found = {tuple(r) for r in digests.differences(left, right, ["k"], "pos", ["v", "s"], chunk=8).collect()}
    assert found == {(2, 17, "changed"), (2, 30, "left only"), (2, 41, "right only")}
    a, b = (digests.root_digests(digests.chunk_digests(x.repartition(n), ["k"], "pos", ["v", "s"], 8), ["k"]) for x, n in ((left, 2), (left, 5)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    null, empty = (spark.createDataFrame([(1, 0, x)], "k int, pos long, s string") for x in (None, ""))
    assert digests.differences(null, empty, ["k"], "pos", ["s"]).count() == 1
    assert digests.differences(left.limit(0), left.limit(0), ["k"], "pos", ["v"]).count() == 0


def test_prefix_identity(spark):
    from lattica.operators import digests

    parent = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 7)], "k int, pos long, v long")
    child = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 9), (2, 0, 8)], "k int, pos long, v long")
    got = sorted(map(tuple, digests.prefix_identity(parent, child, ["k"], "pos", ["v"]).collect()))
    assert got == [(1, 2, 1, 0, None, True), (2, 1, 0, 1, 0, False)]


def test_agreement(spark):
    left = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0), ("c", 1, 1.0)], "g string, k int, v double")
    right = spark.createDataFrame([("a", 1, 1.001), ("a", 2, 2.0), ("b", 1, 1.5)], "g string, k int, v double")
    got = {r["g"]: (r["n_both"], r["one_sided"], r["passed"]) for r in quality.agreement(left, right, ["k"], "v", ["g"], 0.01).collect()}
    assert got == {"a": (2, 0, True), "b": (1, 0, False), "c": (0, 1, False)}


def test_block_counts(spark):
    rows = [("a", r, f) for r in (1, 2, 3) for f in range(4)] + [("a", 1, 0), ("b", 1, 0), ("c", None, 0)]
    got = {r["s"]: tuple(r)[1:] for r in quality.block_counts(spark.createDataFrame(rows, "s string, r int, f int"), ["s"], "r", "f", 3, 4).collect()}
    assert got == {"a": (3, 4, 4, True), "b": (1, 1, 1, False), "c": (0, None, None, False)}


def test_visible_pairs_equal_shadowed_lists_without_moving_pairs(spark):
    """Sight lines found cube by cube equal those of listed pairs and blockers; the query joins nothing."""
    rows = [(f, 3 * i + f, *map(float, xyz)) for f in range(2) for i, xyz in enumerate(np.random.default_rng(f).uniform(-4, 4, (250, 3)))]
    rows += [(0, 5000, 0.5, 0.5, 0.5), (0, 5001, 0.5, 0.5, 0.5), (0, 6000, None, 0.0, 0.0)]
    p = points(spark, rows)
    near = spatial.radius_pairs_open(p, ["frame"], 2.5).withColumn("candidate", F.expr("abs(i - j) > 30"))
    close = near.where("j - i <= 30")
    bonded = close.select("frame", "i", "j").unionByName(close.selectExpr("frame", "j AS i", "i AS j"))
    listed = {(r.frame, r.i, r.j): r.d for r in topology.shadow_contacts(near, ["frame"], bonded, 0.3, 0.15).collect()}
    seen = topology.visible_pairs(p, ["frame"], 2.5, 30, 0.3, 0.15)
    found = seen.collect()
    assert {(r.frame, r.i, r.j): r.d for r in found} == pytest.approx(listed) and len(found) == len(listed) > 500
    plan = queries_sequences.j17_shadow_contacts(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_generated_interactions_are_not_broadcast(spark):
    """Bonds made from a small table of templates are many: they are joined without a copy in the driver."""
    df = queries_sequences.t6_shifted_interactions(Tables(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in next(line for line in plan.splitlines() if "Join" in line)
    assert df.count() > 0


@pytest.mark.parametrize("box", [1.9, 2.5, 7.3, 10.0])
def test_pairs_in_tasks_equal_pairs_by_joins(spark, monkeypatch, box):
    """Whole frames are searched without a join; a frame above the limit goes through blocks, with the same pairs."""
    rows = cloud(60, 3, box=box) + [(7, i, *map(float, xyz)) for i, xyz in enumerate(np.random.default_rng(1).uniform(0, box, (200, 3)))]
    df = points(spark, rows).withColumn("tag", F.concat(F.lit("t"), F.col("bead").cast("string")))
    search = lambda: spatial.radius_pairs(df, ["frame"], box, 1.0, carry=["tag"])
    plain = search()
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(brute(rows, 1.0, box))
    got = plain.collect()
    assert sorted((r.frame, r.i, r.j) for r in got) == want and all((r.tag_i, r.tag_j) == (f"t{r.i}", f"t{r.j}") for r in got)
    monkeypatch.setattr(frames, "LARGE", 100)
    mixed = search()
    assert "Join" in mixed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, got))


def test_batches_hold_whole_frames(spark):
    """Frames keep together over batches of Arrow rows, also those larger than a batch."""
    df = spark.range(400_000).selectExpr("if(id < 150000, 1L, id div 7) AS frame", "id")

    def run(table, code):
        import numpy as np
        import pyarrow as pa

        first = np.searchsorted(code, np.arange(code[-1] + 1))
        return pa.table({"frame": table["frame"].take(first), "n": np.bincount(code)})

    got = frames.by_frame(df, ["frame"], run, "frame bigint, n bigint")
    assert got.exceptAll(df.groupBy("frame").count()).isEmpty() and got.count() == df.select("frame").distinct().count()


def test_components_in_tasks_equal_contraction(spark, monkeypatch):
    """Nested components of small frames need no rounds; frames above the limit are contracted, with the same labels."""
    rng = np.random.default_rng(4)
    rows = [(f, int(a) * 7 - 50, int(b) * 7 - 50, int(k)) for f, n in ((0, 40), (1, 300), (2, 5)) for a, b, k in zip(rng.integers(0, n, n), rng.integers(0, n, n), rng.integers(0, 3, n))]
    rows += [(3, i, i + 1, 0) for i in range(1000)]
    edges = spark.createDataFrame(rows, "frame int, lo long, hi long, level int")
    nodes = spark.createDataFrame([(f, i * 7 - 50) for f in range(3) for i in range(300)] + [(3, i) for i in range(1001)], "frame int, node long")
    label = lambda: sorted((r.frame, r.level, r.node, r.label) for r in forest.nested_components(edges, nodes, ["frame"], 3).collect())
    contract = forest._contract
    monkeypatch.setattr(forest, "_contract", None)
    in_tasks = label()
    monkeypatch.setattr(forest, "_contract", contract)
    monkeypatch.setattr(frames, "LARGE", 200)
    mixed = label()
    monkeypatch.setattr(frames, "LARGE", 0)
    assert in_tasks == mixed == label() and len(in_tasks) == 3 * (900 + 1001)
    assert {r[3] for r in in_tasks if r[0] == 3} == {0}


def test_nearest_in_tasks_equals_rounds(spark, monkeypatch):
    """Frames with few targets need no rounds of joins, whether targets are a table or marked; others give the same distances."""
    rng = np.random.default_rng(8)
    rows = [(f, i, *map(float, rng.uniform(-5, 15, 3))) for f, n in ((0, 60), (1, 9), (2, 130)) for i in range(n)] + [(3, 1, 1.0, 1.0, 1.0)]
    df = points(spark, rows)
    got = lambda out: sorted((r.frame, r.bead, round(r.distance, 9)) for r in out.collect())
    search = lambda *a: spatial.nearest_target_distance(*a, ["frame"], L)
    rounds = spatial._nearest_by_rounds
    monkeypatch.setattr(spatial, "_nearest_by_rounds", None)
    marked = got(search(df, "bead % 4 = 0"))
    assert marked == got(search(df.where("bead % 4 <> 0"), df.where("bead % 4 = 0"))) and len(marked) == 45 + 6 + 97
    monkeypatch.setattr(spatial, "_nearest_by_rounds", rounds)
    monkeypatch.setattr(spatial, "TARGETS", 10)
    assert got(search(df, "bead % 4 = 0")) == marked


def test_stored_quantiles_equal_general_ones(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(g, f"k{i % 3}", float(v), float(1 / (1 + i % 4))) for g, n in ((0, 300), (1, 1), (2, 50)) for i, v in enumerate(rng.integers(0, 40, n))]
    df = spark.createDataFrame(rows, "g int, kind string, distance double, w double")
    wide = df.withColumn("type", F.explode(F.array(F.lit("all"), "kind")))
    near = lambda out: [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, out.collect()))]
    want = quantiles.distance_summary(wide, ["g", "type"], weight="w", q=0.7)
    linear = quantiles.linear_quantile(df, ["g"], "distance", 0.9)
    for limit in (1 << 18, 100):
        monkeypatch.setattr(frames, "LARGE", limit)
        assert sorted(map(tuple, quantiles.stored_distance_summary(df, ["g"], weight="w", q=0.7, kind="kind", out="type").collect())) == near(want)
        assert sorted(map(tuple, quantiles.stored_linear_quantile(df, ["g"], "distance", 0.9).collect())) == near(linear)
    monkeypatch.setattr(frames, "LARGE", 1 << 18)
    assert "Join" not in quantiles.stored_distance_summary(df, ["g"], kind="kind")._jdf.queryExecution().optimizedPlan().toString()


def test_chains_unwrapped_in_tasks_equal_chunked_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f, int(m), i, *map(float, rng.uniform(-5, 15, 3))) for f, n in ((0, 90), (1, 1), (2, 140)) for i, m in enumerate(rng.integers(0, 9, n))]
    df = spark.createDataFrame(rows, "frame int, molecule int, bead int, x double, y double, z double")
    placed = sequences.ranged_position(df, ["frame", "molecule"], ["bead"], "pos")
    want = sorted(map(tuple, polymer.unwrap_chain(placed, ["frame", "molecule"], "pos", L).select("frame", "molecule", "bead", "ux", "uy", "uz").collect()))
    search = lambda: polymer.unwrap_frames(df, ["frame"], "molecule", "bead", L)
    plain = search()
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert [pytest.approx(r) for r in want] == sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(frames, "LARGE", 100)
    assert [pytest.approx(r) for r in want] == sorted(map(tuple, search().collect()))


def test_missing_coordinates_in_tasks_equal_chunked_ones(spark, monkeypatch):
    """Null adds nothing and the next bead adds its own place; before the first known one the chain has none. NaN stays."""
    z = [[None, None, 19.0, 1.0, None, 3.0], [18.0, float("nan"), 1.0, None, 2.0], [None, None], [5.0]]
    rows = [(f, 7, i, 1.0, 2.0, v) for f, chain in enumerate(z) for i, v in enumerate(chain)] + [(4, 7, 1, v, 2.0, 0.0) for v in (19.0, 4.0, 11.0)]
    df = spark.createDataFrame(rows, "frame int, molecule int, bead int, x double, y double, z double")
    got = lambda: sorted(((r.frame, r.bead, *(None if v is None else repr(round(v, 9) + 0.0) for v in r[3:])) for r in polymer.unwrap_frames(df, ["frame"], "molecule", "bead", 20.0).collect()), key=str)
    in_tasks = got()
    assert [r[4] for r in in_tasks if r[0] == 0] == [None, None, "19.0", "21.0", "21.0", "24.0"]
    assert [r[4] for r in in_tasks if r[0] == 1] == ["18.0", "nan", "nan", "nan", "nan"] and [r[4] for r in in_tasks if r[0] == 2] == [None, None]
    assert [r[2] for r in in_tasks if r[0] == 4] == ["11.0", "19.0", "4.0"]  # places 4, 11 and 19, the last by way of the boundary
    monkeypatch.setattr(frames, "LARGE", 2)
    assert got() == in_tasks
    monkeypatch.setattr(frames, "LARGE", 0)
    assert got() == in_tasks


def test_two_strands_in_tasks_equal_chunked_ones(spark, monkeypatch):
    rng = np.random.default_rng(15)
    rows = [(f, i // 2 if f == 2 else i, i, *map(float, rng.uniform(-5, 15, 3))) for f, n in ((0, 90), (1, 1), (2, 140), (3, 7), (4, 2)) for i in rng.permutation(n).tolist()]
    rows = [(f, b, c, x, None if f == 3 and (c > 2 or c == 0) else y, None if c in (89, 45, 46) else z) for f, b, c, x, y, z in rows]
    df = spark.createDataFrame(rows, "frame int, bead int, c int, x double, y double, z double")
    wrapped = df.selectExpr("*", *[f"{a} - {L}D * floor({a} / {L}D) AS t{a}" for a in "xyz"])
    placed = sequences.ranged_position(wrapped.orderBy("c"), ["frame"], ["bead", "tx"], "pos")
    placed = placed.join(df.groupBy("frame").agg(F.count("*").alias("n")), "frame").withColumn("half", F.expr("n div 2"))
    columns = ["frame", "bead", "c", "pos", "n", "ux", "uy", "uz"]
    read = lambda whole: sorted((tuple(None if v is None else round(v, 8) for v in r) for r in whole.select(*columns).collect()), key=str)
    want = read(polymer.unwrap_two_strands(placed, ["frame"], "pos", "half", L, chunk=16))
    search = lambda: polymer.unwrap_two_strand_frames(df, ["frame"], "bead", L, ["c"])
    plain = search()
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert len(want) == 240 and read(plain) == want
    for limit in (100, 0):
        monkeypatch.setattr(frames, "LARGE", limit)
        assert read(search()) == want


def test_stars_in_tasks_equal_distributed_stars(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f, int(a), int(b)) for f, n in ((0, 40), (1, 400)) for a, b in zip(rng.integers(0, n, n), rng.integers(0, n, n)) if a < b] + [(2, i, i + 1) for i in range(300)]
    edges = spark.createDataFrame(rows, "frame int, lo long, hi long").distinct()
    nodes = spark.createDataFrame([(f, i) for f in range(3) for i in range(400)], "frame int, node long")
    label = lambda method: sorted(map(tuple, graph.connected_components(edges, nodes, ["frame"], method=method).collect()))
    stars = graph._star_components
    monkeypatch.setattr(graph, "_star_components", None)
    in_tasks = label("star")
    monkeypatch.setattr(graph, "_star_components", stars)
    assert in_tasks == label("contract")
    monkeypatch.setattr(frames, "LARGE", 100)
    assert in_tasks == label("star")


def test_nearest_counts_a_repeated_id_once(spark):
    df = points(spark, [(0, 1, 1.0, 1.0, 1.0), (0, 1, 3.0, 1.0, 1.0), (0, 2, 2.0, 2.0, 2.0), (0, 8, 4.0, 1.0, 1.0), (1, 1, 5.0, 5.0, 5.0), (1, 9, 5.0, 5.0, 6.0)])
    got = spatial.nearest_target_distance(df, "bead >= 8", ["frame"], L).collect()
    assert sorted((r.frame, r.bead, r.distance) for r in got) == [(0, 1, 1.0), (0, 2, pytest.approx(6**0.5)), (1, 1, 1.0)]


def test_placement_in_tasks_equals_joins_and_rounds(spark, monkeypatch):
    """Small frames need neither rounds nor joins of beads: the same steps and shifts as in larger frames, closed loops, repeated bead
    ids, missing coordinates and lone anchors among them."""
    rng = np.random.default_rng(12)
    rows = [(f, int(m), i, *map(float, rng.uniform(-5, 15, 3))) for f, n in ((0, 90), (1, 1), (2, 140)) for i, m in enumerate(rng.integers(0, 30, n))]
    rows += [(2, 31, 5, 1.0, 2.0, 3.0), (2, 31, 141, None, 2.0, 3.0), (2, 31, 142, 9.0, 2.0, 3.0), (4, 1, 1, 1.0, 1.0, 1.0)]
    beads = spark.createDataFrame(rows, "frame int, molecule int, bead int, x double, y double, z double")
    chain = {(f, i): m for f, m, i, *_ in rows}
    found = {(f, min(chain[f, i], chain[f, j]), max(chain[f, i], chain[f, j])): (i, j) for f, n in ((0, 90), (2, 140)) for i, j in rng.integers(0, n, (40, 2)).tolist() if chain[f, i] < chain[f, j]}
    anchors = spark.createDataFrame([(*k, *v) for k, v in found.items()] + [(3, 1, 2, 1, 2)], "frame int, lo int, hi int, bead_lo int, bead_hi int")

    def answers():
        centres, steps = placement.chain_steps(beads, anchors, ["frame"], "molecule", "bead", L)
        placed = placement.placed_components(steps, centres, ["frame"], ["x"])
        broken = placement.broken_contacts(steps, placed.select("frame", "node", "nx", "ny", "nz"), ["frame"])
        return [sorted(map(tuple, df.collect())) for df in (centres, steps, placed.drop("x"), broken)]

    rounds, joined = placement._placed_in_rounds, placement.image_steps
    monkeypatch.setattr(placement, "_placed_in_rounds", None)
    monkeypatch.setattr(placement, "image_steps", None)
    in_tasks = answers()
    monkeypatch.setattr(placement, "_placed_in_rounds", rounds)
    monkeypatch.setattr(placement, "image_steps", joined)
    for limit in (150, 0):
        monkeypatch.setattr(frames, "LARGE", limit)
        got = answers()
        assert [r[:2] for r in got[0]] == [r[:2] for r in in_tasks[0]] and np.allclose([r[2:] for r in got[0]], [r[2:] for r in in_tasks[0]])
        assert got[1:] == in_tasks[1:]
    assert len(in_tasks[1]) >= len(found) and sum(r[1] for r in in_tasks[3]) > 0
