"""Vector search against brute force."""

import math

import numpy as np
import pytest

from lattica.llm import ann, exact_topk


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, part int, rank int")


def best(ids, x, every, top):
    """Each query's neighbours: those that score above the last one must be found, ties by smaller id."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = [(-float((x[i] * x[j]).sum()), int(ids[j])) for j in range(len(ids)) if j != i]
        out[int(ids[i])] = [(b, -a) for a, b in sorted(score)[:top]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(float).tolist(), 0, 1.0, 2, 3) for i in range(130)]
    rows += [(i, [1.0, 2.0, 0.5, -1.0], None, None, None, None) for i in range(130, 190)]
    usable = list(rows)
    rows += [(400, None, 0, 1.0, 2, 3), (500, [float("nan"), 1.0, 1.0, 1.0], 0, 1.0, 2, 3), (600, [1.0, None, 1.0, 1.0], 0, 1.0, 2, 3), (700, [1.0, 2.0], 0, 1.0, 2, 3)]
    rows += [(800, [math.inf, 1.0, 1.0, 1.0], 0, 1.0, 2, 3), (None, [1.0] * 4, 0, 1.0, 2, 3), (900, [], 0, 1.0, 2, 3), usable[0]]
    return vectors_of(spark, rows), np.array([r[0] for r in usable]), np.array([r[1] for r in usable], np.float32).astype(np.float64)


def test_exact_on_the_given_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.floor(1024 * np.array([r.embedding for r in rows], np.float64))
    assert found(exact_topk.search(table)) == best(ids, x, 100, 10)


def test_exact_with_odd_rows(spark, monkeypatch):
    table, ids, x = odd_vectors(spark)
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(exact_topk, "BLOCK_QUERIES", 2)
    assert found(exact_topk.search(table, every=10, top=6)) == best(ids, np.floor(1024 * x), 10, 6)
    few = table.where("vec_id IN (0, 3, 10, 400)")
    assert found(exact_topk.search(few, every=10, top=6)) == best(np.array([0, 3, 10]), np.floor(1024 * x[[0, 3, 10]]), 10, 6)
    assert exact_topk.search(table.where("false")).count() == 0


def test_different_vectors_of_one_id_are_rows_each(spark):
    rows = [(0, [0.0, 1.0]), (5, [0.5, 1.0]), (5, [0.4, 9.0]), (5, [0.4, 9.0]), (7, [1.0, 2.0]), (10, [1.0, 0.0]), (10, [0.0, 3.0])]
    table = vectors_of(spark, [(*r, 0, 1.0, 2, 3) for r in rows])
    one = 1024 * 1024
    assert found(exact_topk.search(table, every=5, top=3))[0] == [(5, 9 * one), (10, 3 * one), (7, 2 * one)]
    assert found(exact_topk.search(table, every=5, top=3))[10] == [(5, 27 * one), (7, 6 * one), (0, 3 * one)]
    near = found(ann.search(table, every=5, top=4))
    assert near[0] == [(5, 9.0), (10, 3.0), (7, 2.0), (5, 1.0)]
    assert near[10] == [(5, 27.0), (7, 6.0), (0, 3.0), (5, 3.0)]


def test_recall_of_learned_partitions(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got, want = found(ann.search(table)), best(ids, x, 20, 20)
    assert set(got) == set(want)
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
    place = {int(i): k for k, i in enumerate(ids)}
    for q, near in got.items():
        assert all(s == pytest.approx(float((x[place[q]] * x[place[v]]).sum()), abs=1e-12) for v, s in near)
        assert near == sorted(near, key=lambda n: (-n[1], n[0])) and q not in {v for v, _ in near}


def test_learned_partitions_with_odd_rows(spark, monkeypatch):
    table, ids, x = odd_vectors(spark)
    table = table.union(vectors_of(spark, [(1000, [0.0] * 4, 0, 1.0, 2, 3)]))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    all_parts = found(ann.search(table, every=10, top=6, parts=4, probes=4))
    want = best(ids, x, 10, 6)
    assert set(all_parts) == set(want)
    for q in want:
        assert [v for v, _ in all_parts[q]] == [v for v, _ in want[q]]
    assert ann.search(table.where("false")).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    graph = ann.neighbour_graph(x)
    parts = ann.balanced_parts(x, graph, 8)
    assert np.bincount(parts, minlength=8).max() <= 1.05 * 125 + 1
    own = (parts[graph] == parts[:, None]).mean()
    assert own > 2 / 8
