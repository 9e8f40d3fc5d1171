"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts, and a small network learns which parts a vector's
neighbours lie in. Every row is indexed under its most probable part; a query visits several of its most probable parts,
whose rows are reranked by the exact inner product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import stored
from lattica.llm.vectors import best_of, matrix, usable

SAMPLE = 4_096  # vectors that the parts and the router are fitted on
PARTS, PROBES = 32, 24
NEIGHBOURS = 10
HIDDEN = 64
TOP = 20
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 8_192


def neighbour_graph(x: np.ndarray, count: int = NEIGHBOURS) -> np.ndarray:
    """Rows of the ``count`` nearest others (largest inner product) of each vector."""
    count = min(count, len(x) - 1)
    out = np.empty((len(x), count), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, count - 1, axis=1)[:, :count]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 6, slack: float = 1.05) -> np.ndarray:
    """Parts of nearly equal size that cut few edges: median splits along the widest direction, then sweeps in which a
    vertex goes to the part that holds most of its neighbours and has room."""
    label = np.zeros(len(x), np.int64)
    queue = [(np.arange(len(x)), 0, parts)]
    while queue:
        rows, first, count = queue.pop()
        label[rows] = first
        if count == 1 or len(rows) < 2:
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        side = np.ones(centred.shape[1])
        for _ in range(20):
            side = centred.T @ (centred @ side)
            side /= np.linalg.norm(side) or 1.0
        order = rows[np.argsort(centred @ side, kind="stable")]
        cut = len(rows) * (count // 2) // count
        queue += [(order[:cut], first, count // 2), (order[cut:], first + count // 2, count - count // 2)]
    both: list[list[int]] = [list(r) for r in graph]
    for i, near in enumerate(graph.tolist()):
        for j in near:
            both[j].append(i)
    most = int(slack * len(x) / parts) + 1
    size = np.bincount(label, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for i, near in enumerate(both):
            held = np.bincount(label[near], minlength=parts)
            own = label[i]
            gain = np.where(size < most, held - held[own], 0)
            best = int(gain.argmax())
            if gain[best] > 0:
                size[own] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


@dataclass
class Router:
    """Two layers from a vector to the log-probabilities of parts."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        hidden = np.maximum((x / np.where(norm > 0, norm, 1)).astype(np.float32) @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias


def fit_router(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = 20, seed: int = 5) -> Router:
    """Softmax network on the parts' shares among each vector's neighbours (Adam)."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    net = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    net = [w.astype(np.float32) for w in net]
    mean, square = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]
    turn = 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            a, t = x[rows], target[rows]
            h = np.maximum(a @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - t) / len(rows)
            gh = (g @ net[2].T) * (h > 0)
            turn += 1
            for i, grad in enumerate((a.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                mean[i] += 0.1 * (grad - mean[i])
                square[i] += 0.001 * (grad * grad - square[i])
                net[i] -= rate * (mean[i] / (1 - 0.9**turn)) / (np.sqrt(square[i] / (1 - 0.999**turn)) + 1e-8)
    return Router(*net)


def fit(x: np.ndarray, parts: int = PARTS) -> Router:
    """Router fitted on sample vectors (directions, so a few long vectors don't draw all queries)."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.unique((x / norm).astype(np.float32), axis=0)
    if len(x) < 2 * parts:
        d = x.shape[1] if x.ndim == 2 else 1
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(x)
    label = balanced_parts(x, graph, parts)
    target = np.full((len(x), parts), 0, np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
    target[np.arange(len(x)), label] += graph.shape[1] / 2
    return fit_router(x, target / target.sum(axis=1, keepdims=True))


def indexed(vectors: DataFrame, router: Router) -> DataFrame:
    """Every row with its most probable part: vec_id, embedding, part."""
    sent = vectors.sparkSession.sparkContext.broadcast(router)  # a network of fixed size

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            part = sent.value.logits(matrix(batch.column("embedding"))).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(part, pa.int32())], ["vec_id", "embedding", "part"])

    return vectors.mapInArrow(run, "vec_id long, embedding array<double>, part int")


def routed(queries: DataFrame, router: Router, probes: int) -> DataFrame:
    """A row for each query and each of its ``probes`` most probable parts: vec_id, embedding, part."""
    sent = queries.sparkSession.sparkContext.broadcast(router)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            order = np.argsort(-sent.value.logits(matrix(batch.column("embedding"))), axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(list(order), pa.list_(pa.int32()))], ["vec_id", "embedding", "parts"])

    found = queries.mapInArrow(run, "vec_id long, embedding array<double>, parts array<int>")
    return found.select("vec_id", "embedding", F.explode("parts").alias("part"))


def _in_blocks(rows: DataFrame, counts: pd.DataFrame, own: str, other: str) -> DataFrame:
    """Rows dealt to blocks of their part and repeated for every block of the other side."""
    plan = rows.sparkSession.createDataFrame(counts[["part", own, other]].rename(columns={own: "own", other: "other"}), "part int, own int, other int")
    dealt = rows.join(F.broadcast(plan), "part").withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col("own")).cast("int"))  # a row per part
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("other") - 1))).select("part", "row_block", "query_block", "vec_id", "embedding")


def search(table: DataFrame, every: int = 20, top: int = TOP, parts: int = PARTS, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """The ``top`` nearest found of each query (rows whose vec_id is divisible by ``every``): query_id, rank, vec_id, score.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Null, zero and non-finite vectors,
    vectors of another length than most, and rows without an id take no part; rows that repeat id and vector
    count once; different vectors of one id are a row each, and as queries share one list. Other columns are left out, so their names can't clash. A large part is split into blocks of rows and of
    queries, so a vector that a third of all rows repeat fills no single task.
    """
    vectors = stored(usable(table, zero=False), "ann-vectors")
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]  # the bounded sample
    if chosen.empty:
        return vectors.selectExpr("vec_id AS query_id", "CAST(0 AS INT) AS rank", "vec_id", "CAST(0 AS DOUBLE) AS score").where("false")
    router = fit(np.array(chosen.to_list(), np.float64), parts)
    rows = stored(indexed(vectors, router), "ann-index")
    asked = stored(routed(vectors.where(F.col("vec_id") % every == 0), router, probes), "ann-queries")
    counts = rows.groupBy("part").agg(F.count("*").alias("rows")).join(asked.groupBy("part").agg(F.count("*").alias("queries")), "part").toPandas()
    counts["row_block"] = -(-counts["rows"] // BLOCK_ROWS)
    counts["query_block"] = -(-counts["queries"] // BLOCK_QUERIES)
    keys = ["part", "row_block", "query_block"]
    right = _in_blocks(asked, counts, "query_block", "row_block").groupBy(*keys)
    left = _in_blocks(rows, counts, "row_block", "query_block").groupBy(*keys)

    def rerank(a, b):
        return best_of(a, b, top)

    found = left.cogroup(right).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
