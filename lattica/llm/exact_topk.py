"""Exact largest inner products by a pivot-distance index.

One more coordinate gives every vector the same length, so the largest inner product is the smallest distance. Rows are
keyed by nearest pivot and distance to it, and cut into annuli along that distance. A query takes the annuli in order of
the least distance that the triangle inequality allows: the first gives it a bound, and only annuli that may hold something
nearer follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import stored
from lattica.llm.vectors import best_of, matrix, usable

PIVOTS, ANNULI = 16, 4
SAMPLE = 4_096  # vectors that pivots are chosen from
TOP = 10
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 8_192


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """Components as floor(scale * x), in double precision (exact below 2**53)."""
    return vectors.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("embedding"))


def pivots_of(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of a bounded sample (Lloyd's rounds from far apart starts)."""
    chosen = [int(np.linalg.norm(x - x.mean(axis=0), axis=1).argmin())]
    far = np.linalg.norm(x - x[chosen[0]], axis=1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    centres = x[chosen]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        centres = np.array([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes their squared length ``longest``."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]])


def keyed(vectors: DataFrame, pivots: np.ndarray, longest: float) -> DataFrame:
    """Every row with its nearest pivot and its distance to it."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(lifted(matrix(batch.column("embedding")), longest), sent.value)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("embedding"), pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near])], ["vec_id", "embedding", "pivot", "distance"]
                )

    return vectors.mapInArrow(run, "vec_id long, embedding array<double>, pivot int, distance double")


def _visits(queries: DataFrame, pivots: np.ndarray, annuli: list[tuple], longest: float, first: bool) -> DataFrame:
    """A row for each query and annulus to visit: the most promising one at first, then all others within the bound.

    ``annuli``: (pivot, annulus, least, most, row blocks); at most PIVOTS * ANNULI of them. ``queries`` hold ``bound``, the
    score of the last kept neighbour so far (null: none).
    """
    sent = queries.sparkSession.sparkContext.broadcast((pivots, annuli))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, annuli = sent.value
        pivot = np.array([a[0] for a in annuli])
        least, most = np.array([a[2] for a in annuli]), np.array([a[3] for a in annuli])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            at = distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)[:, pivot]
            nearest = np.maximum(np.maximum(at - most, least - at), 0)
            start = np.lexsort((np.broadcast_to(np.arange(len(annuli)), at.shape), np.abs(at - (least + most) / 2), nearest), axis=1)[:, 0]
            if first:
                q, a = np.arange(len(x)), start
            else:
                score = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.sqrt(np.maximum((x * x).sum(axis=1) + longest - 2 * score, 0))
                inside = (nearest <= (reach * (1 + 1e-9) + 1e-6)[:, None]) | np.isnan(score)[:, None]
                inside[np.arange(len(x)), start] = False
                q, a = np.nonzero(inside)
            take = pa.array(q)
            columns = [batch.column("vec_id").take(take), batch.column("embedding").take(take), *[pa.array([annuli[i][k] for i in a.tolist()], pa.int32()) for k in (0, 1, 4)]]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "pivot", "annulus", "blocks"])

    return queries.mapInArrow(run, "vec_id long, embedding array<double>, pivot int, annulus int, blocks int")


def _compared(rows: DataFrame, visits: DataFrame, top: int) -> DataFrame:
    """The best rows of each visited annulus, block by block: query_id, vec_id, score."""
    keys = ["pivot", "annulus", "block", "query_block"]
    most = visits.groupBy("pivot", "annulus").count().agg(F.max("count")).first()[0] or 0
    asked = -(-most // BLOCK_QUERIES) or 1  # blocks of queries
    right = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(asked)).cast("int"))
    left = rows.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))

    def run(a, b):
        return best_of(a, b, top)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def search(table: DataFrame, every: int = 100, top: int = TOP, scale: int = 1024) -> DataFrame:
    """The ``top`` largest integer inner products of each query (rows whose vec_id is divisible by ``every``), exactly:
    query_id, rank, vec_id, score; ties go to the smaller vec_id.

    Vectors that are null or hold null or non-finite components, vectors of another length than most, and rows without an
    id take no part; rows that repeat id and vector count once; different vectors of one id
    are a row each, and as queries share one list; zero vectors do take part. Other columns are left
    out, so their names can't clash. Annuli hold any number of rows: large ones are split into blocks.
    """
    spark = table.sparkSession
    vectors = stored(integers(usable(table, zero=True), scale), "topk-vectors")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    longest = vectors.agg(F.max(squares)).first()[0]
    if longest is None:
        return vectors.selectExpr("vec_id AS query_id", "CAST(0 AS INT) AS rank", "vec_id", "CAST(0 AS LONG) AS score").where("false")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]  # the bounded sample
    pivots = pivots_of(lifted(np.array(sample.to_list(), np.float64), longest), PIVOTS)
    rows = stored(keyed(vectors, pivots, longest), "topk-keyed")
    shares = [i / ANNULI for i in range(1, ANNULI)]
    cuts = rows.groupBy("pivot").agg(F.percentile_approx("distance", shares).alias("cuts"))
    rows = rows.join(F.broadcast(cuts), "pivot")  # a row per pivot
    rows = rows.withColumn("annulus", F.aggregate("cuts", F.lit(0), lambda a, c: a + (F.col("distance") > c).cast("int"))).drop("cuts")
    rings = rows.groupBy("pivot", "annulus").agg(F.min("distance"), F.max("distance"), F.count("*")).orderBy("pivot", "annulus").collect()  # at most PIVOTS * ANNULI
    annuli = [(r[0], r[1], r[2], r[3], -(-r[4] // BLOCK_ROWS)) for r in rings]
    plan = spark.createDataFrame([(a[0], a[1], a[4]) for a in annuli], "pivot int, annulus int, blocks int")
    rows = rows.join(F.broadcast(plan), ["pivot", "annulus"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = stored(rows.select("vec_id", "embedding", "pivot", "annulus", "block"), "topk-rows")

    queries = vectors.where(F.col("vec_id") % every == 0)
    begun = stored(_compared(rows, _visits(queries, pivots, annuli, longest, True), top), "topk-first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = begun.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = _compared(rows, _visits(stored(queries.join(bounds, "vec_id", "left"), "topk-bounds"), pivots, annuli, longest, False), top)
    found = begun.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
