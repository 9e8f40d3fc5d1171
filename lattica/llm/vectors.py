"""Vectors in Arrow batches: which rows take part, and the best candidates of a block by exact inner product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: with an id, of the commonest length, all components finite
    and, unless ``zero``, not all zero. Rows that repeat id and vector count once; different vectors of one id are a row each."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if not zero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = rows.where(F.size("embedding") == (length["length"] if length else 0))
    return rows.distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in one fixed order, so equal vectors have equal products."""
    return np.add.reduce(np.ascontiguousarray(a * b), axis=1)


def best_of(rows: pa.Table, queries: pa.Table, top: int, step: int = 256) -> pa.Table:
    """The ``top`` rows of the block for each query, but its own row: by score, ties by smaller vec_id.

    A matrix product finds what may be among them; those scores are then computed in a fixed order.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        ids = rows.column("vec_id").to_numpy()
        x = matrix(rows.column("embedding").combine_chunks())
        asked = queries.column("vec_id").to_numpy()
        y = matrix(queries.column("embedding").combine_chunks())
        scale = np.abs(x).max() * np.abs(y).max() * x.shape[1] * 1e-12
        for at in range(0, len(y), step):
            part = y[at : at + step]
            near = part @ x.T
            near[asked[at : at + step, None] == ids[None, :]] = -np.inf
            least = np.partition(near, -top, axis=1)[:, -top] if len(ids) > top else np.full(len(part), -np.inf)
            q, c = np.nonzero((near >= least[:, None] - scale) & (near > -np.inf))
            exact = _dots(part[q], x[c])
            order = np.lexsort((ids[c], -exact, q))
            q, c, exact = q[order], c[order], exact[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < top
            out.append((asked[at + q[keep]], ids[c[keep]], exact[keep]))
    columns = [np.concatenate(x) if out else np.empty(0, kind) for x, kind in zip(zip(*out) if out else ((), (), ()), (np.int64, np.int64, np.float64))]
    return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})
