"""Work on whole frames inside tasks.

A frame that fits into a task many times over needs one exchange: its rows come together, sorted by frame, and NumPy works on
as many whole frames at once as make a batch. Frames with more than LARGE rows are few; callers send them through
distributed joins instead (``large_frames`` tells which), so a task never holds more than a batch and one frame of LARGE rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import materialise

LARGE = 1 << 18
BATCH = 1 << 16


def large_frames(sizes: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Frames with more than LARGE rows by ``sizes(keys, n)``, written; nothing if there are none."""
    found = materialise(sizes.where(F.col("n") > (LARGE if limit is None else limit)).select(*keys), "large")
    return None if found.isEmpty() else found


def frame_codes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Numbers of the frames of a table that is sorted by ``keys``: 0 and up, in order."""
    fresh = np.zeros(table.num_rows, bool)
    for k in keys:
        column = table[k].combine_chunks()
        column = column.dictionary_encode().indices if not pa.types.is_integer(column.type) else column
        value = column.to_numpy(zero_copy_only=False)
        fresh[1:] |= value[1:] != value[:-1]
    return np.cumsum(fresh)


def by_frame(df: DataFrame, keys: Sequence[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, clustered: bool = False) -> DataFrame:
    """``run(rows, frame numbers)`` for batches of whole frames. Keys are not null. ``clustered``: the rows of a frame are in one partition."""
    keys = list(keys)

    def work(batches):
        held, n, due = [], 0, BATCH
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= due:
                table = pa.Table.from_batches(held)
                code = frame_codes(table, keys)
                cut = int(np.searchsorted(code, code[-1]))
                if cut:
                    yield from run(table.slice(0, cut).combine_chunks(), code[:cut]).to_batches()
                held, n = table.slice(cut).to_batches(), table.num_rows - cut
                due = max(BATCH, 2 * n)
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from run(table, frame_codes(table, keys)).to_batches()

    return (df if clustered else df.repartition(*keys)).sortWithinPartitions(*keys).mapInArrow(work, schema)


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows, each as often as its count, and the places from its start on."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner] + starts[owner]
