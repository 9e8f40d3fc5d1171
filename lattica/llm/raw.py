"""Texts of Arrow batches as one array of UTF-8 bytes, and words found in it without a loop over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lattica.llm.bpe import slices


def of_bytes(characters: bytes) -> np.ndarray:
    """A table of 256 that is true for the given bytes."""
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


def grouped(column: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """A text column in groups of about ``most`` bytes, with the row at which each begins; null is the empty text."""
    done = 0
    for group in slices([x or b"" for x in column.cast(pa.binary()).to_pylist()], most):
        yield done, group
        done += len(group)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each followed by a line feed, and where each begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.cumsum(sizes) - sizes


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal true stretches."""
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def encoded(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the distinct words, and these (binary)."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())])
    out = words.dictionary_encode()
    return out.indices.to_numpy(), out.dictionary.cast(pa.binary())
