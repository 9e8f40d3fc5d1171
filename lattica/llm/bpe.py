"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regular expression. Every character becomes a symbol (its class and what its neighbours
decide), every symbol is a transition function on nine states, and the functions compose associatively: the composites
of all prefixes come from a blocked scan over the identifiers of the functions' closure. The state before a character and
its symbol say whether a token piece begins there. Pieces are byte slices; merging is cached by slice.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import text_of

LETTER, NUMBER, SPACE, OTHER = range(4)
# The code points with the White_Space property of the Unicode standard.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe to make a contraction, by length.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

# Symbols.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_WHITE, S_JOINED, S_LAST = range(8)
FIRST = 8  # added for the first character of a text
PAD = 16
# States: nothing yet, in a run of letters / numbers / others / white space, after a space that joins the next run, with
# one or two letters of a contraction to come, after a whole contraction.
NONE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, JOINING, ONE_LEFT, TWO_LEFT, WHOLE = range(9)
STATES = 9


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begins-a-piece, by symbol and state."""
    step = np.zeros((PAD + 1, STATES), np.uint8)
    begins = np.ones((PAD + 1, STATES), bool)
    for symbol, state in ((S_LETTER, IN_LETTER), (S_NUMBER, IN_NUMBER), (S_OTHER, IN_OTHER)):
        step[symbol] = state
        begins[symbol, [state, JOINING]] = False
    for left, after in ((ONE_LEFT, WHOLE), (TWO_LEFT, ONE_LEFT)):
        step[S_LETTER, left] = after
        begins[S_LETTER, left] = False
    for symbol, state in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):
        step[symbol] = state
        step[symbol, [IN_OTHER, JOINING]] = IN_OTHER
        begins[symbol, [IN_OTHER, JOINING]] = False
    step[S_WHITE] = step[S_LAST] = IN_WHITE
    begins[S_WHITE, IN_WHITE] = False
    step[S_JOINED] = JOINING
    for symbol in range(FIRST):
        step[FIRST + symbol] = step[symbol, NONE]
    step[PAD] = np.arange(STATES)
    return step, begins


@functools.cache
def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that strings of symbols make: values by function and state, and the function of each pair in turn.

    The first functions are the symbols' own, so a symbol is its function's identifier (equal functions are listed
    once more).
    """
    step, begins = _rules()
    found = [tuple(f) for f in step]
    known = {f: i for i, f in reversed(list(enumerate(found)))}
    at = 0
    while at < len(found):
        for g in step:
            h = tuple(g[list(found[at])])
            if h not in known:
                known[h] = len(found)
                found.append(h)
        at += 1
    pairs = np.array([[known[tuple(np.array(g)[list(f)])] for g in found] for f in found], np.uint16)
    return np.array(found, np.uint8), pairs, begins


def _prefixes(ids: np.ndarray, width: int = 64) -> np.ndarray:
    """Composite of all functions up to and with each place."""
    _, pairs, _ = _closure()
    flat, count = pairs.ravel(), len(pairs)
    n = len(ids)
    if n <= width:
        out = ids.astype(np.uint16)
        for i in range(1, n):
            out[i] = pairs[out[i - 1], out[i]]
        return out
    blocks = -(-n // width)
    lanes = np.full(blocks * width, PAD, np.uint16)
    lanes[:n] = ids
    lanes = np.ascontiguousarray(lanes.reshape(blocks, width).T)
    for i in range(1, width):
        lanes[i] = flat.take(lanes[i - 1].astype(np.intp) * count + lanes[i])
    carry = np.full(blocks, PAD, np.uint16)
    carry[1:] = _prefixes(lanes[-1])[:-1]
    base = carry.astype(np.intp) * count
    for i in range(width):
        lanes[i] = flat.take(base + lanes[i])
    return lanes.T.ravel()[:n]


@functools.cache
def code_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places in ``points`` (code points of texts in a row) where pieces begin; ``firsts`` are the places where non-empty
    texts begin. A piece never spans two texts."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    symbols = code_classes().take(points)
    symbols = np.array([S_LETTER, S_NUMBER, S_WHITE, S_OTHER], np.uint8).take(symbols)
    starts_text = np.zeros(n + 1, bool)
    starts_text[firsts] = True
    starts_text[n] = True
    inside = ~starts_text[1:]  # the next character belongs to the same text
    white = symbols == S_WHITE
    last_white = white & inside
    last_white[:-1] &= ~white[1:]
    symbols[last_white] = np.where(points[last_white] == 0x20, S_JOINED, S_LAST)
    quote = np.flatnonzero((points == 0x27) & inside)
    if len(quote):
        one = points[quote + 1]
        short = np.isin(one, [ord(c) for c in SHORT])
        has_two = inside[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        long = np.zeros(len(quote), bool)
        for a, b in LONG:
            long |= has_two & (one == ord(a)) & (two == ord(b))
        symbols[quote[short]] = S_SHORT
        symbols[quote[long]] = S_LONG
    symbols[firsts] += FIRST
    values, _, begins = _closure()
    prefix = _prefixes(symbols)
    state = np.zeros(n, np.uint8)
    state[1:] = values[:, NONE].take(prefix[:-1])
    return np.flatnonzero(begins.ravel().take(symbols.astype(np.intp) * STATES + state))


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Tokens of byte slices by ranked pair merging, cached, and the way back."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 250_000):
        self.ranks, self.keep = ranks, keep
        lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.token_bytes = lengths
        self.token_at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        by_rank = sorted(ranks.items(), key=lambda item: item[1])
        self.all_bytes = np.frombuffer(b"".join(token for token, _ in by_rank), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.count = array("I"), array("q"), array("q")

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of one piece: the adjacent pair with the lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while scores:
            best = min(scores)
            if best == 1 << 60:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for long pieces: a heap of pairs over a linked list."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if gone[i] or end[i] != middle or middle >= n or end[middle] != stop:
                continue
            gone[middle] = 1
            end[i] = stop
            after[i] = after[middle]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, and the number of tokens of each."""
        if len(self.known) > self.keep:
            self._clear()
        known = self.known
        for piece in set(pieces).difference(known):
            ids = self.merge(piece)
            known[piece] = len(self.start)
            self.start.append(len(self.flat))
            self.count.append(len(ids))
            self.flat.extend(ids)
        at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        counts = np.array(self.count, np.int64)[at]
        return np.array(self.flat, np.uint32)[_ranges(np.array(self.start, np.int64)[at], counts)], counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of tokens in a row."""
        ids = ids.astype(np.intp)
        return self.all_bytes[_ranges(self.token_at[ids], self.token_bytes[ids])]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of every range in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def encode_texts(encoder: Encoder, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of UTF-8 texts in a row, and the number of tokens of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = b"".join(texts)
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    byte_at = np.flatnonzero((raw & 0xC0) != 0x80) if len(points) < len(raw) else np.arange(len(raw))
    text_at = np.cumsum(lengths) - lengths
    firsts = np.searchsorted(byte_at, text_at[lengths > 0])
    begin = byte_at[piece_starts(points, firsts)]
    bounds = begin.tolist()
    bounds.append(len(data))
    pieces = [data[a:b] for a, b in zip(bounds, bounds[1:])]
    ids, counts = encoder.encode(pieces)
    ends = np.concatenate([[0], np.cumsum(counts)])
    first_piece = np.searchsorted(begin, text_at)
    edges = ends[np.append(first_piece, len(begin))]
    return ids, np.diff(edges)


def slices(texts: Iterable[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in groups of about ``most`` bytes; a longer text is a group of its own."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: the bytes of consecutive stretches of ``values``."""
    data = np.ascontiguousarray(values)
    edges = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data.tobytes())])


def clean_bytes(column: pa.Array) -> list[bytes]:
    """Texts as valid UTF-8; a byte that isn't becomes the replacement character."""
    out = []
    for text in column.cast(pa.binary()).to_pylist():
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode("utf-8", "replace").encode()
        out.append(text)
    return out


@functools.lru_cache(maxsize=2)
def _encoder(digest: str, content: tuple[bytes]) -> Encoder:
    return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, content[0].splitlines())})


class _Once(tuple):
    """A one-element tuple whose hash doesn't read its content."""

    def __hash__(self) -> int:
        return 0


def shared_encoder(spark, ranks_path: str):
    """A function without arguments that gives the tasks' encoder. The rank file (a fixed file of under 1 MB) is read on
    the driver and broadcast, so executors need no copy of it."""
    with open(ranks_path, "rb") as f:
        content = f.read()
    sent = spark.sparkContext.broadcast(content)
    digest = hashlib.sha256(content).hexdigest()
    return lambda: _encoder(digest, _Once((sent.value,)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def _encoded(own: Encoder, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for group in slices(clean_bytes(batch.column("text"))):
            ids, counts = encode_texts(own, group)
            lengths = own.token_bytes[ids]
            ends = np.cumsum(lengths)
            edges = np.concatenate([[0], np.cumsum(counts)])
            base = np.repeat(np.concatenate([[0], ends])[edges[:-1]], counts)
            columns = [batch.column("doc_id").slice(done, len(group)), pa.array(counts), packed(ids.astype("<u4"), counts), packed((ends - lengths - base).astype("<u4"), counts)]
            done += len(group)
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "offsets"])


def _decoded(own: Encoder, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids = [np.frombuffer(x or b"", "<u4") for x in part.column("ids").to_pylist()]
            offsets = np.concatenate([np.frombuffer(x or b"", "<u4") for x in part.column("offsets").to_pylist()])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            ids = np.concatenate(ids)
            lengths = own.token_bytes[ids]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            edges = np.concatenate([[0], np.cumsum(counts)])
            if not np.array_equal(ends[:-1] - np.repeat(ends[edges[:-1]], counts), offsets):
                raise ValueError("offsets don't fit the tokens")
            text = packed(own.decode(ids), np.diff(ends[edges]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), part.column("ids"), text], ["doc_id", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Tokens of every text: doc_id, text, n_tokens, ids (little-endian unsigned 32-bit), offsets (of each token's first
    byte in the text, same form).

    Null counts as the empty text, which has no tokens. Repeated rows are encoded each; other columns are left out, so
    their names can't clash. Very long texts and pieces are encoded whole.
    """
    encoder = shared_encoder(docs.sparkSession, ranks_path)
    return _texts(docs).mapInArrow(lambda batches: _encoded(encoder(), batches), "doc_id long, n_tokens long, ids binary, offsets binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The texts' bytes from ``ids`` and ``offsets``: doc_id, n_tokens, ids, decoded. Null ids are no tokens.

    A token goes to the place that its offset names, so a gap or an overlap of offsets raises an error.
    """
    encoder = shared_encoder(encoded.sparkSession, ranks_path)
    return encoded.select("doc_id", "n_tokens", "ids", "offsets").mapInArrow(lambda batches: _decoded(encoder(), batches), "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode and decode every text; digests of the tokens and of the decoded bytes.

    ``encode`` and ``decode`` follow each other in one Python worker, which keeps one vocabulary and one cache.
    """
    encoder = shared_encoder(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        yield from _decoded(own, _encoded(own, batches))

    back = _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
