"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts become weighted sets of five-word shingles. Consistent weighted samples are banded into buckets; pairs from the
buckets are verified by exact weighted Jaccard similarity; the links' connected components are the classes.

Weights are (1 + ln tf) * idf. The idf is damped to lie between 1 and 1 + DAMPING: a large group of near copies makes its
own shingles frequent, and an undamped idf would weigh away what its members share. Document frequencies come from a
count-min sketch over all documents; its error is a fixed share of the number of documents, well below RARE, and
frequencies under RARE (as a share) count as RARE, so weights behave alike at every size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.bpe import slices
from lattica.llm.common import discard, small_batches, stored, text_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 3
WORTH = 20  # a further round needs one link between classes per this number of open (bucket, text) rows
CENTRES = 3  # texts of a bucket that the others are compared with in one round
BLOCK, ASKED = 512, 8192  # members of a bucket, and texts compared with them, in one task
ALIKE = 22  # equal samples, of BANDS * ROWS, that a pair needs to be verified; one of similarity 0.8 has fewer once in 100,000
RARE, DAMPING = 0.01, 0.5
WIDTH_BITS, DEPTH = 18, 2
SLICE = 1 << 19
SPREAD = 64  # pairs that share one copy of a hub's text
BATCH = 256  # rows with texts in an Arrow batch
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.cache
def _powers(count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full(count - 1, 0x100000001B3, np.uint64)]).astype(np.uint64), dtype=np.uint64)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (a run without ASCII white space) of the lower-case texts in a row; words per text."""
    data = [t.lower().encode("utf-8", "replace") + b" " for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends_text = np.cumsum([len(d) for d in data])
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(data), np.int64)
    lengths = ends - starts
    letters = raw[inside].astype(np.uint64) + U64(1)
    first = np.cumsum(lengths) - lengths
    places = np.arange(len(letters)) - np.repeat(first, lengths)
    hashes = _mix(np.add.reduceat(letters * _powers(1 << int(lengths.max()).bit_length()).take(places), first) ^ (lengths.astype(np.uint64) << U64(48)))
    return hashes, np.diff(np.searchsorted(starts, ends_text), prepend=0)


def shingles(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in a row, their counts, shingles per text, and each text's key (16 bytes of hash of
    its words). A text of fewer words than a shingle is one shingle; a text without words has none."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    size = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    first = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())
    stop = np.repeat(ends, size)
    value = np.zeros(len(first), np.uint64)
    for i in range(WORDS):
        at = first + i
        value = value * U64(0x9E3779B97F4A7C15) + np.where(at < stop, padded[np.minimum(at, len(padded) - 1)], U64(i + 1))
    value = _mix(value)
    key = np.zeros((len(texts), 2), np.uint64)
    if len(words):
        places = np.arange(len(words), dtype=np.uint64) - np.repeat(begins, counts).astype(np.uint64)
        some = counts > 0
        for column, salt in ((0, 0x9E3779B97F4A7C15), (1, 0xD1B54A32D192ED03)):
            key[some, column] = _mix(np.add.reduceat(_mix(words ^ (places * U64(salt) + U64(salt))), begins[some]) ^ counts[some].astype(np.uint64))
    owner = np.repeat(np.arange(len(texts)), size)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return value[at], np.diff(np.append(at, len(value))), np.bincount(owner[at], minlength=len(texts)), key


def _cells(values: np.ndarray) -> list[np.ndarray]:
    mask = U64((1 << WIDTH_BITS) - 1)
    return [((values >> U64(20 * d)) & mask).astype(np.int64) for d in range(DEPTH)]


class Weights:
    """Weights of shingles from the count-min sketch of document frequencies."""

    def __init__(self, sketch: np.ndarray, documents: int):
        share = np.maximum(sketch / max(1, documents), RARE)
        self.idf = (1.0 + DAMPING * np.minimum(1.0, np.log(1.0 / np.minimum(share, 1.0)) / np.log(1.0 / RARE))).astype(np.float32)

    def of(self, values: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.maximum.reduce([self.idf[d, cell] for d, cell in enumerate(_cells(values))])  # the least count has the largest idf
        return idf * (1.0 + np.log(tf)).astype(np.float32)


@functools.cache
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the gamma distribution of shape 2, and their logarithms, for 16 random bits."""
    x = np.concatenate([np.geomspace(1e-5, 1.0, 200_000), np.linspace(1.0, 30.0, 400_000)[1:]])
    table = np.interp((np.arange(65536) + 0.5) / 65536, 1.0 - (1.0 + x) * np.exp(-x), x)
    return table.astype(np.float32), np.log(table).astype(np.float32)


def samples(values: np.ndarray, weights: np.ndarray, counts: np.ndarray, hashes: int = BANDS * ROWS) -> np.ndarray:
    """Consistent weighted samples (texts x hashes) of weighted sets in a row; every set has an element."""
    gamma, log_gamma = _gamma()
    starts = np.cumsum(counts) - counts
    log_w = np.log(weights)
    out = np.empty((len(counts), hashes), np.uint64)
    for j in range(hashes):
        bits = (values ^ U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * U64(0xBF58476D1CE4E5B9)
        bits ^= bits >> U64(32)
        r = gamma.take((bits & U64(0xFFFF)).astype(np.int32))
        beta = (bits >> U64(32)).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(log_w / r + beta)
        v = log_gamma.take(((bits >> U64(16)) & U64(0xFFFF)).astype(np.int32)) - r * (t - beta + 1)
        least = np.minimum.reduceat(v, starts)
        at = np.flatnonzero(v == np.repeat(least, counts))
        if len(at) > len(counts):  # ties: the first of each text
            at = at[np.unique(np.searchsorted(starts, at, "right"), return_index=True)[1]]
        out[:, j] = _mix(values[at] + t[at].astype(np.int64).astype(np.uint64) * U64(0xD1B54A32D192ED03))
    return out


def bands_of(sampled: np.ndarray) -> np.ndarray:
    out = np.empty((len(sampled), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(len(sampled), b + 1, np.uint64)
        for i in range(ROWS):
            value = _mix(value * U64(0x9E3779B97F4A7C15) + sampled[:, b * ROWS + i])
        out[:, b] = value
    return out.view(np.int64)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    done = 0
    texts = batch.column("text").to_pylist()
    for group in slices(texts, SLICE):
        yield done, group
        done += len(group)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Count-min sketch of shingles' document frequencies over all documents, and the number of documents.

    A task counts into one fixed array; arrays are added by blocks, so neither tasks nor the driver hold more than it.
    """
    width, block = 1 << WIDTH_BITS, 1 << 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((DEPTH, width), np.int64)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for _, group in _groups(batch):
                values = shingles(group)[0]
                for d, cell in enumerate(_cells(values)):
                    held[d] += np.bincount(cell, minlength=width)
        if rows:
            flat = held.astype("<i8").reshape(-1, block)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(flat))]), pa.array([np.int64(rows).tobytes(), *[x.tobytes() for x in flat]], pa.binary())], ["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total = total + np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    parts = docs.select(text_of().alias("text")).mapInArrow(run, "block long, counts binary")
    schema = "block long, counts binary"
    # two steps: one task adds the arrays of some tasks only
    some = parts.groupBy("block", F.pmod(F.spark_partition_id(), F.lit(32)).alias("salt")).applyInArrow(add, schema)
    rows = {r[0]: np.frombuffer(r[1], "<i8") for r in some.groupBy("block").applyInArrow(add, schema).collect()}
    if not rows:
        return np.zeros((DEPTH, width), np.int64), 0
    return np.concatenate([rows[i] for i in range(len(rows) - 1)]).reshape(DEPTH, width), int(rows[-1][0])


def sketched(docs: DataFrame, weights: Callable[[], Weights]) -> DataFrame:
    """doc_id, key and, for the first row of a key in each task, its bands and samples (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights()
        seen: set[bytes] = set()
        for batch in batches:
            for at, group in _groups(batch):
                values, tf, counts, key = shingles(group)
                keys = [k.tobytes() for k in key]
                bands: list[np.ndarray | None] = [None] * len(group)
                drawn: list[np.ndarray | None] = [None] * len(group)
                if len(values):
                    some = np.flatnonzero(counts)
                    sampled = samples(values, known.of(values, tf), counts[some])
                    for i, row, own in zip(some.tolist(), bands_of(sampled), sampled.astype(np.uint32).view(np.int32)):
                        if keys[i] not in seen:
                            seen.add(keys[i])
                            bands[i], drawn[i] = row, own
                columns = [batch.column("doc_id").slice(at, len(group)), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(drawn, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "bands", "samples"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, key binary, bands array<long>, samples array<int>")


def with_keys(docs: DataFrame, columns: Sequence[str], once: bool = False) -> DataFrame:
    """``columns`` and the key of each text; with ``once``, only the first row of a key in each task."""
    kept = docs.select(*columns)
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            keys: list[bytes] = []
            for group in slices(texts, SLICE):
                keys += [k.tobytes() for k in shingles(group)[3]]
            own = pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(keys, pa.binary())], [*columns, "key"])
            if once:
                fresh = []
                for k in keys:
                    fresh.append(k not in seen)
                    seen.add(k)
                own = own.filter(pa.array(fresh))
            yield own

    return kept.mapInArrow(run, T.StructType([*[kept.schema[c] for c in columns], T.StructField("key", T.BinaryType())]))


def verified(pairs: DataFrame, texts: DataFrame, weights: Callable[[], Weights]) -> DataFrame:
    """Exact weighted Jaccard similarity of pairs (key, other), key < other: key, other, similarity. ``texts``: key, text.

    The end with more pairs is the hub of a pair. A hub's text moves once per SPREAD pairs, the other end's once per pair,
    and both by one join with the texts. Rows are sorted, a hub before those compared with it, so a task holds the shingles
    of one hub and of a slice of a batch, and a hub with many pairs is spread over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights()
        held: tuple = (np.empty(0, np.uint64), np.empty(0, np.float32), 0.0)
        for batch in batches:
            hubs, leaves, at = batch.column("hub").to_pylist(), batch.column("leaf").to_pylist(), 0
            for group in slices(batch.column("text").to_pylist(), SLICE):
                values, tf, counts, _ = shingles(group)
                own = known.of(values, tf)
                edges = np.concatenate([[0], np.cumsum(counts)])
                near = []
                for i in range(len(group)):
                    a, wa = values[edges[i] : edges[i + 1]], own[edges[i] : edges[i + 1]]
                    total = float(wa.sum(dtype=np.float64))
                    if leaves[at + i] is None:
                        held = (a.copy(), wa.copy(), total)
                        continue
                    place = np.searchsorted(held[0], a)
                    hit = place < len(held[0])
                    hit[hit] = held[0][place[hit]] == a[hit]
                    shared = float(np.minimum(wa[hit], held[1][place[hit]]).sum(dtype=np.float64))
                    near.append((hubs[at + i], leaves[at + i], shared / (total + held[2] - shared)))
                at += len(group)
                if near:
                    columns = zip(*near)
                    yield pa.RecordBatch.from_arrays([pa.array(next(columns), pa.binary()), pa.array(next(columns), pa.binary()), pa.array(next(columns), pa.float64())], ["hub", "leaf", "similarity"])

    ends = pairs.select("key").union(pairs.select("other")).groupBy("key").agg(F.count("*").alias("n"))
    met = pairs.join(ends.withColumnRenamed("n", "n_key"), "key").join(ends.select(F.col("key").alias("other"), F.col("n").alias("n_other")), "other")
    first = F.col("n_key") >= F.col("n_other")
    met = met.select(F.when(first, F.col("key")).otherwise(F.col("other")).alias("hub"), F.when(first, F.col("other")).otherwise(F.col("key")).alias("leaf"), F.greatest("n_key", "n_other").alias("n"))
    met = met.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("n") / SPREAD)).alias("salt"))
    wanted = met.select("hub", "salt", "leaf", F.col("leaf").alias("key")).union(met.select("hub", "salt", F.lit(None).cast("binary"), "hub").distinct())
    rows = wanted.join(texts, "key").repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("leaf").asc_nulls_first())
    found = rows.select("hub", "leaf", "text").mapInArrow(run, "hub binary, leaf binary, similarity double")
    return found.select(F.least("hub", "leaf").alias("key"), F.greatest("hub", "leaf").alias("other"), "similarity")


def merged_labels(links: DataFrame, name: str) -> DataFrame:
    """Smallest reachable node of every node of the links (u, v): node, label.

    Rounds of the smallest neighbouring label and of pointer jumping, each written to the shared folder; the number of
    rounds grows with the logarithm of a chain's length.
    """
    both = stored(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label"))
    labels = earlier = stored(labels, f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        lower = stored(lower.join(jump, "label").select("node", "old", F.least("label", "jumped").alias("label")), f"{name}-labels")
        labels = lower.select("node", "label")
        settled = lower.where("old <> label").isEmpty()
        discard(earlier)
        earlier = lower
        if settled:
            discard(both)
            labels.stored_path = lower.stored_path
            return labels


def alike_links(cells: DataFrame, state: DataFrame, drawn: DataFrame, texts: DataFrame, weights: Callable[[], Weights], similarity: float) -> DataFrame:
    """Links (key, other) between the buckets' texts in different classes: all that matter for the classes.

    Every text outside a bucket's largest class is compared with every other text of the bucket, so all pairs of different
    classes are met and none within the largest. Buckets are cut into blocks of members and of texts that ask, and a task
    compares the samples of one block of each. Those with at least ALIKE equal samples meet again with their texts, and
    the task verifies their pairs where they are, in the first band that two texts share, the likeliest first, until
    a text has a link to each class that it can have one to. No pair leaves a task but such links.
    """
    labelled = cells.select("bucket", "band", "key").join(state.select("key", "label"), "key")
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("members"), F.max("n").alias("most"), F.count("*").alias("kinds"))
    sizes = sizes.where("kinds > 1").select("bucket", "main", F.ceil(F.col("members") / BLOCK).alias("blocks"), F.ceil((F.col("members") - F.col("most")) / ASKED).alias("turns"))
    rows = labelled.join(sizes, "bucket").join(drawn, "key").withColumn("minor", F.col("label") != F.col("main"))
    own = F.xxhash64("key", "bucket")
    kept = ["band", "key", "label", "minor", "samples"]
    members = rows.select("bucket", F.pmod(own, F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), *kept, F.lit(False).alias("asks"))
    asking = rows.where("minor").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(own, F.col("turns")).alias("turn"), *kept, F.lit(True).alias("asks"))
    columns = ["bucket", "block", "turn", *kept, "asks"]
    cut = BANDS, ROWS

    def alike(columns: np.ndarray, own: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Equal samples of the members (samples x members) with a text's own, and who is to be verified with it in this band."""
        same = columns == own[:, None]
        equal = same.sum(axis=0)
        return equal, (equal >= ALIKE) & (same.reshape(*cut, -1).all(axis=1).argmax(axis=0) == band)

    def near(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).combine_chunks()
        kind = np.unique(np.array(held.column("label").to_pylist(), object), return_inverse=True)[1]
        named = np.unique(np.array(held.column("key").to_pylist(), object), return_inverse=True)[1]
        drawn_ = held.column("samples").combine_chunks().flatten().to_numpy().reshape(held.num_rows, -1)
        asks, minor, band = held.column("asks").to_numpy(), held.column("minor").to_numpy(), held.column("band")[0].as_py()
        known = np.flatnonzero(~asks)
        across_ = np.ascontiguousarray(drawn_[known].T)
        used = np.zeros(held.num_rows, bool)
        for i in np.flatnonzero(asks):
            hit = alike(across_, drawn_[i], band)[1] & (kind[known] != kind[i]) & (~minor[known] | (named[known] > named[i]))
            used[known[hit]] = True
            used[i] = hit.any()
        for batch in held.filter(pa.array(used)).select(columns).to_batches():
            yield batch

    schema = "bucket long, block long, turn long, band int, key binary, label binary, minor boolean, samples array<int>, asks boolean"
    found = stored(members.union(asking).groupBy("bucket", "block", "turn").applyInArrow(near, schema), "dup-alike")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights()
        place, held, across_ = None, [], None
        for batch in batches:
            at, rows = 0, batch.drop_columns(["text"]).to_pylist()
            for group in slices(batch.column("text").to_pylist(), SLICE):
                values, tf, counts, _ = shingles(group)
                weight = known.of(values, tf)
                edges = np.concatenate([[0], np.cumsum(counts)])
                links = []
                for i, row in enumerate(rows[at : at + len(group)]):
                    a, wa = values[edges[i] : edges[i + 1]], weight[edges[i] : edges[i + 1]]
                    total, drawn_ = float(wa.sum(dtype=np.float64)), np.array(row["samples"], np.int32)
                    if (row["bucket"], row["block"], row["turn"]) != place:
                        place, held, across_ = (row["bucket"], row["block"], row["turn"]), [], None
                    if not row["asks"]:
                        held.append((row["key"], row["label"], row["minor"], drawn_, a.copy(), wa.copy(), total))
                        continue
                    if across_ is None:
                        across_ = np.stack([x[3] for x in held], axis=1)
                    equal, hit = alike(across_, drawn_, row["band"])
                    linked = {row["label"]}
                    for j in sorted(np.flatnonzero(hit).tolist(), key=lambda j: -equal[j]):
                        key, label, minor, _, b, wb, other = held[j]
                        if label in linked or (minor and key < row["key"]) or min(total, other) < (similarity - 1e-6) * max(total, other):
                            continue
                        spot = np.searchsorted(b, a)
                        there = spot < len(b)
                        there[there] = b[spot[there]] == a[there]
                        shared = float(np.minimum(wa[there], wb[spot[there]]).sum(dtype=np.float64))
                        if shared / (total + other - shared) >= similarity:
                            linked.add(label)
                            links.append((min(key, row["key"]), max(key, row["key"])))
                at += len(group)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links)], ["key", "other"])

    rows = found.join(texts, "key").repartition("bucket", "block", "turn").sortWithinPartitions("bucket", "block", "turn", "asks")
    links = stored(rows.select(*columns, "text").mapInArrow(run, "key binary, other binary").distinct(), "dup-links")
    discard(found)
    return links


def across(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs whose texts are in different classes, with the labels u and v."""
    named = pairs.join(state.select("key", F.col("label").alias("u")), "key").join(state.select(F.col("key").alias("other"), F.col("label").alias("v")), "other")
    return named.where("u <> v")


def linked_keys(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, label) of every key in a class of several texts; see ``_linked``."""
    with small_batches(docs.sparkSession, BATCH):
        return _linked(docs, similarity)


def _linked(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, label) of every key in a class of several texts.

    First, in each bucket that holds texts of several classes, CENTRES texts serve as centres that all texts of other classes
    are compared with, and then leave the bucket. Centres are the texts that were most similar, on average, to those they were
    compared with so far: in a group of edited copies those near the original. These rounds join large groups at little
    cost and go on while they bring enough links (WORTH); what they leave is the finish's, so their number affects cost only. Then every
    bucket that is still mixed is finished by ``alike_links``. Pairs whose samples differ too much to be similar aren't verified.
    """
    spark = docs.sparkSession
    sketch, documents = frequencies(docs)
    sent = spark.sparkContext.broadcast((sketch, documents))  # 2**WIDTH_BITS * DEPTH counters, whatever the data
    weights = lambda: Weights(*sent.value)
    rows = stored(sketched(docs, weights), "dup-rows")
    members = rows.select("doc_id", "key")
    cells = stored(rows.where("bands IS NOT NULL").select("key", F.posexplode("bands").alias("band", "bucket")).distinct(), "dup-cells")
    shared = cells.groupBy("bucket").agg(F.count("*").alias("texts")).where("texts > 1").select("bucket")
    all_cells, cells = cells, stored(cells.join(shared, "bucket"), "dup-shared")
    discard(all_cells)
    keys = cells.select("key").distinct()
    texts = with_keys(docs.select(text_of().alias("text")), ["text"], once=True).join(keys, "key", "left_semi")
    texts = stored(texts.groupBy("key").agg(F.min("text").alias("text")), "dup-texts")
    state = stored(keys.select("key", F.col("key").alias("label"), F.lit(0.0).alias("likeness"), F.lit(0).cast("long").alias("tests"), F.lit(0).cast("long").alias("links")), "dup-state")
    drawn = stored(rows.where("samples IS NOT NULL").select("key", "samples").join(keys, "key", "left_semi").dropDuplicates(["key"]), "dup-samples")
    tested = None
    best_first = Window.partitionBy("bucket").orderBy(F.desc("mean"), F.desc("key"))
    while True:
        mean = F.col("likeness") / F.greatest("tests", F.lit(1))
        open_cells = cells.join(state.select("key", "label", mean.alias("mean")), "key")
        mixed = open_cells.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        turns = stored(open_cells.join(mixed, "bucket"), "dup-turns")
        if turns.isEmpty():
            break
        centres = turns.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= CENTRES)
        centres = stored(centres.select("bucket", F.col("key").alias("other"), F.col("label").alias("other_label")), "dup-centres")
        met = turns.join(centres, "bucket").where("label <> other_label")
        pairs = met.select(F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["key", "other"], "left_anti")
        alike = F.aggregate(F.zip_with("samples", "other_samples", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, x: a + x)
        pairs = pairs.join(drawn, "key").join(drawn.select(F.col("key").alias("other"), F.col("samples").alias("other_samples")), "other")
        pairs = stored(pairs.select("key", "other", (alike / (BANDS * ROWS)).alias("estimate")), "dup-pairs")
        checked = stored(verified(pairs.where(F.col("estimate") * (BANDS * ROWS) >= ALIKE - 0.5).select("key", "other"), texts, weights), "dup-checked")
        links = checked.where(F.col("similarity") >= similarity)
        named = links.join(state.select("key", F.col("label").alias("u")), "key").join(state.select(F.col("key").alias("other"), F.col("label").alias("v")), "other")
        named = stored(named.where("u <> v").select("u", "v").distinct(), "dup-named")
        merging, rows_open = named.count(), turns.count()
        found = merging > 0
        estimates = pairs.select("key", "estimate").union(pairs.select("other", "estimate")).groupBy("key").agg(F.sum("estimate").alias("more"), F.count("*").alias("times"))
        linked = links.select("key").union(links.select("other")).groupBy("key").agg(F.count("*").alias("linked"))
        after = state.join(estimates, "key", "left").join(linked, "key", "left")
        label, merged = F.col("label"), None
        if found:
            merged = merged_labels(named, "dup")
            after = after.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
            label = F.coalesce("to", "label")
        after = after.select(
            "key",
            label.alias("label"),
            (F.col("likeness") + F.coalesce("more", F.lit(0.0))).alias("likeness"),
            (F.col("tests") + F.coalesce("times", F.lit(0))).alias("tests"),
            (F.col("links") + F.coalesce("linked", F.lit(0))).alias("links"),
        )
        old = [state, cells, tested, turns, centres, pairs, checked, named, merged]
        state = stored(after, "dup-state")
        cells = stored(turns.select("bucket", "band", "key").join(centres.select("bucket", F.col("other").alias("key")), ["bucket", "key"], "left_anti"), "dup-open")
        new = pairs.select("key", "other")
        tested = stored(new if tested is None else tested.union(new), "dup-tested")
        discard(*old)
        if merging * WORTH < rows_open:
            break
    links = alike_links(cells, state, drawn, texts, weights, similarity)
    named = stored(across(links, state).select("u", "v").distinct(), "dup-named")
    old = [cells, drawn, tested, links, named, texts]
    if not named.isEmpty():
        merged = merged_labels(named, "dup")
        linked = links.select("key").union(links.select("other")).groupBy("key").agg(F.count("*").alias("linked"))
        after = state.join(linked, "key", "left").join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
        old += [state, merged]
        state = stored(after.select("key", F.coalesce("to", "label").alias("label"), (F.col("links") + F.coalesce("linked", F.lit(0))).alias("links")), "dup-state")
    discard(*old)
    return members, state.where("links > 0").select("key", "label")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Class of every document: doc_id, class_id (the smallest id of the class), class_size (rows).

    Texts of the same words, apart from case and white space, are one text; so null, empty and blank texts form one class.
    Null ids are kept and never name a class that has another id. Repeated rows are members each. Columns other than
    doc_id and text are left out, so their names can't clash. An empty table gives no rows.
    """
    members, labels = linked_keys(docs, similarity)
    exact = members.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    groups = stored(exact.join(labels, "key", "left").select("key", "least", "rows", F.coalesce("label", "key").alias("label")), "dup-keys")
    named = groups.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    return members.join(groups.select("key", "label").join(named, "label"), "key").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, columns: Sequence[str], similarity: float = SIMILARITY) -> DataFrame:
    """``columns`` (doc_id and text among them) of one document of each class: the one with the smallest id, nulls last."""
    members, labels = linked_keys(docs, similarity)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    exact = members.groupBy("key").agg(F.min(first).alias("least"))
    groups = exact.join(labels, "key", "left").select(F.col("key"), "least", F.coalesce("label", "key").alias("label"))
    kept = groups.groupBy("label").agg(F.min(F.struct("least", "key")).alias("m")).select(F.col("m.key").alias("kept_key"), F.col("m.least.doc_id").alias("kept_id"))
    copies = members.groupBy("key", "doc_id").agg(F.count("*").alias("copies"))
    kept = stored(kept.join(copies, (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("kept_key", "kept_id", "copies"), "dup-kept")
    keyed = with_keys(docs, list(columns))
    rows = keyed.join(kept, (F.col("key") == F.col("kept_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")))
    single = rows.where("copies = 1").select(*columns)
    if kept.where("copies > 1").isEmpty():
        return single
    return single.unionByName(rows.where("copies > 1").dropDuplicates(["kept_key"]).select(*columns))
