"""Training-order materialisation: token sequences in a keyed pseudorandom order, in shards of fixed-stride records.

Documents are encoded, joined by end marks and cut into sequences of equal length. A Feistel permutation with cycle walking
gives every sequence a global slot: no sort decides the order, a key and the number of sequences do, and the inverse
finds the sequence of any slot. Shard s holds slots s * per_shard and on; every record has the same number of bytes, so a
reader finds a slot by arithmetic and can resume anywhere.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import freed_shuffles, stored, text_of
from lattica.session import shared_folder

LENGTH = 2048
PER_SHARD = 4096
PASSES = 4
KEY = 0x5EED
ROUNDS = 4
HEADER = 16  # slot (8 bytes), tokens (4), end marks (4); then the tokens, 2 bytes each, and a line feed
END_MARK = 50_256
U64 = np.uint64


def _round(half: np.ndarray, key: int, turn: int) -> np.ndarray:
    x = (half + U64((key + 0x9E3779B97F4A7C15 * (turn + 1)) & (1 << 64) - 1)) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(31))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(29))


def _feistel(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    mask, shift = U64((1 << bits) - 1), U64(bits)
    left, right = x >> shift, x & mask
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_round(left, key, turn) & mask), left
        else:
            left, right = right, left ^ (_round(right, key, turn) & mask)
    return (left << shift) | right


def permuted(index: np.ndarray, count: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """Slots of indices in a bijection of 0 .. count - 1 (or, with ``back``, the indices of slots).

    The Feistel network permutes the next even power of two; a value beyond ``count`` is permuted again until it is within.
    """
    bits = max(1, -(-max(1, count - 1).bit_length() // 2))
    out = _feistel(np.asarray(index, np.uint64), bits, key, back)
    while (out >= U64(count)).any():
        far = out >= U64(count)
        out[far] = _feistel(out[far], bits, key, back)
    return out.astype(np.int64)


def sequences(docs: DataFrame, ranks_path: str, length: int = LENGTH, pattern: str | None = None) -> DataFrame:
    """Sequences of ``length`` tokens: tokens (how many are real), doc_ids (of the documents that end in it), ids (16-bit
    little-endian, unpadded), _part and _pos (its place).

    The documents of a task follow each other, each closed by an end mark; only a task's last sequence may be short. Null
    and empty texts are an end mark alone, null ids stay null in the list, repeated rows are encoded each.
    """
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        held: list[np.ndarray] = []
        size = 0
        closed: list[tuple[int, int | None]] = []  # tokens up to and with each end mark since the last cut, document

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal held, size, closed
            stream = np.concatenate(held)
            count = -(-size // length) if last else size // length
            ids = [stream[i * length : (i + 1) * length] for i in range(count)]
            docs_in: list[list[int | None]] = [[] for _ in range(count)]
            rest = []
            for at, doc in closed:
                if (i := (at - 1) // length) < count:
                    docs_in[i].append(doc)
                else:
                    rest.append((at - count * length, doc))
            held, size, closed = [stream[count * length :]], max(0, size - count * length), rest
            return pa.RecordBatch.from_arrays(
                [pa.array([len(x) for x in ids], pa.int32()), pa.array(docs_in, pa.list_(pa.int64())), pa.array([x.tobytes() for x in ids], pa.binary())], ["tokens", "doc_ids", "ids"]
            )

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(coder.encode_to_numpy(text), END_MARK).astype("<u2")
                held.append(ids)
                size += len(ids)
                closed.append((size, doc))
                if size >= 256 * length:
                    yield cut(False)
        if size:
            yield cut(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    made = rows.mapInArrow(run, "tokens int, doc_ids array<long>, ids binary")
    return made.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def _records(rows: DataFrame, count: int, key: int, length: int, per_shard: int, first: int, stop: int, ids: bool) -> DataFrame:
    """slot, shard and, with ``ids``, the record of every sequence with a slot in first .. stop - 1; else its doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permuted(batch.column("index").to_numpy(), count, key)
            take = np.flatnonzero((slot >= first) & (slot < stop))
            slot = slot[take]
            part = batch.take(pa.array(take))
            if ids:
                out = np.zeros((len(take), HEADER + 2 * length), np.uint8)
                out[:, :8] = slot.astype("<i8")[:, None].view(np.uint8)
                out[:, 8:12] = part.column("tokens").to_numpy().astype("<i4")[:, None].view(np.uint8)
                out[:, 12:16] = np.array([len(x) for x in part.column("doc_ids").to_pylist()], "<i4")[:, None].view(np.uint8) if len(take) else 0
                for row, x in zip(out, part.column("ids").to_pylist()):
                    row[HEADER : HEADER + len(x)] = np.frombuffer(x, np.uint8)
                last = pa.array([r.tobytes() for r in out], pa.binary())
            else:
                last = part.column("doc_ids")
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), last], ["slot", "shard", "record" if ids else "doc_ids"])

    wanted = rows if ids else rows.drop("ids")
    return wanted.mapInArrow(run, f"slot long, shard long, {'record binary' if ids else 'doc_ids array<long>'}")


def write_shards(docs: DataFrame, ranks_path: str, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, passes: int = PASSES, pattern: str | None = None) -> tuple[int, DataFrame]:
    """Write all shards under ``folder`` (shard=N/part file); the number of sequences, and a table of slot, shard and doc_ids.

    Equal files under equal split settings give equal slots. Shards are written in ``passes`` over consecutive slots, so
    that only a part of all records is in the shuffle at a time. Shards that a folder already holds whole are left as they
    are, so a stopped job can be repeated with the stored sequences. An empty table writes nothing.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/sequences-{uuid.uuid4().hex}"
    sequences(docs, ranks_path, length, pattern).write.option("compression", "zstd").parquet(path)
    made = spark.read.parquet(path)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = made.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = made.join(F.broadcast(before), "_part").withColumn("index", F.col("before") + F.col("_pos")).drop("_part", "_pos", "before")  # a row per task
    count = made.count()
    shards = -(-count // per_shard)
    for i in range(passes):
        first, stop = shards * i // passes, shards * (i + 1) // passes
        if first == stop:
            continue
        part = _records(rows, count, key, length, per_shard, first * per_shard, stop * per_shard, True)
        there = present_shards(spark, folder, length, per_shard, count)
        if there is not None:
            part = part.join(there, "shard", "left_anti")
        lines = part.repartitionById(stop - first, (F.col("shard") - first).cast("int")).sortWithinPartitions("shard", "slot")
        with freed_shuffles(spark):
            lines.select(F.col("record").cast("string").alias("value"), "shard").write.partitionBy("shard").mode("append").text(folder)
    return count, _records(rows, count, key, length, per_shard, 0, count, False)


def _files(spark: SparkSession, folder: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    except AnalysisException:  # no such folder yet
        return None


def present_shards(spark: SparkSession, folder: str, length: int, per_shard: int, count: int) -> DataFrame | None:
    """Shards whose file is whole, by its length: shard. None if the folder isn't there."""
    files = _files(spark, folder)
    if files is None:
        return None
    stride = HEADER + 2 * length + 1
    files = files.select(F.col("shard").cast("long").alias("shard"), "length") if "shard" in files.columns else files.select(F.lit(-1).cast("long").alias("shard"), "length")
    return files.where(F.col("length") == F.least(F.lit(per_shard), F.lit(count) - F.col("shard") * per_shard) * stride).select("shard").distinct()


def read_slots(spark: SparkSession, folder: str, first: int = 0, stop: int | None = None, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Records of slots first .. stop - 1 (all without ``stop``): slot, shard, byte_offset, tokens, documents, ids.

    Only the shards of the range are opened; a file is cut into records by its stride. A record whose slot doesn't match
    its place raises an error.
    """
    stride = HEADER + 2 * length + 1
    files = _files(spark, folder)
    if files is None or "shard" not in files.columns:
        return spark.createDataFrame([], "slot long, shard long, byte_offset long, tokens int, documents int, ids binary")
    files = files.where(F.col("shard") >= first // per_shard)
    if stop is not None:
        files = files.where(F.col("shard") <= (stop - 1) // per_shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                slots = np.arange(len(raw)) + shard * per_shard
                some = np.flatnonzero((slots >= first) & (slots < (stop if stop is not None else 1 << 62)))
                for at in range(0, len(some), 1024):
                    part = some[at : at + 1024]
                    rows = raw[part]
                    if not (np.array_equal(rows[:, :8].copy().view("<i8")[:, 0], slots[part]) and (rows[:, -1] == 10).all()):
                        raise ValueError(f"shard {shard} doesn't hold its slots")
                    tokens = rows[:, 8:12].copy().view("<i4")[:, 0]
                    ids = [r[HEADER : HEADER + 2 * n].tobytes() for r, n in zip(rows, tokens)]
                    columns = [pa.array(slots[part]), pa.array(np.full(len(part), shard, np.int64)), pa.array(part * stride), pa.array(tokens, pa.int32()), pa.array(rows[:, 12:16].copy().view("<i4")[:, 0], pa.int32()), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "tokens", "documents", "ids"])

    return files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(run, "slot long, shard long, byte_offset long, tokens int, documents int, ids binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """What the written shards hold, slot by slot: slot, shard, byte_offset, tokens, documents, ids_crc32, doc_ids."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    _, places = write_shards(docs, ranks_path, folder)
    read = read_slots(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return read.join(stored(places, "token-places").drop("shard"), "slot")
