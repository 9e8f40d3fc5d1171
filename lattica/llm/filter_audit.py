"""Filter interaction audit: what five text filters remove in every order, from a sparse document-term matrix.

Texts become CSR shards: a row per document, a column per word of one dictionary of all words, counts as entries. Row sums
and numbers of entries decide the two word filters; the flags of the others are attached, and counts of the 32 combinations
of failures answer all orders at once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import discard, stored, text_of
from lattica.llm.raw import encoded, grouped, joined, of_bytes, runs

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT, CAPITAL_PERCENT = 65, 5
SYMBOLS = b"#$%&*|"
SHARD = 1 << 24  # bytes of text in a shard
SALTS = 16
BLANK, SIGNS = of_bytes(b" \t\n\v\f\r"), of_bytes(SYMBOLS)
ROWS = "doc_ids array<long>, parts array<string>, keys array<binary>, flags array<int>, entries array<int>"


def squeezed(values: np.ndarray) -> bytes:
    """Small differences of neighbouring integers, compressed."""
    return pa.compress(np.diff(values, prepend=0).astype("<i4").tobytes(), codec="zstd", asbytes=True)


def spread(data: bytes, count: int) -> np.ndarray:
    """The integers that ``squeezed`` was given."""
    return np.cumsum(np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), "<i4"), dtype=np.int64) if count else np.empty(0, np.int64)


def term_shards(docs: DataFrame) -> DataFrame:
    """Shards of whole documents: their ids, parts, text digests, flags of the filters C and D (as bits), entries per row,
    the entries (columns as places in the shard's own words, and counts) and those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, texts in grouped(batch.column("text"), SHARD):
                raw, begins = joined(texts)
                inside = ~BLANK[raw]
                starts, ends = runs(inside)
                codes, words = encoded(raw, inside, starts, ends)
                row = np.searchsorted(begins, starts, "right") - 1
                cell, counts = np.unique(row * max(1, len(words)) + codes, return_counts=True)
                capitals = np.add.reduceat((raw >= 65) & (raw <= 90), begins, dtype=np.int64)
                points = np.add.reduceat((raw & 0xC0) != 0x80, begins, dtype=np.int64) - 1
                flags = 4 * (100 * capitals > CAPITAL_PERCENT * points) + 8 * (np.add.reduceat(SIGNS[raw], begins, dtype=np.int64) > 0)
                per_row = np.bincount(cell // max(1, len(words)), minlength=len(texts))
                columns = cell % max(1, len(words))
                lists = [
                    batch.column("doc_id").slice(at, len(texts)).to_pylist(),
                    batch.column("part").slice(at, len(texts)).to_pylist(),
                    [hashlib.sha256(x).digest() for x in texts],
                    flags.astype(np.int32),
                    per_row.astype(np.int32),
                ]
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32()]
                out = [pa.array([number]), *[pa.array([x], pa.list_(kind)) for x, kind in zip(lists, kinds)]]
                out += [pa.array([squeezed(columns)]), pa.array([squeezed(counts)])]
                out.append(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words))
                number += 1
                yield pa.RecordBatch.from_arrays(out, ["shard", "doc_ids", "parts", "keys", "flags", "entries", "columns", "counts", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    return rows.mapInArrow(run, f"shard long, {ROWS}, columns binary, counts binary, words array<binary>")


def dictionary(shards: DataFrame) -> DataFrame:
    """Every word of all shards once, with a gapless number from 0, written to the shared folder: word, id."""
    words = shards.select(F.explode("words").alias("word")).distinct()
    words = stored(words.select("word", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "audit-words")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = words.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    out = words.join(F.broadcast(before), "part").select("word", (F.col("before") + F.col("at")).alias("id"))  # one row per shuffle partition
    out.stored_path = words.stored_path
    return out


def csr_shards(docs: DataFrame) -> DataFrame:
    """CSR shards of the document-term matrix whose columns are the numbers of ``dictionary``.

    shard, doc_ids, parts, keys, flags, indptr (array of rows + 1 places), indices (binary, int64) and data (binary, int32).
    Only a shard's distinct words meet the dictionary, so no frequent word gathers its documents in one task. Rows keep
    their documents' order; indices ascend within a row.
    """
    local = stored(term_shards(docs), "audit-shards")
    known = dictionary(local)
    own = local.select("shard", F.posexplode("words").alias("place", "word")).join(known, "word")
    numbers = stored(own.groupBy("shard").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids")), "audit-numbers")
    discard(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                places = row.column("places").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                number = np.empty(len(places), np.int64)
                number[places] = row.column("ids").flatten().to_numpy(zero_copy_only=False)
                per_row = row.column("entries").flatten().to_numpy()
                indptr = np.concatenate([[0], np.cumsum(per_row, dtype=np.int64)])
                indices = number[spread(row.column("columns")[0].as_py(), int(indptr[-1]))]
                data = spread(row.column("counts")[0].as_py(), int(indptr[-1])).astype("<i4")
                order = np.lexsort((indices, np.repeat(np.arange(len(per_row)), per_row)))
                kept = [row.column(c) for c in ("shard", "doc_ids", "parts", "keys", "flags")]
                out = [*kept, pa.array([indptr], pa.list_(pa.int64())), pa.array([indices[order].astype("<i8").tobytes()]), pa.array([data[order].tobytes()])]
                yield pa.RecordBatch.from_arrays(out, ["shard", "doc_ids", "parts", "keys", "flags", "indptr", "indices", "data"])

    sent = local.drop("words").join(numbers, "shard", "left").select("shard", *[c.split()[0] for c in ROWS.split(", ")], "columns", "counts", "places", "ids")
    return sent.mapInArrow(run, f"shard long, {ROWS.rsplit(', ', 1)[0]}, indptr array<long>, indices binary, data binary")


def word_flags(csr: DataFrame) -> DataFrame:
    """A row per document: doc_id, part, key, words, distinct and mask, the failures of A to D as bits. Words are the row's sum,
    distinct words its number of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                indptr = row.column("indptr").flatten().to_numpy()
                sums = np.concatenate([[0], np.cumsum(np.frombuffer(row.column("data")[0].as_buffer(), "<i4"), dtype=np.int64)])
                words, distinct = np.diff(sums[indptr]), np.diff(indptr)
                mask = 1 * (words < LEAST_WORDS) + 2 * (100 * distinct < DISTINCT_PERCENT * words) + row.column("flags").flatten().to_numpy()
                out = [*[row.column(c).flatten() for c in ("doc_ids", "parts", "keys")], pa.array(words), pa.array(distinct), pa.array(mask.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "part", "key", "words", "distinct", "mask"])

    return csr.mapInArrow(run, "doc_id long, part string, key binary, words long, distinct long, mask int")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, words, distinct and mask (bits 0 to 4: the filter A to E fails) of every row of ``docs``.

    A null text is empty; a null source gives the part ''. A row with a null id has no smaller id, so it doesn't fail E, nor does it make
    others fail. Repeated rows count each and, having one id, don't fail E by each other. Texts are equal if their SHA-256
    are. Of all columns only doc_id, text and source are read, so clashing names don't matter. An empty table gives no rows.
    """
    rows = stored(word_flags(csr_shards(docs)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "audit-rows")
    some = rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    salted = some.select("key", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a text of very many copies spreads over tasks
    repeats = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.join(salted, ["key", "salt"], "left").select("doc_id", "part", "words", "distinct", (F.col("mask") + F.when(repeats, 16).otherwise(0)).alias("mask"))


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in itertools.permutations(filters)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, for every part: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    A document is good (toxic) if any label row of its id says so; null ids have no labels. No documents, no rows.
    See ``failures`` for nulls, empty texts, repeated rows and clashing columns.
    """
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good OR toxic")
    rows = stored(failures(docs).select("doc_id", "part", "mask"), "audit-flags")
    named = rows.where("doc_id IS NOT NULL").join(marked, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    named = named.unionByName(rows.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    one = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    groups = named.groupBy("part", "mask").agg(F.count("*").alias("documents"), one("good"), one("toxic"))
    sets = range(1 << len(FILTERS))
    passing = {c: [F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in sets] for c in ("documents", "good", "toxic")}
    times = {n: 120 // n for n in range(1, 6)}  # of all orders, those in which a given one of n filters comes first
    first = F.element_at(F.array(*[F.lit(times[n]) for n in times]), F.greatest(F.bit_count("mask"), F.lit(1)))
    per_filter = lambda amount, test: F.array(*[F.sum(F.when(test(1 << i), amount).otherwise(0)) for i in range(len(FILTERS))])
    fails = lambda bit: F.col("mask").bitwiseAND(bit) > 0
    parts = groups.groupBy("part").agg(
        *[F.array(*x).alias(f"passing_{c}") for c, x in passing.items()],
        per_filter(F.col("documents"), fails).alias("fails"),
        per_filter(F.col("documents"), lambda bit: F.col("mask") == bit).alias("unique"),
        per_filter(F.col("documents") * first, fails).alias("shares"),
    )
    lines = parts.withColumn("filter_order", F.explode(F.lit(orders()))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    lines = lines.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(F.contains(earlier, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    lines = lines.withColumn("before", before).withColumn("at", F.ascii("filter") - ord(FILTERS[0]) + 1)
    after = F.col("before") + F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("at"))
    lines = lines.withColumn("after", after)
    left = lambda c, where: F.element_at(f"passing_{c}", F.col(where) + 1)
    lost = lambda c: left(c, "before") - left(c, "after")
    return lines.select(
        "part", "filter_order", "step", "filter",
        left("documents", "after").alias("kept"),
        lost("documents").alias("removed"),
        (F.element_at("fails", F.col("at")) - lost("documents")).alias("redundant"),
        F.element_at("unique", F.col("at")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.element_at("shares", F.col("at")).alias("shapley"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
      WHEN 'A' THEN len(w) < 50 WHEN 'B' THEN 100 * len(list_distinct(w)) < 65 * len(w)
      WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)
      WHEN 'D' THEN regexp_matches(t, '[#$%&*|]') ELSE coalesce(doc_id > least, false) END) AS failed
  FROM d LEFT JOIN l USING (doc_id)
),
g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS filter, string_split(filter_order[1:step - 1], '') AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
    sum(CASE WHEN NOT list_has_any(failed, list_append(earlier, filter)) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN list_contains(failed, filter) AND NOT list_has_any(failed, earlier) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(failed, filter) AND list_has_any(failed, earlier) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = [filter] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN list_contains(failed, filter) AND NOT list_has_any(failed, earlier) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN list_contains(failed, filter) AND NOT list_has_any(failed, earlier) THEN toxic ELSE 0 END) AS toxic_lost
  FROM g CROSS JOIN s GROUP BY ALL
)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
