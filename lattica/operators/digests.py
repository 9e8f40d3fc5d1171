"""Ordered digests in two levels: chunks of rows, and a root of the chunks.

Tables are compared by roots; only the chunks of keys whose roots differ are compared, and only the rows of chunks that
differ. Each level is one aggregate; a group holds at most ``chunk`` rows, or one digest per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 65536


def _row(pos: str, columns: Sequence[str]) -> Column:
    """Text of a row; NULL and the empty string differ."""
    return F.concat_ws(",", F.col(pos).cast("string"), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])


def chunk_digests(df: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """SHA-256 of the rows of each chunk of positions, in order: keys, chunk, n_rows, digest. Repeated positions are
    ordered by their text, so the digest doesn't depend on partitions."""
    rows = df.select(*keys, F.floor(F.col(pos) / chunk).alias("chunk"), F.struct(F.col(pos).alias("p"), _row(pos, columns).alias("r")).alias("_e"))
    ordered = F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["r"])
    return rows.groupBy(*keys, "chunk").agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(ordered, "|"), 256).alias("digest"))


def root_digests(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SHA-256 of a key's chunk digests in order: keys, n_rows, root."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda e: F.concat_ws(":", e["chunk"].cast("string"), e["digest"]))
    return chunks.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(ordered, "|"), 256).alias("root"))


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Positions at which two tables differ, found by descent: keys, position, reason (changed, left only, right only).

    Rows that repeat a position are compared as a set, with their number. Keys must not be NULL.
    """
    keys = list(keys)
    sides = [chunk_digests(x, keys, pos, columns, chunk) for x in (left, right)]
    roots = [root_digests(x, keys).withColumnRenamed("root", f"_r{i}").drop("n_rows") for i, x in enumerate(sides)]
    odd_keys = roots[0].join(roots[1], keys, "full").where("NOT _r0 <=> _r1").select(*keys)
    parts = [x.join(odd_keys, keys, "left_semi").select(*keys, "chunk", F.col("digest").alias(f"_d{i}")) for i, x in enumerate(sides)]
    odd = parts[0].join(parts[1], [*keys, "chunk"], "full").where("NOT _d0 <=> _d1").select(*keys, "chunk")
    tagged = [
        x.withColumn("chunk", F.floor(F.col(pos) / chunk)).join(odd, [*keys, "chunk"], "left_semi").select(*keys, F.col(pos).alias("position"), _row(pos, columns).alias("_row"), F.lit(i).alias("_side"))
        for i, x in enumerate((left, right))
    ]
    own = [F.array_sort(F.collect_list(F.when(F.col("_side") == i, F.col("_row")))) for i in (0, 1)]
    both = tagged[0].union(tagged[1]).groupBy(*keys, "position").agg(own[0].alias("_a"), own[1].alias("_b")).where("_a <> _b")
    reason = F.when(F.size("_a") == 0, "right only").when(F.size("_b") == 0, "left only").otherwise("changed")
    return both.select(*keys, "position", reason.alias("reason"))


def prefix_identity(parent: DataFrame, child: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Per key of the parent: is the child the parent's rows, unchanged, followed by added ones?

    Columns: keys, kept (parent rows), added (child rows after the parent's last), broken (positions up to there that
    differ), first_broken, passed.
    """
    keys = list(keys)
    ends = parent.groupBy(*keys).agg(F.max(pos).alias("_end"), F.count("*").alias("kept"))
    placed = child.join(ends.select(*keys, "_end"), keys)
    added = placed.where(F.col(pos) > F.col("_end")).groupBy(*keys).agg(F.count("*").alias("added"))
    bad = differences(parent, placed.where(F.col(pos) <= F.col("_end")).drop("_end"), keys, pos, columns, chunk)
    bad = bad.groupBy(*keys).agg(F.count("*").alias("broken"), F.min("position").alias("first_broken"))
    out = ends.drop("_end").join(added, keys, "left").join(bad, keys, "left").na.fill(0, ["added", "broken"])
    return out.select(*keys, "kept", "added", "broken", "first_broken", (F.col("broken") == 0).alias("passed"))
