"""Mixing sources to target weights by weighted fair queueing.

Every source serves its documents in a shuffled order at a rate equal to its target, as often as needed. A document's
virtual finish time is the source's words up to and with it, divided by the target. All documents are sorted by that time
across sources and the mix ends where the budget does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import numbered, stored, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = 20240607


def target_sizes(sources: DataFrame, share: float, most: int) -> DataFrame:
    """Targets of sources (``source_size``, ``weight``): together ``share`` times all sizes, by weight; a target stops at
    ``most`` times its source, and the excess goes to the others by weight until none is above.

    Each round is one aggregate over the sources. Sizes stay integers, so reruns agree. ``share`` must not exceed ``most``.
    """
    if share > most:
        raise ValueError("the share can't exceed what repeats allow")
    full = F.lit(False)
    held, level = -1, 0.0
    while True:
        row = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if row[3] == held:
            break
        held = row[3]
        if row[2] is None:
            level = None
            break
        level = (share * (row[0] or 0) - most * (row[1] or 0)) / row[2]
        full = F.col("source_size") * most <= F.col("weight") * level
    limit = (F.col("source_size") * most).cast("double")
    return sources.withColumn("target", limit if level is None else F.least(limit, F.col("weight") * F.lit(float(level))))


def queue(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """The mix: a row for every stretch of words served, in serving order.

    Columns: row (a number for each input row), doc_id, size (words), source_size, target, copy (0 for the first
    service), taken (words of this stretch that are in the budget), position (gapless in serving order) and ``keep``.

    A null text has no words, a null source is a source of its own, the last in order. Ties in the shuffled order are
    equal rows and follow their place in storage. Repeated rows count each. A stretch that crosses its source's target is
    cut there, so that the mix meets the targets to the word. Empty input gives no rows. Columns that aren't asked for
    are left out, so their names can't clash.
    """
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text_of()).alias("shuffled"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    sizes = stored(sizes, "mix-sizes")
    per_source = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-source-sizes")
    ranked = numbered(per_source, [F.col("source").asc_nulls_last()], "rank", "mix-sources", total="source_size", before="earlier")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    sources = stored(target_sizes(stored(ranked, "mix-ranks"), share, most), "mix-targets")

    rows = numbered(sizes, [F.col("source").asc_nulls_last(), F.col("shuffled")], "row", "mix-order", total="size", before="all_before")
    rows = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.row", "d.doc_id", "d.size", "s.source_size", "s.target", "s.rank", *[f"d.kept_{c}" for c in keep],
        (F.col("d.all_before") - F.col("s.earlier")).alias("before"),
    )
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    start = F.col("copy") * F.col("source_size") + F.col("before")
    stop = start + F.col("size")
    horizon = F.floor("target")
    cut = F.when((start < horizon) & (horizon < stop), F.array(F.struct(start.alias("start"), horizon.alias("stop")), F.struct(horizon.alias("start"), stop.alias("stop"))))
    whole = F.array(F.struct(start.alias("start"), stop.alias("stop")))
    stretches = copies.withColumn("stretch", F.explode(F.coalesce(cut, whole))).drop("before")
    stretches = stretches.withColumn("words", F.col("stretch.stop") - F.col("stretch.start")).withColumn(
        "finish", F.when(F.col("target") > 0, F.col("stretch.stop") / F.col("target")).otherwise(0.0)
    )
    budget = int(share * (sources.agg(F.sum("source_size")).first()[0] or 0))
    line = numbered(stored(stretches, "mix-stretches"), [F.col("finish"), F.col("rank"), F.col("stretch.start"), F.col("row")], "position", "mix-line", total="words", before="served")
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("served")))
    return line.select("row", "doc_id", "size", "source_size", "target", "copy", taken.cast("long").alias("taken"), "position", *[F.col(f"kept_{c}").alias(c) for c in keep])


def mix(docs: DataFrame, **options) -> DataFrame:
    """Words that the mix takes of every document, repeats counted: doc_id, size, source_size, target, taken."""
    return (
        queue(docs, **options)
        .groupBy("row")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"))
        .drop("row")
    )


def mixed_documents(docs: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """The documents of the mix, whole: a row for every service that is taken by at least half, with ``columns``.

    Only the one document of a source that meets its target is rounded; a document without words is served once. The queue
    runs on sizes and hashes; texts move once, to meet their number of services. Rows that are equal in all ``columns``
    share theirs.
    """
    keys = ["_mix_a", "_mix_b"]
    own = docs.select(*columns).withColumn("_mix_a", F.xxhash64(*columns)).withColumn("_mix_b", F.xxhash64(F.lit(1), *columns))
    line = queue(own, keep=keys, **options)
    copies = line.groupBy("row", "copy").agg(*[F.first(c).alias(c) for c in (*keys, "size")], F.sum("taken").alias("taken"))
    served = F.when(F.col("size") == 0, F.col("copy") == 0).otherwise(F.col("taken") * 2 >= F.col("size"))
    each = copies.groupBy("row").agg(*[F.first(k).alias(k) for k in keys], F.count(F.when(served, 1)).alias("services"))
    services = stored(each.groupBy(*keys).agg(F.sum("services").alias("_services"), F.count("*").alias("_rows")).where("_services > 0"), "mix-services")
    found = own.join(services, keys)
    rows = found.where("_rows = 1")
    if not services.where("_rows > 1").isEmpty():
        rows = rows.unionByName(found.where("_rows > 1").dropDuplicates(keys))
    return rows.withColumn("_service", F.explode(F.sequence(F.lit(1), F.col("_services")))).select(*columns)
