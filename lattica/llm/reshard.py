"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new ones of given capacity.

Rows are known by blocks and parts (hashes of the text, so equal texts share both; only a text whose copies fill a good share
of a shard is cut into pieces by document). Their sizes, a table whose length depends on parameters alone, are enough to solve the flow between shards and
to pick the blocks that carry it. Then each affected shard's files are written once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import freed_shuffles, partitions, text_of
from lattica.session import shared_folder

OLD, NEW = 12, 16
BLOCKS, PARTS = 128, 64
LARGE = 64  # a block above a shard's capacity divided by this is split into its parts
HEAVY = 8  # a text whose copies are above a shard's capacity divided by this is split into pieces


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Integer flow from supplies to capacities with the least cost (successive shortest paths with potentials).

    Works on shards, never on rows. Raises ValueError if the capacities are too small.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities are smaller than the shards")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost; the reverse is at index ^ 1
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, x in enumerate(supply):
        add(source, i, x, 0)
    for j, x in enumerate(capacity):
        add(n + j, sink, x, 0)
    first = len(edges)
    for i in range(n):
        for j in range(m):
            add(i, n + j, supply[i], cost[i][j])
    potential = [0] * (n + m + 2)
    left = sum(supply)
    while left:
        far: dict[int, int] = {source: 0}
        via: dict[int, int] = {}
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, price = edges[e]
                if room and (x := d + price + potential[a] - potential[b]) < far.get(b, 1 << 62):
                    far[b], via[b] = x, e
                    heapq.heappush(heap, (x, b))
        for a, d in far.items():
            potential[a] += d
        path, a = [], sink
        while a != source:
            path.append(via[a])
            a = edges[via[a] ^ 1][0]
        amount = min(left, *(edges[e][1] for e in path))
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
        left -= amount
    return [[edges[first + 2 * (i * m + j) + 1][1] for j in range(m)] for i in range(n)]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def sized(docs: DataFrame, old_shard: Column, blocks: int = BLOCKS, parts: int = PARTS, shards: int = NEW) -> DataFrame:
    """doc_id and text of every row with its old shard, block, part, piece and size (UTF-8 bytes of the text and 1).

    Piece is 0 but for heavy texts; there are fewer than ``shards`` * HEAVY of those.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        old_shard.cast("int").alias("old_shard"),
        F.pmod(F.xxhash64(text_of()), F.lit(blocks)).cast("int").alias("block"),
        F.pmod(F.xxhash64(F.lit(1), text_of()), F.lit(parts)).cast("int").alias("part"),
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.xxhash64(text_of()).alias("_a"),
        F.xxhash64(F.lit(2), text_of()).alias("_b"),
    )
    limit = max(1, (rows.agg(F.sum("size")).first()[0] or 0) // shards // HEAVY)
    heavy = rows.groupBy("_a", "_b").agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") > limit).select("_a", "_b", F.lit(True).alias("_heavy"))
    piece = F.when(F.col("_heavy"), 1 + F.pmod(F.xxhash64("doc_id", "_a"), F.lit(parts))).otherwise(0).cast("int")
    return rows.join(F.broadcast(heavy), ["_a", "_b"], "left").withColumn("piece", piece).drop("_a", "_b", "_heavy")


UNIT = ["old_shard", "block", "part", "piece"]


def block_sizes(rows: DataFrame) -> pd.DataFrame:
    """Bytes by old shard, block, part and piece: the first three's product of rows and PARTS for each heavy text at most."""
    return rows.groupBy(*UNIT).agg(F.sum("size").alias("bytes")).orderBy(*UNIT).toPandas()


def plan_transfers(sizes: pd.DataFrame, shards: int, capacity: list[int] | None = None, cost: list[list[int]] | None = None) -> pd.DataFrame:
    """New shard of every (old_shard, block, part, piece): columns of ``sizes`` and shard.

    A byte that stays costs nothing, any other one, unless ``cost`` says otherwise. Blocks are dealt in falling size to the
    transfer with most room left, so the transfers are met to about the smallest block.
    """
    total = int(sizes["bytes"].sum())
    olds = sorted({int(x) for x in sizes["old_shard"]})
    capacity = capacity or equal_capacities(total, shards)
    cost = cost or [[int(i != j) for j in range(shards)] for i in olds]
    supply = [int(sizes.loc[sizes["old_shard"] == i, "bytes"].sum()) for i in olds]
    flow = min_cost_flow(supply, capacity, cost) if olds else []
    large = max(1, total // shards // LARGE)
    units: dict[tuple[int, int], dict[tuple[int, ...], tuple[int, list[int]]]] = defaultdict(dict)
    for (old, block), group in sizes.groupby(["old_shard", "block"]):
        if int(group["bytes"].sum()) <= large:
            units[int(old)][(int(block),)] = (int(group["bytes"].sum()), list(group.index))
        else:
            for row in group.itertuples():
                units[int(old)][(int(block), int(row.part), int(row.piece))] = (int(row.bytes), [row.Index])
    shard = [0] * len(sizes)
    for old, room in zip(olds, flow):
        room = list(room)
        for _, (size, at) in sorted(units[old].items(), key=lambda item: (-item[1][0], item[0])):
            j = max(range(shards), key=lambda k: (room[k], -k))
            room[j] -= size
            for i in at:
                shard[i] = j
    return sizes.assign(shard=shard)


def moved_bytes(plan: pd.DataFrame) -> int:
    return int(plan.loc[plan["old_shard"] != plan["shard"], "bytes"].sum())


def write_shards(rows: DataFrame, plan: pd.DataFrame, folder: str) -> DataFrame:
    """Rows in the shards of the plan, written under ``folder`` as shard=N and read back, with each row's slot.

    A range sort by shard and hash fills the files; a slot is a row's place in its shard, gapless from 0.
    """
    spark = rows.sparkSession
    where = spark.createDataFrame(plan[[*UNIT, "shard"]], "old_shard int, block int, part int, piece int, shard int")
    placed = rows.join(F.broadcast(where), UNIT)  # bounded by the number of blocks, parts and heavy texts
    laid = (
        placed.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), "shard", F.xxhash64("doc_id", text_of()), "_tie")
        .sortWithinPartitions("shard", F.xxhash64("doc_id", text_of()), "_tie")
        .select("doc_id", "text", "shard", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"))
    )
    with freed_shuffles(spark):
        laid.write.partitionBy("shard").parquet(folder)
    written = spark.read.schema("doc_id long, text string, _part int, _pos long, shard int").parquet(folder)
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = written.groupBy("shard", "_part").agg(F.count("*").alias("_rows"), F.min("_pos").alias("_first"))
    pieces = pieces.select("shard", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"))
    return written.join(F.broadcast(pieces), ["shard", "_part"]).select("doc_id", "text", "shard", (F.col("_offset") + F.col("_pos")).alias("slot"))  # at most a row per file


def rewrite(layout: dict[int, str], plan: pd.DataFrame, rows: DataFrame, folder: str) -> dict[int, list[str]]:
    """Folders of each new shard after the plan's transfers over a stored layout (old shard -> folder).

    ``rows`` are the stored layout's rows as ``sized`` gives them. A shard that loses blocks is rewritten, one that only
    gains gets new files beside its own, and one without transfers keeps its folder untouched.
    """
    moves = plan[plan["old_shard"] != plan["shard"]]
    losing = sorted({int(x) for x in moves["old_shard"]})
    part = plan[plan["old_shard"].isin(losing)]
    write_shards(rows.where(F.col("old_shard").isin(losing)), part, folder)
    out: dict[int, list[str]] = defaultdict(list)
    for shard, path in layout.items():
        if shard not in losing and (plan["old_shard"] == shard).any():
            out[shard].append(path)
    for shard in sorted({int(x) for x in part["shard"]}):
        out[shard].append(f"{folder}/shard={shard}")
    return dict(out)


def reshard(docs: DataFrame, old_shard: Column | None = None, shards: int = NEW, folder: str | None = None) -> DataFrame:
    """Documents moved from their old shards to ``shards`` of nearly equal bytes: doc_id, text, shard, slot.

    Without ``old_shard`` the old layout is by the text's checksum over 12 shards. Null texts count as empty, of one byte;
    equal rows are placed each; equal texts stay in one shard unless they fill more than an 8th of one. An empty table gives
    no rows. Other columns are left out, so their names can't clash.
    """
    import uuid

    if old_shard is None:
        old_shard = F.pmod(F.crc32(text_of().cast("binary")), F.lit(OLD))
    rows = sized(docs, old_shard, shards=shards)
    plan = plan_transfers(block_sizes(rows), shards)
    return write_shards(rows, plan, folder or f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}")


def digests(docs: DataFrame) -> DataFrame:
    """What the rewritten files hold: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return reshard(docs).select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
