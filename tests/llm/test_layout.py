"""Mixing, resharding and token shards."""

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lattica.llm import bpe, mixing, reshard, token_shards


def filled(sizes, share=1.5, most=2):
    """Targets by the rule, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(docs):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sizes = defaultdict(int)
    rows = docs.select("doc_id", "text", "source").collect()
    for r in rows:
        sizes[r.source] += len(words.findall(r.text or ""))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert sorted(r["size"] for r in out) == sorted(len(words.findall(r.text or "")) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    return sizes, filled(sizes), rows, out


def test_mix_meets_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes, target, rows, out = check_mix(docs)
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= len(sizes) + 1 for s in sizes)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_mix_order_is_fair(spark, small):
    """In every prefix of the mix each source has about its share."""
    line = mixing.queue(spark.read.parquet(f"{small}/documents.parquet")).orderBy("position").collect()
    assert [r.position for r in line] == list(range(len(line)))
    largest = max(r["size"] for r in line)
    done, total = defaultdict(int), {r.source_size: r.target for r in line}
    for r in line:
        done[r.source_size] += r.taken
        if sum(done.values()) > sum(total.values()) / 2:
            break
    assert all(abs(done[s] - t / 2) <= largest + t / 20 for s, t in total.items())


def test_mix_odd_rows(stored_odd, no_documents):
    _, target, _, out = check_mix(stored_odd)
    assert sum(r.taken for r in out) == int(1.5 * sum(r["size"] for r in out))
    assert {round(r.target, 3) for r in out} == {round(t, 3) for t in target.values()}
    assert mixing.mix(no_documents).count() == 0
    kept = mixing.mixed_documents(stored_odd, ["doc_id", "text", "lang", "source", "n_chars"])
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.where("doc_id = 3").count() == 1


def test_flow_is_minimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, m = rng.integers(1, 4), rng.integers(1, 4)
        supply = [int(x) for x in rng.integers(0, 4, n)]
        capacity = [int(x) for x in rng.integers(0, 4, m)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[int(x) for x in rng.integers(0, 5, m)] for _ in range(n)]
        flow = reshard.min_cost_flow(supply, capacity, cost)
        assert [sum(f) for f in flow] == supply
        assert all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
        found = sum(cost[i][j] * flow[i][j] for i in range(n) for j in range(m))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        best = min(
            sum(cost[i][j] for i, j in zip(units, to)) for to in itertools.product(range(m), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(m))
        )
        assert found == best
    with pytest.raises(ValueError):
        reshard.min_cost_flow([3], [2], [[0]])


def check_shards(docs, spread):
    rows = docs.select("doc_id", "text").collect()
    out = reshard.digests(docs).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in out) == want
    shards = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        shards[r.shard].append(r)
    for held in shards.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    if spread is not None:
        size = [sum(r["size"] for r in shards[s]) for s in range(16)]
        assert max(size) - min(size) <= spread * sum(size) / 16
    return out


def test_shards_are_equal(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_shards(docs, 0.25)
    hot = docs.union(docs.where("doc_id = 1").withColumn("doc_id", F.explode(F.sequence(F.lit(1000), F.lit(1399)))).select(*docs.columns))
    check_shards(hot, 0.25)


def test_few_bytes_move(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    where = defaultdict(set)
    for r in reshard.reshard(docs).select("text", "shard").collect():
        where[r.text or ""].add(r.shard)
    copies = defaultdict(int)
    for r in docs.select("text").collect():
        copies[r.text or ""] += len((r.text or "").encode()) + 1
    assert all(len(where[t]) == 1 for t, n in copies.items() if n <= sum(copies.values()) // 16 // 8)
    sizes = reshard.block_sizes(reshard.sized(docs, F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(12))))
    plan = reshard.plan_transfers(sizes, 16)
    total = int(sizes["bytes"].sum())
    least = sum(max(0, int(b) - total // 16) for b in sizes.groupby("old_shard")["bytes"].sum())
    assert least * 0.9 <= reshard.moved_bytes(plan) <= least * 1.15


def test_untouched_shards_stay(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = reshard.sized(docs, F.when(F.col("doc_id") < 100, 0).otherwise(1))
    sizes = reshard.block_sizes(rows)
    size = sizes.groupby("old_shard")["bytes"].sum()
    capacity = [int(size[0]), int(size[1]) // 2, int(size[1]) - int(size[1]) // 2]
    plan = reshard.plan_transfers(sizes, 3, capacity)
    new = reshard.rewrite({0: "/old/0", 1: "/old/1"}, plan, rows, str(tmp_path / "new"))
    assert new[0] == ["/old/0"] and set(new) == {0, 1, 2}
    got = spark.read.schema("doc_id long, text string, shard int").parquet(str(tmp_path / "new"))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.where("doc_id >= 100").collect()}
    assert {r.shard for r in got.select("shard").distinct().collect()} == {1, 2}


def test_shards_odd_rows(stored_odd, no_documents):
    check_shards(stored_odd, None)
    assert reshard.digests(no_documents).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(count):
    index = np.arange(count)
    slots = token_shards.permuted(index, count)
    assert sorted(slots.tolist()) == list(range(count))
    assert np.array_equal(token_shards.permuted(slots, count, back=True), index)
    if count > 100:
        assert abs(np.corrcoef(index, slots)[0, 1]) < 0.2
        assert not np.array_equal(slots, token_shards.permuted(index, count, key=7))


def sequence_stream(spark, folder, count, length, per_shard):
    rows = token_shards.read_slots(spark, folder, length=length, per_shard=per_shard).collect()
    assert sorted(r.slot for r in rows) == list(range(count))
    by = {r.slot: np.frombuffer(r.ids, "<u2") for r in rows}
    slots = token_shards.permuted(np.arange(count), count)
    return np.concatenate([by[s] for s in slots.tolist()]), rows


def test_token_shards_round_trip(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path, folder = public_tokenizers.path("byte_bpe_50k.tiktoken"), str(tmp_path / "t")
    count, places = token_shards.write_shards(docs, path, folder, length=128, per_shard=50, passes=3)
    stream, rows = sequence_stream(spark, folder, count, 128, 50)
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = sorted(bytes(x.tobytes()) for x in np.split(stream, np.flatnonzero(stream == token_shards.END_MARK) + 1) if len(x))
    want = sorted(np.append(np.array(coder.encode_ordinary(r.text), "<u2"), np.uint16(token_shards.END_MARK)).tobytes() for r in docs.collect())
    assert got == want
    assert all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * (16 + 256 + 1) for r in rows)
    assert sorted(d for r in places.collect() for d in r.doc_ids) == sorted(r.doc_id for r in docs.collect())
    part = token_shards.read_slots(spark, folder, 70, 130, length=128, per_shard=50)
    assert sorted(r.slot for r in part.collect()) == list(range(70, 130))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("part-*")}
    lost = sorted(files)[0]
    lost.unlink()
    again, _ = token_shards.write_shards(docs, path, folder, length=128, per_shard=50, passes=3)
    now = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("part-*")}
    assert again == count and len(now) == len(files) and sum(f not in files for f in now) <= 1
    assert np.array_equal(sequence_stream(spark, folder, count, 128, 50)[0], stream)


def test_token_shards_odd_rows(spark, stored_odd, no_documents):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = token_shards.digests(stored_odd, path).collect()
    assert sum(r.documents for r in rows) == stored_odd.count() == sum(len(r.doc_ids) for r in rows)
    assert token_shards.digests(no_documents, path).count() == 0
