"""Masked pseudo-likelihood: a window network that predicts every token from both sides scores documents.

All words of all documents are counted. The most frequent ones are tokens of their own, the others share hashed tokens, and
a word's probability is that of its token times its own share of the token's occurrences. The table of counts grows with the
corpus and stays on Spark: shards of documents meet it by a join of their distinct words. The network, of fixed size, is
trained on all documents: in each round every task runs stochastic gradient steps over the masked tokens of its own
documents, and the tasks' networks are averaged. A document's score is the sum of log-probabilities of all its words, each
given its neighbours on both sides. Averages follow how the documents lie in tasks, so scores differ between splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.bpe import slices
from lattica.llm.common import discard, stored, text_of
from lattica.llm.filter_audit import spread, squeezed
from lattica.llm.neardup import SLICE, word_hashes

CLASSES = 32  # the output is a class of tokens, then one of CLASSES tokens in it
TOKENS = CLASSES * CLASSES
FREQUENT = 768  # the other tokens are shared by hash
SHARED = TOKENS - FREQUENT  # a power of two
SHARD = 1 << 24  # bytes of text whose distinct words meet the counts together
OFFSETS = (-2, -1, 1, 2)
SIZE = 32
MASKED = 0.15
ROUNDS = 2
BATCH = 4096
PAD = TOKENS

Net = list[np.ndarray]


class Model(NamedTuple):
    net: Net
    frequent: np.ndarray
    counts: DataFrame  # word (a hash), times: every word of the corpus
    totals: np.ndarray  # occurrences of each shared token


def new_network(seed: int = 11) -> Net:
    """Inputs by offset and token, hidden bias, class weights and bias, token weights and bias by class."""
    rng = np.random.default_rng(seed)
    inputs = rng.normal(0, 0.1, (len(OFFSETS), TOKENS + 1, SIZE))
    inputs[:, PAD] = 0
    parts = [inputs, np.zeros(SIZE), rng.normal(0, 0.1, (SIZE, CLASSES)), np.zeros(CLASSES), rng.normal(0, 0.1, (CLASSES, SIZE, CLASSES)), np.zeros((CLASSES, CLASSES))]
    return [p.astype(np.float32) for p in parts]


def tokens_of(texts: list[str], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts in a row, tokens per text, and the words' hashes. ``frequent``: (hash, token) of the frequent words, by hash."""
    words, counts = word_hashes(texts)
    out = (FREQUENT + (words % np.uint64(SHARED))).astype(np.int64)
    if len(frequent) and len(words):
        hashes = frequent[:, 0]
        place = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        hit = hashes[place] == words
        out[hit] = frequent[place[hit], 1]
    return out, counts, words


def contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Neighbours of every token at OFFSETS (offsets x tokens); beyond a text's ends they are padding."""
    n = len(tokens)
    ends = np.repeat(np.cumsum(counts), counts)
    begins = ends - np.repeat(counts, counts)
    out = np.empty((len(OFFSETS), n), np.int64)
    for row, offset in zip(out, OFFSETS):
        at = np.arange(n) + offset
        inside = (at >= begins) & (at < ends)
        row[:] = np.where(inside, tokens[np.clip(at, 0, n - 1)], PAD)
    return out


def _hidden(net: Net, context: np.ndarray) -> np.ndarray:
    total = net[0][0].take(context[0], axis=0)
    for table, near in zip(net[0][1:], context[1:]):
        total += table.take(near, axis=0)
    total += net[1]
    return np.tanh(total, out=total)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def log_probabilities(net: Net, tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Log-probability of each token given its neighbours."""
    out = np.empty(len(tokens), np.float64)
    for at in range(0, len(tokens), 8192):
        own = tokens[at : at + 8192]
        hidden = _hidden(net, context[:, at : at + 8192])
        kind, inner = own // CLASSES, own % CLASSES
        score = _log_softmax(hidden @ net[2] + net[3])[np.arange(len(own)), kind].astype(np.float64)
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = order[edges[c] : edges[c + 1]]
            if len(rows):
                score[rows] += _log_softmax(hidden[rows] @ net[4][c] + net[5][c])[np.arange(len(rows)), inner[rows]]
        out[at : at + 8192] = score
    return out


def train_step(net: Net, squares: Net, tokens: np.ndarray, context: np.ndarray, rate: float = 0.1) -> None:
    """One Adagrad step on the mean loss of the given tokens."""
    n = len(tokens)
    kind, inner = tokens // CLASSES, tokens % CLASSES
    hidden = _hidden(net, context)
    slope = np.exp(_log_softmax(hidden @ net[2] + net[3]))
    slope[np.arange(n), kind] -= 1
    slope /= n
    back = slope @ net[2].T
    grads = [np.zeros_like(net[0]), None, hidden.T @ slope, slope.sum(axis=0), np.zeros_like(net[4]), np.zeros_like(net[5])]
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        rows = order[edges[c] : edges[c + 1]]
        if len(rows):
            own = np.exp(_log_softmax(hidden[rows] @ net[4][c] + net[5][c]))
            own[np.arange(len(rows)), inner[rows]] -= 1
            own /= n
            grads[4][c] = hidden[rows].T @ own
            grads[5][c] = own.sum(axis=0)
            back[rows] += own @ net[4][c].T
    back *= 1 - hidden * hidden
    grads[1] = back.sum(axis=0)
    for table, near in zip(grads[0], context):
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        table[near[order[first]]] = np.add.reduceat(back[order], first, axis=0)
    grads[0][:, PAD] = 0
    for weight, square, grad in zip(net, squares, grads):
        square += grad * grad
        weight -= rate * grad / np.sqrt(square + 1e-8)


def counted_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of the texts, and how often each occurs. Hashing takes 40 times a text's bytes, so a slice goes at a time."""
    words = np.concatenate([word_hashes(group)[0] for group in slices(texts, SLICE)])
    return np.unique(words.view(np.int64), return_counts=True)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its hash) and times for every word of all documents, stored. Tasks count their own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in slices(batch.column("text").to_pylist(), SHARD):
                words, times = counted_words(group)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(times)], ["word", "times"])

    counted = docs.select(text_of().alias("text")).mapInArrow(run, "word long, times long")
    return stored(counted.groupBy("word").agg(F.sum("times").alias("times")), "lm-words")


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(hash, token) of the ``most`` most frequent words, by hash, and the occurrences of each shared token, whose words are all others."""
    best = [tuple(r) for r in counts.orderBy(F.desc("times"), "word").limit(most).collect()]
    slot = F.col("word").bitwiseAND(SHARED - 1).cast("int")
    totals = np.zeros(SHARED)
    for place, times in counts.groupBy(slot.alias("slot")).agg(F.sum("times").alias("times")).collect():  # at most SHARED rows
        totals[place] = times
    for word, times in best:
        totals[word & (SHARED - 1)] -= times
    table = np.array([w for w, _ in best], np.int64).view(np.uint64)
    order = np.argsort(table)
    known = np.stack([table[order], order.astype(np.uint64)], axis=1) if best else np.empty((0, 2), np.uint64)
    return known, totals


def _packed(net: Net) -> bytes:
    return b"".join(w.astype("<f4").tobytes() for w in net)


def _unpacked(data: np.ndarray, like: Net) -> Net:
    sizes = np.cumsum([w.size for w in like])
    return [x.reshape(w.shape).astype(np.float32) for x, w in zip(np.split(data, sizes[:-1]), like)]


def trained(docs: DataFrame, frequent: np.ndarray, net: Net, turn: int) -> Net:
    """The average of the tasks' networks, weighted by masked tokens. Networks are added by blocks of weights, in two steps,
    so no task holds more than a share of them. Without tokens the network stays."""
    sent = docs.sparkSession.sparkContext.broadcast((net, frequent))  # of fixed size
    block = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, known = sent.value
        own, squares = [w.copy() for w in base], [np.full_like(w, 1e-3) for w in base]
        rng = np.random.default_rng(turn)
        seen = 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for group in slices(batch.column("text").to_pylist(), SLICE):
                tokens, counts, _ = tokens_of(group, known)
                masked = np.flatnonzero(rng.random(len(tokens)) < MASKED)
                context = contexts(tokens, counts)[:, masked]
                waiting.append((tokens[masked], context))
                if sum(len(t) for t, _ in waiting) >= BATCH:
                    t, c = np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting], axis=1)
                    waiting = []
                    seen += len(t)
                    for at in range(0, len(t), BATCH):
                        train_step(own, squares, t[at : at + BATCH], c[:, at : at + BATCH])
        if waiting and (t := np.concatenate([x[0] for x in waiting])).size:
            seen += len(t)
            train_step(own, squares, t, np.concatenate([x[1] for x in waiting], axis=1))
        if seen:
            flat = np.frombuffer(_packed(own), "<f4").astype("<f8") * seen
            flat = np.append(flat, float(seen))
            pieces = [flat[i : i + block].tobytes() for i in range(0, len(flat), block)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces))), pa.array(pieces, pa.binary())], ["block", "weights"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            for x in batch.column("weights").to_pylist():
                total = total + np.frombuffer(x, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["block", "weights"])

    schema = "block long, weights binary"
    parts = docs.select(text_of().alias("text")).mapInArrow(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = parts.groupBy("block", "salt").applyInArrow(add, schema)
    rows = some.groupBy("block").applyInArrow(add, schema).collect()  # one network
    if not rows:
        return net
    flat = np.concatenate([np.frombuffer(r[1], "<f8") for r in sorted(rows, key=lambda r: r[0])])
    return _unpacked(flat[:-1] / flat[-1], net)


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Network, vocabulary and word counts from all documents."""
    counts = word_counts(docs)
    frequent, totals = frequent_words(counts)
    net = new_network()
    for turn in range(rounds):
        net = trained(docs, frequent, net, turn)
    return Model(net, frequent, counts, totals)


def token_scores(texts: list[str], net: Net, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Summed log-probability of the tokens of each text, tokens of each text, and the words with shared tokens: their text's
    place and their hash, one by one."""
    tokens, counts, words = tokens_of(texts, frequent)
    ends = np.concatenate([[0.0], np.cumsum(log_probabilities(net, tokens, contexts(tokens, counts)))])
    edges = np.concatenate([[0], np.cumsum(counts)])
    rare = tokens >= FREQUENT
    return np.diff(ends[edges]), counts, np.repeat(np.arange(len(texts)), counts)[rare], words[rare].view(np.int64)


def scored_shards(docs: DataFrame, net: Net, frequent: np.ndarray) -> DataFrame:
    """Shards of whole documents: ids, tokens and token scores, and the entries of words with shared tokens as places in the
    shard's own list of those words."""
    sent = docs.sparkSession.sparkContext.broadcast((net, frequent))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text").to_pylist(), SHARD):
                parts, at = [], 0
                for group in slices(texts, SLICE):
                    total, counts, owner, word = token_scores(group, *known)
                    parts.append((total, counts, (owner + at).astype(np.int32), word))
                    at += len(group)
                total, counts, owner, word = (np.concatenate(x) for x in zip(*parts))
                del parts  # the entries of a shard are its largest arrays
                words, place = np.unique(word, return_inverse=True)
                del word
                place += owner.astype(np.int64) * max(1, len(words))
                del owner
                place.sort()
                first = np.flatnonzero(np.diff(place, prepend=-1))
                cell, times = place[first], np.diff(first, append=len(place))
                del place, first
                entries = np.bincount(cell // max(1, len(words)), minlength=len(texts)).astype(np.int32)
                ids = batch.column("doc_id").slice(done, len(texts)).to_pylist()
                lists = [(ids, pa.int64()), (counts, pa.int64()), (total, pa.float64()), (entries, pa.int32()), (words, pa.int64())]
                out = [pa.array([number]), *[pa.array([x], pa.list_(kind)) for x, kind in lists]]
                out += [pa.array([squeezed(cell % max(1, len(words)))]), pa.array([squeezed(times)])]
                yield pa.RecordBatch.from_arrays(out, ["shard", "doc_ids", "tokens", "totals", "entries", "words", "columns", "times"])
                number += 1
                done += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "shard long, doc_ids array<long>, tokens array<long>, totals array<double>, entries array<int>, words array<long>, columns binary, times binary")


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Score of every document: doc_id, n_tokens, log_likelihood (the sum), per_token (its mean; null without tokens).

    A word of a shared token has the share times / (occurrences of the token + 1) of it; a word that the model's corpus lacks
    has the share of one occurrence. Null, empty and blank texts have no tokens and the sum 0. Equal texts score alike up to
    rounding; repeated rows and rows with a null id are scored each; an empty table gives no rows. Very long texts are scored
    whole. Columns other than doc_id and text are left out, so their names can't clash.
    """
    net, frequent, counts, totals = model or fit(docs)
    shards = stored(scored_shards(docs, net, frequent), "lm-shards")
    whole = F.element_at(F.lit(totals + 1), F.col("word").bitwiseAND(SHARED - 1).cast("int") + 1)
    share = (F.log(F.coalesce("known", F.lit(1)).cast("double")) - F.log(whole)).cast("float").alias("share")
    own = shards.select("shard", F.posexplode("words").alias("place", "word")).join(counts.withColumnRenamed("times", "known"), "word", "left").select("shard", "place", share)
    shares = stored(own.groupBy("shard").agg(F.collect_list("place").alias("places"), F.collect_list("share").alias("shares")), "lm-shares")  # of a shard's words
    if model is None:
        discard(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                flat = lambda c: row.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                entries, tokens = flat("entries"), flat("tokens")
                share = np.zeros(len(flat("places")))
                share[flat("places").astype(np.int64)] = flat("shares")
                n = int(entries.sum())
                sums = spread(row.column("times")[0].as_py(), n) * share[spread(row.column("columns")[0].as_py(), n)]
                total = flat("totals") + np.bincount(np.repeat(np.arange(len(entries)), entries), sums, minlength=len(entries))
                mean = pa.array(total / np.maximum(tokens, 1), mask=tokens == 0)
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), pa.array(tokens, pa.int64()), pa.array(total), mean], ["doc_id", "n_tokens", "log_likelihood", "per_token"])

    sent = shards.drop("words").join(shares, "shard", "left")
    return sent.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, per_token double")
