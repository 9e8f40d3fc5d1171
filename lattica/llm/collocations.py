"""Phrase collocations by best-first branch and bound.

Phrases grow to the right from counted prefixes. Whatever follows a prefix x y, the phrase's score is at most
f(x y) / f(x), since f(x y z) is at most f(x y) and at most f(y z). So the frontier is expanded best bound first, in rounds: a round
takes every prefix with a bound above a level, and every two-word candidate with a score above it, whose survival depends on
the three-word candidates around it. Once a language has enough surviving scores above the level, nothing below can
enter; else its level falls.

Counts are whole. A Bloom filter of a round's phrases spares the tasks most of the others; what it lets through by
mistake is removed by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.bpe import slices
from lattica.llm.common import discard, stored, text_of
from lattica.llm.raw import encoded, joined, of_bytes, runs

LEAST, TOP = 10, 2000
WITHIN = 50  # per cent of a phrase's places that a longer candidate must hold to replace it
BEGIN, FASTER = 2, 8  # the first round's level is the score at BEGIN * TOP, each next one at FASTER times that place
ONE = 1_000_000  # the largest score
FEWEST_BITS, MOST_BITS = 20, 28  # of a Bloom filter, as a power of two: 32 MB at most
PROBES = 3
GROUP = 1 << 23  # bytes of text counted at once
ENDS, GAPS = of_bytes(b".,;:!?\n\v\f\r"), of_bytes(b" \t")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * U64(0x9E3779B97F4A7C15) + second)


class Bloom:
    """A set of hashes in ``bits`` bits; ``holds`` is never false for a member."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, U64(len(bits) * 8 - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: U64) -> list[np.ndarray]:
        step = _mix(hashes) | U64(1)
        return [(hashes + step * U64(i)) & mask for i in range(PROBES)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.mask):
            out &= (self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0
        return out


def bloom(phrases: DataFrame, columns: list[str]) -> np.ndarray:
    """Bloom filter of (lang, *columns), one or two words, of a stored table. Each task sets bits in an array of the filter's
    size; arrays are merged by blocks in two steps, so the driver gets one filter of at most 32 MB."""
    size = 1 << int(np.clip((8 * max(1, phrases.count()) - 1).bit_length(), FEWEST_BITS, MOST_BITS))
    block = min(1 << 20, size // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            langs = np.array(batch.column("lang").cast(pa.binary()).to_pylist(), object)
            for lang in set(langs):
                own = batch.filter(pa.array(langs == lang))
                hashes = [word_hashes(lang, own.column(c).cast(pa.binary()).to_pylist()) for c in columns]
                for at in Bloom.places(hashes[0] if len(columns) == 1 else pair_hashes(*hashes), U64(size - 1)):
                    np.bitwise_or.at(bits, (at >> U64(3)).astype(np.int64), U64(1).astype(np.uint8) << (at & U64(7)).astype(np.uint8))
        parts = bits.reshape(-1, block)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["block", "bits"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block, np.uint8)
        for batch in batches:
            for x in batch.column("bits").to_pylist():
                total |= np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "bits"])

    schema = "block long, bits binary"
    some = phrases.select("lang", *columns).mapInArrow(run, schema).groupBy("block", F.pmod(F.spark_partition_id(), F.lit(32)).alias("salt")).applyInArrow(merge, schema)
    out = np.zeros(size // 8, np.uint8).reshape(-1, block)
    for row in some.groupBy("block").applyInArrow(merge, schema).collect():
        out[row[0]] = np.frombuffer(row[1], np.uint8)
    return out.reshape(-1)


Batch = tuple[list[pa.Array], np.ndarray]


def _unigrams(lang: bytes, codes: np.ndarray, piece: np.ndarray, words: pa.Array, filters: list[Bloom]) -> Batch:
    counts = np.bincount(codes, minlength=len(words))
    return [pa.concat_arrays([words, pa.nulls(1, pa.binary())])], np.append(counts, counts.sum())


def _bigrams(lang: bytes, codes: np.ndarray, piece: np.ndarray, words: pa.Array, filters: list[Bloom]) -> Batch:
    known = filters[0].holds(word_hashes(lang, words.to_pylist()))[codes]
    due = np.flatnonzero((piece[:-1] == piece[1:]) & known[:-1] & known[1:])
    key, counts = np.unique(codes[due].astype(np.int64) * len(words) + codes[due + 1], return_counts=True)
    return [words.take(pa.array(key // len(words))), words.take(pa.array(key % len(words)))], counts


def _trigrams(lang: bytes, codes: np.ndarray, piece: np.ndarray, words: pa.Array, filters: list[Bloom]) -> Batch:
    frequent, right, left = filters
    hashes = word_hashes(lang, words.to_pylist())[codes]
    pair = pair_hashes(hashes[:-1], hashes[1:])
    usual = (piece[:-1] == piece[1:]) & frequent.holds(pair)
    due = np.flatnonzero(usual[:-1] & usual[1:])
    due = due[right.holds(pair[due]) | left.holds(pair[due + 1])]
    pairs, at = np.unique(codes[due].astype(np.int64) * len(words) + codes[due + 1], return_inverse=True)
    key, counts = np.unique(at * len(words) + codes[due + 2], return_counts=True)
    first = pairs[key // len(words)] if len(pairs) else key
    return [words.take(pa.array(x)) for x in (first // len(words), first % len(words), key % len(words))], counts


def counted(docs: DataFrame, size: int, filters: list[np.ndarray]) -> DataFrame:
    """Places of phrases of ``size`` words, summed: lang, a (to c), n. One word: all words, and a null one for their total. Two:
    both words pass the filter. Three: both pairs pass the first filter, and the first pair the second or the last the third.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters) if filters else None  # at most 32 MB each
    names = ["a", "b", "c"][:size]
    grow: Callable[..., Batch] = (_unigrams, _bigrams, _trigrams)[size - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [Bloom(x) for x in sent.value] if sent else []
        for batch in batches:
            langs = np.array(batch.column("lang").cast(pa.binary()).to_pylist(), object)
            texts = np.empty(len(langs), object)
            texts[:] = batch.column("text").cast(pa.binary()).to_pylist()
            for lang in sorted(set(langs)):
                for group in slices(texts[langs == lang], GROUP):
                    raw = LOWER[joined(group)[0]]
                    inside = ~(ENDS | GAPS)[raw]
                    starts, ends = runs(inside)
                    if len(starts) < size:
                        continue
                    piece = np.cumsum(ENDS[raw], dtype=np.int64)[starts]
                    columns, counts = grow(lang, *_coded(raw, inside, starts, ends, piece), tests)
                    for at in range(0, len(counts), 1 << 16):
                        some = [pa.array([lang] * len(counts[at : at + (1 << 16)]), pa.binary()), *[c.slice(at, 1 << 16) for c in columns], pa.array(counts[at : at + (1 << 16)])]
                        yield pa.RecordBatch.from_arrays(some, ["lang", *names, "n"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    grams = rows.mapInArrow(run, f"lang binary, {', '.join(f'{x} binary' for x in names)}, n long")
    return grams.groupBy("lang", *names).agg(F.sum("n").alias("n")).select(*[F.col(x).cast("string").alias(x) for x in ("lang", *names)], "n")


def _coded(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    codes, words = encoded(raw, inside, starts, ends)
    return codes, piece, words


def score(a: str, left: str, right: str) -> Column:
    """floor(ONE * a * a / (l * r)), exact: decimals of 38 digits hold the products of counts below 10**15."""
    return F.expr(f"cast((cast({a} as decimal(20,0)) * {a} * {ONE}) div (cast({left} as decimal(20,0)) * {right}) as long)")


def level_at(scored: DataFrame, place: int) -> DataFrame:
    """Score of each language's ``place``-th best phrase, 0 if it has fewer: lang, low."""
    shares = scored.groupBy("lang", "score").agg(F.count("*").alias("k"))
    above = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("score")))  # a row per score: at most ONE + 1
    return shares.withColumn("above", above).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= place, F.col("score"))), F.lit(0)).alias("low"))


def surviving(pairs: DataFrame, triples: DataFrame, levels: DataFrame) -> DataFrame:
    """Candidates with scores from their language's level up that no longer candidate replaces."""
    inside = triples.select("lang", "a", "b", "n").unionByName(triples.select("lang", F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    inside = inside.groupBy("lang", "a", "b").agg(F.max("n").alias("most"))
    above = pairs.join(levels, "lang").where("score >= low").drop("low", "bound")
    left = above.join(inside, ["lang", "a", "b"], "left").where(f"most IS NULL OR 100 * most < {WITHIN} * n")
    left = left.select("lang", F.concat_ws(" ", "a", "b").alias("phrase"), "n", "l", "r", "score")
    longer = triples.join(levels, "lang").where("score >= low")
    return left.unionByName(longer.select("lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), "n", "l", "r", "score"))


def mine(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's ``top`` collocations: lang, rank, phrase, a, l, r, n, score.

    A null language is 'und', together with documents of that name; a null text is empty. Repeated rows count each. Ties by
    score go to the larger a, then to the smaller phrase by bytes. A language with fewer candidates returns them all, one
    without any no row. Only text and lang are read, so other columns' names can't clash. An empty table gives no rows.
    """
    single = counted(docs, 1, [])
    single = stored(single.where(f"a IS NULL OR n >= {LEAST}"), "phrase-words")
    words = single.where("a IS NOT NULL")
    totals = single.where("a IS NULL").select("lang", F.col("n").alias("total"))
    pairs = stored(counted(docs, 2, [bloom(words, ["a"])]).where(f"n >= {LEAST}"), "phrase-pairs")
    one = lambda c, name: words.select("lang", F.col("a").alias(c), F.col("n").alias(name))
    scored = pairs.join(one("a", "l"), ["lang", "a"]).join(one("b", "r"), ["lang", "b"])
    bound = F.expr(f"cast(cast(n as decimal(20,0)) * {ONE} div l as long)")
    scored = stored(scored.select("lang", "a", "b", "n", "l", "r", score("n", "l", "r").alias("score"), bound.alias("bound")), "phrase-scored")
    discard(pairs)
    frequent = bloom(scored, ["a", "b"])
    levels = stored(level_at(scored, BEGIN * top).withColumn("high", F.lit(ONE + 1).cast("long")), "phrase-levels")
    settled, triples, place = None, None, BEGIN * top
    while True:
        open_ = scored.join(levels, "lang")
        right = stored(open_.where("bound >= low AND bound < high").select("lang", "a", "b"), "phrase-right")
        left = stored(open_.where("score >= low AND score < high").select("lang", "a", "b"), "phrase-left")
        found = counted(docs, 3, [frequent, bloom(right, ["a", "b"]), bloom(left, ["a", "b"])]).where(f"n >= {LEAST}")
        found = found.join(scored.select("lang", "a", "b", F.col("n").alias("ab"), F.col("l").alias("one"), "bound"), ["lang", "a", "b"])
        after = scored.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc"), F.col("r").alias("last"), F.col("score").alias("then"))
        found = found.join(after, ["lang", "b", "c"]).join(levels, "lang").withColumn("first", F.greatest("bound", "then")).where("first >= low AND first < high")
        cuts = F.array(
            F.struct(score("n", "one", "bc").alias("score"), F.lit(1).alias("k"), F.col("one").alias("l"), F.col("bc").alias("r")),
            F.struct(score("n", "ab", "last").alias("score"), F.lit(2).alias("k"), F.col("ab").alias("l"), F.col("last").alias("r")),
        )
        found = found.withColumn("cut", F.array_min(cuts)).select("lang", "a", "b", "c", "n", "cut.l", "cut.r", "cut.score")
        old = [right, left, triples]
        triples = stored(found if triples is None else triples.unionByName(found), "phrase-triples")
        discard(*old)
        reached = levels.select("lang", "low")
        reached = reached if settled is None else reached.unionByName(settled)
        alive = surviving(scored, triples, reached)
        enough = alive.groupBy("lang").agg(F.count("*").alias("alive"))
        state = stored(levels.select("lang", "low").join(enough, "lang", "left").withColumn("done", (F.col("low") == 0) | (F.coalesce("alive", F.lit(0)) >= top)), "phrase-state")
        due = state.where("NOT done")
        ready = state.where("done").select("lang", "low")
        settled = ready if settled is None else settled.unionByName(ready)
        if due.isEmpty():
            break
        place *= FASTER
        levels = stored(level_at(scored, place).join(due.select("lang", F.col("low").alias("high")), "lang"), "phrase-levels")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
    ranked = surviving(scored, triples, settled).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM p, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) + 1)) AS u(i) WHERE i + k - 1 <= len(w) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= {LEAST}),
x AS (SELECT lang, phrase, k, a, cut, array_to_string(w[1:cut], ' ') AS one, array_to_string(w[cut + 1:], ' ') AS rest
      FROM c, unnest([1, 2]) AS u(cut) WHERE cut < k),
y AS (SELECT x.*, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * a * {ONE} // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM x JOIN g l ON l.lang = x.lang AND l.phrase = one JOIN g r ON r.lang = x.lang AND r.phrase = rest),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
      UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
v AS (SELECT z.* FROM z LEFT JOIN (SELECT lang, phrase, max(a) AS most FROM i GROUP BY ALL) m USING (lang, phrase)
      WHERE most IS NULL OR k = 3 OR 100 * most < {WITHIN} * z.a),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM v JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
