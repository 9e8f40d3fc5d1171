"""Classifiers, near duplicates, pseudo-likelihood and the pipeline."""

import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import linear, neardup, pseudo_likelihood, quality, toxicity

MIDDLE = "/root/testdata/sf0.1"


def tables(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_logistic_regression_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    weights, bias = linear.fit_logistic(np.arange(401) * 3, np.tile(np.arange(3), 400), x.ravel(), y, 3)
    assert ((x @ weights + bias > 0) == y).mean() > 0.93
    assert weights[0] > 0 > weights[1] and abs(weights[2]) < abs(weights[1])


def test_toxicity_held_out(spark):
    docs, labels = tables(spark, MIDDLE)
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) >= 0.85
    assert np.mean([r.predicted for r in clean]) <= 0.02


def test_quality_held_out(spark):
    docs, labels = tables(spark, MIDDLE)
    out = quality.classify(docs, labels)
    assert out.count() == docs.count()
    rows = [r for r in out.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.keep for r in rows if r.quality == 1]) >= 0.99
    assert np.mean([r.keep for r in rows if r.quality == 0]) <= 0.05


def test_posteriors_shrink(spark):
    """A sparse path is drawn to its site, a sparse site to the whole; a large one stays near its own rate."""
    rows = [("big", "p", float(i % 10 == 0)) for i in range(2000)] + [("big", "q", 1.0)]
    rows += [(f"s{k}", "p", float(i % 10 < 9)) for k in range(20) for i in range(100)] + [("tiny", None, 0.0), (None, "p", 1.0)]
    rates, overall = quality.posteriors(spark.createDataFrame(rows, "site string, path string, good double"))
    got = {(r.site, r.path): r for r in rates.collect()}
    assert got["big", "p"].path_rate == pytest.approx(0.1, abs=0.02)
    assert got["big", "q"].path_rate < 0.9
    assert 0.05 < got["tiny", None].site_rate < overall
    assert got[None, "p"].site_rate > overall
    assert all(0 < r.path_rate < 1 for r in got.values())


def test_classifiers_with_odd_rows(stored_odd, no_documents, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        for classify, columns in ((toxicity.classify, 4), (quality.classify, 6)):
            out = classify(stored_odd, labels)
            assert len(out.columns) == columns
            rows = out.collect()
            assert len(rows) == stored_odd.count()
            assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert toxicity.classify(no_documents, odd_labels).count() == 0
    assert quality.classify(no_documents, no_labels).count() == 0


def brute_classes(rows):
    """Classes by exact weighted similarity of all pairs, from the definition with plain dictionaries."""
    sketch = np.zeros((neardup.DEPTH, 1 << neardup.WIDTH_BITS), np.int64)
    sets = []
    for r in rows:
        value, tf, _, key = neardup.shingles([r.text or ""])
        sets.append((value, tf, key[0].tobytes()))
        for d, cell in enumerate(neardup._cells(value)):
            sketch[d] += np.bincount(cell, minlength=sketch.shape[1])
    weights = neardup.Weights(sketch, len(rows))
    sets = [(dict(zip(v.tolist(), weights.of(v, tf).astype(float).tolist())), k) for v, tf, k in sets]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][0], sets[j][0]
            shared = sum(min(w, b[v]) for v, w in a.items() if v in b)
            union = sum(a.values()) + sum(b.values()) - shared
            if sets[i][1] == sets[j][1] or (union and shared / union >= 0.8):
                label[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r.doc_id)
    return Counter(tuple(sorted(g, key=lambda x: (x is None, x))) for g in groups.values())


def own_classes(out):
    groups = defaultdict(list)
    for r in out.collect():
        groups[r.class_id, r.class_size].append(r.doc_id)
    return Counter(tuple(sorted(g, key=lambda x: (x is None, x))) for g in groups.values())


def test_near_duplicates_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert own_classes(neardup.classes(docs)) == brute_classes(docs.collect())


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """A template with many edited copies that are nearer to it than to each other, a chain, and clean texts."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        words = list(base)
        for at in rng.choice(400, 1 + k % 7, replace=False):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    chain = [f"c{i}" for i in range(300)]
    for k in range(12):
        rows.append((100 + k, " ".join(chain[k * 20 : k * 20 + 300] + [f"c{300 + i}" for i in range(k * 20)])))
    rows += [(200 + k, " ".join(f"t{x}" for x in rng.integers(0, 5000, 150))) for k in range(40)]
    path = str(tmp_path_factory.mktemp("star") / "documents")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def test_star_and_chain(star):
    assert own_classes(neardup.classes(star)) == brute_classes(star.orderBy("doc_id").collect())


def test_one_of_each(star):
    kept = {r.doc_id for r in neardup.one_of_each(star, ["doc_id", "text"]).collect()}
    groups = own_classes(neardup.classes(star))
    assert kept == {g[0] for g in groups}


def test_samples_estimate_similarity():
    a = [f"w{i}" for i in range(500)]
    b = [w if i % 60 else f"z{i}" for i, w in enumerate(a)]
    value, tf, counts, _ = neardup.shingles([" ".join(a), " ".join(b)])
    drawn = neardup.samples(value, np.where(np.arange(len(value)) % 2, 1.5, 1.0).astype(np.float32), counts, hashes=2000)
    x = dict(zip(value[: counts[0]].tolist(), np.where(np.arange(counts[0]) % 2, 1.5, 1.0)))
    y = dict(zip(value[counts[0] :].tolist(), np.where(np.arange(counts[0], len(value)) % 2, 1.5, 1.0)))
    shared = sum(min(w, y[v]) for v, w in x.items() if v in y)
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(shared / (sum(x.values()) + sum(y.values()) - shared), abs=0.04)


def test_near_duplicates_odd_rows(stored_odd, no_documents):
    rows = neardup.classes(stored_odd).collect()
    assert len(rows) == stored_odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[8] == {1} and by[2] == by[3] == by[4] == {2} and by[5] == by[6] == {5} and by[7] == {7}
    kept = neardup.one_of_each(stored_odd, ["doc_id", "text", "lang", "source", "n_chars"]).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (False, 5), (False, 7), (True, 0)]
    assert neardup.classes(no_documents).count() == 0
    assert neardup.one_of_each(no_documents, ["doc_id", "text"]).count() == 0


def test_probabilities_sum_to_one():
    net = pseudo_likelihood.new_network()
    context = np.array([[3], [5], [7], [pseudo_likelihood.PAD]])
    every = np.arange(pseudo_likelihood.TOKENS)
    total = np.exp(pseudo_likelihood.log_probabilities(net, every, np.repeat(context, len(every), axis=1))).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    tokens, context = rng.integers(0, 1024, 20), rng.integers(0, 1024, (4, 20))
    net = [w.astype(np.float64) for w in pseudo_likelihood.new_network()]
    before = [w.copy() for w in net]
    squares = [np.zeros_like(w) for w in net]
    pseudo_likelihood.train_step(net, squares, tokens, context, rate=0.0)
    loss = lambda: -pseudo_likelihood.log_probabilities(before, tokens, context).mean()
    for part, at in ((0, (1, int(context[1, 3]), 2)), (1, (4,)), (2, (3, int(tokens[0]) // 32)), (4, (int(tokens[0]) // 32, 5, int(tokens[0]) % 32))):
        old = before[part][at]
        before[part][at] = old + 1e-5
        up = loss()
        before[part][at] = old - 1e-5
        slope = (up - loss()) / 2e-5
        before[part][at] = old
        assert slope**2 == pytest.approx(squares[part][at], rel=1e-3, abs=1e-12)


def test_pseudo_likelihood_learns(spark):
    """Text with structure becomes likelier than the same words shuffled."""
    rng = np.random.default_rng(3)
    lines = ["the cat sat on the mat", "a dog ran in the park", "we read old books at night", "rain fell on the cold town"]
    rows = [(i, " ".join(rng.choice(lines, 30))) for i in range(400)]
    mixed = [(1000 + i, " ".join(rng.permutation(text.split()))) for i, text in rows[:40]]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in pseudo_likelihood.scored(docs, pseudo_likelihood.fit(docs.where("doc_id < 1000"), rounds=6)).collect()}
    better = [got[i].per_token > got[1000 + i].per_token + 0.5 for i in range(40)]
    assert np.mean(better) > 0.9
    assert all(r.n_tokens == len(t.split()) for (i, t) in rows for r in [got[i]])


def test_document_sums_equal_a_plain_loop(spark, small, monkeypatch):
    """Word by word: the token's probability times the word's share, counted in a dictionary; several shards."""
    monkeypatch.setattr(pseudo_likelihood, "SHARD", 1 << 16)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(300).repartition(3).cache()
    model = pseudo_likelihood.fit(docs, rounds=1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    hashes = {i: pseudo_likelihood.word_hashes([t])[0].tolist() for i, t in texts.items()}
    times = Counter(w for ws in hashes.values() for w in ws)
    assert {r.word % (1 << 64): r.times for r in model.counts.collect()} == times
    known = {int(h): int(t) for h, t in model.frequent}
    shared = Counter()
    for w, n in times.items():
        if w not in known:
            shared[w % 256] += n
    got = {r.doc_id: r for r in pseudo_likelihood.scored(docs, model).collect()}
    assert got.keys() == texts.keys()
    for i in list(texts)[::10]:
        own = np.array([known.get(w, 768 + w % 256) for w in hashes[i]], np.int64)
        plain = 0.0
        for at in range(len(own)):
            near = np.array([[own[at + o] if 0 <= at + o < len(own) else pseudo_likelihood.PAD] for o in pseudo_likelihood.OFFSETS])
            plain += float(pseudo_likelihood.log_probabilities(model.net, own[at : at + 1], near)[0])
            if hashes[i][at] not in known:
                plain += np.log(times[hashes[i][at]] / (shared[hashes[i][at] % 256] + 1))
        assert got[i].n_tokens == len(own) and got[i].log_likelihood == pytest.approx(plain, rel=1e-4, abs=1e-3)


def test_rare_words_score_apart_from_random_strings(spark):
    """Words beyond the network's own tokens: those that other documents hold are likelier than strings that none holds."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "po", "ri") for b in range(800)]
    chosen = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(rng.choice(words, 80, p=chosen / chosen.sum()))) for i in range(600)]
    rare = words[1200:2400]
    rows += [(10_000 + i, " ".join(rng.choice(rare, 40))) for i in range(20)]
    rows += [(20_000 + i, " ".join(f"x{rng.integers(1 << 40):x}" for _ in range(40))) for i in range(20)]
    got = {r.doc_id: r.per_token for r in pseudo_likelihood.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    known, strings = [got[10_000 + i] for i in range(20)], [got[20_000 + i] for i in range(20)]
    assert min(known) > max(strings)


def test_words_of_a_shard_are_counted_in_slices():
    """Counting a shard's words holds their hashes and one slice's letters, not 40 times the shard."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5_000, 300)) for _ in range(5_000)]
    want, times = np.unique(pseudo_likelihood.word_hashes(texts)[0].view(np.int64), return_counts=True)
    tracemalloc.start()
    got = pseudo_likelihood.counted_words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[0] == want).all() and (got[1] == times).all()
    assert peak < 10 * sum(map(len, texts))


def test_pseudo_likelihood_odd_rows(stored_odd, no_documents):
    rows = pseudo_likelihood.scored(stored_odd).collect()
    assert len(rows) == stored_odd.count()
    for r in rows:
        assert (r.per_token is None) == (r.n_tokens == 0) and r.log_likelihood <= 0
    assert pseudo_likelihood.scored(no_documents).count() == 0


def test_pipeline_stages(spark, small, stored_odd, tmp_path, odd_labels):
    """Each stage on the one before: columns stay, decisions take effect."""
    docs, labels = tables(spark, small)
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, small).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == corpus_pipeline.COLUMNS
        sizes.append(kept.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    first = spark.read.parquet(str(tmp_path / "toxicity"))
    bad = toxicity.classify(docs, labels).where("predicted = 1").select("doc_id")
    assert first.join(bad, "doc_id").count() == 0 and first.count() + bad.count() == docs.count()
    third, second = spark.read.parquet(str(tmp_path / "near_duplicates")), spark.read.parquet(str(tmp_path / "quality"))
    assert third.count() == neardup.classes(second).select("class_id").distinct().count()
    odd_labels.write.parquet(str(tmp_path / "odd" / "labels.parquet"))
    stored_odd.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    stored_odd.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    odd_labels.where("false").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_batches_are_small(spark, tmp_path, monkeypatch):
    """Whole texts enter a stage's tasks in batches of few rows, and the session keeps its own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.range(2_000).selectExpr("id AS doc_id", "'a text' AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["rows"])

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", lambda spark, docs, folder: docs.mapInArrow(sizes, "rows long"))])
    before = spark.conf.get(name)
    seen = [r.rows for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(seen) == 2_000 and max(seen) <= 256 and spark.conf.get(name) == before


def test_pairs_without_centres_are_found(spark, tmp_path):
    """Pairs of copies that share one passage with all others, so their buckets' centres are unrelated to them."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(600)]
    rows = []
    for k in range(100):
        own, edited = ([f"{kind}{k}x{i}" for i in range(60)] for kind in "oe")
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + own[:20] + edited[20:]))]
    path = str(tmp_path / "documents")
    spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    assert own_classes(neardup.classes(docs)) == brute_classes(docs.orderBy("doc_id").collect())


def test_pairs_of_a_loose_group_are_not_moved(spark, tmp_path, monkeypatch):
    """Copies with so many edits that none is similar to another: all pairs are tested, but only those with centres are shuffled."""
    rng = np.random.default_rng(6)
    base, n = [f"w{i}" for i in range(400)], 300
    rows = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(400, 2 if k in (7, 8) else 11, replace=False):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    plain, moved = neardup.verified, []
    monkeypatch.setattr(neardup, "verified", lambda pairs, *a: (moved.append(pairs.count()), plain(pairs, *a))[1])
    assert own_classes(neardup.classes(docs)) == brute_classes(docs.orderBy("doc_id").collect())
    assert sum(moved) < 40 * n


def test_all_labels_are_evidence(spark, tmp_path, monkeypatch):
    """Labels beyond the fitting sample count for the sites: here they alone tell two sites of equal texts apart."""
    rows = [(i, f"some plain words {i % 7}", "en", "ab"[i % 2], 18) for i in range(400)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(path)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    monkeypatch.setattr(quality.fit, "__defaults__", ("quality", 4))
    got = quality.scored(spark.read.parquet(path), labels, ["doc_id", "source"])
    rate = {r.source: r.quality_site_rate for r in got.collect()}
    assert rate["b"] - rate["a"] > 0.5
