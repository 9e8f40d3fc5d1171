"""Filter audit, licence scan and collocations against plain versions."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import collocations, filter_audit, license_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_masks(rows):
    """Failures of each (doc_id, text), by the contract's words."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        words = WORD.findall(t)
        failed = [
            len(words) < 50,
            100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search("[#$%&*|]", t)),
            i is not None and i > least[t],
        ]
        out.append("".join(x for x, f in zip("ABCDE", failed) if f))
    return out


def plain_audit(rows, good, toxic):
    """rows: (doc_id, text, source)."""
    masks = plain_masks([r[:2] for r in rows])
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], m) for r, m in zip(rows, masks) if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                earlier = set(order[: step - 1])
                gone = [i for i, m in own if f in m and not earlier & set(m)]
                out[part, order, step] = [
                    sum(not set(order[:step]) & set(m) for _, m in own),
                    len(gone),
                    sum(f in m for _, m in own) - len(gone),
                    sum(m == f for _, m in own),
                    sum(i in good for i in gone),
                    sum(i in toxic for i in gone),
                ]
    total = defaultdict(int)
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_a_loop(odd, stored_odd, odd_labels):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(stored_odd, odd_labels).collect()}
    assert got == plain_audit(rows, {1, 7, 3}, {5, 6})


def test_audit_of_repeated_texts_and_signs(spark, no_labels):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(9, words, "a"), (3, words, "b"), (3, words, "b"), (None, words, "a"), (4, words + " 50%", "a"), (5, words.upper(), None), (6, "the " * 80, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(docs, no_labels).collect()}
    assert got == plain_audit(rows, set(), set())
    assert got["a", "EABCD", 1][:2] == (2, 1) and got["a", "EABCD", 5][1] == 1


def test_csr_shards_rebuild_every_document(stored_odd):
    rows = filter_audit.csr_shards(stored_odd).collect()
    documents, columns = [], defaultdict(Counter)
    for r in rows:
        indices, data = np.frombuffer(r["indices"], "<i8"), np.frombuffer(r["data"], "<i4")
        for k, key in enumerate(r["keys"]):
            at = slice(r["indptr"][k], r["indptr"][k + 1])
            assert (np.diff(indices[at]) > 0).all()
            documents.append((bytes(key), sorted(data[at].tolist())))
            for i, n in zip(indices[at].tolist(), data[at].tolist()):
                columns[i][bytes(key)] += n
    want, words = [], defaultdict(Counter)
    for r in stored_odd.select("text").collect():
        text = (r.text or "").encode()
        key = hashlib.sha256(text).digest()
        counts = Counter(WORD.findall(r.text or ""))
        want.append((key, sorted(counts.values())))
        for w, n in counts.items():
            words[w][key] += n
    assert sorted(documents) == sorted(want)
    assert sorted(sorted(x.items()) for x in columns.values()) == sorted(sorted(x.items()) for x in words.values())
    assert sorted(columns) == list(range(len(words)))


def test_audit_of_nothing(no_documents, no_labels):
    assert filter_audit.audit(no_documents, no_labels).count() == 0


PLAIN_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(PLAIN_LOWER))
    places = [(i, label) for phrase, label in license_scan.BASE.items() for n in [len(phrase.split())] for i in range(len(words)) if words[i : i + n] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def scanned(docs):
    return docs, license_scan.scan(docs).collect()


def test_scan_finds_every_place_of_base_phrases(spark, odd):
    texts = [
        "All rights reserved. ALL RIGHTS\nreserved all rights not reserved", "CC-BY cc by CC BY cc ccby", "General Public License general public licensé",
        "GNU General Public License, version 3 all rights reserved cc by", "K cc by", "cc bK by cc K", None, "", "42", "reserved all rights", "İ cc İ by cc by",
    ]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *plain_base(r.text)) for r in docs.collect()), key=repr)


def test_scan_bridges_small_edits_and_rejects_scattered_words(spark):
    permission = dict(license_scan.TEMPLATES[::-1])["mit"]
    long = license_scan.TEMPLATES[2][1]
    words = long.split()
    edited = " ".join([*words[:9], "and", "gladly", *words[9:17], *words[18:]])
    scattered = " and other things ".join(" ".join(words[i : i + 3]) for i in range(0, len(words) - 3, 3))
    docs = spark.createDataFrame([(1, f"x y {edited} z"), (2, scattered), (3, permission), (4, " ".join(words[: len(words) // 2])), (5, "All rights reserved.")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[1].labels == "mit" and 0.8 <= got[1].score < 1 and got[1].base_labels == ""
    assert got[2].labels == "" and got[2].score == 0 and got[4].labels == ""
    assert got[3].labels == "mit" and got[3].score == 1
    assert (got[5].labels, got[5].score, got[5].first_word) == ("reserved", 1.0, 0)
    span = license_scan.spans(docs).where("doc_id = 1 AND label = 'mit'").collect()
    assert [(r.first_word, r.last_word) for r in span] == [(2, 1 + len(edited.replace("(", " ").split()))]


def test_scan_of_nothing_and_native_plan(spark, no_documents, stored_odd):
    assert license_scan.scan(no_documents).count() == 0
    plan = license_scan.scan(stored_odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_collocations(rows, top, least=10):
    """rows: (text, lang)."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(PLAIN_LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for n in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            value, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-value, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (value, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -value))
    return sorted(out)


def test_collocations_equal_a_loop(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        words = [f"w{int(x)}" for x in rng.zipf(1.3, 120) % 60]
        for at in range(0, 110, 11):
            words[at : at + 3] = [["New", "york", "city"], ["ab", "cd", "w1"], ["x", "x", "x"], ["été", "dé", "jà"]][int(rng.integers(4))]
        rows.append((" ".join(words).replace("w7 ", "w7, ").replace("w9 ", "W9\t"), [None, "en", "und", "fr"][i % 4]))
    rows += [(None, "en"), ("", None), ("a\nb", "xx")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit(1)).withColumn("a", F.lit("x")).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    for top, begin in ((2000, 2), (20, 1)):
        monkeypatch.setattr(collocations, "BEGIN", begin)
        monkeypatch.setattr(collocations, "FASTER", 2)
        got = sorted(tuple(r) for r in collocations.mine(docs, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == plain_collocations(rows, top)


def test_bloom_holds_all_members_and_few_others(spark):
    rows = spark.createDataFrame([("en", f"w{i}", f"v{i}") for i in range(5000)], "lang string, a string, b string")
    held = collocations.Bloom(collocations.bloom(rows, ["a", "b"]))
    of = lambda n, m: collocations.pair_hashes(collocations.word_hashes(b"en", [b"w%d" % i for i in n]), collocations.word_hashes(b"en", [b"v%d" % i for i in m]))
    assert held.holds(of(range(5000), range(5000))).all()
    assert held.holds(of(range(5000), range(1, 5001))).mean() < 0.02


def test_exact_scores_past_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_001, 3_000_000_000_007)], "n long, l long, r long").select(collocations.score("n", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * 3_000_000_000_000**2 // (4_000_000_000_001 * 3_000_000_000_007)


def test_collocations_of_odd_documents(stored_odd, no_documents):
    rows = [(r.text, r.lang) for r in stored_odd.collect()]
    got = sorted(tuple(r) for r in collocations.mine(stored_odd).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations(rows, 2000)
    assert collocations.mine(no_documents).count() == 0
