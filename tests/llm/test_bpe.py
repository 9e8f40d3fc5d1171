"""Byte-level BPE against tiktoken, and boundaries on hostile strings."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODER = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Encoder(RANKS)


def encoded(texts):
    ids, counts = bpe.encode_texts(OWN, [t.encode() for t in texts])
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab sStTmMdDrReEvVlL''''!?  \n\t éß中1٢৩́\U0001f600½", max_size=40), min_size=1, max_size=6))
def test_same_tokens(texts):
    assert encoded(texts) == [CODER.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_characters(text):
    assert [OWN.decode(np.array(encoded([text])[0], np.uint32)).tobytes().decode()] == [text]


def test_classes_of_characters():
    """A character's class shows in a vocabulary where only whole pieces merge."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = [c for c in points if c < 0x3000 or c % 97 == 0]
    single = {bytes([i]): i for i in range(256)}
    for kind, before in ((bpe.LETTER, "a"), (bpe.NUMBER, "1"), (bpe.OTHER, "!")):
        for c in points[:: 7 if kind != bpe.LETTER else 3]:
            raw = chr(c).encode()
            ranks = dict(single)
            whole = before.encode() + raw
            for n in range(2, len(whole) + 1):
                ranks[whole[:n]] = 255 + n
            coder = tiktoken.Encoding("one", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if c % 5 == 0 else None
            if coder is not None and __import__("unicodedata").category(chr(c)) != "Cn":
                assert (len(coder.encode_ordinary(whole.decode())) == 1) == (bpe.code_classes()[c] == kind), hex(c)


@pytest.mark.parametrize("text", ["", " ", "'s", "''s", "x's's", "a" * 5_000, " " * 3_000, "abc" * 2_000 + "'ll", "\n\n  a", "it's  \n"])
def test_edges(text):
    assert encoded([text, "next"]) == [CODER.encode_ordinary(text), CODER.encode_ordinary("next")]


def test_over_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = CODER.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows(stored_odd, no_documents):
    out = bpe.digests(stored_odd, PATH).collect()
    texts = sorted((r.text or "") for r in stored_odd.collect())
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert bpe.digests(no_documents, PATH).count() == 0


def test_offsets_are_checked(spark):
    bad = spark.createDataFrame([(1, 1, bytearray(np.array([5], "<u4").tobytes()), bytearray(np.array([3], "<u4").tobytes()))], "doc_id long, n_tokens long, ids binary, offsets binary")
    with pytest.raises(Exception, match="offsets"):
        bpe.decode(bad, PATH).collect()


def test_one_worker_encodes_and_decodes(spark, small):
    plan = bpe.digests(spark.read.parquet(f"{small}/documents.parquet"), PATH)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
