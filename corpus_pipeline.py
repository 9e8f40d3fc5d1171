"""The corpus pipeline: documents to tokens in stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``; other columns are left out. Nulls, empty texts and empty
tables are treated as the operators' docstrings say. Without labels, nothing is rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, mixing, neardup, quality, toxicity
from lattica.llm.common import small_batches, table
from lattica.session import shared_folder

ROWS = 256  # rows with texts in an Arrow batch
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, with its sites' posteriors, doesn't reject."""
    out = quality.scored(docs, table(spark, sf_dir, "labels"), COLUMNS)
    return out.where(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.one_of_each(docs, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, a row for every time that one is served; one that isn't served goes."""
    return mixing.mixed_documents(docs, COLUMNS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens and of the bytes that they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_bytes),
]
ORACLE_SQL = None  # trained classifiers and token merges have no SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with small_batches(spark, ROWS):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
