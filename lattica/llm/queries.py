"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import ann, bpe, collocations, exact_topk, filter_audit, license_scan, mixing, neardup, pseudo_likelihood, quality, reshard, token_shards, toxicity
from lattica.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@register
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@register
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@register
def op10_reshard(spark: SparkSession, folder: str) -> DataFrame:
    return reshard.digests(table(spark, folder, "documents"))


@register
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(table(spark, folder, "documents"))


@register
def op2_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"))


@register
def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_topk.search(table(spark, folder, "embeddings"))


ORACLE["op5_exact_top_k"] = """
WITH u AS (SELECT DISTINCT vec_id, embedding FROM embeddings),
v AS (
  SELECT vec_id, list_transform(embedding, x -> CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM u
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), p -> p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""


@register
def op1_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_shards.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register
def op7_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_likelihood.scored(table(spark, folder, "documents"))


@register
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLE["op11_filter_audit"] = filter_audit.ORACLE


@register
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


ORACLE["op12_license_scan"] = license_scan.ORACLE


@register
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


ORACLE["op13_collocations"] = collocations.ORACLE
