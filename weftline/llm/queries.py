"""One registered query for each training-data operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.llm.license_rules import oracle as license_sql


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.lm_scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.chat_format import digests, format_chats

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = F.lit("\\### Assistant: </turn> ok").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), one)
    return digests(format_chats(turns.unionByName(extra)))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(13 + length(regexp_replace(role || text, '([\\<#:])', '\\\1', 'g')))::BIGINT AS formatted_chars,
  true AS round_trip
FROM t GROUP BY conv_id
"""


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality_knn import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.license_rules import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.embedding_join import embedding_components

    return embedding_components(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_jaccard_join, op3_chat_format, op4_quality_knn, op5_bpe, op6_license_rules, op7_mix_sources, op8_quality_rules, op9_embedding_join, op10_pii)
}
ORACLE_SQL: dict[str, str] = {"op3_chat_format": OP3_SQL, "op6_license_rules": license_sql()}
