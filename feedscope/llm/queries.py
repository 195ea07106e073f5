"""The operators' registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedscope.llm import chat_repair, class_lm, decontam, hard_negatives, language_id, license_scan, ngram_join, quality_rules, source_mix, token_counts, token_shards, warc, whitening
from feedscope.llm.common import load


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(load(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_digest(load(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(load(spark, sf_dir, "pages"))


def op5_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(load(spark, sf_dir, "conversations"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shard_digest(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(load(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(load(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(load(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(load(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(load(spark, sf_dir, "embeddings"))


def op13_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_source_mix, op3_decontamination, op4_warc, op5_chat_repair, op6_token_counts, op7_token_shards, op8_language_id, op9_license_scan, op10_ngram_join, op11_hard_negatives, op12_whitening, op13_class_lm)}


_WARC = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
h AS (SELECT page_id, url, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS hex, first FROM p JOIN f ON p.html = f.html)
SELECT page_id, payload_bytes, %s AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, regexp_replace(url, '\s', '%%20', 'g') AS url, NULL::VARCHAR AS error
FROM h
""" % " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, {1 + 10 * k}, 10))::BIGINT >> {35 - 5 * d}) & 31) + 1)::INT, 1)" for k in range(4) for d in range(8))


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE, "op2_source_mix": source_mix.ORACLE, "op4_warc": _WARC, "op11_hard_negatives": hard_negatives.ORACLE}
