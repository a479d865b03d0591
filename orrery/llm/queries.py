"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, exact_dedup, mixing, ngram, pii, suffix_quality, token_records, toxicity, warc
from .common import read, scratch


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram.held_out_scores(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_records.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    out = token_records.read_back(spark, folder)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bagminhash.near_classes(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup_groups(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(read(spark, sf_dir, "pages"))
    return out.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_quality.measures(read(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        suffix_quality.base_failed().alias("base_failed"), suffix_quality.verdict().alias("kept"),
    )


QUERIES = {f.__name__: f for f in (op1_mixing, op2_lm_scoring, op3_toxicity, op4_token_records, op5_near_dedup, op6_pii, op7_exact_dedup, op8_bpe, op9_warc, op10_quality_rules)}

ORACLES = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM m""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
