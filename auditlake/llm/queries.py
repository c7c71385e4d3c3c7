"""The registered queries of this folder: one per operator, each over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import table
from auditlake.llm.decontaminate import contamination
from auditlake.llm.language_id import language_id
from auditlake.llm.near_duplicates import near_duplicates
from auditlake.llm.oracle import ORACLE  # noqa: F401
from auditlake.llm.piece_sampling import sampled_pieces
from auditlake.llm.prefix_trie import conversation_trie, shared_heads
from auditlake.llm.quality_rules import quality
from auditlake.llm.shards import shards
from auditlake.llm.site_quality import site_quality
from auditlake.llm.source_divergence import source_divergence
from auditlake.llm.suffix_dedup import remove_repeats
from auditlake.llm.token_counts import token_counts
from auditlake.llm.token_files import token_files
from auditlake.llm.warc import responses_of, warc_derivatives

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return site_quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), with_ids=False).drop("ids")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_derivatives(responses_of(table(spark, sf_dir, "pages")))
    return records.select(
        F.col("key").cast("long").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "date", "content_type",
        "content_length", "block_digest", "source_payload_digest", F.crc32("block").alias("block_crc32"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), shared_heads)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_site_quality, op4_decontamination, op5_sampled_pieces, op6_shards, op7_quality_rules, op8_near_duplicates, op9_token_files, op10_warc_derivatives, op11_prefix_trie, op12_source_divergence, op13_language_id)}
