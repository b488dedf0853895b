"""The thin queries of this subpackage: contracts in, digests out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .decontaminate import decontaminate
from .html import extract_pages
from .language import detect_languages
from .mixing import mix_sources
from .neardup import near_dup_classes
from .quality import score_quality
from .substrings import dedup_substrings
from .token_counts import count_tokens
from .vectors import vector_classes
from .warc import archive_round_trip


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix_sources(spark, read(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op2_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_classes(spark, read(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(spark, read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_languages(spark, read(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_classes(spark, read(spark, sf_dir, "documents")).drop("key")


def op7_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_round_trip(spark, read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_vector_near_dedup,
        op3_decontaminate,
        op4_substring_dedup,
        op5_language_id,
        op6_minhash_near_dedup,
        op7_extract_html,
        op8_quality_votes,
        op9_warc_round_trip,
        op10_token_rollups,
    )
}
