"""From raw documents to a training mix: language ID, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the
shared folder and reads it again as the next stage's documents.  All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarion.llm.common import Scratch, read
from tessarion.llm.decontaminate import clean_documents
from tessarion.llm.language import detect_languages
from tessarion.llm.mixing import mix_sources
from tessarion.llm.neardup import near_dup_classes
from tessarion.llm.substrings import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if the network gives its language this share of its bytes, a little above chance: short
#: texts are placed with little confidence and are no worse for it.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; it rejects ``und``, null texts among them, and what it cannot place."""
    return detect_languages(spark, docs, carry=True).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: its representative, the one with the least id.

    A text stays under its own key, so ids that are null or repeat with different texts lose nothing; of
    repeated rows one stays.  Null, empty and wordless texts are no copies of each other and stay.
    """
    scratch = Scratch(spark, "near-dup-stage")
    stay = scratch.table(near_dup_classes(spark, docs).where("kept").select("doc_id", "key").distinct(), "keep")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).alias("own"))
    kept = rows.join(stay, (F.col("own") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    return kept.dropDuplicates(["id", "own"]).select("row.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id holds; what loses all its words goes.

    A text that loses nothing stays as it is, white space included; so do null texts, and rows under a null id.
    """
    whole = next(name for k in range(len(docs.columns) + 1) if (name := f"whole{k}") not in docs.columns)
    cut = dedup_substrings(spark, docs.withColumn(whole, F.col("text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"others.{whole}"))
    stay = cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    rest = [F.col(f"others.`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    return stay.select("doc_id", text.alias("text"), F.char_length(text).cast("bigint").alias("n_chars"), *rest).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside an occurrence of a benchmark window; null texts have none."""
    return clean_documents(spark, docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, and taken, the words that the mix takes of a document."""
    documents, _ = mix_sources(spark, docs)
    return documents.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", language_stage),
    ("near-dedup", near_dup_stage),
    ("substring dedup", substring_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: A trained network, sampled sketches and a pseudorandom mix have no equal in SQL; tests compare ``run``
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
