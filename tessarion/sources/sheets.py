"""Samples of documents for review, and the scoring of reviewed sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V

# Shares at which a review says stop, or sees little scatter.
MOST_MISSING, LEAST_SCATTERED = 0.5, 0.2


def sample_documents(docs: DataFrame, n: int, seed: int = 0, key: str = "path") -> DataFrame:
    """The same ``n`` documents for a seed, wherever and however often it runs."""
    return docs.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def decision_documents(paths: DataFrame) -> DataFrame:
    """folder, path: the decision records among the Markdown files of a repository (path, relative to its root).

    Folders that are named for it by custom; where there are none, any with at least five files whose names begin
    with a number within four characters.
    """
    rows = paths.where(F.endswith(F.lower("path"), F.lit(".md")) & ~F.rlike("path", F.lit(r"(^|/)\.git/")))
    rows = rows.select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"))
    known = rows.where(F.col("folder").isin(*V.DECISION_FOLDERS))
    numbered = rows.groupBy("folder").agg(F.count_if(F.rlike(F.substring("stem", 1, 4), F.lit("[0-9]"))).alias("n")).where("n >= 5")
    other = rows.join(numbered.select("folder"), "folder", "left_semi").where(F.lit(known.isEmpty()))
    found = known.select("folder", "path", "stem").unionByName(other.select("folder", "path", "stem"))
    return found.where(~F.lower("stem").isin(*V.NO_DECISIONS)).select("folder", "path")


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def bucket_shares(sheet: DataFrame) -> DataFrame:
    """bucket, n, share of reviewed rows in buckets 1 (stated), 2 (scattered) and 3 (missing)."""
    counts = sheet.where(F.trim("bucket").isin("1", "2", "3")).groupBy(F.trim("bucket").alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def verdict(sheet: DataFrame) -> DataFrame:
    """One row: total, missing and scattered shares, and STOP, MARGINAL or PROCEED."""
    b = F.trim("bucket")
    out = sheet.where(b.isin("1", "2", "3")).agg(F.count("*").alias("total"), F.count_if(b == "3").alias("missing"), F.count_if(b == "2").alias("scattered"))
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    out = out.withColumn("missing", share("missing")).withColumn("scattered", share("scattered"))
    return out.withColumn("verdict", F.when(F.col("missing") > MOST_MISSING, "STOP").when(F.col("scattered") < LEAST_SCATTERED, "MARGINAL").otherwise("PROCEED"))
