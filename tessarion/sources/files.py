"""Artifacts from files: single files, scenario folders with a manifest, folders of Markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V
from ..functions.ids import content_id

MANIFEST = "name string, question string, artifacts array<struct<file: string, type: string, recorded_at: string>>"


def inferred_type(stem: Column) -> Column:
    """Artifact type by the first hint that begins the stem or follows an underscore or a hyphen."""
    out = F.lit("document")
    for hint, kind in reversed(V.TYPE_HINTS):
        out = F.when(F.rlike(F.lower(stem), F.lit(f"(^|[_-]){hint}")), kind).otherwise(out)
    return out


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("file", name).withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", ""))


def _artifacts(rows: DataFrame) -> DataFrame:
    return rows.select(
        content_id("artifact", "type", "content").alias("artifact_id"), "type", F.col("path").alias("source"), "content", "recorded_at", "ingest_seq"
    )


def load_artifact(spark: SparkSession, path: str, artifact_type: str | None = None, recorded_at: str = "") -> DataFrame:
    """One file as one artifact; its id is the hash of type and content, so loading it again changes nothing."""
    rows = _files(spark, path)
    kind = F.lit(artifact_type) if artifact_type else inferred_type(F.col("stem"))
    return _artifacts(rows.withColumns({"type": kind, "recorded_at": F.lit(recorded_at), "ingest_seq": F.lit(0).cast("bigint")}))


def load_scenario(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts of a folder in the order of its manifest.json; without one, its Markdown files by name, undated."""
    files = _files(spark, folder, "*.md")
    manifest = f"{folder}/manifest.json"
    there = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        order = F.row_number().over(W.orderBy("file")) - 1  # a folder of fixtures
        return _artifacts(files.withColumns({"type": inferred_type(F.col("stem")), "recorded_at": F.lit(""), "ingest_seq": order.cast("bigint")}))
    listed = spark.read.schema(MANIFEST).json(manifest, multiLine=True).select(F.posexplode("artifacts").alias("ingest_seq", "a"))
    listed = listed.select(F.col("ingest_seq").cast("bigint").alias("ingest_seq"), "a.file", F.col("a.type").alias("given"), F.coalesce("a.recorded_at", F.lit("")).alias("recorded_at"))
    rows = listed.join(files, "file").withColumn("type", F.coalesce("given", inferred_type(F.col("stem"))))
    return _artifacts(rows)


def scan_folder(spark: SparkSession, folder: str, dates: DataFrame | None = None, since: str = "", pattern: str = "*.md") -> DataFrame:
    """All Markdown files below a folder, in order of their paths.

    ``dates`` (path, recorded_at) dates them, paths as they are below the folder or in full; what is dated
    ``since`` or before is left out, what is undated never is.
    """
    rows = _files(spark, folder, pattern).withColumn("type", inferred_type(F.col("stem"))).withColumn("recorded_at", F.lit(""))
    if dates is not None:
        inside = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
        below = lambda c: F.element_at(F.split(F.col(c), r"\Q" + inside + r"\E", 2), -1)
        known = dates.groupBy(below("path").alias("__path")).agg(F.min("recorded_at").alias("__date"))
        rows = rows.join(known, below("path") == F.col("__path"), "left").withColumn("recorded_at", F.coalesce("__date", F.lit("")))
    if since:
        rows = rows.where((F.col("recorded_at") == "") | (F.col("recorded_at") > since))
    return _artifacts(rows.withColumn("ingest_seq", F.col("path")))


@dataclass
class MarkdownFolder:
    """A folder of documents as a source, dated by ``dates`` (path, recorded_at): the cursor is the last date."""

    folder: str
    dates: DataFrame | None = None
    pattern: str = "*.md"

    @property
    def source_id(self) -> str:
        return f"folder:{self.folder}:{self.pattern}"

    def fetch(self, spark: SparkSession, since: str = "") -> DataFrame:
        return scan_folder(spark, self.folder, self.dates, since, self.pattern).withColumn("cursor", F.col("recorded_at"))


def self_scan(documents: DataFrame, log: DataFrame) -> DataFrame:
    """A repository about itself: its documents, by path, and then its commits, as one set of artifacts."""
    shape = lambda rows, rank, at: rows.select("artifact_id", "type", "content", "recorded_at", F.struct(F.lit(rank).alias("rank"), at.alias("at")).alias("ingest_seq"))
    return shape(documents, 0, F.col("ingest_seq").cast("string")).unionByName(shape(log, 1, F.lpad(F.col("ingest_seq").cast("string"), 20, "0")))


def unknown(artifacts: DataFrame, applied: DataFrame) -> DataFrame:
    """Artifacts that were not applied yet."""
    return artifacts.join(applied.select("artifact_id"), "artifact_id", "left_anti")
