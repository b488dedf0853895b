"""Incremental ingestion: micro-batches of artifacts, or runs over a source, into a store.

A batch is compiled and folded onto what memory holds; nothing that was linked before is linked again.
Artifacts that are applied already are skipped.  Late artifacts are never dropped: an older one loses to
what is stored, by its date.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..functions.scratch import Scratch
from ..operators import linker
from ..operators.compiler import Compiled, compile_artifacts
from ..operators.memory import Memory
from ..operators.store import FolderStore, MemoryStore, as_tables
from ..sources.base import ArtifactSource
from ..sources.files import inferred_type, unknown


@dataclass
class SourceRun:
    """What one pass over a source saw."""

    source_id: str
    produced: int = 0
    skipped: int = 0
    cursor: str = ""
    notes: list[str] = field(default_factory=list)


def _store(spark: SparkSession, where: str | MemoryStore) -> MemoryStore:
    return FolderStore(spark, where) if isinstance(where, str) else where


def applied(spark: SparkSession, where: str | MemoryStore) -> DataFrame:
    return _store(spark, where).table("applied")


def apply_batch(artifacts: DataFrame, where: str | MemoryStore, batch: int = 0, *, rules: Sequence[linker.Rule] = linker.DEFAULT_RULES, compile: Callable[[DataFrame], Compiled] = compile_artifacts) -> int:
    """Compile, link and commit the artifacts that memory does not know; their number.

    Artifacts (artifact_id, type, content, recorded_at, ingest_seq) are applied in order of ``ingest_seq``,
    of any type that has an order; of a repeated artifact the first counts.  Two batches end as one
    batch of both would.  The commit is atomic: an interrupted batch is done again from the start.
    """
    spark = artifacts.sparkSession
    store, scratch = _store(spark, where), Scratch(spark, "batch")
    first = artifacts.groupBy("artifact_id").agg(F.min_by(F.struct(*[c for c in artifacts.columns if c != "artifact_id"]), F.struct("ingest_seq", F.coalesce("recorded_at", F.lit("")))).alias("r"))
    new = scratch.table(unknown(first.select("artifact_id", "r.*"), store.table("applied")), "new")
    n = new.count()
    if n:
        delta = linker.link(spark, new, compile(new), memory=store.load(), rules=rules)
        ledger = new.select("artifact_id", F.coalesce("recorded_at", F.lit("")).alias("recorded_at"), F.lit(batch).cast("bigint").alias("batch"))
        store.commit({**as_tables(delta), "applied": ledger})
    scratch.drop(new)
    return n


def ingest_source(spark: SparkSession, source: ArtifactSource, where: str | MemoryStore, *, resume: bool = True, **options) -> SourceRun:
    """Apply what a source holds beyond its cursor, then move the cursor.

    Artifacts are known by their content, so an overlap is skipped: the cursor saves work and decides nothing.
    """
    store = _store(spark, where)
    run = SourceRun(source.source_id)
    known = cursors(spark, store).where(F.col("source") == source.source_id).first() if resume else None
    scratch = Scratch(spark, "pull")
    rows = scratch.table(source.fetch(spark, known["cursor"] if known else ""), "fetched")
    run.produced = apply_batch(rows.drop("cursor"), store, **options)
    seen = rows.agg(F.count_distinct("artifact_id").alias("n"), F.max_by("cursor", "ingest_seq").alias("cursor")).first()
    run.skipped, run.cursor = seen["n"] - run.produced, seen["cursor"] or ""
    if run.cursor:
        set_cursor(spark, store, source.source_id, run.cursor)
    if not seen["n"]:
        run.notes.append("nothing new")
    scratch.drop(rows)
    return run


def ingest_stream(stream: DataFrame, where: str | MemoryStore, checkpoint: str, **options):
    """Apply a stream of artifacts until what is there now is done; the finished query.

    The checkpoint holds the source's position; a batch that is replayed adds nothing.
    """
    query = stream.writeStream.foreachBatch(lambda batch, k: apply_batch(batch, where, k, **options) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def markdown_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Markdown files below a folder as artifacts without dates, in order of their paths."""
    rows = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    rows = rows.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source"))
    rows = rows.withColumn("type", inferred_type(F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", "")))
    return rows.select(content_id("artifact", "type", "content").alias("artifact_id"), "type", "source", "content", F.lit("").alias("recorded_at"), F.col("source").alias("ingest_seq"))


def set_cursor(spark: SparkSession, where: str | MemoryStore, source: str, cursor: str) -> None:
    """Move a source's cursor: a row more; the latest counts."""
    store = _store(spark, where)
    seq = (store.table("cursors").where(F.col("source") == source).agg(F.max("seq").alias("s")).first()["s"] or 0) + 1
    store.commit({"cursors": spark.createDataFrame([(source, cursor, seq)], "source string, cursor string, seq bigint")})


def latest_cursors(rows: DataFrame) -> DataFrame:
    """source, cursor of (source, cursor, seq): the latest of each."""
    return rows.groupBy("source").agg(F.max_by("cursor", "seq").alias("cursor"))


def cursors(spark: SparkSession, where: str | MemoryStore) -> DataFrame:
    return latest_cursors(_store(spark, where).table("cursors"))


def load_memory(spark: SparkSession, folder: str) -> Memory:
    return Memory.load(spark, folder)
