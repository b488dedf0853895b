"""Memory: the tables of facts and evidence, and lookups over them, all set-based."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import is_artifact, is_entity

SCHEMAS = {
    "entities": "entity_id string, name string, type string, aliases array<string>",
    "facts": "fact_id string, subject_ref string, predicate string, object_ref string, fact_type string",
    "evidence": "evidence_id string, fact_id string, artifact_id string, artifact_type string, recorded_at string, confidence double, authority double, supporting array<string>",
    "supersessions": "superseding string, superseded string, reason string, artifact_id string, recorded_at string, basis string",
    "conflicts": "fact_a string, fact_b string, conflict_type string, artifact_id string",
}
#: Rows of ids and short texts that are broadcast whatever the session's threshold: at most some ten MB.
FEW = 100_000
KEYS = {"entities": ["entity_id"], "facts": ["fact_id"], "evidence": ["evidence_id"], "supersessions": ["superseding", "superseded"], "conflicts": ["fact_a", "fact_b", "conflict_type"]}


@dataclass
class Memory:
    """Five tables; none is ever updated or deleted from, a retired fact is one with an edge."""

    entities: DataFrame
    facts: DataFrame
    evidence: DataFrame
    supersessions: DataFrame
    conflicts: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Memory:
        return cls(*[spark.createDataFrame([], SCHEMAS[f.name]) for f in fields(cls)])

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Memory:
        from .store import FolderStore

        return FolderStore(spark, folder).load()

    def save(self, folder: str) -> None:
        """Add what the folder's memory lacks, as one commit; saving again adds nothing."""
        from .store import FolderStore, as_tables

        FolderStore(self.facts.sparkSession, folder).commit(as_tables(self))


# -- lookups --------------------------------------------------------------------


def aliases(entities: DataFrame) -> DataFrame:
    """alias (lower case), entity_id: names first, then aliases; an alias of several concepts goes to the least id."""
    names = entities.select(F.lower("name").alias("alias"), F.lit(0).alias("rank"), "entity_id")
    others = entities.select(F.explode(F.transform("aliases", F.lower)).alias("alias"), F.lit(1).alias("rank"), "entity_id")
    best = names.unionByName(others).groupBy("alias").agg(F.min(F.struct("rank", "entity_id")).alias("b"))
    return best.select("alias", "b.entity_id")


def resolve_names(names: DataFrame, entities: DataFrame, column: str = "name") -> DataFrame:
    """Adds entity_id, null for names that memory never bound."""
    known = aliases(entities).withColumnRenamed("alias", "__alias")
    return names.join(known, F.lower(F.trim(names[column])) == F.col("__alias"), "left").drop("__alias")


def active_facts(m: Memory) -> DataFrame:
    return m.facts.join(m.supersessions.select(F.col("superseded").alias("fact_id")), "fact_id", "left_anti")


def with_status(m: Memory) -> DataFrame:
    """Facts with is_active."""
    return marked(m.facts, m.supersessions.select(F.col("superseded").alias("fact_id")))


def marked(facts: DataFrame, retired: DataFrame) -> DataFrame:
    """Facts with is_active: whether they are not among the retired (fact_id)."""
    gone = retired.select("fact_id").distinct().withColumn("gone", F.lit(True))
    return facts.join(gone, "fact_id", "left").withColumn("is_active", F.col("gone").isNull()).drop("gone")


def active_for_subject(m: Memory, ref: str) -> DataFrame:
    return active_facts(m).where(F.col("subject_ref") == ref)


def active_with_object(m: Memory, ref: str, predicates: list[str] | None = None) -> DataFrame:
    found = active_facts(m).where(F.col("object_ref") == ref)
    return found if predicates is None else found.where(F.col("predicate").isin(predicates))


def existing_fact(m: Memory, subject: str, predicate: str, obj: str) -> DataFrame:
    return m.facts.where((F.col("subject_ref") == subject) & (F.col("predicate") == predicate) & (F.col("object_ref") == obj))


def mentions(facts: DataFrame) -> DataFrame:
    """ref, fact_id: a row for each concept that a fact names, once if it names it twice."""
    return facts.select(F.explode(F.array_distinct(F.array("subject_ref", "object_ref"))).alias("ref"), "fact_id")


def facts_mentioning(m: Memory, ref: str) -> DataFrame:
    return m.facts.where((F.col("subject_ref") == ref) | (F.col("object_ref") == ref))


def evidence_for(m: Memory, fact_id: str) -> DataFrame:
    return m.evidence.where(F.col("fact_id") == fact_id).orderBy("recorded_at", "evidence_id")


def edges_retiring(m: Memory, fact_id: str) -> DataFrame:
    return m.supersessions.where(F.col("superseded") == fact_id)


def edges_caused_by(m: Memory, fact_id: str) -> DataFrame:
    return m.supersessions.where(F.col("superseding") == fact_id)


def edges_both_ways(m: Memory) -> DataFrame:
    """fact_id, other: every edge seen from either end."""
    pair = m.supersessions.select(F.explode(F.array(F.struct(F.col("superseded").alias("fact_id"), F.col("superseding").alias("other")), F.struct(F.col("superseding").alias("fact_id"), F.col("superseded").alias("other")))).alias("e"))
    return pair.select("e.*")


def conflicts_involving(m: Memory, fact_id: str) -> DataFrame:
    return m.conflicts.where((F.col("fact_a") == fact_id) | (F.col("fact_b") == fact_id))


def label(ref: Column, name: Column) -> Column:
    """A concept's name, the short form of an artifact, or the text itself."""
    return F.coalesce(name, F.when(is_artifact(ref), F.concat(F.lit("<"), F.substring(ref, 10, 12), F.lit(">"))), ref)


def with_labels(rows: DataFrame, entities: DataFrame, *columns: str) -> DataFrame:
    """Adds <column>_label for each ref column."""
    for c in columns:
        names = entities.select(F.col("entity_id").alias(c), F.col("name").alias("__name"))
        rows = rows.join(names, c, "left").withColumn(f"{c}_label", label(F.col(c), F.col("__name"))).drop("__name")
    return rows


def support_columns() -> list[Column]:
    """What evidence adds up to, over any group of it: support, evidence_count, last_asserted ('' if none is dated)."""
    w = F.round(F.col("confidence") * F.col("authority"), 6)
    return [F.round(F.sum(w), 6).alias("support"), F.count("*").alias("evidence_count"), F.coalesce(F.max(F.nullif("recorded_at", F.lit(""))), F.lit("")).alias("last_asserted")]


def support(evidence: DataFrame) -> DataFrame:
    """fact_id, support, evidence_count, last_asserted ('' if no evidence is dated)."""
    return evidence.groupBy("fact_id").agg(*support_columns())


def stats(m: Memory) -> DataFrame:
    """One row of counts; active facts are those without a retiring edge."""
    one = m.facts.agg(F.count("*").alias("facts"))
    counts = {
        "entities": m.entities.agg(F.count("*")),
        "evidence": m.evidence.agg(F.count("*")),
        "supersessions": m.supersessions.agg(F.count("*")),
        "conflicts": m.conflicts.agg(F.count("*")),
        "retired": m.supersessions.agg(F.count_distinct("superseded")),
    }
    for name, df in counts.items():
        one = one.withColumn(name, df.scalar())
    return one.withColumn("active_facts", F.col("facts") - F.col("retired")).drop("retired")


def literal_operands(facts: DataFrame) -> DataFrame:
    """Operands that never became a concept."""
    refs = facts.select("fact_id", F.explode(F.array("subject_ref", "object_ref")).alias("ref"))
    return refs.where(~is_entity(F.col("ref")) & ~is_artifact(F.col("ref")))
