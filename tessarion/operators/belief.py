"""Read path: what is believed about every concept, and why, answered in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V
from ..functions.ids import is_artifact, is_entity
from ..functions.scratch import Scratch
from . import memory as M
from .components import connected_components
from .memory import Memory

CLASS_BOUND = 64


def rank_of(predicate: Column) -> Column:
    """Place of a predicate in the order of presentation, 99 for others."""
    order = F.create_map(*[F.lit(x) for pair in ((p, k) for k, p in enumerate(V.DECISION_PREDICATES)) for x in pair])
    return F.coalesce(F.element_at(order, predicate), F.lit(99))


def identity_edges(m: Memory) -> DataFrame:
    return M.active_facts(m).where("predicate = 'same_as'").select(F.col("subject_ref").alias("a"), F.col("object_ref").alias("b"))


def identity_classes(m: Memory, bound: int = CLASS_BOUND) -> DataFrame:
    """ref, class_id, canonical_ref, label, member_rank, class_size, truncated for refs in active same_as facts.

    The canonical member has the longest label, then the least; members beyond ``bound`` are left out of
    a class, which is flagged then.
    """
    comps = connected_components(identity_edges(m), Scratch(m.facts.sparkSession, "identity"))
    named = M.with_labels(comps.select(F.col("id").alias("ref"), F.col("component").alias("class_id")), m.entities, "ref").withColumnRenamed("ref_label", "label")
    in_class = W.partitionBy("class_id")
    order = in_class.orderBy(F.length("label").desc(), "label", "ref")
    ranked = named.withColumn("member_rank", F.row_number().over(order)).withColumn("canonical_ref", F.first("ref").over(order)).withColumn("n", F.count("*").over(in_class))
    return ranked.where(F.col("member_rank") <= bound).select("ref", "class_id", "canonical_ref", "label", "member_rank", F.least("n", F.lit(bound)).alias("class_size"), (F.col("n") >= bound).alias("truncated"))


def classed_mentions(m: Memory, classes: DataFrame) -> DataFrame:
    """class_id, fact_id: every fact with every class that it mentions; a ref outside all classes is its own."""
    rows = M.mentions(m.facts.where("predicate <> 'same_as'")).join(classes.select("ref", "class_id"), "ref", "left")
    return rows.select(F.coalesce("class_id", "ref").alias("class_id"), "fact_id").distinct()


def first_retiring(m: Memory) -> DataFrame:
    """fact_id, retired_by, retired_by_artifact, retirement_reason, basis: the first edge of each retired fact."""
    e = m.supersessions.groupBy(F.col("superseded").alias("fact_id")).agg(F.min(F.struct("recorded_at", "superseding", "artifact_id", "reason", "basis")).alias("e"))
    return e.select("fact_id", F.col("e.superseding").alias("retired_by"), F.col("e.artifact_id").alias("retired_by_artifact"), F.col("e.reason").alias("retirement_reason"), F.col("e.basis").alias("basis"))


def nodes(m: Memory) -> DataFrame:
    """Every fact with labels, support and standing."""
    rows = M.with_labels(m.facts, m.entities, "subject_ref", "object_ref")
    rows = rows.join(M.support(m.evidence), "fact_id", "left").join(first_retiring(m), "fact_id", "left")
    return rows.withColumns(
        {
            "support": F.coalesce("support", F.lit(0.0)),
            "evidence_count": F.coalesce("evidence_count", F.lit(0)),
            "last_asserted": F.coalesce("last_asserted", F.lit("")),
            "active": F.col("retired_by").isNull(),
        }
    )


def beliefs(m: Memory, classes: DataFrame | None = None, predicates: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """class_id, fact_id, section ('current' or 'history'), predicate_rank and the node of each fact.

    A class gets the facts that mention it under the wanted predicates, and the facts that its current
    ones retired, whatever their predicate.  ``only`` (class_id) names the classes, if not all are wanted.
    """
    classes = identity_classes(m) if classes is None else classes
    wanted = predicates or V.DECISION_PREDICATES
    node = nodes(m)
    mentions = classed_mentions(m, classes)
    mentions = mentions if only is None else mentions.join(only.select("class_id"), "class_id", "left_semi")
    direct = mentions.join(node.where(F.col("predicate").isin(wanted)).select("fact_id", "active"), "fact_id")
    walked = direct.where("active").join(m.supersessions.select(F.col("superseding").alias("fact_id"), "superseded"), "fact_id").select("class_id", F.col("superseded").alias("fact_id"))
    every = direct.select("class_id", "fact_id").unionByName(walked).distinct()
    out = every.join(node, "fact_id")
    return out.withColumn("section", F.when(F.col("active"), "current").otherwise("history")).withColumn("predicate_rank", rank_of(F.col("predicate")))


def ask(m: Memory, names: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """names (name) with ref, class_id and outcome: 'answered', 'unbound', 'no facts' or 'no decision'."""
    classes = identity_classes(m)
    bound = M.resolve_names(names, m.entities).join(classes.select(F.col("ref").alias("entity_id"), "class_id"), "entity_id", "left").withColumn("class_id", F.coalesce("class_id", "entity_id"))
    seen = classed_mentions(m, classes).join(m.facts.select("fact_id", "predicate"), "fact_id")
    counts = seen.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(F.col("predicate").isin(predicates or V.DECISION_PREDICATES)).alias("n_wanted"))
    out = bound.join(counts, "class_id", "left")
    outcome = F.when(F.col("entity_id").isNull(), "unbound").when(F.coalesce("n", F.lit(0)) == 0, "no facts").when(F.col("n_wanted") == 0, "no decision").otherwise("answered")
    return out.select("name", F.col("entity_id").alias("ref"), "class_id", outcome.alias("outcome"))


def decisions_of(belief: DataFrame) -> DataFrame:
    """The decision of each class: its first current selection by (object_ref, fact_id).

    A minimum of rows as structs, which is aggregated before the shuffle: a concept in many facts is no
    large group.
    """
    chosen = belief.where("section = 'current' AND predicate = 'selected'")
    rest = [c for c in belief.columns if c not in ("class_id", "predicate_rank", "object_ref", "fact_id")]
    first = chosen.groupBy("class_id").agg(F.min_by(F.struct(*rest), F.struct("predicate_rank", "object_ref", "fact_id")).alias("r"), F.min(F.struct("predicate_rank", "object_ref", "fact_id")).alias("f"))
    return first.select("class_id", "f.*", "r.*").select(*belief.columns)


def conflicts_of(m: Memory, belief: DataFrame) -> DataFrame:
    """class_id, n_conflicts: conflict rows that touch a class's directly mentioned facts, from either side.

    A conflict between two facts of one class counts from both, as two open ends.
    """
    ends = m.conflicts.select("fact_a", "fact_b", F.explode(F.array("fact_a", "fact_b")).alias("fact_id"))
    return belief.select("class_id", "fact_id").join(ends, "fact_id").groupBy("class_id").agg(F.count("*").alias("n_conflicts"))


def filled(template: str, **parts: Column) -> Column:
    """A text with columns in the places of their names."""
    out, rest = [], template
    while rest:
        before, brace, rest = rest.partition("{")
        out.append(F.lit(before))
        if brace:
            name, _, rest = rest.partition("}")
            out.append(parts[name])
    return F.concat(*out)


def diagnostics(m: Memory, belief: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, diagnostics (array): what memory says is shaky about an answer."""
    per = belief.groupBy("class_id").agg(
        F.count_if(F.col("section") == "current").alias("current"),
        F.count_if(F.col("section") == "history").alias("history"),
        F.count_if((F.col("section") == "history") & (F.col("basis") == "ingestion_order")).alias("by_ingestion"),
        F.count_if((F.col("section") == "current") & (F.col("last_asserted") == "")).alias("undated"),
    )
    merged = classes.groupBy("class_id").agg(F.max("class_size").alias("names"), F.max("truncated").alias("truncated"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_rank", "label"))), lambda x: x["label"]), ", ").alias("labels"), F.min_by("label", "member_rank").alias("canonical"))
    rows = per.join(merged, "class_id", "left")
    count = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    merged = filled(V.MERGED, name=F.col("canonical"), n=F.col("names").cast("string"), labels=F.col("labels"))
    notes = F.array(
        F.when((F.col("current") > 0) & (F.col("history") == 0), V.NO_HISTORY),
        F.when(F.col("by_ingestion") > 0, count("by_ingestion", V.INGESTION_ORDERED)),
        F.when(F.col("names") > 1, merged),
        F.when(F.col("truncated"), V.TRUNCATED),
        F.when(F.col("undated") > 0, count("undated", V.UNDATED)),
    )
    return rows.select("class_id", F.filter(notes, lambda n: n.isNotNull()).alias("diagnostics"))


def timeline(m: Memory, classes: DataFrame | None = None) -> DataFrame:
    """class_id, when, fact_id, event, artifact_id, artifact_type, statement and place, undated entries last."""
    classes = identity_classes(m) if classes is None else classes
    asserted = m.evidence.select("fact_id", F.col("recorded_at").alias("when"), "artifact_id", "artifact_type", F.lit("asserted").alias("event"))
    retired = m.supersessions.select(F.col("superseded").alias("fact_id"), F.col("recorded_at").alias("when"), "artifact_id", F.lit("").alias("artifact_type"), F.lit("retired").alias("event"))
    events = asserted.unionByName(retired).groupBy("when", "fact_id", "event", "artifact_id").agg(F.min("artifact_type").alias("artifact_type"))
    labelled = M.with_labels(m.facts, m.entities, "subject_ref", "object_ref")
    statement = F.concat("subject_ref_label", F.lit(" --"), "predicate", F.lit("--> "), "object_ref_label")
    rows = classed_mentions(m, classes).join(events, "fact_id").join(labelled.select("fact_id", statement.alias("statement")), "fact_id")
    order = W.partitionBy("class_id").orderBy(F.col("when") == "", "when", "fact_id", "event", "artifact_id")
    return rows.withColumn("place", F.row_number().over(order))


def dependents(m: Memory, classes: DataFrame | None = None) -> DataFrame:
    """class_id, fact_id, ref, label, predicate, support, evidence_count: what relies on each concept now."""
    classes = identity_classes(m) if classes is None else classes
    live = M.active_facts(m).where(F.col("predicate").isin(V.DEPENDENCY_PREDICATES) & ~is_artifact(F.col("subject_ref")))
    live = live.join(classes.select(F.col("ref").alias("object_ref"), "class_id"), "object_ref", "left").withColumn("class_id", F.coalesce("class_id", "object_ref"))
    rows = M.with_labels(live, m.entities, "subject_ref").join(M.support(m.evidence), "fact_id", "left")
    return rows.select("class_id", "fact_id", F.col("subject_ref").alias("ref"), F.col("subject_ref_label").alias("label"), "predicate", F.coalesce("support", F.lit(0.0)).alias("support"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"))


def decisions(m: Memory) -> DataFrame:
    """subject, object, is_current of every recorded selection."""
    return decided(m.facts, m.supersessions.select(F.col("superseded").alias("fact_id")), m.entities)


def decided(facts: DataFrame, retired: DataFrame, entities: DataFrame) -> DataFrame:
    """``decisions`` of facts and of those that are retired (fact_id)."""
    rows = M.with_labels(M.marked(facts, retired).where("predicate = 'selected'"), entities, "subject_ref", "object_ref")
    return rows.select(F.col("subject_ref_label").alias("subject"), F.col("object_ref_label").alias("object"), F.col("is_active").alias("is_current"))


def health(m: Memory) -> DataFrame:
    """One row: what is weak about the knowledge base."""
    proof = m.evidence.groupBy("fact_id").agg(F.count("*").alias("n"), F.count_if(F.col("recorded_at") != "").alias("dated"))
    rows = M.with_status(m).join(proof, "fact_id", "left")
    literal = lambda c: (~is_entity(F.col(c)) & ~is_artifact(F.col(c))).cast("int")
    out = rows.agg(
        F.count("*").alias("total_facts"),
        F.count_if("is_active").alias("active_facts"),
        F.count_if(F.coalesce("dated", F.lit(0)) == 0).alias("undated_facts"),
        F.count_if(F.col("is_active") & (F.col("n") == 1)).alias("single_source_facts"),
        F.coalesce(F.sum(literal("subject_ref") + literal("object_ref")), F.lit(0)).cast("bigint").alias("unresolved_literals"),
    )
    held = m.facts.select("fact_id")
    by_order = m.supersessions.where("basis = 'ingestion_order'").join(held, m.supersessions["superseded"] == held["fact_id"], "left_semi")
    ends = m.conflicts.select(F.explode(F.array("fact_a", "fact_b")).alias("fact_id")).join(held, "fact_id", "left_semi")
    return out.withColumn("ingestion_ordered_supersessions", by_order.agg(F.count("*")).scalar()).withColumn("open_conflicts", ends.agg(F.floor(F.count("*") / 2)).scalar())


def health_notes(report: DataFrame) -> DataFrame:
    """Adds notes (array of text) to a health row."""
    say = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    notes = F.array(
        say("ingestion_ordered_supersessions", " supersession(s) rest on ingestion order. Re-importing those artifacts in a different order could change what the project believes."),
        say("single_source_facts", " active fact(s) have exactly one supporting artifact."),
        say("unresolved_literals", " fact operand(s) never resolved to an entity and are stored as literal text."),
    )
    return report.withColumn("notes", F.filter(notes, lambda n: n.isNotNull()))
