"""Linker: compiled facts to memory, and the rules that retire or contradict facts.

Rules follow the order of ingestion: an artifact meets what memory holds by then, a retired fact that is
asserted again stays retired, and a declaration retires only what is stored already.  ``replay`` folds any
number of artifacts, onto stored memory or onto none, to the edges that one artifact at a time would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V
from ..functions.ids import artifact_ref, content_id, entity_id
from ..functions.scratch import SLICE, Scratch, in_slice, stored_size
from . import memory as M
from .compiler import Compiled, literal_map
from .memory import Memory
from .store import missing

EDGE = "superseding string, superseded string, reason string, artifact_id string, recorded_at string, basis string"
CONFLICT = "fact_a string, fact_b string, conflict_type string, artifact_id string"
#: What a rule is: (session, assertions, memory before them or None) to (supersessions, conflicts).
Rule = Callable[[SparkSession, DataFrame, Memory | None], tuple[DataFrame, DataFrame]]


def authority(artifact_type: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in V.AUTHORITY.items() for x in pair])
    return F.coalesce(F.element_at(weights, artifact_type), F.lit(V.DEFAULT_AUTHORITY))


def weight(confidence: Column, auth: Column) -> Column:
    return F.round(confidence * auth, 6)


def time_order(a: Column, b: Column) -> Column:
    """How an assertion at ``a`` stands to one at ``b``; times are ISO text and compare as text."""
    return F.when((a == "") | (b == ""), "unknown").when(a == b, "simultaneous").when(a > b, "later").otherwise("earlier")


def bind(entity_rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds entity_id to entity rows: that of a known (alias, entity_id), else the hash of the name."""
    if known is None:
        return entity_rows.withColumn("entity_id", entity_id(F.col("name")))
    hit = known.select(F.lower("alias").alias("key"), F.col("entity_id").alias("known_id"))
    return entity_rows.join(hit, "key", "left").withColumn("entity_id", F.coalesce("known_id", entity_id(F.col("name")))).drop("known_id")


def operand(text: Column, bound: Column, artifact_id: Column) -> Column:
    """The artifact itself, the concept of that name in this artifact, or the text as it is."""
    return F.when(F.lower(F.trim(text)).isin(list(V.SELF_REFERENCES)), artifact_ref(artifact_id)).otherwise(F.coalesce(bound, text))


def assertions(artifacts: DataFrame, compiled: Compiled, known: DataFrame | None = None) -> DataFrame:
    """One row a compiled fact: fact_id and refs with the artifact's id, type, date, order and weights."""
    bound = bind(compiled.entities, known)
    side = lambda c: bound.select("artifact_id", F.col("key").alias(f"{c}_key"), F.col("entity_id").alias(f"{c}_entity"))
    rows = compiled.facts.withColumn("subject_key", F.lower(F.trim("subject"))).withColumn("object_key", F.lower(F.trim("object")))
    rows = rows.join(side("subject"), ["artifact_id", "subject_key"], "left").join(side("object"), ["artifact_id", "object_key"], "left")
    rows = rows.withColumn("subject_ref", operand(F.col("subject"), F.col("subject_entity"), F.col("artifact_id")))
    rows = rows.withColumn("object_ref", operand(F.col("object"), F.col("object_entity"), F.col("artifact_id")))
    meta = artifacts.select("artifact_id", F.col("type").alias("artifact_type"), F.coalesce("recorded_at", F.lit("")).alias("recorded_at"), "ingest_seq")
    rows = rows.join(meta, "artifact_id")
    return rows.select(
        content_id("fact", "subject_ref", "predicate", "object_ref").alias("fact_id"),
        "subject_ref",
        "predicate",
        "object_ref",
        "fact_type",
        "artifact_id",
        "fact_ord",
        "artifact_type",
        "recorded_at",
        "ingest_seq",
        "confidence",
        authority(F.col("artifact_type")).alias("authority"),
        "supporting",
    )


def promote(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The distinct facts of assertions that memory does not hold."""
    new = rows.select("fact_id", "subject_ref", "predicate", "object_ref", "fact_type").dropDuplicates(["fact_id"])
    return new if known is None else missing(new, known, ["fact_id"])


def evidence(rows: DataFrame) -> DataFrame:
    return rows.select(
        content_id("evidence", F.col("artifact_id"), F.concat(F.lit("fact:"), F.col("fact_ord").cast("string"))).alias("evidence_id"),
        "fact_id",
        "artifact_id",
        "artifact_type",
        "recorded_at",
        "confidence",
        "authority",
        "supporting",
    ).dropDuplicates(["evidence_id"])


def entity_table(artifacts: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """entity_id, name, type, aliases; the first artifact in order names a concept."""
    rows = bind(entity_rows).join(artifacts.select("artifact_id", "ingest_seq"), "artifact_id")
    first = rows.groupBy("entity_id").agg(F.min(F.struct("ingest_seq", "entity_ord", "name", "type")).alias("f"), F.array_sort(F.collect_set("name")).alias("aliases"))
    return first.select("entity_id", "f.name", "f.type", "aliases")


# -- rules, in order of ingestion ------------------------------------------------


def sightings(rows: DataFrame, memory: Memory | None, scratch: Scratch) -> DataFrame:
    """Facts that a rule may ask about: a row a fact and date, at the place of its first artifact.

    ``place`` is (ingest_seq, artifact_id); ``new`` marks where memory takes the fact in.  Copies of an
    assertion are aggregated before the shuffle, so a fact that all artifacts repeat is as many rows as dates.
    """
    fact = ["fact_id", "subject_ref", "predicate", "object_ref"]
    n = 1 + stored_size(rows) // SLICE
    rows = rows.where(F.col("predicate").isin("selected", *V.DECLARED_PREDICATES, "prohibits", "allows")).unionByName(declared_uses(rows, scratch))
    return scratch.sliced(lambda k: sighted(rows.where(in_slice("fact_id", k, n)), fact, memory), n, "sightings")


def declared_uses(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Assertions of use whose subject or object a declaration is about: no other use meets a rule."""
    refs = scratch.table(rows.where(F.col("predicate").isin(V.DECLARED_PREDICATES)).select(F.col("subject_ref").alias("ref")).distinct(), "declared-refs")
    refs = F.broadcast(refs) if refs.count() <= M.FEW else refs
    uses = rows.where(F.col("predicate").isin([p for p in V.CURRENCY_PREDICATES if p != "selected"]))
    about = lambda rows, side: rows.join(refs.withColumnRenamed("ref", side), side, "left_semi").select(*uses.columns)
    # one about both comes twice, which its first sighting does not depend on
    return about(uses, "subject_ref").unionByName(about(uses, "object_ref"))


def sighted(rows: DataFrame, fact: list[str], memory: Memory | None) -> DataFrame:
    seen = rows.groupBy(*fact, "recorded_at").agg(F.min(F.struct("ingest_seq", "artifact_id")).alias("place"))
    seen = seen.withColumn("new", F.col("place") == F.min("place").over(W.partitionBy("fact_id")))
    if memory is None:
        return seen
    known = memory.facts.join(seen.select("fact_id"), "fact_id", "left_semi").select("fact_id", F.lit(True).alias("known"))
    return seen.join(known, "fact_id", "left").withColumn("new", F.col("new") & F.col("known").isNull()).drop("known")


def standing(memory: Memory, seen: DataFrame, declared: DataFrame, scratch: Scratch) -> DataFrame:
    """Active stored facts that the batch may meet: fact_id, refs, predicate, at (the last date, '' if none).

    Stored tables are only scanned, for the refs and then for the facts of the batch: both are small, so
    joins broadcast them.
    """
    facts = memory.facts
    refs = scratch.table(seen.select(F.col("subject_ref").alias("ref")).unionByName(declared.select("ref")).distinct(), "refs")
    meeting = [*V.CURRENCY_PREDICATES, "prohibits", "allows"]
    near = facts.where(F.col("predicate").isin(meeting)).join(refs.withColumnRenamed("ref", "subject_ref"), "subject_ref", "left_semi")
    if not declared.isEmpty():
        named = declared.select(F.col("ref").alias("object_ref")).distinct()
        near = near.unionByName(facts.where(F.col("predicate").isin(V.CURRENCY_PREDICATES)).join(named, "object_ref", "left_semi").select(*near.columns))
        near = scratch.table(near, "near")
        subjects = near.where("predicate = 'selected'").select("subject_ref").distinct()
        near = near.unionByName(facts.where("predicate = 'selected'").join(subjects, "subject_ref", "left_semi").select(*near.columns))
    near = scratch.table(near.select("fact_id", "subject_ref", "predicate", "object_ref").distinct(), "near")
    gone = memory.supersessions.select(F.col("superseded").alias("fact_id")).join(near.select("fact_id"), "fact_id", "left_semi")
    live = scratch.table(near.join(gone, "fact_id", "left_anti"), "live")
    at = memory.evidence.join(live.select("fact_id"), "fact_id", "left_semi").groupBy("fact_id").agg(F.max("recorded_at").alias("at"))
    return scratch.table(live.join(at, "fact_id", "left").withColumn("at", F.coalesce("at", F.lit(""))), "standing")


def verdict_columns(found: DataFrame) -> DataFrame:
    """Edges and conflicts of meetings: incoming, at, stored, stored_at, reason, artifact_id -> kind and an edge's columns."""
    order = time_order(F.col("at"), F.col("stored_at"))
    loses = order == "earlier"
    return found.select(
        F.when(order == "simultaneous", "conflict").otherwise("edge").alias("kind"),
        F.when(loses, F.col("stored")).otherwise(F.col("incoming")).alias("a"),
        F.when(loses, F.col("incoming")).otherwise(F.col("stored")).alias("b"),
        F.when(order == "simultaneous", V.SIMULTANEOUS).when(loses, F.concat("reason", F.lit(V.PREDATES))).otherwise(F.col("reason")).alias("reason"),
        "artifact_id",
        F.col("at").alias("recorded_at"),
        F.when(order == "unknown", V.BY_INGESTION).otherwise(V.BY_TIME).alias("basis"),
    )


FOUND = "kind string, a string, b string, reason string, artifact_id string, recorded_at string, basis string"


def usage_meetings(seen: DataFrame, declared: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Declarations against facts of use: each such fact is on its own, so this is joins and one window a fact.

    A fact meets the declarations about its subject or its object after its first assertion, up to the first
    artifact that retires it.
    """
    uses = F.col("predicate").isin([p for p in V.CURRENCY_PREDICATES if p != "selected"])
    held = seen.where(F.col("new") & uses).select("fact_id", "subject_ref", "object_ref")
    dates = seen.where(uses).select("fact_id", "place", "recorded_at")
    if stored is not None:
        held = held.unionByName(stored.where(uses).select("fact_id", "subject_ref", "object_ref"))
        dates = dates.unionByName(stored.where(uses).select("fact_id", F.lit(None).cast(seen.schema["place"].dataType).alias("place"), F.col("at").alias("recorded_at")))
    on = lambda side: declared.join(held.select("fact_id", F.col(side).alias("ref")), "ref")
    pairs = on("subject_ref").unionByName(on("object_ref")).dropDuplicates(["r", "fact_id"])
    met = pairs.join(dates.withColumnRenamed("place", "then").withColumnRenamed("recorded_at", "date"), "fact_id").where(F.col("then").isNull() | (F.col("then") < F.col("place")))
    met = met.groupBy("r", "said", "place", "at", "fact_id").agg(F.max("date").alias("stored_at"))
    retires = time_order(F.col("at"), F.col("stored_at")).isin("later", "unknown")
    end = F.min(F.when(retires, F.col("place"))).over(W.partitionBy("fact_id"))
    met = met.withColumn("end", end).where(F.col("end").isNull() | (F.col("place") <= F.col("end")))
    return met.select(F.col("r").alias("incoming"), "at", F.col("fact_id").alias("stored"), "stored_at", declaration(F.col("said")).alias("reason"), F.col("place.artifact_id").alias("artifact_id"))


def declaration(predicate: Column) -> Column:
    before, _, after = V.DECLARATION.partition("{predicate}")
    return F.concat(F.lit(before), predicate, F.lit(after))


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """Selections of subjects against each other and against declarations, in order; meetings as they come.

    Events (subject, artifact_id, declared, fact, ref, at, new, said) are sorted by subject and place, what
    memory holds first (artifact_id null).  Kept is what stands on one subject, however long its history.
    """
    for subject, of_subject in groupby(events, key=lambda e: e[0]):
        at: dict[str, str] = {}  # the last date of each standing selection
        chosen: dict[str, str] = {}  # object -> the standing selection of it; there is one
        objects: dict[str, str] = {}
        for artifact, batch in groupby(of_subject, key=lambda e: e[1]):
            if artifact is None:
                for _, _, _, fact, ref, date, _, _ in batch:
                    at[fact], chosen[ref], objects[fact] = date, fact, ref
                continue
            batch = list(batch)
            gone = set()
            for _, _, declared, fact, ref, date, new, said in sorted(batch, key=lambda e: not e[2]):
                if not new:
                    continue
                reason = V.DECLARATION.format(predicate=said) if declared else V.OCCUPANCY
                against = list(at) if not declared or ref == subject else [chosen[ref]] if ref in chosen else []
                for stored in against:
                    then = at[stored]
                    if date and then and date < then:
                        gone.add(fact)
                    elif not (date and date == then):
                        gone.add(stored)
                    yield fact, date, stored, then, reason, artifact
            for _, _, declared, fact, ref, date, new, _ in batch:
                if not declared and (new or fact in at):
                    at[fact] = max(at.get(fact, ""), date)
                    chosen[ref], objects[fact] = fact, ref
            for fact in gone:
                if at.pop(fact, None) is not None:
                    del chosen[objects.pop(fact)]


MEETING = "incoming string, at string, stored string, stored_at string, reason string, artifact_id string"


def fold_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = MEETING.replace(" string", "").split(", ")
    found = fold(chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches))
    while True:
        rows = list(islice(found, 8192))
        if not rows:
            return
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)


def fold_retired(events: Iterable[tuple]) -> Iterator[str]:
    """The facts that the meetings of ``fold`` over the same events retire, without the meetings.

    Selections of equal dates stand beside each other and each further one meets them all, so meetings may grow with
    the square of a subject's history.  Standing selections are held by date here: what an event retires is whole dates.
    """
    for subject, of_subject in groupby(events, key=lambda e: e[0]):
        at: dict[str, str] = {}
        chosen: dict[str, str] = {}
        objects: dict[str, str] = {}
        dated: dict[str, set[str]] = {}  # date -> the standing selections whose last date it is

        def put(fact: str, date: str) -> None:
            at[fact] = date
            dated.setdefault(date, set()).add(fact)

        def take(fact: str) -> str | None:
            date = at.pop(fact, None)
            if date is not None:
                dated[date].discard(fact)
                if not dated[date]:
                    del dated[date]
            return date

        for artifact, batch in groupby(of_subject, key=lambda e: e[1]):
            if artifact is None:
                for _, _, _, fact, ref, date, _, _ in batch:
                    put(fact, date)
                    chosen[ref], objects[fact] = fact, ref
                continue
            batch = list(batch)
            gone, swept = set(), set()
            for _, _, declared, fact, ref, date, new, _ in batch:
                if not new:
                    continue
                if declared and ref != subject:
                    met = {at[chosen[ref]]} if ref in chosen else ()
                else:
                    met = dated
                if any(date and then and date < then for then in met):
                    gone.add(fact)
                if declared and ref != subject:
                    gone.update(chosen[ref] for then in met if not (date and then and date <= then))
                else:
                    swept.update(then for then in met if not (date and then and date <= then))
            gone.update(*(dated[then] for then in swept))
            for _, _, declared, fact, ref, date, new, _ in batch:
                if not declared and (new or fact in at):
                    put(fact, max(take(fact) or "", date))
                    chosen[ref], objects[fact] = fact, ref
            for fact in gone:
                if take(fact) is not None:
                    del chosen[objects.pop(fact)]
            yield from gone


def retired_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = fold_retired(chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches))
    while rows := list(islice(found, 8192)):
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["fact_id"])


def selection_meetings(seen: DataFrame, declared: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Selections of one subject depend on each other's fate, so each subject's history streams through ``fold``.

    A subject is one task's stream, which holds no more than the standing selections of it.
    """
    return selection_events(seen, declared, stored).mapInArrow(fold_stream, MEETING)


def selection_events(seen: DataFrame, declared: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The events of ``fold``, a subject's in one partition and in order."""
    chosen = seen.where("predicate = 'selected'")
    facts = chosen.select("subject_ref", "place", F.lit(False).alias("declared"), F.col("fact_id").alias("fact"), F.col("object_ref").alias("ref"), F.col("recorded_at").alias("at"), "new", F.lit("").alias("said"))
    pairs = chosen.select("subject_ref", "object_ref")
    if stored is not None:
        held = stored.where("predicate = 'selected'")
        pairs = pairs.unionByName(held.select("subject_ref", "object_ref"))
        none = F.lit(None).cast(seen.schema["place"].dataType)
        facts = facts.unionByName(held.select("subject_ref", none.alias("place"), F.lit(False).alias("declared"), F.col("fact_id").alias("fact"), F.col("object_ref").alias("ref"), "at", F.lit(False).alias("new"), F.lit("").alias("said")))
    about = pairs.select("subject_ref", F.explode(F.array("subject_ref", "object_ref")).alias("ref")).distinct()
    said = about.join(declared, "ref").dropDuplicates(["subject_ref", "r"])
    events = facts.unionByName(said.select("subject_ref", "place", F.lit(True).alias("declared"), F.col("r").alias("fact"), "ref", "at", F.lit(True).alias("new"), "said"))
    ordered = events.repartition("subject_ref").sortWithinPartitions("subject_ref", F.col("place").asc_nulls_first(), "declared", "fact")
    return ordered.select("subject_ref", F.col("place.artifact_id").alias("artifact_id"), "declared", "fact", "ref", "at", "new", "said")


def negations(seen: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``prohibits`` against ``allows`` of the same subject and object, of different artifacts, in either order: kind and columns as of edges."""
    both = F.col("predicate").isin("prohibits", "allows")
    columns = ["subject_ref", "object_ref", "predicate", "fact_id", "place"]
    rows = seen.where(F.col("new") & both).select(*columns)
    if stored is not None:
        rows = rows.unionByName(stored.where(both).withColumn("place", F.lit(None).cast(seen.schema["place"].dataType)).select(*columns))
    side = lambda p, c: rows.where(F.col("predicate") == p).select("subject_ref", "object_ref", F.col("fact_id").alias(c), F.col("place").alias(f"{c}_place"))
    met = side("prohibits", "a").join(side("allows", "b"), ["subject_ref", "object_ref"])
    met = met.where(~F.col("a_place").eqNullSafe(F.col("b_place")))
    later = F.greatest("a_place", "b_place")  # of two, one of which may be null
    empty = F.lit("")
    return met.select(F.lit("conflict").alias("kind"), "a", "b", F.lit(V.NEGATION_CONFLICT).alias("reason"), later["artifact_id"].alias("artifact_id"), empty.alias("recorded_at"), empty.alias("basis"))


def told(rows: DataFrame, memory: Memory | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What the rules see: sightings, declarations among them, and what stands in memory."""
    seen = sightings(rows, memory, scratch)
    declared = seen.where(F.col("new") & F.col("predicate").isin(V.DECLARED_PREDICATES))
    declared = scratch.table(declared.select(F.col("fact_id").alias("r"), F.col("subject_ref").alias("ref"), F.col("predicate").alias("said"), "place", F.col("recorded_at").alias("at")), "declared")
    return seen, declared, None if memory is None else standing(memory, seen, declared, scratch)


def retired(spark: SparkSession, rows: DataFrame, memory: Memory | None = None) -> DataFrame:
    """fact_id, each once: the facts that the edges of ``replay`` retire.

    For who asks whether a fact stands: edges may be many more than facts, and are not made here.
    """
    scratch = Scratch(spark, "retired", lean=True)
    seen, declared, stored = told(rows, memory, scratch)
    gone = selection_events(seen, declared, stored).mapInArrow(retired_stream, "fact_id string")
    if not declared.isEmpty():
        gone = gone.unionByName(verdict_columns(usage_meetings(seen, declared, stored)).where("kind = 'edge'").select(F.col("b").alias("fact_id")))
    found = scratch.table(gone.distinct(), "retired")
    scratch.drop(seen, declared)
    return found


def replay(spark: SparkSession, rows: DataFrame, memory: Memory | None = None) -> tuple[DataFrame, DataFrame]:
    """(supersessions, conflicts) of ``assertions`` folded in order of (ingest_seq, artifact_id) onto ``memory``.

    Two artifacts that come in one batch or in two, in the same order, give the same edges.  Every edge
    carries the artifact that caused it.
    """
    scratch = Scratch(spark, "replay", lean=True)
    seen, declared, stored = told(rows, memory, scratch)
    met = selection_meetings(seen, declared, stored)
    if not declared.isEmpty():
        met = met.unionByName(usage_meetings(seen, declared, stored))
    found = scratch.table(verdict_columns(met).unionByName(negations(seen, stored)), "edges")
    scratch.drop(seen, declared)
    edges = found.where("kind = 'edge'").select(F.col("a").alias("superseding"), F.col("b").alias("superseded"), "reason", "artifact_id", "recorded_at", "basis")
    conflicts = found.where("kind = 'conflict'").select(F.least("a", "b").alias("fact_a"), F.greatest("a", "b").alias("fact_b"), F.col("reason").alias("conflict_type"), "artifact_id")
    return edges, conflicts


#: The rules of a linker; further ones see the same assertions and the same memory.
DEFAULT_RULES: tuple[Rule, ...] = (replay,)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The edge of the first rule (``rule``) that found each pair."""
    first = edges.groupBy("superseding", "superseded").agg(F.min(F.struct("rule", "reason", "artifact_id", "recorded_at", "basis")).alias("e"))
    return first.select("superseding", "superseded", "e.reason", "e.artifact_id", "e.recorded_at", "e.basis")


def distinct_conflicts(conflicts: DataFrame) -> DataFrame:
    """A conflict is between two facts, in no direction."""
    pair = [F.least("fact_a", "fact_b").alias("fact_a"), F.greatest("fact_a", "fact_b").alias("fact_b"), "conflict_type"]
    return conflicts.groupBy(*pair).agg(F.min(F.struct("rule", "artifact_id")).alias("e")).select("fact_a", "fact_b", "conflict_type", "e.artifact_id")


def apply_rules(spark: SparkSession, rows: DataFrame, memory: Memory | None = None, rules: Sequence[Rule] = DEFAULT_RULES) -> tuple[DataFrame, DataFrame]:
    """(supersessions, conflicts) of all rules, each pair once."""
    edges, conflicts = spark.createDataFrame([], f"{EDGE}, rule int"), spark.createDataFrame([], f"{CONFLICT}, rule int")
    for k, rule in enumerate(rules):
        e, c = rule(spark, rows, memory)
        edges, conflicts = edges.unionByName(e.withColumn("rule", F.lit(k))), conflicts.unionByName(c.withColumn("rule", F.lit(k)))
    return distinct_edges(edges), distinct_conflicts(conflicts)


def stored_assertions(spark: SparkSession, artifacts: DataFrame, compiled: Compiled, memory: Memory | None = None) -> DataFrame:
    """``assertions``, stored once, since every table of memory is made of them."""
    return Scratch(spark, "asserted", lean=True).table(assertions(artifacts, compiled, None if memory is None else M.aliases(memory.entities)), "assertions")


def link(spark: SparkSession, artifacts: DataFrame, compiled: Compiled, *, memory: Memory | None = None, rules: Sequence[Rule] = DEFAULT_RULES) -> Memory:
    """What compiled artifacts (artifact_id, type, recorded_at, ingest_seq) add to ``memory``, or a memory of them alone.

    ``ingest_seq`` orders the artifacts and may be of any type that has an order; equals go by artifact_id.
    """
    keep = Scratch(spark, "linked").table
    rows = stored_assertions(spark, artifacts, compiled, memory)
    edges, conflicts = apply_rules(spark, rows, memory, rules)
    return Memory(entity_table(artifacts, compiled.entities), promote(rows, None if memory is None else memory.facts), evidence(rows), keep(edges, "edges"), keep(conflicts, "conflicts"))


def retract(memory: Memory, fact_id: str, reason: str, author: str, on: str) -> tuple[Memory, str]:
    """A person's correction: retires an active fact, with evidence of weight 1.2 and its own basis.

    Raises KeyError for a fact that memory does not hold and ValueError for one that is retired already.
    Returns the memory with the correction, and the correction's artifact id.
    """
    spark = memory.facts.sparkSession
    if memory.facts.where(F.col("fact_id") == fact_id).isEmpty():
        raise KeyError(fact_id)
    if not memory.supersessions.where(F.col("superseded") == fact_id).isEmpty():
        raise ValueError(f"{fact_id} is retired already")
    one = spark.range(1).select(F.lit(f"Correction by {author} on {on}: {reason} [{fact_id}]").alias("content"))
    artifact = content_id("artifact", F.lit("correction"), F.col("content"))
    marker = one.select(artifact.alias("artifact_id")).withColumn("subject_ref", artifact_ref(F.col("artifact_id"))).withColumn("object_ref", F.lit(fact_id)).withColumn("predicate", F.lit("describes"))
    marker = marker.withColumn("fact_id", content_id("fact", "subject_ref", "predicate", "object_ref"))
    fact = marker.select("fact_id", "subject_ref", "predicate", "object_ref", F.lit("observation").alias("fact_type"))
    proof = marker.select(
        content_id("evidence", F.col("artifact_id"), F.lit("fact:0")).alias("evidence_id"), "fact_id", "artifact_id", F.lit("correction").alias("artifact_type"), F.lit(on).alias("recorded_at"),
        F.lit(1.0).alias("confidence"), F.lit(V.AUTHORITY["correction"]).alias("authority"), F.array(F.lit(reason)).alias("supporting"),
    )
    edge = marker.select(F.col("fact_id").alias("superseding"), F.lit(fact_id).alias("superseded"), F.lit(reason).alias("reason"), "artifact_id", F.lit(on).alias("recorded_at"), F.lit(V.BY_PERSON).alias("basis"))
    after = Memory(memory.entities, memory.facts.unionByName(fact), memory.evidence.unionByName(proof), memory.supersessions.unionByName(edge), memory.conflicts)
    return after, marker.first()["artifact_id"]


__all__ = ["DEFAULT_RULES", "apply_rules", "assertions", "authority", "bind", "link", "literal_map", "replay", "retract", "time_order", "weight"]
