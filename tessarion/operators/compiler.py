"""Compiler: artifacts to observations, segments, statements, entities, claims, facts and relations.

Everything is a native expression.  Text stays on its own row up to the clauses; one shuffle by artifact
serves the ordinals, the removal of repeats and the entities.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import markdown
from ..functions import vocabulary as V
from ..functions.ids import content_id
from ..functions.phrases import ANY, clauses, confidence, dialect, each, has_any, has_determiner, is_concept, is_negated, is_usable, normalize_phrase, sentences, strip
from ..functions.scratch import Scratch

COMPILER_VERSION = "0.1.0"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


#: One of these a clause must hold, in any letter case, for a pattern to match: looked for first, since it is cheap.
NEEDED = {
    "replace_with": ["replac"], "use_for": ["use", "using"], "adopt_for": ["adopt"], "migrate_to": ["migrat"], "move_into": ["mov"], "remove_from": ["remov"],
    "depends_on": ["depend"], "requires": ["require"], "uses": ["use", "using"], "deprecates": ["deprecat"], "imports": ["import"], "implements": ["implement"],
    "extends": ["extends"], "calls": ["call"], "contains": ["contains"], "exposes": ["exposes"], "built_on": ["built", "sits", "runs", "backed"], "replaces": ["replaces"],
    "port_to": ["port", "switch", "move"], "aka": ["aka", "a.ka", "ak.a", "a.k.a", "also"], "also_known_as": ["known", "called", "referred"], "same_thing_as": ["same"], "prefer_over": ["over"],
}
#: The same for the patterns of known names.
NEEDED_NAMES = (
    ["api gateway"], ["jwt validation"], ["authentication"], ["postgres", "redis", "mongodb", "mysql", "sqlite", "dynamodb", "elasticsearch"],
    ["kubernetes", "k8s", "docker", "terraform", "helm", "ansible"], ["react", "vue", "angular", "next.js", "node.js", "django", "fastapi", "flask", "spring boot"],
    ["kafka", "rabbitmq", "nats", "pulsar", "aws sqs"], ["oauth", "jwt", "grpc", "graphql", "rest", "saml"],
)


def with_artifact_ids(artifacts: DataFrame) -> DataFrame:
    """Adds artifact_id, the hash of type and content, to (type, content, …)."""
    return artifacts.withColumn("artifact_id", content_id("artifact", "type", "content"))


def by_artifact(rows: DataFrame) -> DataFrame:
    """Dealt out by artifact: whatever is grouped by it, or by it and more, needs no further shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "artifact_id")


def observe(artifacts: DataFrame) -> DataFrame:
    """artifact_id, obs_ord, type, text, header of (artifact_id, content).

    Artifacts are dealt out first: the files that they come from may be few and small, and the work is not.
    """
    return each(by_artifact(artifacts.select("artifact_id", "content")), ["artifact_id"], markdown.observations(F.col("content")), "obs_ord", "o").select("artifact_id", "obs_ord", "o.*")


def with_sections(observations: DataFrame) -> DataFrame:
    """Adds section_header: the last heading so far, its own included."""
    so_far = W.partitionBy("artifact_id").orderBy("obs_ord").rowsBetween(W.unboundedPreceding, 0)
    return observations.withColumn("section_header", F.coalesce(F.last("header", ignorenulls=True).over(so_far), F.lit("")))


def segment(observations: DataFrame) -> DataFrame:
    """artifact_id, seg_ord, kind, text; headings without a body are left out."""
    text = strip(F.col("text"))
    reason, tradeoff = F.startswith(text, F.lit("Reason:")), F.startswith(text, F.lit("Trade-off:"))
    kind = F.when(reason, "reason").when(tradeoff, "tradeoff").otherwise(F.coalesce(F.element_at(literal_map(V.SEGMENT_KINDS), F.col("type")), F.lit("description")))
    body = F.when(reason, strip(F.substr(text, F.lit(8)))).when(tradeoff, strip(F.substr(text, F.lit(11)))).otherwise(text)
    return observations.where("type <> 'header'").select("artifact_id", F.col("obs_ord").alias("seg_ord"), kind.alias("kind"), body.alias("text"))


def own_statements(segments: DataFrame) -> DataFrame:
    """What the artifact says of itself: one statement a segment."""
    predicate = F.coalesce(F.element_at(literal_map(V.SEGMENT_PREDICATES), F.lower("kind")), F.lit("unknown"))
    return segments.select("artifact_id", "seg_ord", F.lit(0).alias("stmt_pos"), F.lit(V.SELF_SUBJECT).alias("subject"), predicate.alias("predicate"), F.col("text").alias("target"))


def clause_rows(segments: DataFrame) -> DataFrame:
    """artifact_id, seg_ord, sent, negated, cl, clause."""
    rows = each(segments, ["artifact_id", "seg_ord"], sentences(F.col("text")), "sent", "sentence")
    return each(rows, ["artifact_id", "seg_ord", "sent", is_negated(F.col("sentence")).alias("negated")], clauses(F.col("sentence")), "cl", "clause")


MATCHES = "array<struct<pat:int,nth:int,pattern:string,predicate:string,raw_subject:string,raw_object:string>>"


def raw_matches(rows: DataFrame) -> DataFrame:
    """All pattern matches: adds pat, nth, pattern, predicate, raw_subject and raw_object to clause rows."""

    def matches(k: int, name: str, rx: str, predicate: str, subject: int, obj: int) -> Column:
        pick = lambda g: F.regexp_extract_all("clause", dialect(F.col("clause"), ANY + rx), F.lit(g))
        pairs = F.transform(
            F.arrays_zip(pick(subject).alias("s"), pick(obj).alias("o")),
            lambda z, i: F.struct(F.lit(k).alias("pat"), i.alias("nth"), F.lit(name).alias("pattern"), F.lit(predicate).alias("predicate"), z["s"].alias("raw_subject"), z["o"].alias("raw_object")),
        )
        between = rx.split(V.OPERAND)[1]  # a pattern whose words between the operands are missing would be tried from every place
        may = has_any(F.col("clause"), NEEDED.get(name, [""])) & F.rlike(F.col("clause"), dialect(F.col("clause"), ANY + between))
        return F.when(may, pairs).otherwise(F.array().cast(MATCHES))

    found = F.concat(*[matches(k, *p) for k, p in enumerate(V.RELATIONAL_PATTERNS)])
    return each(rows, ["*"], found, "at", "m").select("*", "m.*").drop("at", "m", "clause")


def judged_matches(raw: DataFrame) -> DataFrame:
    """Matches whose operands are concepts, with negation applied; the first of equals within a segment."""
    # of an array of one, since a filter on columns that are only computed works them out for each mention
    operands = F.struct(normalize_phrase(F.col("raw_subject")).alias("subject"), normalize_phrase(F.col("raw_object")).alias("object"))
    named = each(raw, ["*"], F.array(operands), "at", "operands").select("*", "operands.*").drop("at", "operands")
    good = named.where(
        is_usable(F.col("subject"))
        & is_usable(F.col("object"))
        & is_concept(F.col("subject"), has_determiner(F.col("raw_subject")))
        & is_concept(F.col("object"), has_determiner(F.col("raw_object")))
        & (F.lower("subject") != F.lower("object"))
        & (~F.col("negated") | F.col("predicate").isin(V.NEGATABLE))
    ).withColumn("predicate", F.when(F.col("negated"), "prohibits").otherwise(F.col("predicate")))
    place = ("sent", "cl", "pat", "nth")
    first = good.groupBy("artifact_id", "seg_ord", F.lower("subject").alias("s"), "predicate", F.lower("object").alias("o")).agg(F.min(F.struct(*place, "subject", "object", "pattern")).alias("f"))
    return first.select("artifact_id", "seg_ord", "predicate", "f.*")


def relational_matches(segments: DataFrame) -> DataFrame:
    return judged_matches(raw_matches(clause_rows(segments)))


def statements(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """artifact_id, seg_ord, stmt_pos, subject, predicate, target: own statement first, then matches in order."""
    in_segment = W.partitionBy("artifact_id", "seg_ord").orderBy("sent", "cl", "pat", "nth")
    related = matches.select("artifact_id", "seg_ord", F.row_number().over(in_segment).alias("stmt_pos"), "subject", "predicate", F.col("object").alias("target"))
    return own_statements(segments).unionByName(related)


def claims(stmts: DataFrame) -> DataFrame:
    return stmts.withColumn("confidence", confidence(F.col("target")))


def fact_type(predicate: Column) -> Column:
    out = F.lit("observation")
    for kind, members in V.FACT_TYPES.items():
        out = F.when(predicate.isin(members), kind).otherwise(out)
    return out


def normalized_predicate(predicate: Column, extra: dict[str, str] | None = None) -> Column:
    return F.coalesce(F.element_at(literal_map(V.PROMOTED | {k.lower(): v for k, v in (extra or {}).items()}), F.lower(predicate)), F.lit("unknown"))


def facts(scored: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """artifact_id, fact_ord, subject, predicate, object, fact_type, confidence, supporting: promoted claims.

    ``fact_ord`` counts promoted claims only; ``extra`` maps further free predicates.
    """
    stmt_ord = F.row_number().over(W.partitionBy("artifact_id").orderBy("seg_ord", "stmt_pos")) - 1
    named = scored.withColumn("stmt_ord", stmt_ord).withColumn("predicate", normalized_predicate(F.col("predicate"), extra))
    kept = named.where((F.col("confidence") >= V.CONFIDENCE_FLOOR) & (F.col("predicate") != "unknown"))
    fact_ord = F.row_number().over(W.partitionBy("artifact_id").orderBy("stmt_ord")) - 1
    return kept.select(
        "artifact_id",
        fact_ord.alias("fact_ord"),
        "subject",
        "predicate",
        F.col("target").alias("object"),
        fact_type(F.col("predicate")).alias("fact_type"),
        "confidence",
        F.array(F.concat(F.lit("statement:"), F.col("stmt_ord").cast("string"))).alias("supporting"),
    )


def vocabulary_entities(segments: DataFrame) -> DataFrame:
    """Known names and identifiers: artifact_id, seg_ord, ord, key, name, type; the first of equals in a segment."""

    def found(k: int, rx: str, kind: str, may: Column) -> Column:
        names = F.regexp_extract_all("text", dialect(F.col("text"), rx), F.lit(0))
        rows = F.transform(names, lambda n, i: F.struct(F.lit(k).alias("pat"), i.alias("nth"), n.alias("name"), F.lit(kind).alias("type")))
        return F.when(may, rows).otherwise(F.array().cast("array<struct<pat:int,nth:int,name:string,type:string>>"))

    every = [found(k, ANY + rx, kind, has_any(F.col("text"), NEEDED_NAMES[k])) for k, (rx, kind) in enumerate(V.ENTITY_PATTERNS)]
    every.append(found(len(V.ENTITY_PATTERNS), "(?U)" + V.CAMEL_CASE, "unknown", F.rlike(F.col("text"), F.lit("[A-Z][a-z0-9]+[A-Z]"))))
    rows = each(segments, ["artifact_id", "seg_ord"], F.concat(*every), "ord", "e")
    first = rows.groupBy("artifact_id", "seg_ord", F.lower("e.name").alias("key")).agg(F.min(F.struct("ord", "e.name", "e.type")).alias("f"))
    return first.select("artifact_id", "seg_ord", "key", "f.*")


def hinted_type(name: Column) -> Column:
    out = F.lit("unknown")
    for hint, kind in reversed(V.ENTITY_HINTS):
        out = F.when(F.contains(F.lower(name), F.lit(hint)), kind).otherwise(out)
    return out


def phrase_entities(matches: DataFrame) -> DataFrame:
    """Operands of matches as entities, shaped as ``vocabulary_entities``."""
    both = F.posexplode(F.array("subject", "object")).alias("side", "name")
    rows = matches.select("artifact_id", "seg_ord", "sent", "cl", "pat", "nth", both)
    first = rows.groupBy("artifact_id", "seg_ord", F.lower("name").alias("key")).agg(F.min(F.struct("sent", "cl", "pat", "nth", "side", "name")).alias("f"))
    in_segment = W.partitionBy("artifact_id", "seg_ord").orderBy("f")
    return first.select("artifact_id", "seg_ord", "key", (F.row_number().over(in_segment) - 1).alias("ord"), F.col("f.name").alias("name"), hinted_type(F.col("f.name")).alias("type"))


def entities(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """artifact_id, key, name, type, entity_ord: the artifact's entities.

    A known name keeps its place and gives way to a phrase of equal key only if its type is unknown; a
    name that is a whole word of another name of its segment is left out there; the first segment decides.
    """
    a = vocabulary_entities(segments).withColumn("kind", F.lit(0))
    b = phrase_entities(matches).withColumn("kind", F.lit(1))
    per_key = a.unionByName(b).groupBy("artifact_id", "seg_ord", "key").agg(F.min(F.struct("kind", "ord", "name", "type")).alias("v"), F.max(F.struct("kind", "ord", "name", "type")).alias("p"))
    takes = (F.col("v.type") == "unknown") & (F.col("p.kind") == 1)
    chosen = F.when(takes, F.col("p")).otherwise(F.col("v"))
    merged = per_key.select("artifact_id", "seg_ord", "key", F.col("v.kind").alias("kind"), F.col("v.ord").alias("ord"), chosen["name"].alias("name"), chosen["type"].alias("type"))
    # one list a segment; a name is looked for in the longer ones only
    whole = merged.groupBy("artifact_id", "seg_ord").agg(F.collect_list(F.struct("key", "kind", "ord", "name", "type")).alias("all"))
    word = lambda key: F.concat(F.lit(r"(?U)\b\Q"), key, F.lit(r"\E\b"))
    alone = lambda e: ~F.exists("all", lambda o: (F.length(o["key"]) > F.length(e["key"])) & F.contains(o["key"], e["key"]) & F.rlike(o["key"], word(e["key"])))
    kept = each(whole, ["artifact_id", "seg_ord"], F.filter("all", alone), "at", "e").select("artifact_id", "seg_ord", "e.*")
    first = kept.groupBy("artifact_id", "key").agg(F.min(F.struct("seg_ord", "kind", "ord", "name", "type")).alias("f"))
    entity_ord = F.row_number().over(W.partitionBy("artifact_id").orderBy("f.seg_ord", "f.kind", "f.ord")) - 1
    return first.select("artifact_id", "key", "f.name", "f.type", entity_ord.alias("entity_ord"))


def relations(fact_rows: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """artifact_id, fact_ord, subject_key, predicate, object_key, confidence: facts with both operands known.

    A name that stands for more than one entity stands for none; keys are unique in an artifact here.
    """
    side = lambda c: entity_rows.select("artifact_id", F.col("key").alias(c))
    keyed = fact_rows.withColumn("subject_key", F.lower("subject")).withColumn("object_key", F.lower("object"))
    both = keyed.join(side("subject_key"), ["artifact_id", "subject_key"]).join(side("object_key"), ["artifact_id", "object_key"])
    return both.select("artifact_id", "fact_ord", "subject_key", "predicate", "object_key", "confidence")


@dataclass
class Compiled:
    """The tables of a compilation, all keyed by artifact_id."""

    observations: DataFrame
    segments: DataFrame
    statements: DataFrame
    entities: DataFrame
    claims: DataFrame
    facts: DataFrame
    relations: DataFrame

    def by_id(self, table: str, artifact_id: str, ordinal: int) -> DataFrame:
        """One record of one artifact; an unknown table is a KeyError, an unknown record an empty result."""
        keys = {"observations": "obs_ord", "segments": "seg_ord", "claims": "stmt_ord", "entities": "entity_ord", "facts": "fact_ord", "relations": "fact_ord"}
        rows = getattr(self, table) if table in keys else None
        if rows is None:
            raise KeyError(table)
        rows = rows.where(F.col("artifact_id") == artifact_id)
        if table == "claims":
            rows = rows.withColumn("stmt_ord", F.row_number().over(W.partitionBy("artifact_id").orderBy("seg_ord", "stmt_pos")) - 1)
        return rows.where(F.col(keys[table]) == ordinal)

    def to_json(self) -> DataFrame:
        """artifact_id, ir: one JSON text an artifact, lists in order."""
        out = self.segments.select("artifact_id").distinct()
        for name, order in (("segments", ["seg_ord"]), ("statements", ["seg_ord", "stmt_pos"]), ("entities", ["entity_ord"]), ("facts", ["fact_ord"])):
            t: DataFrame = getattr(self, name)
            rest = [c for c in t.columns if c not in ("artifact_id", *order)]
            out = out.join(t.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name)), "artifact_id", "left")
        body = F.struct(*[F.coalesce(c, F.expr(f"cast(array() as {dict(out.dtypes)[c]})")).alias(c) for c in out.columns if c != "artifact_id"], F.lit(COMPILER_VERSION).alias("compiler_version"), F.lit("1.0").alias("ontology_version"))
        return out.select("artifact_id", F.to_json(body).alias("ir"))


def compile_artifacts(
    artifacts: DataFrame,
    *,
    match: Callable[[DataFrame], DataFrame] = relational_matches,
    state: Callable[[DataFrame, DataFrame], DataFrame] = statements,
    recognize: Callable[[DataFrame, DataFrame], DataFrame] = entities,
    promote: Callable[[DataFrame, dict[str, str] | None], DataFrame] = facts,
    relate: Callable[[DataFrame, DataFrame], DataFrame] = relations,
    extra_predicates: dict[str, str] | None = None,
) -> Compiled:
    """Compile (artifact_id, content).

    Every stage may be replaced by a function of the same frames: ``match`` (segments to relational matches),
    ``state`` (segments, matches to statements), ``recognize`` (segments, matches to entities), ``promote``
    (claims, further predicates to facts) and ``relate`` (facts, entities to relations).

    Observations, matches, facts and entities are written once to the shared folder, since every later
    table reads them several times.
    """
    keep = Scratch(artifacts.sparkSession, "compiled").table
    obs = keep(observe(artifacts), "observations")
    segs = by_artifact(segment(obs))
    found = by_artifact(keep(match(segs), "matches"))
    stmts = state(segs, found)
    scored = claims(stmts)
    fact_rows = keep(promote(scored, extra_predicates), "facts")
    entity_rows = keep(recognize(segs, found), "entities")
    return Compiled(obs, segs, stmts, entity_rows, scored, fact_rows, relate(fact_rows, entity_rows))
