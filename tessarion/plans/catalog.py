"""The library's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V
from ..functions.ids import entity_id, ref_kind
from ..functions.markdown import strip_noise
from ..functions.phrases import confidence, is_concept, is_negated, is_usable, normalize_phrase
from ..operators import apps, compiler, linker
from ..operators import belief as B
from ..operators import memory as M
from . import projections as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a function under its name; ``sql`` continues the CTEs of the projections unless base is off."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {P.SQL_BASE}{sql}" if base else sql
        return f

    return add


def text_of(column: str) -> F.Column:
    return F.array_join(F.array_sort(column), ", ")


# -- aggregates and lookups --------------------------------------------------------


@query("SELECT fact_id, support, CAST(evidence_count AS BIGINT) AS evidence_count, last_asserted FROM sup")
def a02_support(spark, sf):
    return M.support(P.evidence_of(P.asserted(spark, sf)))


@query("SELECT artifact_type, CAST(count(*) AS BIGINT) AS n, coalesce(max(nullif(recorded_at, '')), '') AS last FROM ev GROUP BY artifact_type")
def a01_latest_by_type(spark, sf):
    proof = P.evidence_of(P.asserted(spark, sf))
    return proof.groupBy("artifact_type").agg(F.count("*").alias("n"), F.coalesce(F.max(F.nullif("recorded_at", F.lit(""))), F.lit("")).alias("last"))


@query("""SELECT (SELECT count(*) FROM fact) AS facts, (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM ev) AS evidence,
  (SELECT count(*) FROM supersession) AS supersessions, (SELECT count(*) FROM conflict) AS conflicts,
  (SELECT count(*) FROM fact) - (SELECT count(*) FROM gone) AS active_facts""")
def a04_stats(spark, sf):
    return M.stats(P.star_memory(spark, sf))


@query("""SELECT count(*) AS total_facts, count(*) FILTER (g.fact_id IS NULL) AS active_facts, count(*) FILTER (coalesce(last_asserted, '') = '') AS undated_facts,
  count(*) FILTER (g.fact_id IS NULL AND evidence_count = 1) AS single_source_facts, CAST(0 AS BIGINT) AS unresolved_literals,
  (SELECT count(*) FROM supersession WHERE basis = 'ingestion_order') AS ingestion_ordered_supersessions, (SELECT count(*) FROM conflict) AS open_conflicts
  FROM fact LEFT JOIN sup USING (fact_id) LEFT JOIN gone g ON g.fact_id = fact.fact_id""")
def a05_health(spark, sf):
    return B.health(P.star_memory(spark, sf))


@query("""SELECT fact_id, string_agg(artifact_type || '=' || CAST(n AS VARCHAR), ', ' ORDER BY artifact_type) AS types FROM (SELECT fact_id, artifact_type, count(*) AS n FROM ev GROUP BY ALL) GROUP BY fact_id""")
def a06_evidence_by_type(spark, sf):
    per = P.evidence_of(P.asserted(spark, sf)).groupBy("fact_id", "artifact_type").agg(F.count("*").alias("n"))
    return per.groupBy("fact_id").agg(text_of(F.collect_list(F.concat("artifact_type", F.lit("="), F.col("n").cast("string")))).alias("types"))


@query("SELECT ref, count(*) AS n FROM (SELECT subject_ref AS ref FROM fact UNION ALL SELECT object_ref FROM fact) GROUP BY ref")
def a07_mention_counts(spark, sf):
    rows = P.facts_of(P.asserted(spark, sf))
    return rows.select(F.explode(F.array("subject_ref", "object_ref")).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))


@query("SELECT predicate || ' -> ' || CASE predicate WHEN 'uses' THEN 'depends_on' ELSE 'requires' END AS rename, count(*) AS affected FROM fact WHERE predicate IN ('uses', 'depends_on') GROUP BY predicate")
def a09_migration_impact(spark, sf):
    return apps.Renames({"uses": "depends_on", "depends_on": "requires"}).plan(P.facts_of(P.asserted(spark, sf)))


@query("SELECT predicate, count(*) AS n FROM fact GROUP BY predicate")
def a12_predicate_distribution(spark, sf):
    return apps.predicate_distribution(P.facts_of(P.asserted(spark, sf)))


@query("SELECT ref, count(*) AS n FROM (SELECT fact_id, subject_ref AS ref FROM fact UNION SELECT fact_id, object_ref FROM fact) GROUP BY ref HAVING count(*) > 1")
def a12_reused_concepts(spark, sf):
    return apps.reused_concepts(P.facts_of(P.asserted(spark, sf)))


@query("SELECT lower(string_split(p_name, ' ')[-1]) AS head, count(*) AS n, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS names FROM part GROUP BY 1 HAVING count(*) > 1", base=False)
def a12_head_nouns(spark, sf):
    return apps.head_noun_clusters(P.read(spark, sf, "part").select(F.col("p_name").alias("name")))


@query("SELECT lower(name) AS alias, min(entity_id) AS entity_id FROM ent GROUP BY 1")
def k01_aliases(spark, sf):
    return M.aliases(P.entity_rows(spark, sf))


@query("SELECT fact.* FROM fact JOIN (SELECT subject_ref, predicate, object_ref FROM fact ORDER BY fact_id LIMIT 1) USING (subject_ref, predicate, object_ref)")
def k03_existing_fact(spark, sf):
    m = P.star_memory(spark, sf)
    one = m.facts.orderBy("fact_id").first()
    return M.existing_fact(m, one["subject_ref"], one["predicate"], one["object_ref"]).drop("fact_type")


@query("SELECT subject_ref, predicate, count(*) AS n FROM fact WHERE fact_id NOT IN (SELECT fact_id FROM gone) GROUP BY ALL")
def k04_active_by_subject(spark, sf):
    return M.active_facts(P.star_memory(spark, sf)).groupBy("subject_ref", "predicate").agg(F.count("*").alias("n"))


@query("SELECT object_ref, count(*) AS n FROM fact WHERE fact_id NOT IN (SELECT fact_id FROM gone) AND predicate IN ('selected', 'uses', 'depends_on') GROUP BY object_ref")
def k05_active_with_object(spark, sf):
    live = M.active_facts(P.star_memory(spark, sf)).where(F.col("predicate").isin(V.CURRENCY_PREDICATES))
    return live.groupBy("object_ref").agg(F.count("*").alias("n"))


@query("SELECT fact_id, subject_ref AS ref FROM fact UNION SELECT fact_id, object_ref FROM fact")
def k07_mentions(spark, sf):
    return M.mentions(P.facts_of(P.asserted(spark, sf)))


@query("SELECT fact_id, string_agg(evidence_id, ',' ORDER BY recorded_at, evidence_id) AS proof FROM ev GROUP BY fact_id")
def k08_evidence_in_order(spark, sf):
    proof = P.evidence_of(P.asserted(spark, sf))
    listed = F.array_sort(F.collect_list(F.struct("recorded_at", "evidence_id")))
    return proof.groupBy("fact_id").agg(F.array_join(F.transform(listed, lambda x: x["evidence_id"]), ",").alias("proof"))


@query("SELECT superseding, superseded, reason, artifact_id, recorded_at, basis FROM supersession")
def k09_supersessions(spark, sf):
    return P.star_memory(spark, sf).supersessions


@query("SELECT fact_id, fact_id IN (SELECT fact_id FROM gone) AS is_superseded FROM fact")
def k10_is_superseded(spark, sf):
    return M.with_status(P.star_memory(spark, sf)).select("fact_id", (~F.col("is_active")).alias("is_superseded"))


@query("SELECT fact_id, count(*) AS n FROM (SELECT fact_a AS fact_id FROM conflict UNION ALL SELECT fact_b FROM conflict) GROUP BY fact_id")
def k11_conflicts_per_fact(spark, sf):
    rows = P.star_memory(spark, sf).conflicts
    return rows.select(F.explode(F.array("fact_a", "fact_b")).alias("fact_id")).groupBy("fact_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT ref, coalesce(label, CASE WHEN starts_with(ref, 'artifact:') THEN '<' || substr(ref, 10, 12) || '>' END, ref) AS ref_label FROM (SELECT subject_ref AS ref FROM fact UNION SELECT object_ref FROM fact UNION SELECT 'artifact:' || artifact_id FROM art) LEFT JOIN lab USING (ref)")
def k12_labels(spark, sf):
    rows = P.facts_of(P.asserted(spark, sf)).select(F.explode(F.array("subject_ref", "object_ref")).alias("ref"))
    arts = P.order_artifacts(spark, sf).select(F.concat(F.lit("artifact:"), "artifact_id").alias("ref"))
    return M.with_labels(rows.unionByName(arts).distinct(), P.entity_rows(spark, sf), "ref")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN starts_with(ref, 'entity_') THEN 'entity' WHEN starts_with(ref, 'artifact:') THEN 'artifact' ELSE 'literal' END AS kind FROM (SELECT subject_ref AS ref FROM fact UNION ALL SELECT 'artifact:' || artifact_id FROM art UNION ALL SELECT c_name FROM customer)) GROUP BY kind")
def m03_ref_kinds(spark, sf):
    refs = P.facts_of(P.asserted(spark, sf)).select(F.col("subject_ref").alias("ref"))
    refs = refs.unionByName(P.order_artifacts(spark, sf).select(F.concat(F.lit("artifact:"), "artifact_id").alias("ref"))).unionByName(P.read(spark, sf, "customer").select(F.col("c_name").alias("ref")))
    return refs.groupBy(ref_kind(F.col("ref")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM fact) AS facts, (SELECT count(*) FROM ev) AS evidence, (SELECT count(*) FROM supersession) AS supersessions, (SELECT count(*) FROM conflict) AS conflicts")
def s12_ingest_star(spark, sf):
    m = P.ingested_star(spark, sf)
    count = lambda t: t.agg(F.count("*")).scalar()
    return spark.range(1).select(count(m.facts).alias("facts"), count(m.evidence).alias("evidence"), count(m.supersessions).alias("supersessions"), count(m.conflicts).alias("conflicts"))


# -- joins and sets --------------------------------------------------------------


@query("SELECT fact_id FROM fact WHERE fact_id NOT IN (SELECT fact_id FROM gone)")
def j01_active_anti_join(spark, sf):
    return M.active_facts(P.star_memory(spark, sf)).select("fact_id")


@query("SELECT artifact_id FROM art WHERE artifact_id IN (SELECT artifact_id FROM ev)")
def j02_artifacts_with_evidence(spark, sf):
    return P.order_artifacts(spark, sf).select("artifact_id").join(P.evidence_of(P.asserted(spark, sf)), "artifact_id", "left_semi")


@query("SELECT fact.fact_id, s.label AS subject, predicate, o.label AS object, support FROM fact JOIN sup USING (fact_id) JOIN lab s ON s.ref = subject_ref JOIN lab o ON o.ref = object_ref")
def j04_labelled_facts(spark, sf):
    rows = P.asserted(spark, sf)
    out = M.with_labels(P.facts_of(rows), P.entity_rows(spark, sf), "subject_ref", "object_ref").join(M.support(P.evidence_of(rows)), "fact_id")
    return out.select("fact_id", F.col("subject_ref_label").alias("subject"), "predicate", F.col("object_ref_label").alias("object"), "support")


_TRIPLES = """, pred AS (SELECT DISTINCT s.label AS subject, predicate, o.label AS object FROM fact JOIN lab s ON s.ref = subject_ref JOIN lab o ON o.ref = object_ref),
lbl AS (SELECT DISTINCT n_name AS subject, 'uses' AS predicate, part AS object FROM np),
norm_p AS (SELECT DISTINCT lower(trim(subject)) AS subject, predicate, lower(trim(object)) AS object FROM pred),
norm_l AS (SELECT DISTINCT lower(trim(subject)) AS subject, predicate, lower(trim(object)) AS object FROM lbl)
"""


def _labels(spark, sf):
    parts = P.read(spark, sf, "part").join(P.read(spark, sf, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    return parts.select(F.lit("star").alias("case"), F.col("n_name").alias("subject"), F.lit("uses").alias("predicate"), P.part_name().alias("object"))


def _predicted(spark, sf):
    return apps.predicted_triples(P.star_memory(spark, sf)).withColumn("case", F.lit("star"))


@query(_TRIPLES + "SELECT 'star' AS \"case\", 'matched' AS kind, * FROM (SELECT * FROM norm_p INTERSECT SELECT * FROM norm_l) UNION ALL SELECT 'star', 'spurious', * FROM (SELECT * FROM norm_p EXCEPT SELECT * FROM norm_l) UNION ALL SELECT 'star', 'missed', * FROM (SELECT * FROM norm_l EXCEPT SELECT * FROM norm_p) UNION ALL SELECT 'star', 'violation', * FROM norm_p WHERE predicate = 'allows'")
def u03_triple_sets(spark, sf):
    predicted = _predicted(spark, sf)
    return apps.triple_sets(predicted, _labels(spark, sf), predicted.where("predicate = 'allows'"))


@query(_TRIPLES + """, reach AS (SELECT * FROM norm_l WHERE object NOT LIKE '%1'), n AS (SELECT
  (SELECT count(*) FROM (SELECT * FROM norm_p INTERSECT SELECT * FROM norm_l)) AS tp, (SELECT count(*) FROM (SELECT * FROM norm_p EXCEPT SELECT * FROM norm_l)) AS fp,
  (SELECT count(*) FROM (SELECT * FROM norm_l EXCEPT SELECT * FROM norm_p)) AS fn, (SELECT count(*) FROM (SELECT * FROM norm_p INTERSECT SELECT * FROM reach)) AS rtp,
  (SELECT count(*) FROM (SELECT * FROM reach EXCEPT SELECT * FROM norm_p)) AS rfn), r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS rc, rtp / (rtp + fp) AS rp, rtp / (rtp + rfn) AS rr FROM n)
SELECT c AS "case", tp, fp, fn, rtp AS reachable_tp, rfn AS reachable_fn, p AS precision, rc AS recall, rp AS reachable_precision, rr AS reachable_recall, 2 * p * rc / (p + rc) AS f1, 2 * rp * rr / (rp + rr) AS reachable_f1
FROM r, (VALUES ('star'), (NULL)) t(c)""")
def q15_extraction_scores(spark, sf):
    labels = _labels(spark, sf)
    return apps.score_extraction(_predicted(spark, sf), labels, labels.where("object LIKE '%1'"))


# -- windows, order, top-k ----------------------------------------------------------


@query("SELECT evidence_id, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY recorded_at, evidence_id) - 1 AS INTEGER) AS ordinal FROM ev")
def w01_ordinals(spark, sf):
    order = W.partitionBy("fact_id").orderBy("recorded_at", "evidence_id")
    return P.evidence_of(P.asserted(spark, sf)).select("evidence_id", (F.row_number().over(order) - 1).alias("ordinal"))


@query("SELECT superseded AS fact_id, min(row(recorded_at, superseding, reason, basis))[2] AS retired_by, min(row(recorded_at, superseding, reason, basis))[3] AS retirement_reason, min(row(recorded_at, superseding, reason, basis))[4] AS basis FROM supersession GROUP BY superseded")
def w02_first_retiring(spark, sf):
    return B.first_retiring(P.star_memory(spark, sf)).drop("retired_by_artifact")


_RANK = "CASE predicate " + " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(V.DECISION_PREDICATES)) + " ELSE 99 END"


@query(f"SELECT fact_id, CAST(row_number() OVER (PARTITION BY subject_ref ORDER BY {_RANK}, object_ref, fact_id) AS INTEGER) AS place FROM fact")
def o01_belief_order(spark, sf):
    order = W.partitionBy("subject_ref").orderBy(B.rank_of(F.col("predicate")), "object_ref", "fact_id")
    return P.facts_of(P.asserted(spark, sf)).select("fact_id", F.row_number().over(order).alias("place"))


@query("SELECT s.label AS subject, o.label AS object, support FROM fact JOIN sup USING (fact_id) JOIN lab s ON s.ref = subject_ref JOIN lab o ON o.ref = object_ref WHERE predicate = 'selected' AND fact_id NOT IN (SELECT fact_id FROM gone) ORDER BY support DESC, subject, object LIMIT 10")
def o05_top_decisions(spark, sf):
    return apps.brief(P.star_memory(spark, sf))["decisions"]


@query("SELECT label, count(*) AS facts FROM (SELECT subject_ref AS ref FROM fact UNION ALL SELECT object_ref FROM fact) JOIN lab USING (ref) GROUP BY label ORDER BY facts DESC, label LIMIT 10")
def o05_top_components(spark, sf):
    return apps.brief(P.star_memory(spark, sf))["components"]


# -- identity --------------------------------------------------------------------

_CLASS = """, same AS (SELECT subject_ref AS a, object_ref AS b FROM fact WHERE predicate = 'same_as' AND fact_id NOT IN (SELECT fact_id FROM gone)),
both_ways AS (SELECT a, b FROM same UNION SELECT b, a FROM same),
reach AS (SELECT a AS ref, a AS r FROM both_ways UNION SELECT reach.ref, b FROM reach JOIN both_ways ON reach.r = both_ways.a),
comp AS (SELECT ref, min(r) AS class_id FROM reach GROUP BY ref),
class AS (
  SELECT ref, class_id, label, row_number() OVER (PARTITION BY class_id ORDER BY length(label) DESC, label, ref) AS member_rank, count(*) OVER (PARTITION BY class_id) AS class_size,
    first(ref) OVER (PARTITION BY class_id ORDER BY length(label) DESC, label, ref) AS canonical_ref FROM comp JOIN lab USING (ref)),
men AS (
  SELECT DISTINCT coalesce(class_id, ref) AS class_id, fact_id FROM (SELECT fact_id, subject_ref AS ref FROM fact WHERE predicate <> 'same_as' UNION SELECT fact_id, object_ref FROM fact WHERE predicate <> 'same_as') LEFT JOIN comp USING (ref))
"""


@query(_CLASS + "SELECT ref, class_id, canonical_ref, label, CAST(member_rank AS INTEGER) AS member_rank, class_size, class_size >= 64 AS truncated FROM class")
def g01_identity_classes(spark, sf):
    return B.identity_classes(P.star_memory(spark, sf))


@query("SELECT a.superseding AS first, a.superseded AS second, b.superseded AS third FROM supersession a JOIN supersession b ON a.superseded = b.superseding")
def g03_two_hops(spark, sf):
    e = P.star_memory(spark, sf).supersessions.select("superseding", "superseded")
    return e.select(F.col("superseding").alias("first"), F.col("superseded").alias("second")).join(e.select(F.col("superseding").alias("second"), F.col("superseded").alias("third")), "second").select("first", "second", "third")


# -- read path -------------------------------------------------------------------

_WANTED = ", ".join(f"'{p}'" for p in V.DECISION_PREDICATES)
_BELIEF = _CLASS + f""", direct AS (SELECT men.class_id, fact_id, fact_id NOT IN (SELECT fact_id FROM gone) AS active FROM men JOIN fact USING (fact_id) WHERE predicate IN ({_WANTED})),
bel AS (
  SELECT class_id, fact_id FROM direct UNION SELECT class_id, superseded FROM direct JOIN supersession ON superseding = fact_id WHERE active),
believed AS (SELECT class_id, fact.*, coalesce(support, 0) AS support, coalesce(last_asserted, '') AS last_asserted, CASE WHEN fact_id IN (SELECT fact_id FROM gone) THEN 'history' ELSE 'current' END AS section, {_RANK} AS rank FROM bel JOIN fact USING (fact_id) LEFT JOIN sup USING (fact_id))
"""


@query(_BELIEF + "SELECT class_id, fact_id, section, support FROM believed")
def q01_beliefs(spark, sf):
    return B.beliefs(P.star_memory(spark, sf)).select("class_id", "fact_id", "section", "support")


@query(_BELIEF + """SELECT name, entity_id AS ref, coalesce(class_id, entity_id) AS class_id,
  CASE WHEN entity_id IS NULL THEN 'unbound' WHEN n IS NULL THEN 'no facts' WHEN w = 0 THEN 'no decision' ELSE 'answered' END AS outcome
FROM (SELECT name, entity_id, comp.class_id AS class_id FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT part FROM np UNION ALL SELECT c_name FROM customer) q
  LEFT JOIN (SELECT lower(name) AS k, min(entity_id) AS entity_id FROM ent GROUP BY 1) e ON lower(trim(name)) = k LEFT JOIN comp ON comp.ref = entity_id) z
LEFT JOIN (SELECT class_id AS cid, count(*) AS n, count(*) FILTER (predicate IN (""" + _WANTED + """)) AS w FROM men JOIN fact USING (fact_id) GROUP BY 1) c ON cid = coalesce(class_id, entity_id)""")
def q02_ask_every_name(spark, sf):
    names = P.read(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(P.read(spark, sf, "region").select(F.col("r_name").alias("name")))
    names = names.unionByName(P.read(spark, sf, "part").select(P.part_name().alias("name"))).unionByName(P.read(spark, sf, "customer").select(F.col("c_name").alias("name")))
    return B.ask(P.star_memory(spark, sf), names)


@query(_BELIEF + "SELECT class_id, fact_id, support, last_asserted FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY rank, object_ref, fact_id) AS nth FROM believed WHERE section = 'current' AND predicate = 'selected') WHERE nth = 1")
def q03_decisions_of_classes(spark, sf):
    return B.decisions_of(B.beliefs(P.star_memory(spark, sf))).select("class_id", "fact_id", "support", "last_asserted")


@query(_CLASS + """, tl AS (SELECT DISTINCT recorded_at AS w, fact_id, 'asserted' AS event, artifact_id, artifact_type FROM ev UNION SELECT DISTINCT recorded_at, superseded, 'retired', artifact_id, '' FROM supersession)
SELECT class_id, w AS "when", fact_id, event, artifact_id, artifact_type, CAST(row_number() OVER (PARTITION BY class_id ORDER BY w = '', w, fact_id, event, artifact_id) AS INTEGER) AS place FROM men JOIN tl USING (fact_id)""")
def q05_timelines(spark, sf):
    return B.timeline(P.star_memory(spark, sf)).drop("statement")


@query(_CLASS + """SELECT coalesce(class_id, object_ref) AS class_id, fact_id, subject_ref AS ref, label, predicate, support, evidence_count FROM fact JOIN sup USING (fact_id) LEFT JOIN comp ON comp.ref = object_ref JOIN lab ON lab.ref = subject_ref
WHERE predicate IN ('uses', 'depends_on', 'requires', 'imports', 'calls', 'contains') AND fact_id NOT IN (SELECT fact_id FROM gone)""")
def q06_dependents(spark, sf):
    return B.dependents(P.star_memory(spark, sf))


@query("SELECT s.label AS subject, o.label AS object, fact_id NOT IN (SELECT fact_id FROM gone) AS is_current FROM fact JOIN lab s ON s.ref = subject_ref JOIN lab o ON o.ref = object_ref WHERE predicate = 'selected'")
def q07_decisions(spark, sf):
    return B.decisions(P.star_memory(spark, sf))


_PROPOSED = """, prop AS (SELECT DISTINCT n_name AS subject, CASE WHEN p_size % 3 = 0 THEN 'removes' ELSE 'uses' END AS predicate, part AS object FROM np)
, hit AS (
  SELECT DISTINCT subject, prop.predicate, object, f.fact_id FROM prop JOIN lab s ON s.label = subject JOIN lab o ON o.label = object LEFT JOIN comp cs ON cs.ref = s.ref
  JOIN fact f ON f.predicate = 'prohibits' AND f.object_ref = o.ref LEFT JOIN comp cf ON cf.ref = f.subject_ref
  WHERE prop.predicate = 'uses' AND coalesce(cs.class_id, s.ref) = coalesce(cf.class_id, f.subject_ref) AND f.fact_id NOT IN (SELECT fact_id FROM gone))
"""


def _proposed(spark, sf):
    parts = P.read(spark, sf, "part").join(P.read(spark, sf, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    return parts.select(F.col("n_name").alias("subject"), F.when(F.col("p_size") % 3 == 0, "removes").otherwise("uses").alias("predicate"), P.part_name().alias("object")).distinct()


@query(_CLASS + _PROPOSED + "SELECT subject, predicate, object, fact_id, last_asserted AS established_at, support FROM hit JOIN sup USING (fact_id)")
def q12_violations(spark, sf):
    found, _ = apps.check_compliance(P.star_memory(spark, sf), _proposed(spark, sf))
    return found.drop("established_by")


@query(_CLASS + _PROPOSED + "SELECT * FROM prop EXCEPT SELECT subject, predicate, object FROM hit")
def q12_no_rule(spark, sf):
    return apps.check_compliance(P.star_memory(spark, sf), _proposed(spark, sf))[1]


@query("SELECT s.label AS subject, o.label AS object FROM fact JOIN lab s ON s.ref = subject_ref JOIN lab o ON o.ref = object_ref WHERE predicate = 'prohibits' AND fact_id NOT IN (SELECT fact_id FROM gone)")
def q13_constraints(spark, sf):
    return apps.brief(P.star_memory(spark, sf))["constraints"]


@query(_BELIEF + """, dec AS (SELECT class_id, label AS got FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY rank, object_ref, fact_id) AS nth FROM believed WHERE section = 'current' AND predicate = 'selected') JOIN lab ON lab.ref = object_ref WHERE nth = 1),
qs AS (SELECT n_name AS ask, CASE WHEN n_nationkey % 2 = 0 THEN 'small ring 1' END AS expect FROM nation UNION ALL SELECT c_name, CASE WHEN c_custkey % 2 = 0 THEN 'x' END FROM customer)
SELECT ask, expect, got, CASE WHEN got IS NULL THEN CASE WHEN expect IS NULL THEN 'correctly_declined' ELSE 'declined' END WHEN lower(trim(got)) = lower(trim(expect)) THEN 'correct' ELSE 'wrong' END AS outcome
FROM qs LEFT JOIN lab ON lower(label) = lower(trim(ask)) LEFT JOIN comp ON comp.ref = lab.ref LEFT JOIN dec ON dec.class_id = coalesce(comp.class_id, lab.ref)""")
def q16_pilot(spark, sf):
    a = P.read(spark, sf, "nation").select(F.col("n_name").alias("ask"), F.when(F.col("n_nationkey") % 2 == 0, "small ring 1").alias("expect"))
    b = P.read(spark, sf, "customer").select(F.col("c_name").alias("ask"), F.when(F.col("c_custkey") % 2 == 0, "x").alias("expect"))
    return apps.run_pilot(P.star_memory(spark, sf), a.unionByName(b))


_EDGES = """, per AS (
  SELECT class_id, count(*) FILTER (section = 'current') AS cur, count(*) FILTER (section = 'history') AS hist, count(*) FILTER (section = 'history' AND basis = 'ingestion_order') AS by_order, count(*) FILTER (section = 'current' AND last_asserted = '') AS undated
  FROM believed LEFT JOIN (SELECT superseded AS fact_id, min(row(recorded_at, superseding, artifact_id, reason, basis))[5] AS basis FROM supersession GROUP BY superseded) USING (fact_id) GROUP BY class_id),
named AS (SELECT class_id, count(*) AS n, string_agg(label, ', ' ORDER BY member_rank) AS labels, min(row(member_rank, label))[2] AS canonical FROM class GROUP BY class_id)
SELECT class_id, array_to_string(list_filter([
  CASE WHEN cur > 0 AND hist = 0 THEN 'No supersession edge touches this entity: memory holds a current position but no recorded history of what it replaced.' END,
  CASE WHEN by_order > 0 THEN by_order || ' supersession(s) here were ordered by ingestion order, not by artifact timestamps. Re-importing these artifacts in a different order could invert this answer.' END,
  CASE WHEN n > 1 THEN '''' || canonical || ''' resolved across ' || n || ' names asserted to be the same concept: ' || labels || '.' END,
  CASE WHEN n >= 64 THEN 'The identity class hit the traversal bound; some equivalent names were not followed.' END,
  CASE WHEN undated > 0 THEN undated || ' current fact(s) carry no timestamped evidence.' END], lambda x: x IS NOT NULL), chr(10)) AS notes FROM per LEFT JOIN named USING (class_id)"""


@query(_BELIEF + _EDGES)
def q04_diagnostics(spark, sf):
    m = P.star_memory(spark, sf)
    classes = B.identity_classes(m)
    return B.diagnostics(m, B.beliefs(m, classes), classes).select("class_id", F.array_join("diagnostics", "\n").alias("notes"))


@query("SELECT fact_id, CASE predicate WHEN 'selected' THEN 'uses ' || o.label || ' for ' || s.label WHEN 'uses' THEN s.label || ' uses ' || o.label WHEN 'depends_on' THEN s.label || ' depends on ' || o.label WHEN 'replaced_by' THEN 'replaced ' || s.label || ' with ' || o.label WHEN 'prohibits' THEN s.label || ' must not use ' || o.label WHEN 'allows' THEN s.label || ' may use ' || o.label ELSE s.label || ' same as ' || o.label END AS said FROM fact JOIN lab s ON s.ref = subject_ref JOIN lab o ON o.ref = object_ref")
def q09_phrases(spark, sf):
    from ..operators.prose import phrase

    m = P.star_memory(spark, sf)
    rows = M.with_labels(m.facts, m.entities, "subject_ref", "object_ref")
    return rows.select("fact_id", phrase(F.col("subject_ref_label"), F.col("predicate"), F.col("object_ref_label")).alias("said"))


@query("SELECT count(*) FILTER (NOT starts_with(subject_ref, 'artifact:')) AS domain_facts, count(*) AS facts, count(*) FILTER (NOT starts_with(subject_ref, 'artifact:')) / count(*) AS share FROM fact")
def q17_domain_share(spark, sf):
    return apps.domain_share(P.facts_of(P.asserted(spark, sf)))


# -- linker ----------------------------------------------------------------------


@query(f"SELECT name, {P.sql_entity('name')} AS entity_id FROM (SELECT c_name AS name FROM customer UNION ALL SELECT n_name FROM nation)", base=False)
def l01_bind(spark, sf):
    names = P.read(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(P.read(spark, sf, "nation").select(F.col("n_name").alias("name")))
    return names.select("name", entity_id(F.col("name")).alias("entity_id"))


@query("SELECT fact_id, subject_ref, predicate, object_ref FROM fact")
def l03_promote(spark, sf):
    return linker.promote(P.asserted(spark, sf).withColumn("fact_type", F.lit("relationship"))).drop("fact_type")


@query("SELECT evidence_id, fact_id, artifact_id, artifact_type, recorded_at, confidence, authority, round(confidence * authority, 6) AS weight FROM ev")
def l04_evidence(spark, sf):
    rows = P.evidence_of(P.asserted(spark, sf)).drop("supporting")
    return rows.withColumn("weight", linker.weight(F.col("confidence"), F.col("authority")))


@query("""SELECT a.artifact_id AS a, b.artifact_id AS b, CASE WHEN a.recorded_at = '' OR b.recorded_at = '' THEN 'unknown' WHEN a.recorded_at = b.recorded_at THEN 'simultaneous' WHEN a.recorded_at > b.recorded_at THEN 'later' ELSE 'earlier' END AS time_order
FROM art a JOIN art b ON b.ingest_seq = a.ingest_seq + 1""")
def l05_time_order(spark, sf):
    arts = P.order_artifacts(spark, sf)
    b = arts.select((F.col("ingest_seq") - 1).alias("ingest_seq"), F.col("artifact_id").alias("b"), F.col("recorded_at").alias("bt"))
    return arts.join(b, "ingest_seq").select(F.col("artifact_id").alias("a"), "b", linker.time_order(F.col("recorded_at"), F.col("bt")).alias("time_order"))


@query("SELECT fact_a, fact_b, conflict_type, artifact_id FROM conflict")
def l10_conflicts(spark, sf):
    return P.star_memory(spark, sf).conflicts


@query("SELECT superseding, superseded, reason, artifact_id, recorded_at, basis FROM supersession")
def l12_replay_in_order(spark, sf):
    return linker.replay(spark, P.asserted(spark, sf))[0]


# -- compiler ----------------------------------------------------------------------

_DOCS = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '## Context' || chr(10) || '- ' ELSE '' END || substr(text, 1, 60) || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || '| t |' || chr(10) || chr(10) || 'Reason:' || chr(10) || chr(10) || text AS content FROM documents"


def _documents(spark, sf):
    head = F.when(F.col("doc_id") % 2 == 0, "## Context\n- ").otherwise("")
    content = F.concat(head, F.substring("text", 1, 60), F.lit("\n```\ncode\n```\n| t |\n\nReason:\n\n"), F.col("text"))
    return P.read(spark, sf, "documents").select("doc_id", content.alias("content"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(content, '(?ms)^[^\S\n]*(?:```|~~~)[^\n]*(?:\n|\z)(?:.*?^[^\S\n]*(?:```|~~~)[^\n]*(?:\n|\z)|.*\z)', '', 'g'), '(?m)^[^\S\n]*\|[^\n]*\|[^\S\n]*(?:\n|\z)', '', 'g')) AS cleaned FROM (""" + _DOCS + ")", base=False)
def c01_strip_noise(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(strip_noise(F.col("content"))).alias("cleaned"))


@query("SELECT doc_id, regexp_matches(text, '(?i)\\b(never|not|cannot|can''t|won''t|must not|may not|does not|do not|should not|shall not|no longer|neither|nor)\\b') AS negated FROM documents", base=False)
def c09_negation(spark, sf):
    return P.read(spark, sf, "documents").select("doc_id", is_negated(F.col("text")).alias("negated"))


_SENT = "SELECT p_partkey, 'Use the ' || {part} || ' for ' || n_name || ' storage' || CASE WHEN p_size % 2 = 0 THEN ' because it is cheap' ELSE '' END || '.' AS s FROM part JOIN nation ON p_partkey % 25 = n_nationkey".replace("{part}", P._PART)


def _sentences(spark, sf):
    parts = P.read(spark, sf, "part").join(P.read(spark, sf, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    tail = F.when(F.col("p_size") % 2 == 0, " because it is cheap").otherwise("")
    return parts.select(F.col("p_partkey").cast("string").alias("artifact_id"), F.lit(0).alias("seg_ord"), F.concat(F.lit("Use the "), P.part_name(), F.lit(" for "), F.col("n_name"), F.lit(" storage"), tail, F.lit(".")).alias("text"))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, regexp_extract(s, '\\bus(?:e|es|ed|ing)\\s+([A-Za-z0-9][\\w\\.\\-/ ]{{1,90}}?)\\s+for\\s+([A-Za-z0-9][\\w\\.\\-/ ]{{1,90}}?)(?:[\\.,;]|$)', 2, 'i') AS raw_subject, regexp_extract(s, '\\bus(?:e|es|ed|ing)\\s+([A-Za-z0-9][\\w\\.\\-/ ]{{1,90}}?)\\s+for\\s+([A-Za-z0-9][\\w\\.\\-/ ]{{1,90}}?)(?:[\\.,;]|$)', 1, 'i') AS raw_object FROM ({_SENT})", base=False)
def c10_use_for_matches(spark, sf):
    raw = compiler.raw_matches(compiler.clause_rows(_sentences(spark, sf)))
    return raw.where("pattern = 'use_for'").select("artifact_id", "raw_subject", "raw_object")


@query("SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, n_name || ' storage' AS subject, 'selected' AS predicate, " + P._PART + " AS object FROM part JOIN nation ON p_partkey % 25 = n_nationkey", base=False)
def c10_relational_matches(spark, sf):
    return compiler.relational_matches(_sentences(spark, sf)).select("artifact_id", "subject", "predicate", "object")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, regexp_replace(regexp_replace(s, ' because .*$', ''), '\\.$', '') AS phrase FROM ({_SENT})", base=False)
def c11_phrases(spark, sf):
    return _sentences(spark, sf).select("artifact_id", normalize_phrase(F.col("text")).alias("phrase"))


@query("SELECT name, length(name) >= 2 AND len(string_split(name, ' ')) <= 6 AS usable, regexp_matches(name, '[A-Z0-9]') OR len(string_split(name, ' ')) >= 2 AS concept FROM (SELECT p_name AS name FROM part UNION SELECT n_name FROM nation)", base=False)
def c14_concepts(spark, sf):
    names = P.read(spark, sf, "part").select(F.col("p_name").alias("name")).union(P.read(spark, sf, "nation").select("n_name")).distinct()
    return names.select("name", is_usable(F.col("name")).alias("usable"), is_concept(F.col("name"), F.lit(False)).alias("concept"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z''])(should|might|may|could|probably|likely|appears|seems|possibly|perhaps)($|[^a-z''])') THEN CAST(0.4 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS confidence FROM documents", base=False)
def c19_confidence(spark, sf):
    return P.read(spark, sf, "documents").select("doc_id", confidence(F.col("text")).alias("confidence"))


# -- sources -----------------------------------------------------------------------


@query("SELECT name, CASE WHEN regexp_matches(name, '(^|[_-])adr') THEN 'adr' WHEN regexp_matches(name, '(^|[_-])rfc') THEN 'document' WHEN regexp_matches(name, '(^|[_-])pr') THEN 'pull_request' WHEN regexp_matches(name, '(^|[_-])commit') THEN 'commit' WHEN regexp_matches(name, '(^|[_-])issue') THEN 'issue' ELSE 'document' END AS type FROM (SELECT DISTINCT lower(c_mktsegment) || '-' || event_type AS name FROM customer, (SELECT DISTINCT event_type FROM events) UNION SELECT 'adr-001' UNION SELECT 'my_issue' UNION SELECT 'process')", base=False)
def s02_infer_types(spark, sf):
    from ..sources.files import inferred_type

    segments = P.read(spark, sf, "customer").select(F.lower("c_mktsegment").alias("a")).distinct()
    kinds = P.read(spark, sf, "events").select("event_type").distinct()
    names = segments.crossJoin(kinds).select(F.concat("a", F.lit("-"), "event_type").alias("name"))  # a handful of names with one another
    extra = spark.range(1).select(F.explode(F.array(F.lit("adr-001"), F.lit("my_issue"), F.lit("process"))).alias("name"))
    return names.union(extra).distinct().select("name", inferred_type(F.col("name")).alias("type"))


@query("SELECT doc_id, doc_id % 4 < 2 AS noise FROM documents", base=False)
def s06_commit_noise(spark, sf):
    from ..sources.records import is_noise

    head = F.element_at(F.array(F.lit("Merge branch 'x'"), F.lit("BUMP a to 2"), F.lit("Add cache"), F.lit("Mergers")), (F.col("doc_id") % 4 + 1).cast("int"))
    return P.read(spark, sf, "documents").select("doc_id", is_noise(F.concat(head, F.lit("\n\n"), F.col("text"))).alias("noise"))


@query("SELECT artifact_id FROM art WHERE artifact_id NOT IN (SELECT artifact_id FROM asserted)")
def s10_unknown_artifacts(spark, sf):
    return P.order_artifacts(spark, sf).select("artifact_id").join(P.asserted(spark, sf).select("artifact_id"), "artifact_id", "left_anti")


@query("SELECT event_type AS source, arg_max(CAST(event_id AS VARCHAR), event_id) AS cursor FROM events GROUP BY event_type", base=False)
def s11_cursors(spark, sf):
    from ..streaming.ingest import latest_cursors

    return latest_cursors(P.read(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("cursor"), F.col("event_id").alias("seq")))


@query("""SELECT bucket, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM (SELECT CASE WHEN p_size <= 20 THEN '1' WHEN p_size <= 40 THEN '2' ELSE '3' END AS bucket FROM part) GROUP BY bucket""", base=False)
def s15_bucket_shares(spark, sf):
    from ..sources.sheets import bucket_shares

    bucket = F.when(F.col("p_size") <= 20, "1").when(F.col("p_size") <= 40, "2").otherwise("3")
    return bucket_shares(P.read(spark, sf, "part").select(bucket.alias("bucket")))
