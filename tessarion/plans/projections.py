"""The driver's star schema seen as artifacts, facts, evidence and texts; in Spark and, for oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ids import content_id, entity_id
from ..functions.scratch import Scratch
from ..operators.linker import authority, replay
from ..operators.memory import Memory


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def part_name() -> Column:
    return F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))


def order_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, type, recorded_at, ingest_seq, custkey: one artifact an order, some undated."""
    kind = F.create_map(*[F.lit(x) for pair in (("1", "adr"), ("2", "pull_request"), ("3", "issue"), ("4", "commit"), ("5", "document")) for x in pair])
    return read(spark, sf_dir, "orders").select(
        content_id("artifact", F.lit("order"), F.col("o_orderkey").cast("string")).alias("artifact_id"),
        F.element_at(kind, F.substring("o_orderpriority", 1, 1)).alias("type"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("recorded_at"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.col("o_custkey").alias("custkey"),
    )


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda t, c, kind: read(spark, sf_dir, t).select(c.alias("name"), F.lit(kind).alias("type"))
    rows = named("nation", F.col("n_name"), "team").unionByName(named("region", F.col("r_name"), "team")).unionByName(named("part", part_name(), "component"))
    return rows.select(entity_id(F.col("name")).alias("entity_id"), "name", "type", F.array(F.lower("name")).alias("aliases"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a line item with its order, nation and part: keys and flags, since the rows are dealt out twice."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("priority"), (F.col("o_orderstatus") == "P").alias("undated"), F.col("o_orderdate").cast("date").alias("on"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", (F.col("l_discount") > 0.05).alias("low"))
    parts = read(spark, sf_dir, "part").select("p_partkey", entity_id(part_name()).alias("object_ref"))
    return items.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


def line_assertions(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, *more: str) -> DataFrame:
    """One assertion a line item: the customer's nation uses, selected or depends on the part.

    ``rows`` are those of ``lines``, all if not given, and ``more`` names further columns of theirs to keep.
    """
    predicate = F.create_map(*[F.lit(x) for pair in (("A", "uses"), ("N", "selected"), ("R", "depends_on")) for x in pair])
    kind = F.create_map(*[F.lit(x) for pair in (("1", "adr"), ("2", "pull_request"), ("3", "issue"), ("4", "commit"), ("5", "document")) for x in pair])
    nations = read(spark, sf_dir, "nation").select("n_nationkey", entity_id(F.col("n_name")).alias("subject_ref"))
    rows = (lines(spark, sf_dir) if rows is None else rows).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        "subject_ref", F.element_at(predicate, F.col("l_returnflag")).alias("predicate"), "object_ref", content_id("artifact", F.lit("order"), F.col("l_orderkey").cast("string")).alias("artifact_id"), F.col("l_orderkey").alias("ingest_seq"),
        F.element_at(kind, F.col("priority")).alias("artifact_type"), F.when(F.col("undated"), "").otherwise(F.date_format("on", "yyyy-MM-dd")).alias("recorded_at"), F.when(F.col("low"), 0.4).otherwise(1.0).alias("confidence"), *more,
    )


def part_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules about parts: some are replaced by the next part, some are prohibited or allowed to a nation."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size", part_name().alias("part"))
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("part").alias("next"))
    replaced = parts.where("p_size = 50").join(after, "p_partkey").select("p_partkey", F.col("part").alias("s"), F.lit("replaced_by").alias("predicate"), F.col("next").alias("o"))
    of_nation = parts.join(nations, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    rule = lambda cond, p: of_nation.where(cond).select((F.col("p_partkey") + (1 if p == "allows" else 0)).alias("p_partkey"), F.col("n_name").alias("s"), F.lit(p).alias("predicate"), F.col("part").alias("o"))
    rows = replaced.unionByName(rule("p_size IN (1, 2)", "prohibits")).unionByName(rule("p_size = 2", "allows"))
    return rows.select(
        entity_id(F.col("s")).alias("subject_ref"), "predicate", entity_id(F.col("o")).alias("object_ref"), content_id("artifact", F.lit("part"), F.col("p_partkey").cast("string")).alias("artifact_id"), (F.col("p_partkey") * 7).alias("ingest_seq"),
        F.lit("adr").alias("artifact_type"), F.lit("1998-01-01").alias("recorded_at"), F.lit(1.0).alias("confidence"),
    )


def identity_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is the same thing as its region: five classes, the regions'."""
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        entity_id(F.col("n_name")).alias("subject_ref"), F.lit("same_as").alias("predicate"), entity_id(F.col("r_name")).alias("object_ref"), content_id("artifact", F.lit("nation"), F.col("n_nationkey").cast("string")).alias("artifact_id"), F.col("n_nationkey").cast("bigint").alias("ingest_seq"),
        F.lit("document").alias("artifact_type"), F.lit("").alias("recorded_at"), F.lit(1.0).alias("confidence"),
    )


def asserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = line_assertions(spark, sf_dir).unionByName(part_assertions(spark, sf_dir)).unionByName(identity_assertions(spark, sf_dir))
    return every.withColumn("fact_id", content_id("fact", "subject_ref", "predicate", "object_ref"))


def fact_type(predicate: Column) -> Column:
    from ..operators.compiler import fact_type as of

    return of(predicate)


def facts_of(rows: DataFrame) -> DataFrame:
    return rows.select("fact_id", "subject_ref", "predicate", "object_ref").distinct().withColumn("fact_type", fact_type(F.col("predicate")))


def evidence_of(rows: DataFrame) -> DataFrame:
    return evidence_rows(rows.select("fact_id", "artifact_id", "artifact_type", "recorded_at", "confidence").distinct())


def evidence_rows(rows: DataFrame) -> DataFrame:
    """The evidence of assertions that differ."""
    keyed = rows.select(content_id("evidence", F.col("artifact_id"), F.col("fact_id"), F.col("confidence").cast("string")).alias("evidence_id"), "fact_id", "artifact_id", "artifact_type", "recorded_at", "confidence")
    return keyed.withColumn("authority", authority(F.col("artifact_type"))).withColumn("supporting", F.array().cast("array<string>"))


def distinct_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``asserted``, each once, with ``first``: whether a row is the one of its fact that stands for it.

    Lines are dealt out by part, which all lines of a fact share, so neither step deals them out again.
    """
    once = lines(spark, sf_dir).distinct()
    of_fact = W.partitionBy("l_partkey", "object_ref", "c_nationkey", "l_returnflag").orderBy("l_orderkey", "low")
    said = line_assertions(spark, sf_dir, once.withColumn("first", F.row_number().over(of_fact) == 1), "first")
    others = part_assertions(spark, sf_dir).unionByName(identity_assertions(spark, sf_dir)).distinct()
    of_fact = W.partitionBy("subject_ref", "predicate", "object_ref").orderBy("ingest_seq", "artifact_id")
    every = said.unionByName(others.withColumn("first", F.row_number().over(of_fact) == 1))
    return every.withColumn("fact_id", content_id("fact", "subject_ref", "predicate", "object_ref"))


def build_star_memory(spark: SparkSession, sf_dir: str) -> Memory:
    """Ingest the star schema: all tables of memory, written to the shared folder.

    Facts and evidence are the distinct assertions, stored once, seen from two sides.
    """
    scratch = Scratch(spark, "star", lean=True)
    rows = scratch.table(distinct_assertions(spark, sf_dir), "asserted")
    facts = rows.where("first").select("fact_id", "subject_ref", "predicate", "object_ref").withColumn("fact_type", fact_type(F.col("predicate")))
    edges, conflicts = replay(spark, rows)
    return Memory(scratch.table(entity_rows(spark, sf_dir), "entities"), facts, evidence_rows(rows), edges, conflicts)


_stored: dict[str, tuple[tuple, Memory]] = {}


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """The application, and the files of the tables that memory is made of, with their sizes and times."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(sf_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(fs_path(f"{sf_dir}/{t}.parquet")) for t in ("customer", "lineitem", "nation", "orders", "part", "region")]
    return (spark.sparkContext.applicationId, *((f.getLen(), f.getModificationTime()) for f in found))


def ingested_star(spark: SparkSession, sf_dir: str) -> Memory:
    """Ingest the star schema and keep it as the memory that the read path answers from."""
    version = _version(spark, sf_dir)
    _stored[sf_dir] = (version, build_star_memory(spark, sf_dir))
    return _stored[sf_dir][1]


def star_memory(spark: SparkSession, sf_dir: str) -> Memory:
    """The stored memory of the star schema; ingested once an application, unless its files have changed since."""
    known = _stored.get(sf_dir)
    return known[1] if known and known[0] == _version(spark, sf_dir) else ingested_star(spark, sf_dir)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short decision record a part: artifact_id, type, recorded_at, ingest_seq, content."""
    parts = read(spark, sf_dir, "part").join(read(spark, sf_dir, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    part = part_name()
    body = F.concat(
        F.lit("# Record "), F.col("p_partkey").cast("string"), F.lit("\n\n## Decision\nUse "), part, F.lit(" for the "), F.col("n_name"), F.lit(" service, because it fits.\n\n```\nx = 1\n```\n| a | b |\n\nReason:\n"),
        F.lit("The "), F.col("n_name"), F.lit(" gateway depends on "), part, F.lit(".\n\n- The "), F.lower("p_type"), F.lit(" module uses "), part, F.lit(".\n- "), F.col("n_name"), F.lit(" must not use old storage."),
        F.when(F.col("p_size") % 2 == 0, "\n\nThis should probably be replaced.").otherwise(""),
    )
    out = parts.select(F.lit("adr").alias("type"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd").alias("recorded_at"), F.col("p_partkey").alias("ingest_seq"), body.alias("content"))
    return out.withColumn("artifact_id", content_id("artifact", "type", "content"))


# -- the same projections as DuckDB SQL --------------------------------------------


def sql_id(scope: str, *parts: str) -> str:
    return f"('{scope}_' || substr(sha256('{scope}:' || {" || ':' || ".join(parts)}), 1, 16))"


def sql_entity(name: str) -> str:
    return sql_id("entity", f"lower(trim({name}))")


_PART = "(p_name || ' ' || CAST(p_partkey AS VARCHAR))"
#: CTEs from sight to gone: the rules in order of ingestion over any CTE ``asserted``; selections fold in a recursive step.
SQL_RULES = """
sight AS (
  SELECT fact_id, subject_ref, predicate, object_ref, recorded_at, min(row(ingest_seq, artifact_id)) AS place FROM asserted
  WHERE predicate IN ('selected', 'uses', 'depends_on', 'replaced_by', 'deprecated', 'prohibits', 'allows') GROUP BY ALL),
seen AS MATERIALIZED (SELECT *, place = min(place) OVER (PARTITION BY fact_id) AS new FROM sight),
declared AS (SELECT fact_id AS r, subject_ref AS ref, predicate AS said, place, recorded_at AS r_at FROM seen WHERE new AND predicate IN ('replaced_by', 'deprecated')),
pair AS (
  SELECT r, said, d.place, r_at, c.fact_id AS c, max(c.recorded_at) AS c_at FROM declared d JOIN seen c ON (c.subject_ref = d.ref OR c.object_ref = d.ref) AND c.predicate IN ('uses', 'depends_on') AND c.place < d.place
  GROUP BY ALL),
ended AS (SELECT *, min(CASE WHEN r_at = '' OR c_at = '' OR r_at > c_at THEN place END) OVER (PARTITION BY c) AS until FROM pair),
chosen AS (SELECT * FROM seen WHERE predicate = 'selected'),
about AS (SELECT DISTINCT subject_ref, declared.* FROM declared JOIN (SELECT subject_ref, subject_ref AS ref FROM chosen UNION SELECT subject_ref, object_ref FROM chosen) USING (ref)),
event AS MATERIALIZED (
  SELECT subject_ref, place, max(t) AS t, row_number() OVER (PARTITION BY subject_ref ORDER BY place) AS n,
    coalesce(list({f: fact_id, o: object_ref, t: t, new: new}) FILTER (fact_id IS NOT NULL), []) AS facts, coalesce(list({r: r, ref: ref, said: said}) FILTER (r IS NOT NULL), []) AS decls
  FROM (SELECT subject_ref, place, recorded_at AS t, fact_id, object_ref, new, NULL AS r, NULL AS ref, NULL AS said FROM chosen UNION ALL SELECT subject_ref, place, r_at, NULL, NULL, NULL, r, ref, said FROM about)
  GROUP BY subject_ref, place),
step AS (
  SELECT DISTINCT subject_ref, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(f VARCHAR, o VARCHAR, t VARCHAR)[]) AS held, CAST([] AS STRUCT(i VARCHAR, f VARCHAR, o VARCHAR, reason VARCHAR)[]) AS met, CAST('' AS VARCHAR) AS artifact_id, CAST('' AS VARCHAR) AS t FROM event
  UNION ALL
  SELECT subject_ref, n,
    list_concat(
      list_transform(list_filter(held, lambda h: NOT list_contains(list_transform(list_filter(met, lambda m: m.o IN ('later', 'unknown')), lambda m: m.f), h.f)),
        lambda h: {f: h.f, o: h.o, t: greatest(h.t, coalesce(list_max(list_transform(list_filter(facts, lambda x: x.f = h.f), lambda x: x.t)), ''))}),
      list_transform(list_filter(facts, lambda x: x.new AND NOT list_contains(list_transform(list_filter(met, lambda m: m.o = 'earlier'), lambda m: m.i), x.f)), lambda x: {f: x.f, o: x.o, t: x.t})),
    met, artifact_id, t
  FROM (
    SELECT step.subject_ref, event.n, held, facts, place[2] AS artifact_id, event.t, list_transform(list_concat(
        flatten(list_transform(decls, lambda d: list_transform(list_filter(held, lambda h: d.ref = step.subject_ref OR h.o = d.ref), lambda h: {i: d.r, f: h.f, t: h.t, reason: 'Explicit ' || d.said || ' declaration'}))),
        flatten(list_transform(list_filter(facts, lambda x: x.new), lambda x: list_transform(held, lambda h: {i: x.f, f: h.f, t: h.t, reason: 'Single-occupancy decision supersession'})))),
      lambda m: {i: m.i, f: m.f, o: CASE WHEN m.t = '' OR event.t = '' THEN 'unknown' WHEN event.t > m.t THEN 'later' WHEN event.t < m.t THEN 'earlier' ELSE 'simultaneous' END, reason: m.reason}) AS met
    FROM step JOIN event ON event.subject_ref = step.subject_ref AND event.n = step.n + 1)),
meeting AS MATERIALIZED (
  SELECT m.i, m.f, m.o, m.reason, artifact_id, t FROM (SELECT unnest(met) AS m, artifact_id, t FROM step)
  UNION ALL
  SELECT r, c, CASE WHEN r_at = '' OR c_at = '' THEN 'unknown' WHEN r_at > c_at THEN 'later' WHEN r_at < c_at THEN 'earlier' ELSE 'simultaneous' END, 'Explicit ' || said || ' declaration', place[2], r_at FROM ended WHERE until IS NULL OR place <= until),
supersession AS (
  SELECT CASE WHEN o = 'earlier' THEN f ELSE i END AS superseding, CASE WHEN o = 'earlier' THEN i ELSE f END AS superseded, reason || CASE WHEN o = 'earlier' THEN ' (incoming assertion pre-dates stored assertion)' ELSE '' END AS reason,
    artifact_id, t AS recorded_at, CASE WHEN o = 'unknown' THEN 'ingestion_order' ELSE 'recorded_at' END AS basis FROM meeting WHERE o <> 'simultaneous'),
conflict AS (
  SELECT least(i, f) AS fact_a, greatest(i, f) AS fact_b, 'simultaneous_incompatible_assertions' AS conflict_type, artifact_id FROM meeting WHERE o = 'simultaneous'
  UNION ALL SELECT least(p.fact_id, a.fact_id), greatest(p.fact_id, a.fact_id), 'prohibits_allows_contradiction', greatest(p.place, a.place)[2]
  FROM seen p JOIN seen a USING (subject_ref, object_ref) WHERE p.new AND a.new AND p.predicate = 'prohibits' AND a.predicate = 'allows' AND p.place <> a.place),
gone AS (SELECT DISTINCT superseded AS fact_id FROM supersession)
"""
#: CTEs art, ent, asserted, fact and ev; used after WITH.
SQL_BASE = f"""
art AS (
  SELECT {sql_id("artifact", "'order'", "CAST(o_orderkey AS VARCHAR)")} AS artifact_id,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'adr' WHEN '2' THEN 'pull_request' WHEN '3' THEN 'issue' WHEN '4' THEN 'commit' ELSE 'document' END AS type,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS recorded_at, o_orderkey AS ingest_seq, o_custkey AS custkey
  FROM orders),
ent AS (
  SELECT {sql_entity("name")} AS entity_id, name, type FROM (
    SELECT n_name AS name, 'team' AS type FROM nation UNION ALL SELECT r_name, 'team' FROM region UNION ALL SELECT {_PART}, 'component' FROM part)),
np AS (SELECT p_partkey, p_size, {_PART} AS part, n_name FROM part JOIN nation ON p_partkey % 25 = n_nationkey),
said AS (
  SELECT {sql_entity("n_name")} AS subject_ref, CASE l_returnflag WHEN 'A' THEN 'uses' WHEN 'N' THEN 'selected' ELSE 'depends_on' END AS predicate,
    {sql_entity(_PART)} AS object_ref, artifact_id, ingest_seq, art.type AS artifact_type, recorded_at, CASE WHEN l_discount > 0.05 THEN CAST(0.4 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS confidence
  FROM lineitem JOIN art ON l_orderkey = ingest_seq JOIN customer ON custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT {sql_entity("s")}, p, {sql_entity("o")}, {sql_id("artifact", "'part'", "CAST(k AS VARCHAR)")}, k * 7, 'adr', '1998-01-01', CAST(1.0 AS DOUBLE) FROM (
    SELECT a.p_partkey AS k, a.part AS s, 'replaced_by' AS p, b.part AS o FROM np a JOIN np b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size = 50
    UNION ALL SELECT p_partkey, n_name, 'prohibits', part FROM np WHERE p_size IN (1, 2)
    UNION ALL SELECT p_partkey + 1, n_name, 'allows', part FROM np WHERE p_size = 2)
  UNION ALL
  SELECT {sql_entity("n_name")}, 'same_as', {sql_entity("r_name")}, {sql_id("artifact", "'nation'", "CAST(n_nationkey AS VARCHAR)")}, n_nationkey, 'document', '', CAST(1.0 AS DOUBLE) FROM nation JOIN region ON n_regionkey = r_regionkey),
asserted AS (SELECT *, {sql_id("fact", "subject_ref", "predicate", "object_ref")} AS fact_id FROM said),
fact AS (SELECT DISTINCT fact_id, subject_ref, predicate, object_ref FROM asserted),
ev AS (
  SELECT *, CASE artifact_type WHEN 'adr' THEN 1.0::DOUBLE WHEN 'pull_request' THEN 0.8::DOUBLE WHEN 'document' THEN 0.7::DOUBLE WHEN 'issue' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS authority FROM (
    SELECT DISTINCT {sql_id("evidence", "artifact_id", "fact_id", "CASE WHEN confidence < 1 THEN '0.4' ELSE '1.0' END")} AS evidence_id, fact_id, artifact_id, artifact_type, recorded_at, confidence FROM asserted)),
sup AS (
  SELECT fact_id, round(sum(round(confidence * authority, 6)), 6) AS support, count(*) AS evidence_count, coalesce(max(nullif(recorded_at, '')), '') AS last_asserted FROM ev GROUP BY fact_id),
{SQL_RULES},
lab AS (SELECT entity_id AS ref, name AS label FROM ent)
"""


_SERVICE, _GATEWAY, _MODULE = "n_name || ' service'", "n_name || ' gateway'", "lower(p_type) || ' module'"
#: CTEs of ``texts``: rec (a record), part_of (its segments with the relation that each asserts), and what linking them asserts.
SQL_TEXTS = f"""
rec AS (
  SELECT *, {sql_id("artifact", "'adr'", "content")} AS artifact_id FROM (
    SELECT p_partkey AS k, {_PART} AS part, n_name, p_type, p_size % 2 = 0 AS hedged, strftime(DATE '2020-01-01' + p_size, '%Y-%m-%d') AS recorded_at,
      '# Record ' || p_partkey || E'\\n\\n## Decision\\nUse ' || {_PART} || ' for the ' || n_name || E' service, because it fits.\\n\\n```\\nx = 1\\n```\\n| a | b |\\n\\nReason:\\nThe ' || n_name || ' gateway depends on ' || {_PART}
      || E'.\\n\\n- The ' || lower(p_type) || ' module uses ' || {_PART} || E'.\\n- ' || n_name || ' must not use old storage.' || CASE WHEN p_size % 2 = 0 THEN E'\\n\\nThis should probably be replaced.' ELSE '' END AS content
    FROM part JOIN nation ON p_partkey % 25 = n_nationkey)),
part_of AS (
  SELECT artifact_id, k, recorded_at, p.* FROM (SELECT artifact_id, k, recorded_at, unnest(list_filter([
    {{pos: 1, type: 'decision', kind: 'decision', own: 'selected', text: 'Use ' || part || ' for the ' || n_name || ' service, because it fits.', s: {_SERVICE}, p: 'selected', o: part}},
    {{pos: 2, type: 'reason', kind: 'reason', own: 'has_reason', text: 'The ' || n_name || ' gateway depends on ' || part || '.', s: {_GATEWAY}, p: 'depends_on', o: part}},
    {{pos: 3, type: 'paragraph', kind: 'description', own: 'description', text: 'The ' || lower(p_type) || ' module uses ' || part || '.', s: {_MODULE}, p: 'uses', o: part}},
    {{pos: 4, type: 'paragraph', kind: 'description', own: 'description', text: n_name || ' must not use old storage.', s: n_name, p: 'prohibits', o: 'old storage'}},
    {{pos: 5, type: 'paragraph', kind: 'description', own: 'description', text: CASE WHEN hedged THEN 'This should probably be replaced.' END, s: NULL, p: NULL, o: NULL}}], lambda x: x.text IS NOT NULL)) AS p FROM rec)),
stmt AS (
  SELECT artifact_id, k, recorded_at, pos AS seg_ord, 0 AS stmt_pos, 'Current Change' AS subject, own AS predicate, text AS target FROM part_of
  UNION ALL SELECT artifact_id, k, recorded_at, pos, 1, s, p, o FROM part_of WHERE s IS NOT NULL),
promoted AS (
  SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY seg_ord, stmt_pos) - 1 AS stmt_ord FROM stmt),
asserted AS (
  SELECT *, {sql_id("fact", "subject_ref", "predicate", "object_ref")} AS fact_id FROM (
    SELECT artifact_id, k AS ingest_seq, recorded_at, CASE WHEN stmt_pos = 0 THEN 'artifact:' || artifact_id ELSE {sql_entity("subject")} END AS subject_ref, CASE predicate WHEN 'description' THEN 'describes' ELSE predicate END AS predicate,
      CASE WHEN stmt_pos = 0 THEN target ELSE {sql_entity("target")} END AS object_ref, subject, target, stmt_pos FROM promoted WHERE seg_ord < 5))
"""
