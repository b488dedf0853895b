import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.texts import OAUTH, QUEUE, artifacts
from tessarion.functions.scratch import Scratch
from tessarion.operators import apps, compiler, linker, prose, reports
from tessarion.operators import belief as B
from tessarion.operators import memory as M
from tessarion.operators.memory import Memory
from tessarion.operators.store import FolderStore, SessionStore
from tessarion.plans import catalog, text_queries  # noqa: F401  (the second registers its queries with the first)
from tessarion.plans import projections as P


@pytest.fixture(scope="module")
def corpora(spark, tmp_path_factory):
    out = {}
    for name, rows in (("oauth", OAUTH), ("queue", QUEUE)):
        arts = artifacts(spark, rows)
        linker.link(spark, arts, compiler.compile_artifacts(arts)).save(folder := str(tmp_path_factory.mktemp(name)))
        out[name] = (Memory.load(spark, folder), arts, folder)
    return out


def answer(m, name):
    spark = m.facts.sparkSession
    asked = B.ask(m, spark.createDataFrame([(name,)], "name string")).first()
    return asked, B.beliefs(m).where(F.col("class_id") == asked["class_id"])


def test_scenario(corpora):
    m, _, _ = corpora["oauth"]
    asked, belief = answer(m, "Service-to-Service Authentication")
    assert asked["outcome"] == "answered"
    decision = B.decisions_of(belief).first()
    assert (decision["object_ref_label"], decision["support"]) == ("OAuth2", 2.3)
    past = belief.where("section = 'history' AND predicate = 'selected'").collect()
    assert [(r["object_ref_label"], r["basis"]) for r in past] == [("JWT", "recorded_at")]
    assert m.conflicts.count() == 0
    types = m.evidence.where(F.col("fact_id") == decision["fact_id"]).select("artifact_type").collect()
    assert sorted(r[0] for r in types) == ["adr", "commit", "pull_request"]


def test_unanswered(corpora):
    m, _, _ = corpora["queue"]
    names = m.facts.sparkSession.createDataFrame([("rate limiting",), ("asynchronous messaging",)], "name string")
    assert {r["name"]: r["outcome"] for r in B.ask(m, names).collect()} == {"rate limiting": "unbound", "asynchronous messaging": "answered"}


def test_saving_again_adds_nothing(corpora, spark):
    m, arts, folder = corpora["oauth"]
    before = M.stats(m).first()
    linker.link(spark, arts, compiler.compile_artifacts(arts)).save(folder)
    assert M.stats(Memory.load(spark, folder)).first() == before


ROWS = "fact_id string, subject_ref string, predicate string, object_ref string, fact_type string, artifact_id string, recorded_at string, ingest_seq bigint"


def one_at_a_time(rows):
    """The rules as a store that takes one artifact after the other would apply them, by plain loops."""
    facts, dates, gone, edges, conflicts = {}, {}, set(), {}, {}
    for artifact in sorted({(r[7], r[5]) for r in rows}):
        batch = [r for r in rows if (r[7], r[5]) == artifact]
        at = batch[0][6]
        found = []
        promoted = {r[0]: r for r in batch if r[0] not in facts}
        for r in promoted.values():
            for f, (s, p, o) in facts.items():
                if f in gone:
                    continue
                if r[2] in ("replaced_by", "deprecated") and p in ("selected", "uses", "depends_on") and r[1] in (s, o):
                    found.append((r[0], f, f"Explicit {r[2]} declaration"))
                if r[2] == p == "selected" and s == r[1] and o != r[3]:
                    found.append((r[0], f, "Single-occupancy decision supersession"))
                if {r[2], p} == {"prohibits", "allows"} and (s, o) == (r[1], r[3]):
                    conflicts[min(f, r[0]), max(f, r[0]), "prohibits_allows_contradiction"] = artifact[1]
        retired = set()
        for incoming, f, reason in found:
            then = max(dates[f])
            if at and then and at == then:
                conflicts[min(f, incoming), max(f, incoming), "simultaneous_incompatible_assertions"] = artifact[1]
            elif at and then and at < then:
                edges[f, incoming] = (reason + " (incoming assertion pre-dates stored assertion)", artifact[1], at, "recorded_at")
                retired.add(incoming)
            else:
                edges[incoming, f] = (reason, artifact[1], at, "recorded_at" if at and then else "ingestion_order")
                retired.add(f)
        gone |= retired
        for r in batch:
            facts.setdefault(r[0], r[1:4])
            dates.setdefault(r[0], []).append(at)
    return edges, conflicts, gone


def corpus(seed, artifacts=60):
    """Random assertions over few names, with undated artifacts, equal dates, repeats and every rule's predicates."""
    rng = random.Random(seed)
    rows = []
    for k in range(artifacts):
        at = rng.choice(["", *(f"20{y}-01-01" for y in range(10, 16))])
        for _ in range(rng.randint(1, 4)):
            s, o = rng.sample("abcdef", 2)
            p = rng.choice(["selected", "selected", "selected", "uses", "depends_on", "replaced_by", "deprecated", "prohibits", "allows", "requires"])
            rows.append((f"{s}-{p}-{o}", s, p, o, "relationship", f"a{k:03d}", at, k // 2))
    return rows


def as_evidence(spark, rows):
    data = [(f"{r[5]}-{r[0]}", r[0], r[5], "adr", r[6], 1.0, 1.0, []) for r in {(r[5], r[0]): r for r in rows}.values()]
    return spark.createDataFrame(data, M.SCHEMAS["evidence"])


def ingest_in(spark, rows, sizes):
    """Memory after the artifacts came in batches of these sizes."""
    store = SessionStore(spark)
    order = sorted({(r[7], r[5]) for r in rows})
    at = 0
    for size in sizes:
        names = {a for _, a in order[at : at + size]}
        at += size
        batch = [r for r in rows if r[5] in names]
        frame = spark.createDataFrame(batch, ROWS)
        edges, conflicts = linker.apply_rules(spark, frame, store.load())
        store.commit({"facts": linker.promote(frame), "evidence": as_evidence(spark, batch), "supersessions": edges, "conflicts": conflicts})
    return store.load()


def edges_of(m):
    edges = {(r["superseding"], r["superseded"]): (r["reason"], r["artifact_id"], r["recorded_at"], r["basis"]) for r in m.supersessions.collect()}
    return edges, {(r["fact_a"], r["fact_b"], r["conflict_type"]): r["artifact_id"] for r in m.conflicts.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_replay_is_one_artifact_at_a_time(spark, seed):
    rows = corpus(seed)
    edges, conflicts, gone = one_at_a_time(rows)
    assert len(edges) > 20 and len(conflicts) > 3
    m = ingest_in(spark, rows, [60])
    assert edges_of(m) == (edges, conflicts)
    assert {r[0] for r in M.active_facts(m).select("fact_id").collect()} == {r[0] for r in rows} - gone


def test_batches_end_as_one(spark):
    rows = corpus(9)
    edges, conflicts, _ = one_at_a_time(rows)
    assert edges_of(ingest_in(spark, rows, [7, 33, 20])) == (edges, conflicts)


def selections(*choices):
    return [(f"cache-selected-{o}", "cache", "selected", o, "decision", f"a{k}", at, k) for k, (o, at) in enumerate(choices)]


@pytest.mark.parametrize("sizes", [[3], [2, 1]])
def test_retired_stays_retired(spark, sizes):
    """Redis, Kafka, Redis again: asserting a retired choice again does not bring it back, in however many batches."""
    m = ingest_in(spark, selections(("Redis", "2020"), ("Kafka", "2021"), ("Redis", "2022")), sizes)
    assert [r["object_ref"] for r in M.active_facts(m).collect()] == ["Kafka"]
    (edge,) = m.supersessions.collect()
    assert (edge["superseded"], edge["artifact_id"], edge["basis"]) == ("cache-selected-Redis", "a1", "recorded_at")


def test_all_orders_agree(spark):
    """Four dated artifacts come to one belief in any order."""
    facts = [("jwt", "2023"), ("oauth", "2024-05-02"), ("oauth", "2024-05-20"), ("oauth", "2024-06-03")]
    rows = []
    for n, order in enumerate(itertools.permutations(facts)):
        rows += [(f"{n}-{o}", f"s{n}", "selected", o, "decision", f"a{n}-{k}", at, k) for k, (o, at) in enumerate(order)]
    edges, _ = linker.replay(spark, spark.createDataFrame(rows, ROWS))
    assert sorted((r["superseding"], r["superseded"]) for r in edges.collect()) == sorted((f"{n}-oauth", f"{n}-jwt") for n in range(24))


def test_further_rules(spark):
    """A rule of one's own sees assertions and memory, and may return edges and conflicts."""

    def rejected(spark, rows, memory):
        no, yes = (rows.where(F.col("predicate") == p).select("subject_ref", "object_ref", "artifact_id", F.col("fact_id").alias(p)) for p in ("rejected", "selected"))
        both = no.join(yes.drop("artifact_id"), ["subject_ref", "object_ref"])
        edges = both.select(F.col("rejected").alias("superseding"), F.col("selected").alias("superseded"), F.lit("no").alias("reason"), "artifact_id", F.lit("").alias("recorded_at"), F.lit("x").alias("basis"))
        return edges, both.select(F.col("rejected").alias("fact_a"), F.col("selected").alias("fact_b"), F.lit("t").alias("conflict_type"), "artifact_id")

    rows = [*selections(("Redis", "2020")), ("n", "cache", "rejected", "Redis", "decision", "a7", "2021", 7)]
    edges, conflicts = linker.apply_rules(spark, spark.createDataFrame(rows, ROWS), None, (*linker.DEFAULT_RULES, rejected))
    assert [r["superseded"] for r in edges.collect()] == ["cache-selected-Redis"] and [tuple(r) for r in conflicts.collect()] == [("cache-selected-Redis", "n", "t", "a7")]


@pytest.mark.parametrize("seed", range(2))
def test_retired_without_edges(spark, seed):
    """What is retired is known without the edges, onto memory too."""
    rows = corpus(seed)
    gone = one_at_a_time(rows)[2]
    retired = lambda rows, m=None: {r["fact_id"] for r in linker.retired(spark, spark.createDataFrame(rows, ROWS), m).collect()}
    assert retired(rows) == gone
    late = {a for _, a in sorted({(r[7], r[5]) for r in rows})[30:]}
    before = ingest_in(spark, rows, [30])
    assert retired([r for r in rows if r[5] in late], before) | {r["superseded"] for r in before.supersessions.collect()} == gone


def test_selections_of_one_date_store_no_pairs(spark, monkeypatch, tmp_path):
    """400 records choose for one service on one date: c23_linked_texts stores rows in their number, not its square."""
    parts = spark.range(400).select((F.col("id") * 25).alias("p_partkey"), F.lit("grey bolt").alias("p_name"), F.lit("PROMO TIN").alias("p_type"), F.lit(50).alias("p_size"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    stored, sliced = [], Scratch.sliced

    def counted(self, make, n, tag):
        out = sliced(self, make, n, tag)
        stored.append((out.count(), tag))
        return out

    monkeypatch.setattr(Scratch, "sliced", counted)
    said = catalog.QUERIES["c23_linked_texts"](spark, str(tmp_path)).collect()
    assert len(said) == 800 and all(r["is_current"] for r in said)
    assert max(stored)[0] <= 10 * 400, max(stored)


def test_folder_store(spark, tmp_path):
    """A delta without its marker is not there; compaction changes no table."""
    rows = corpus(3, 20)
    store = FolderStore(spark, f"{tmp_path}/m")
    assert store.load().facts.isEmpty()
    for part in (rows[:20], rows[20:]):
        store.commit({"facts": linker.promote(spark.createDataFrame(part, ROWS)), "evidence": as_evidence(spark, part)})
    before = {n: sorted(map(str, store.table(n).collect())) for n in ("facts", "evidence")}
    assert len(before["facts"]) == len({r[0] for r in rows})
    store._write("lost", {"facts": spark.createDataFrame([("x", "s", "uses", "o", "relationship")], M.SCHEMAS["facts"])})
    store.compact()
    assert len(store.tokens()) == 1 and {n: sorted(map(str, store.table(n).collect())) for n in before} == before


def test_identity_chain_and_cycle(spark):
    ents = [(f"entity_{n}", n, "unknown", [n]) for n in ("auth", "service-to-service authentication", "s2s", "alone")]
    same = [("entity_auth", "entity_s2s"), ("entity_s2s", "entity_service-to-service authentication"), ("entity_service-to-service authentication", "entity_auth")]
    facts = [(f"f{k}", a, "same_as", b, "observation") for k, (a, b) in enumerate(same)]
    e = Memory.empty(spark)
    m = Memory(spark.createDataFrame(ents, M.SCHEMAS["entities"]), spark.createDataFrame(facts, M.SCHEMAS["facts"]), e.evidence, e.supersessions, e.conflicts)
    rows = B.identity_classes(m).orderBy("member_rank").collect()
    assert [r["label"] for r in rows] == ["service-to-service authentication", "auth", "s2s"]
    assert {r["class_size"] for r in rows} == {3} and not any(r["truncated"] for r in rows)
    assert B.identity_classes(m, bound=2).count() == 2


def test_correction(corpora):
    m, _, _ = corpora["queue"]
    fact = m.facts.where("predicate = 'depends_on'").orderBy("fact_id").first()["fact_id"]
    after, artifact = linker.retract(m, fact, "not so", "someone", "2025-02-01")
    assert M.edges_retiring(after, fact).first()["basis"] == "human_correction"
    assert after.evidence.where(F.col("artifact_id") == artifact).first()["authority"] == 1.2
    with pytest.raises(ValueError):
        linker.retract(after, fact, "again", "someone", "2025-02-02")
    with pytest.raises(KeyError):
        linker.retract(m, "fact_none", "x", "someone", "2025-02-02")


def test_compliance_and_brief(corpora):
    m, _, _ = corpora["queue"]
    proposed = m.facts.sparkSession.createDataFrame([("order service", "uses", "RabbitMQ"), ("order service", "uses", "Kafka"), ("order service", "removes", "RabbitMQ")], "subject string, predicate string, object string")
    bad, unknown = apps.check_compliance(m, proposed)
    assert [(r["subject"], r["object"], r["established_at"]) for r in bad.collect()] == [("order service", "RabbitMQ", "2025-01-15")]
    assert unknown.count() == 2
    tables = {k: v.collect() for k, v in apps.brief(m).items()}
    assert ("asynchronous messaging", "Kafka") in [(r["subject"], r["object"]) for r in tables["decisions"]]
    assert [(r["subject"], r["object"]) for r in tables["constraints"]] == [("order service", "RabbitMQ")]


def test_scores_and_pilot(corpora):
    m, _, _ = corpora["queue"]
    spark = m.facts.sparkSession
    t = "case string, subject string, predicate string, object string"
    labels = spark.createDataFrame([("q", "asynchronous messaging", "selected", "Kafka"), ("q", "RabbitMQ", "replaced_by", "Kafka"), ("q", "order consumer", "likes", "Kafka")], t)
    scores = apps.score_extraction(apps.predicted_triples(m).withColumn("case", F.lit("q")), labels, labels.where("predicate = 'likes'"))
    total = scores.where("case IS NULL").first()
    assert (total["tp"], total["fn"], total["reachable_fn"], total["reachable_recall"]) == (2, 1, 0, 1.0)
    asked = spark.createDataFrame([("asynchronous messaging", "Kafka"), ("rate limiting", None), ("nothing known", "x")], "ask string, expect string")
    done = apps.run_pilot(m, asked)
    assert {r["ask"]: r["outcome"] for r in done.collect()} == {"asynchronous messaging": "correct", "rate limiting": "correctly_declined", "nothing known": "declined"}
    s = apps.pilot_summary(done).first()
    assert (s["correct"], s["wrong"], s["declined"]) == (2, 0, 1)


def test_renames():
    r = apps.Renames({"a": "b", "b": "c", "x": "y", "y": "x"})
    assert r.canonical("a") == "c" and r.equivalents("b") == ["a", "b", "c"] and r.expand(["c", "z"]) == ["a", "b", "c", "z"]
    assert r.canonical("x") in ("x", "y")


def test_prose(corpora):
    m, _, _ = corpora["oauth"]
    ref = answer(m, "service-to-service authentication")[0]["class_id"]
    said = prose.told(m).where(F.col("class_id") == ref).first()["prose"]
    assert said.startswith("The project uses OAuth2 for service-to-service authentication. That position is corroborated by an ADR and a commit and a pull request"[:75])
    assert "This replaced an earlier position: uses JWT for service-to-service authentication, asserted by an ADR, most recently on 2023-01-11." in said
    text = prose.rendered(m).where(F.col("class_id") == ref).first()["text"]
    assert "CURRENT\n" in text and "SUPERSEDED\n" in text and "support=2.3 across 3 artifact(s)  last asserted 2024-06-03" in text


def test_timeline_dependents_health(corpora):
    m, _, _ = corpora["queue"]
    kafka = answer(m, "Kafka")[0]["class_id"]
    assert {r["label"] for r in B.dependents(m).where(F.col("class_id") == kafka).collect()} >= {"order service", "notification worker"}
    times = [r["when"] for r in B.timeline(m).where(F.col("class_id") == kafka).orderBy("place").collect()]
    assert times == sorted(times)
    h = B.health_notes(B.health(m)).first()
    assert h["total_facts"] == m.facts.count() and h["notes"]


def test_reports(corpora):
    m, _, _ = corpora["queue"]
    spark = m.facts.sparkSession
    text = reports.brief_text(apps.brief(m))
    assert "CURRENT DECISIONS\n" in text and "  order service must not use RabbitMQ" in text
    proposed = spark.createDataFrame([("order service", "uses", "RabbitMQ"), ("x", "uses", "y")], "subject string, predicate string, object string")
    said = reports.compliance_summary(2, *apps.check_compliance(m, proposed))
    assert said.startswith("checked 2 relationship(s): 1 violation(s), 1 with no applicable rule\n  VIOLATION  order service uses RabbitMQ is forbidden") and said.endswith(reports.NO_RULE)
    done = apps.run_pilot(m, spark.createDataFrame([("asynchronous messaging", "Kafka")], "ask string, expect string"))
    assert "accuracy answered   100%" in reports.pilot_text(done, apps.pilot_summary(done))


def test_pages_in_pieces(corpora, monkeypatch, spark):
    """A page is the same whether it is cut into pieces and streamed or joined as a whole; every question gets its own."""
    m, _, _ = corpora["queue"]
    names = spark.createDataFrame([("Kafka",), ("kafka",), ("Kafka",), ("RabbitMQ",), ("nothing such",)], "name string")
    found = lambda: (sorted(map(tuple, prose.rendered(m).collect())), sorted(map(tuple, prose.answers(m, names).collect())))
    whole = found()
    monkeypatch.setattr(prose, "PIECE", 64)
    monkeypatch.setattr(prose, "LARGE", 300)
    assert found() == whole
    assert [n for n, _, _ in whole[1]] == ["Kafka", "Kafka", "RabbitMQ", "kafka", "nothing such"]
    assert any(t.count("\n\n") and len(t) > 300 for _, t in whole[0])


def test_large_pages_are_compressed_as_they_go(corpora, monkeypatch, spark, tmp_path):
    """Large pages are not written by a codec that holds each of them twice more; a codec that was chosen stays."""
    m, _, _ = corpora["queue"]
    whole = sorted(map(tuple, prose.rendered(m).collect()))
    monkeypatch.setattr(prose, "LARGE", 300)
    codec = "spark.sql.parquet.compression.codec"
    try:
        for chosen, used in (("snappy", "zstd"), ("gzip", "gz")):
            spark.conf.set(codec, chosen)
            prose.rendered(m).write.parquet(out := f"{tmp_path}/{chosen}")
            assert sorted(map(tuple, spark.read.parquet(out).collect())) == whole
            assert all(p.name.endswith(f".{used}.parquet") for p in Path(out).glob("part-*"))
    finally:
        spark.conf.unset(codec)


def test_prose_in_slices(corpora, monkeypatch):
    """Prose is the same whether memory is taken at once or by slices, and whether a history is one piece or many."""
    m, _, _ = corpora["oauth"]
    found = lambda: sorted(map(tuple, prose.told(m).collect()))
    whole = found()
    monkeypatch.setattr(prose, "stored_size", lambda df: 2 * prose.SLICE)
    monkeypatch.setattr(prose, "PIECE", 64)
    monkeypatch.setattr(prose, "LARGE", 300)
    assert found() == whole and any(p.count("This replaced an earlier position") and len(p) > 300 for _, _, p in whole)


def test_star_is_stored_once(spark):
    """Facts and evidence of the star schema are two sides of one stored table, each row once."""
    sf = "/root/testdata/sf0.001"
    m, rows = P.build_star_memory(spark, sf), P.asserted(spark, sf)
    assert sorted(m.facts.inputFiles()) == sorted(m.evidence.inputFiles())
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    assert same(m.facts, P.facts_of(rows)) and same(m.evidence, P.evidence_of(rows))


def test_uses_that_no_declaration_is_about(spark, monkeypatch):
    """Only uses that a declaration names are dealt out for the rules; edges are those of all of them, in slices too."""
    rows = [("a", "uses", "x", 1), ("b", "uses", "y", 2), ("x", "replaced_by", "z", 3), ("a", "selected", "x", 4), ("a", "selected", "y", 5), ("y", "depends_on", "x", 6)]
    told = spark.createDataFrame([(f"{s}-{p}-{o}", s, p, o, f"art{n}", "adr", f"2024-01-0{n}", n) for s, p, o, n in rows], "fact_id string, subject_ref string, predicate string, object_ref string, artifact_id string, artifact_type string, recorded_at string, ingest_seq long")
    seen = linker.sightings(told, None, Scratch(spark, "t"))
    assert {r["fact_id"] for r in seen.collect()} == {"a-uses-x", "x-replaced_by-z", "a-selected-x", "a-selected-y", "y-depends_on-x"}
    edges = lambda: sorted((r["superseding"], r["superseded"]) for r in linker.replay(spark, told)[0].collect())
    assert edges() == [("a-selected-y", "a-selected-x"), ("x-replaced_by-z", "a-uses-x")]
    monkeypatch.setattr(linker, "stored_size", lambda df: 2 * linker.SLICE)
    assert edges() == [("a-selected-y", "a-selected-x"), ("x-replaced_by-z", "a-uses-x")]


def test_pages_in_slices(corpora, monkeypatch, spark):
    """Pages are the same by slices of memory, and nothing but their pieces is left on disk as large as they are."""
    m, _, _ = corpora["queue"]
    whole = sorted(map(tuple, prose.rendered(m).collect()))
    monkeypatch.setattr(prose, "stored_size", lambda df: 2 * prose.SLICE)
    scratch = Scratch(spark, "t", lean=True)
    pieces = prose.page_pieces(m, scratch)
    assert sorted(map(tuple, prose.joined_pages(pieces).collect())) == whole
    left = [p.name for p in Path(scratch.root.removeprefix("file:")).iterdir()]
    assert any(n.endswith("pieces") for n in left) and not any(n.endswith(("blocks", "walked", "conflicts")) for n in left)
