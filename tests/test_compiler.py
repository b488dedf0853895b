import pytest

from tests.texts import artifacts
from tessarion.operators import compiler

GOLDEN = {
    "adr": (
        "# ADR 001: Move JWT Validation to Gateway\n\n## Status\nAccepted\n\n## Context\nEvery service currently duplicates authentication logic.\n\n## Decision\nMove JWT validation into the API Gateway.\n\n## Consequences\nGateway complexity increases.\n",
        [("Current Change", "describes", "Accepted"), ("Current Change", "has_reason", "Every service currently duplicates authentication logic."), ("Current Change", "selected", "Move JWT validation into the API Gateway."), ("API Gateway", "contains", "JWT validation"), ("Current Change", "has_tradeoff", "Gateway complexity increases.")],
        {"API Gateway", "JWT validation", "authentication"},
        5,
    ),
    "commit": (
        "Add retry logic to payments client\n\nPayments provider intermittently returns 5xx errors.\n\nThis adds exponential backoff with 3 retries.\n",
        [("Current Change", "description", "Add retry logic to payments client"), ("Current Change", "description", "Payments provider intermittently returns 5xx errors."), ("Current Change", "description", "This adds exponential backoff with 3 retries.")],
        set(),
        3,
    ),
    "pr": (
        "# Pull Request\n\nMove JWT validation into the API Gateway.\n\nReason:\nEvery service currently duplicates authentication logic.\n\nTrade-off:\nGateway complexity increases.\n",
        [("Current Change", "description", "Move JWT validation into the API Gateway."), ("API Gateway", "contains", "JWT validation"), ("Current Change", "has_reason", "Every service currently duplicates authentication logic."), ("Current Change", "has_tradeoff", "Gateway complexity increases.")],
        {"API Gateway", "JWT validation", "authentication"},
        4,
    ),
    "hedged": ("# Pull Request\n\nThis should improve performance.\n", [("Current Change", "description", "This should improve performance.")], set(), 0),
}


@pytest.fixture(scope="module")
def compiled(spark):
    names = list(GOLDEN)
    arts = artifacts(spark, [("adr" if n == "adr" else "pull_request", "", GOLDEN[n][0]) for n in names])
    ids = {r["ingest_seq"]: r["artifact_id"] for r in arts.collect()}
    return compiler.compile_artifacts(arts), {n: ids[k] for k, n in enumerate(names)}


@pytest.mark.parametrize("name", list(GOLDEN))
def test_golden(compiled, name):
    c, ids = compiled
    _, stmts, names, n_facts = GOLDEN[name]
    own = f"artifact_id = '{ids[name]}'"
    got = [(r["subject"], r["predicate"], r["target"]) for r in c.statements.where(own).orderBy("seg_ord", "stmt_pos").collect()]
    assert got == stmts
    assert {r["name"] for r in c.entities.where(own).collect()} == names
    facts = c.facts.where(own).orderBy("fact_ord").collect()
    assert [f["fact_ord"] for f in facts] == list(range(n_facts))


def matches(spark, text):
    seg = spark.createDataFrame([("a", 0, text)], "artifact_id string, seg_ord int, text string")
    return {(r["subject"], r["predicate"], r["object"]) for r in compiler.relational_matches(seg).collect()}


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Use Redis for session storage.", {("session storage", "selected", "Redis")}),
        ("We replaced RabbitMQ with Kafka.", {("RabbitMQ", "replaced_by", "Kafka")}),
        ("Kafka now replaces RabbitMQ.", {("RabbitMQ", "replaced_by", "Kafka")}),
        ("The web tier depends on PostgreSQL.", {("web tier", "depends_on", "PostgreSQL")}),
        ("The linker never calls the parser.", {("linker", "prohibits", "parser")}),
        ("The web tier is also known as the frontend service.", {("web tier", "same_as", "frontend service")}),
        ("The order service uses Kafka, and the notification worker uses Kafka.", {("order service", "uses", "Kafka"), ("notification worker", "uses", "Kafka")}),
        ("We prefer Kafka over RabbitMQ.", {("Kafka", "rejected", "RabbitMQ")}),
        ("It uses everything.", set()),
        ("The storefront depends on Café Über.", {("storefront", "depends_on", "Café Über")}),
    ],
)
def test_patterns(spark, text, wanted):
    assert matches(spark, text) >= wanted
    if not wanted:
        assert matches(spark, text) == set()


def test_markdown(spark):
    content = "Intro line\n- one\n  more\n* two\n\n```\ncode uses nothing\n```\n| a | b |\n\nReason:\n\nBecause.\n\n## Decision\nUse X.\n\n~~~\nopen fence"
    obs = compiler.with_sections(compiler.observe(spark.createDataFrame([("a", content)], "artifact_id string, content string"))).orderBy("obs_ord").collect()
    assert [(o["type"], o["text"]) for o in obs] == [("paragraph", "Intro line"), ("paragraph", "one more"), ("paragraph", "two"), ("reason", "Reason:\nBecause."), ("decision", "Use X.")]
    assert obs[-1]["section_header"] == "Decision"


def test_label_chain(spark):
    """A chunk that was taken along is not looked at again; a last label stays alone."""
    obs = compiler.observe(spark.createDataFrame([("a", "A:\n\nB:\n\nC:\n\nD"), ("b", "Reason:"), ("c", None)], "artifact_id string, content string"))
    got = {k: [r["text"] for r in obs.where(f"artifact_id = '{k}'").orderBy("obs_ord").collect()] for k in "abc"}
    assert got == {"a": ["A:\nB:", "C:\nD"], "b": ["Reason:"], "c": []}


def test_json_and_order(compiled, spark):
    c, ids = compiled
    first = {r["artifact_id"]: r["ir"] for r in c.to_json().collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = {r["artifact_id"]: r["ir"] for r in c.to_json().collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again and len(first) == len(ids)
    assert c.by_id("facts", ids["adr"], 3).first()["predicate"] == "contains"
    assert c.by_id("claims", ids["adr"], 3).first()["predicate"] == "contains"
    with pytest.raises(KeyError):
        c.by_id("nothing", "x", 0)


def test_work_is_dealt_out_and_done_once(spark):
    """Artifacts of one file are read by several tasks; no filter works out again what it only asks about."""
    from pyspark.sql import functions as F

    arts = spark.range(200).select(F.col("id").cast("string").alias("artifact_id"), F.concat(F.lit("The order service uses Kafka "), "id", F.lit(".")).alias("content")).coalesce(1)
    obs = compiler.observe(arts)
    assert obs.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    segs = compiler.segment(obs)
    for rows in (obs, compiler.relational_matches(segs), compiler.vocabulary_entities(segs)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter" in line and ("regexp_extract_all" in line or "content#" in line)]
    assert compiler.relational_matches(segs).count() == 200


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Use Redis\u2003for session storage.", {("session storage", "selected", "Redis")}),
        ("The caf\u00e9 gateway U\u017fES the session store.", {("caf\u00e9 gateway", "uses", "session store")}),
        ("Use of old things, the cart service\tuses PostgreSQL.", {("cart service", "uses", "PostgreSQL")}),
    ],
)
def test_cheap_looks_lose_no_match(spark, text, wanted):
    assert wanted <= matches(spark, text)


def test_grouping_by_artifact_shuffles_once(spark):
    arts = artifacts(spark, [("adr", "", GOLDEN["adr"][0])])
    found = compiler.compile_artifacts(arts)
    plan = found.claims._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # segments and matches: whatever is grouped by artifact stays there


def test_arrays_are_worked_out_before_the_explode(spark):
    seg = spark.createDataFrame([("a", 0, "Use Redis for sessions.")], "artifact_id string, seg_ord int, text string")
    plan = compiler.clause_rows(seg)._jdf.queryExecution().optimizedPlan().toString()
    assert all("posexplode(each_array" in line for line in plan.splitlines() if "Generate " in line)
