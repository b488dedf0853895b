import ast
import io
import json
from pathlib import Path

from pyspark.sql import functions as F

from tests.texts import OAUTH, QUEUE, artifacts
from tessarion import cli, server
from tessarion.operators import belief as B
from tessarion.operators import extraction
from tessarion.operators.memory import Memory, stats
from tessarion.operators.store import SessionStore
from tessarion.sources import files, records, sheets
from tessarion.streaming import ingest

ROOT = Path(__file__).resolve().parents[1]


def scenario(folder, rows, with_manifest=True):
    listed = []
    for k, (kind, at, text) in enumerate(rows):
        (folder / f"{k}-{kind}.md").write_text(text)
        listed.append({"file": f"{k}-{kind}.md", "type": kind, "recorded_at": at})
    if with_manifest:
        (folder / "manifest.json").write_text(json.dumps({"name": "x", "artifacts": listed}))
    return str(folder)


def test_files(spark, tmp_path):
    folder = scenario(tmp_path, OAUTH)
    rows = files.load_scenario(spark, folder).orderBy("ingest_seq").collect()
    assert [(r["type"], r["recorded_at"], r["content"]) for r in rows] == OAUTH
    (tmp_path / "manifest.json").unlink()
    loose = files.load_scenario(spark, folder).orderBy("ingest_seq").collect()
    assert [r["recorded_at"] for r in loose] == [""] * 4 and files.scan_folder(spark, folder).count() == 4
    one = files.load_artifact(spark, f"{folder}/0-adr.md").first()
    assert one["type"] == "adr" and one["artifact_id"] == rows[0]["artifact_id"]
    known = files.load_scenario(spark, folder).limit(1)
    assert files.unknown(files.scan_folder(spark, folder), known).count() in (3, 4)


def test_commit_log_and_discussions(spark):
    r, f = records.RECORD, records.FIELD
    log = f"a1{f}2024-01-02T03:04:05Z{f}me{f}Use Redis for caching.\n\nBecause.\n{r}\nb2{f}2024-01-03T00:00:00Z{f}me{f}Merge branch 'x'{r}\nc3{f}2024-01-04T00:00:00Z{f}you{f}bump x to 2{r}\n"
    rows = records.commits(spark.createDataFrame([(log,)], "log string")).collect()
    assert [(x["content"], x["recorded_at"], x["metadata"]["sha"]) for x in rows] == [("Use Redis for caching.\n\nBecause.", "2024-01-02", "a1")]
    items = spark.createDataFrame([(1, "T", "B", "2024-05-06T01:00:00Z", "2024-05-07"), (2, "Only", None, "2024-05-08", "")], "number bigint, title string, body string, created_at string, updated_at string")
    said = spark.createDataFrame([(1, "2", "x", "second"), (1, "1", "y", "first")], "number bigint, at string, login string, body string")
    got = {x["ingest_seq"]: x["content"] for x in records.discussions(items, said).collect()}
    assert got == {1: "T\n\nB\n\ny: first\n\nx: second", 2: "Only"}


def test_record_source(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"cursor": "1", "body": "a"}\n{"cursor": "2", "body": "b"}\n')
    spark.dataSource.register(records.record_source("probe", records.file_fetch(str(path)), "cursor string, body string", ["cursor", "body"]))
    assert [r["body"] for r in spark.read.format("probe").option("since", "1").load().collect()] == ["b"]


def test_sheets(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{k}",) for k in range(20)], "path string")
    picked = [r["path"] for r in sheets.sample_documents(docs, 5, 7).collect()]
    assert picked == [r["path"] for r in sheets.sample_documents(docs.repartition(3), 5, 7).collect()]
    sheets.write_sheet(spark.createDataFrame([("1",), ("2",), ("3",), ("x",)], "bucket string"), f"{tmp_path}/s")
    v = sheets.verdict(sheets.read_sheet(spark, f"{tmp_path}/s")).first()
    assert (v["total"], v["verdict"]) == (3, "PROCEED")
    assert sheets.verdict(spark.createDataFrame([("3",)], "bucket string")).first()["verdict"] == "STOP"


def test_stream_and_replay(spark, tmp_path):
    """Batches and replays come to one memory; the command line and the server answer from it."""
    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    arts = artifacts(spark, QUEUE)
    assert ingest.apply_batch(arts, whole) == 4 and ingest.apply_batch(arts, whole) == 0
    ingest.apply_batch(arts.where("ingest_seq < 2"), parts, 1)
    ingest.apply_batch(arts, parts, 2)
    a, b = Memory.load(spark, whole), Memory.load(spark, parts)
    assert stats(a).first() == stats(b).first()
    pick = lambda m: {(r[0], r[1]) for r in m.supersessions.select("superseding", "superseded").collect()}
    assert pick(a) == pick(b)
    ingest.set_cursor(spark, parts, "src", "1")
    ingest.set_cursor(spark, parts, "src", "2")
    assert [tuple(r) for r in ingest.cursors(spark, parts).collect()] == [("src", "2")]

    out = io.StringIO()
    assert cli.main(["explain", "--memory", whole, "asynchronous messaging"], out) == 0 and "uses Kafka for asynchronous messaging" in out.getvalue()
    assert cli.main(["ask", "--memory", whole, "rate limiting"], out) == 1
    assert cli.main(["check", "--memory", whole, "order service|uses|RabbitMQ"], out) == 1
    assert cli.main(["check", "--memory", whole, "order service uses RabbitMQ"], out) == 2
    tools = server.Tools(spark, whole)
    assert server.handle(tools, {"id": 1, "method": "nothing"})["error"]["code"] == server.UNKNOWN_METHOD
    assert server.handle(tools, {"id": 2, "method": "ask_project", "params": {"name": "asynchronous messaging"}})["result"]["answered"]


def test_markdown_stream(spark, tmp_path):
    inbox, folder = tmp_path / "in", f"{tmp_path}/memory"
    inbox.mkdir()
    scenario(inbox, OAUTH[:2], with_manifest=False)
    ingest.ingest_stream(ingest.markdown_stream(spark, str(inbox)), folder, f"{tmp_path}/checkpoint")
    assert ingest.applied(spark, folder).count() == 2
    ingest.ingest_stream(ingest.markdown_stream(spark, str(inbox)), folder, f"{tmp_path}/checkpoint")
    assert ingest.applied(spark, folder).count() == 2
    assert B.decisions(Memory.load(spark, folder)).count() >= 2


def test_cached_extraction(spark, tmp_path):
    asked = tmp_path / "asked"
    good = extraction.mock_provider({"Good.": '```json\n[{"subject": "A", "predicate": "uses", "object": "B"}]\n```', "Bad.": "no json"})

    def counting(prompts):
        with asked.open("a") as f:
            f.write("x" * len(prompts))
        return good(prompts)

    seg = spark.createDataFrame([("a", 0, "Good."), ("a", 1, "Bad."), ("b", 0, "Good.")], "artifact_id string, seg_ord int, text string")
    ex = extraction.CachedExtractor(spark, counting, f"{tmp_path}/cache")
    assert ex.hit_rate(seg) == 0
    rows = {(r["artifact_id"], r["seg_ord"]): (r["subject"], r["predicate"], r["target"]) for r in ex.statements(seg).collect()}
    assert rows == {("a", 0): ("A", "uses", "B"), ("b", 0): ("A", "uses", "B"), ("a", 1): ("Current Change", "description", "Bad.")}
    ex.statements(seg).collect()
    assert ex.hit_rate(seg) == 1 and len(asked.read_text()) == 2


def test_boundaries():
    """Only the pipeline's own modules import its subpackage; lower layers do not import higher ones."""
    order = ["functions", "operators", "sources", "streaming", "plans"]
    for path in (ROOT / "tessarion").rglob("*.py"):
        layer = path.relative_to(ROOT / "tessarion").parts[0]
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.ImportFrom) and node.level and layer in order:
                to = (node.module or "").split(".")[0] if node.level > 1 else layer
                assert to != "llm", path
                if to in order:
                    assert order.index(to) <= order.index(layer), (path, node.module)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["a02_support"](spark, "/root/testdata/sf0.001").where(F.col("support") <= 0).isEmpty()


def test_sources_move_their_cursors(spark, tmp_path):
    """A log whose cursor is gone is read again from the start; pages wait when they are told to; folders skip what is old."""
    r, f = records.RECORD, records.FIELD
    commit = lambda sha, at, body: f"{sha}{f}{at}T00:00:00Z{f}me{f}{body}{r}\n"
    history = [commit("a1", "2024-01-02", "Use Redis for caching."), commit("b2", "2024-01-03", "Use Kafka for messaging.")]
    asked = []

    def read(since):
        asked.append(since)
        if since == "gone":
            raise LookupError(since)
        return "".join(history if not since else history[1:])

    store = SessionStore(spark)
    log = records.CommitLog("log", read)
    run = ingest.ingest_source(spark, log, store)
    assert (run.produced, run.skipped, run.cursor) == (2, 0, "b2")
    history.append(commit("c3", "2024-01-04", "Use Valkey for caching."))
    assert ingest.ingest_source(spark, log, store).skipped == 1 and asked == ["", "b2"]
    ingest.set_cursor(spark, store, "log", "gone")
    run = ingest.ingest_source(spark, log, store)
    assert (run.produced, run.skipped) == (0, 3) and asked[2:] == ["gone", ""]
    assert [(x["subject"], x["object"], x["is_current"]) for x in B.decisions(store.load()).where("subject = 'caching'").orderBy("object").collect()] == [("caching", "Redis", False), ("caching", "Valkey", True)]


def test_pages(spark):
    waits, tries = [], []
    items = [{"number": k, "title": f"T{k}", "body": None, "created_at": "2024-01-01T0", "updated_at": f"2024-0{k}-01T0"} for k in (1, 2, 3)]

    def page(k):
        tries.append(k)
        if len(tries) == 1:
            raise records.RateLimited(7)
        return items[2 * k - 2 : 2 * k]

    def comments(number):
        if number == 2:
            raise LookupError(number)
        return [{"login": "x", "body": f"c{number}"}, {"login": None, "body": " "}]

    source = records.Discussions("issues", page, comments, per_page=2, sleep=waits.append)
    rows = source.fetch(spark, "2024-02-01").orderBy("ingest_seq").collect()
    assert [(x["content"], x["cursor"], x["recorded_at"]) for x in rows] == [("T2", "2024-02-01", "2024-01-01"), ("T3\n\nx: c3", "2024-03-01", "2024-01-01")]
    assert waits == [7] and tries == [1, 1, 2]


def test_folder_since(spark, tmp_path):
    folder = scenario(tmp_path, OAUTH, with_manifest=False)
    dates = spark.createDataFrame([("0-adr.md", "2020-01-01"), (f"{folder}/1-adr.md", "2021-01-01")], "path string, recorded_at string")
    rows = files.MarkdownFolder(folder, dates).fetch(spark, "2020-06-01").orderBy("ingest_seq").collect()
    assert [(r["source"][-8:], r["recorded_at"]) for r in rows] == [("1-adr.md", "2021-01-01"), ("quest.md", ""), ("ommit.md", "")]
    both = files.self_scan(files.scan_folder(spark, folder), records.commits(spark.createDataFrame([(f"a1{records.FIELD}2024-01-02{records.FIELD}me{records.FIELD}Use Redis for caching.{records.RECORD}",)], "log string")))
    assert [r["type"] for r in both.orderBy("ingest_seq").collect()][-1] == "commit" and both.count() == 5
