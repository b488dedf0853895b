"""Artifacts from records of other systems: version-control logs and issue trackers.

The parsing is DataFrame expressions over raw records; ``RecordSource`` is a Python data source that
reads increments through an injected fetch function, with the record's key as offset.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.ids import content_id

# Separators of a log's records and fields, and beginnings of commits that assert nothing.
RECORD, FIELD = "\x1e", "\x1f"
NOISE = ("merge branch", "merge pull request", "merge remote", "bump ", "chore(deps)", 'revert "', "wip", "fixup!", "squash!")


def is_noise(body: F.Column) -> F.Column:
    first = F.lower(F.split(F.trim(body), "\n", 2)[0])
    return F.exists(F.array(*[F.lit(n) for n in NOISE]), lambda p: F.startswith(first, p))


def commits(log: DataFrame, column: str = "log") -> DataFrame:
    """Artifacts of log texts of ``sha FIELD date FIELD author FIELD body RECORD``; noise is left out."""
    rows = log.select(F.posexplode(F.split(column, RECORD, -1)).alias("ingest_seq", "record")).where(F.trim(F.regexp_replace("record", r"\s+", " ")) != "")
    parts = F.split(F.regexp_replace("record", r"^\s+", ""), FIELD, 4)
    rows = rows.select("ingest_seq", parts[0].alias("sha"), F.substring(parts[1], 1, 10).alias("recorded_at"), parts[2].alias("author"), F.regexp_replace(parts[3], r"^\s+|\s+$", "").alias("content"))
    rows = rows.where((F.col("content") != "") & ~is_noise(F.col("content")))
    return rows.select(content_id("artifact", F.lit("commit"), F.col("sha")).alias("artifact_id"), F.lit("commit").alias("type"), "content", "recorded_at", F.col("ingest_seq").cast("bigint").alias("ingest_seq"), F.create_map(F.lit("sha"), "sha", F.lit("author"), "author").alias("metadata"))


def discussions(items: DataFrame, comments: DataFrame, kind: str = "issue") -> DataFrame:
    """Artifacts of items (number, title, body, created_at, updated_at) and comments (number, at, login, body):
    title, body and comments, parted by blank lines."""
    said = comments.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", F.concat(F.coalesce("login", F.lit("")), F.lit(": "), F.coalesce("body", F.lit(""))).alias("text")))).alias("said"))
    rows = items.join(said, "number", "left")
    texts = F.concat(F.array("title", "body"), F.coalesce(F.transform("said", lambda x: x["text"]), F.array().cast("array<string>")))
    content = F.array_join(F.filter(texts, lambda t: t.isNotNull() & (F.trim(t) != "")), "\n\n")
    rows = rows.withColumn("type", F.lit(kind)).withColumn("content", content).withColumn("recorded_at", F.substring("created_at", 1, 10))
    return rows.select(content_id("artifact", "type", "content").alias("artifact_id"), "type", "content", "recorded_at", F.col("number").cast("bigint").alias("ingest_seq"), "updated_at")


class RateLimited(Exception):
    """Raised by a transport: ``wait`` seconds until it may be asked again, if it says so."""

    def __init__(self, wait: float | None = None):
        super().__init__("rate limited")
        self.wait = wait


def patiently(call: Callable[[], list[dict]], attempts: int = 4, longest: float = 60, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Call a transport, waiting as long as it asks, or longer each time, when it is rate limited."""
    for k in range(attempts - 1):
        try:
            return call()
        except RateLimited as e:
            sleep(min(longest, max(1, e.wait) if e.wait is not None else 2**k))
    return call()


@dataclass
class CommitLog:
    """A version-control log as a source.

    ``read(since)`` returns the log text after a commit, all of it for '', and raises LookupError for a commit
    that it does not know: then everything is read, and what is known already is skipped by its id.
    """

    source_id: str
    read: Callable[[str], str]

    def fetch(self, spark: SparkSession, since: str = "") -> DataFrame:
        try:
            text = self.read(since)
        except LookupError:
            text = self.read("")
        rows = commits(spark.createDataFrame([(text,)], "log string"))
        return rows.withColumn("cursor", F.col("metadata")["sha"])


@dataclass
class Discussions:
    """Pull requests or issues of a tracker as a source, read page by page in order of their last update.

    ``page(k)`` returns the k-th page (from 1) of items (number, title, body, created_at, updated_at),
    ``comments(number)`` those of one item (at, login, body); both may raise RateLimited, and a thread that
    cannot be read (LookupError) does not lose its item.
    """

    source_id: str
    page: Callable[[int], list[dict]]
    comments: Callable[[int], list[dict]] = lambda number: []
    kind: str = "issue"
    per_page: int = 50
    sleep: Callable[[float], None] = time.sleep

    def fetch(self, spark: SparkSession, since: str = "") -> DataFrame:
        items, said, k = [], [], 0
        while True:
            k += 1
            batch = patiently(lambda at=k: self.page(at), sleep=self.sleep)
            for x in batch:
                updated = (x.get("updated_at") or "")[:10]
                if since and updated and updated < since:
                    continue
                items.append((x["number"], x.get("title"), x.get("body"), x.get("created_at") or updated, updated))
                try:
                    found = patiently(lambda n=x["number"]: self.comments(n), sleep=self.sleep)
                except LookupError:
                    found = []
                said += [(x["number"], f"{j:08d}", c.get("login") or "someone", c["body"]) for j, c in enumerate(found) if (c.get("body") or "").strip()]
            if len(batch) < self.per_page:
                break
        rows = spark.createDataFrame(items, "number bigint, title string, body string, created_at string, updated_at string")
        out = discussions(rows, spark.createDataFrame(said, "number bigint, at string, login string, body string"), self.kind).where("content <> ''")
        return out.withColumn("ingest_seq", F.struct("updated_at", "ingest_seq")).withColumn("cursor", F.col("updated_at")).drop("updated_at")


class _Increments(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Callable[[str], list[dict]], fields: list[str]):
        self.fetch, self.fields = fetch, fields

    def initialOffset(self) -> dict:
        return {"since": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self.fetch(start["since"])
        end = max([start["since"], *(r["cursor"] for r in rows)])
        return iter([tuple(r.get(f) for f in self.fields) for r in rows]), {"since": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = [r for r in self.fetch(start["since"]) if r["cursor"] <= end["since"]]
        return iter([tuple(r.get(f) for f in self.fields) for r in rows])


class _Whole(DataSourceReader):
    def __init__(self, fetch: Callable[[str], list[dict]], fields: list[str], since: str):
        self.fetch, self.fields, self.since = fetch, fields, since

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter([tuple(r.get(f) for f in self.fields) for r in self.fetch(self.since)])


def record_source(name: str, fetch: Callable[[str], list[dict]], schema: str, fields: list[str]) -> type[DataSource]:
    """A data source class to register with ``spark.dataSource.register``.

    ``fetch(since)`` returns records after a cursor, each with ``cursor`` and the fields of ``schema``.
    Batch reads take the option ``since``; streams keep the cursor in their checkpoint.
    """

    class RecordSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _Whole(fetch, fields, self.options.get("since", ""))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Increments(fetch, fields)

    return RecordSource


def file_fetch(path: str) -> Callable[[str], list[dict]]:
    """A fetch over a file of JSON lines with a ``cursor`` each, for tests and replays."""

    def fetch(since: str) -> list[dict]:
        with open(path, encoding="utf-8") as f:
            rows = [json.loads(line) for line in f if line.strip()]
        return [r for r in rows if r["cursor"] > since]

    return fetch
