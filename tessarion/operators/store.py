"""Stored memory: committed deltas in a folder that driver and executors share, or frames in a session.

A delta is written table by table under a token of its own and becomes part of memory by one marker file,
written last; readers take marked deltas only.  A crash before the marker leaves nothing behind that any
reader sees, and doing the batch again commits it as a whole.  There is one writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import fields
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.commits import Commits
from .memory import KEYS, SCHEMAS, Memory

LEDGER = "artifact_id string, recorded_at string, batch bigint"
CURSORS = "source string, cursor string, seq bigint"
TABLES = {**SCHEMAS, "applied": LEDGER, "cursors": CURSORS}
ALL_KEYS = {**KEYS, "applied": ["artifact_id"], "cursors": ["source", "seq"]}


class MemoryStore(Protocol):
    """What ingestion asks of a store."""

    spark: SparkSession

    def load(self) -> Memory: ...

    def table(self, name: str) -> DataFrame: ...

    def commit(self, delta: dict[str, DataFrame]) -> None: ...


def missing(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows, one a key, whose key ``stored`` lacks.  The stored table is scanned for the rows' keys, not shuffled with them."""
    rows = rows.dropDuplicates(key)
    known = stored.select(*key).join(rows.select(*key), key, "left_semi")
    return rows.join(known, key, "left_anti")


def as_tables(memory: Memory) -> dict[str, DataFrame]:
    return {f.name: getattr(memory, f.name) for f in fields(memory)}


class FolderStore:
    """Memory in a folder of Parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.commits = spark, folder, Commits(spark, folder)

    def tokens(self) -> list[str]:
        """The committed deltas: as many as batches since the last compaction."""
        return list(self.commits.all())

    def table(self, name: str) -> DataFrame:
        tokens = self.tokens()
        if not tokens:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(f"{TABLES[name]}, delta string").parquet(f"{self.folder}/{name}")
        return rows.where(F.col("delta").isin(tokens)).drop("delta")  # whole folders are pruned

    def load(self) -> Memory:
        return Memory(**{name: self.table(name) for name in SCHEMAS})

    def _write(self, token: str, delta: dict[str, DataFrame]) -> None:
        for name, schema in TABLES.items():
            rows = self.spark.createDataFrame([], schema)
            if name in delta:
                rows = rows.unionByName(delta[name].select(*rows.columns))
            rows.write.parquet(f"{self.folder}/{name}/delta={token}")

    def commit(self, delta: dict[str, DataFrame]) -> None:
        """Add the rows of each table whose keys memory lacks; all of them, or none."""
        token = uuid.uuid4().hex
        self._write(token, {name: missing(rows, self.table(name), ALL_KEYS[name]) for name, rows in delta.items()})
        self.commits.mark(token, {"rows": "delta"})

    def compact(self) -> None:
        """Rewrite all deltas as one, which takes their place by its marker; then remove them."""
        old = self.tokens()
        if len(old) < 2:
            return
        token = uuid.uuid4().hex
        self._write(token, {name: self.table(name) for name in TABLES})
        self.commits.mark(token, {"replaces": old})
        for name in TABLES:
            for gone in old:
                self.commits.delete(f"{self.folder}/{name}/delta={gone}")


class SessionStore:
    """Memory as frames of the session: for tests and small jobs, gone with the session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def load(self) -> Memory:
        return Memory(**{name: self.tables[name] for name in SCHEMAS})

    def commit(self, delta: dict[str, DataFrame]) -> None:
        new = {}
        for name, rows in delta.items():
            rows = self.tables[name].limit(0).unionByName(rows.select(*self.tables[name].columns))
            found = missing(rows, self.tables[name], ALL_KEYS[name]).select(*rows.columns).collect()
            new[name] = self.tables[name].unionByName(self.spark.createDataFrame(found, TABLES[name]))
        self.tables.update(new)
