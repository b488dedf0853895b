"""What a source of artifacts is."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class ArtifactSource(Protocol):
    """A place that artifacts come from.

    ``source_id`` names its cursor and must stay the same from run to run.  ``fetch`` returns artifacts
    beyond a cursor ('' for all): artifact_id, type, source, content, recorded_at, ingest_seq (the
    oldest first) and cursor, the position that each stands for.
    """

    @property
    def source_id(self) -> str: ...

    def fetch(self, spark: SparkSession, since: str = "") -> DataFrame: ...
