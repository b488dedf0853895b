"""Content-addressed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(scope: str, *parts: Column | str) -> Column:
    """``scope_`` and 16 hex digits of the SHA-256 of ``scope:part:part…``; null parts count as empty."""
    cols = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    return F.concat(F.lit(f"{scope}_"), F.substring(F.sha2(F.concat(F.lit(f"{scope}:"), F.concat_ws(":", *cols)), 256), 1, 16))


def entity_id(name: Column) -> Column:
    """The id of a concept depends on its name alone, whatever its letter case."""
    return content_id("entity", F.lower(F.trim(name)))


def artifact_ref(artifact_id: Column) -> Column:
    return F.concat(F.lit("artifact:"), artifact_id)


def is_artifact(ref: Column) -> Column:
    return F.startswith(ref, F.lit("artifact:"))


def is_entity(ref: Column) -> Column:
    return F.startswith(ref, F.lit("entity_"))


def ref_kind(ref: Column) -> Column:
    return F.when(is_entity(ref), "entity").when(is_artifact(ref), "artifact").otherwise("literal")
