"""Small expressions used by several operators; written tables are the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import Scratch, shared_root

__all__ = ["WORD", "Scratch", "ascii_words", "doc_crc_mod", "read", "shared_root", "unit_draw"]

#: Words as the contracts of mixing, substring and near-dedup take them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_words(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    return F.filter(parts, lambda w: w != "")


def unit_draw(*cols: Column) -> Column:
    """A reproducible draw in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def doc_crc_mod(doc_id: Column, n: int) -> Column:
    """The fold of a document: crc32 of the decimal text of its id, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
