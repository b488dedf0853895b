"""Token counts as delta-maintained rollups.

A batch is a set of signed rows: +1 for an inserted document, -1 for a deleted one, both for a revised one
(its old text leaves, its new text comes).  Rows are tokenised, summed by source, language and tokenizer
version, and the sums are committed under the batch's id.  Totals are sums of committed deltas, so nothing
is counted again; a batch id that is committed already changes nothing, whatever comes with it.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.commits import Commits
from .common import WORD, Scratch
from .words import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NEWER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this kind split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEASURES = ("docs", "chars", "tokens")
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(version: str, ranks: bytes) -> tiktoken.Encoding:
    if version not in _encodings:
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}
        _encodings[version] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[version]


class TokenLedger:
    """Committed deltas in a folder of the shared store.

    ``version`` names the tokenizer in the totals; by default it is the vocabulary file's name.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str = TOKENIZER, version: str | None = None):
        self.spark, self.folder = spark, folder
        self.version = version or Path(tokenizer).stem
        self.ranks = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())  # a vocabulary file, whatever the corpus
        self.commits = Commits(spark, folder)

    def deltas(self, changes: DataFrame) -> DataFrame:
        """source, lang, tokenizer and signed docs, chars and tokens of changes (sign, text, source, lang)."""
        version, ranks = self.version, self.ranks

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoding(version, ranks.value)
            for b in slices(batches, limit=1 << 20):
                tokens = [len(t) for t in enc.encode_ordinary_batch([t or "" for t in b.column("text").to_pylist()], num_threads=1)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("sign", "source", "lang", "chars")] + [pa.array(tokens, pa.int64())], ["sign", "source", "lang", "chars", "tokens"])

        rows = changes.select(F.col("sign").cast("bigint").alias("sign"), "source", "lang", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("chars"), "text")
        rows = rows.mapInArrow(count, "sign bigint, source string, lang string, chars bigint, tokens bigint")
        sums = {"docs": F.col("sign"), "chars": F.col("sign") * F.col("chars"), "tokens": F.col("sign") * F.col("tokens")}
        return rows.groupBy("source", "lang").agg(*[F.sum(e).alias(m) for m, e in sums.items()]).withColumn("tokenizer", F.lit(version))

    def _name(self, batch_id: str) -> str:
        return quote(f"{self.version}~{batch_id}", safe="")

    def committed(self, batch_id: str) -> bool:
        return self.commits.there(self._name(batch_id))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False, and no work, if its id is committed already.

        The sums are written under a name of their own and count once the batch's marker is made, so a batch
        is there as a whole or not at all; of two writers of one batch the second finds the marker taken and
        drops its sums.
        """
        if self.committed(batch_id):
            return False
        data = uuid.uuid4().hex
        self.deltas(changes).write.parquet(f"{self.folder}/sums={data}")
        done = self.commits.mark(self._name(batch_id), {"data": data})
        if not done:
            self.commits.delete(f"{self.folder}/sums={data}")
        return done

    def _sums(self, data: list[str]) -> DataFrame:
        schema = "source string, lang string, docs bigint, chars bigint, tokens bigint, tokenizer string"
        if not data:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, sums string").parquet(self.folder)
        return rows.where(F.col("sums").isin(data)).groupBy("source", "lang", "tokenizer").agg(*[F.sum(m).alias(m) for m in MEASURES])

    def compact(self) -> None:
        """Write the sums of all batches as one; their ids stay committed."""
        old = self.commits.all()
        if len(old) < 2:
            return
        data = uuid.uuid4().hex
        self._sums([w["data"] for w in old.values()]).write.parquet(f"{self.folder}/sums={data}")
        self.commits.mark(f"compact-{data}", {"data": data, "replaces": list(old)})
        for what in old.values():
            self.commits.delete(f"{self.folder}/sums={what['data']}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, chars, tokens; groups whose documents are all gone are left out."""
        sums = self._sums([what["data"] for what in self.commits.all().values()])
        return sums.where(" OR ".join(f"{m} <> 0" for m in MEASURES))


def rollups(totals: DataFrame) -> DataFrame:
    """Totals by (tokenizer, source, lang), (tokenizer, source) and (tokenizer).

    level counts the keys in use, since a null source or lang is a group of its own.
    """
    level = (F.lit(3) - F.grouping("source") - F.grouping("lang")).alias("level")
    return totals.groupingSets([[F.col("tokenizer"), F.col("source"), F.col("lang")], [F.col("tokenizer"), F.col("source")], [F.col("tokenizer")]], "tokenizer", "source", "lang").agg(
        level, *[F.sum(m).alias(m) for m in MEASURES]
    )


def inserts(docs: DataFrame) -> DataFrame:
    return docs.select(F.lit(1).alias("sign"), "text", "source", "lang")


def deletes(docs: DataFrame) -> DataFrame:
    return docs.select(F.lit(-1).alias("sign"), "text", "source", "lang")


def revisions(docs: DataFrame, **changed: Column) -> DataFrame:
    """Both sides of documents some of whose columns become others."""
    columns = ["text", "source", "lang"]
    before, after = (F.struct(F.lit(sign).alias("sign"), *[(new.get(c, F.col(c))).alias(c) for c in columns]) for sign, new in ((-1, {}), (1, changed)))
    return docs.select(F.explode(F.array(before, after)).alias("r")).select("r.*")


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, newer: str = NEWER) -> DataFrame:
    """Rollups of ``docs`` (text, source, lang) after a life of changes, by two versions of the tokenizer.

    The first ledger takes all documents in, then revises those without a language, which are ``und`` from
    then on, then deletes those without a word; every batch is committed again, as a driver that starts anew
    would, and changes nothing.  The newer tokenizer takes in what is left.  Null texts are documents without
    tokens, until they are deleted; a null source is a group of its own; repeated rows count each; an empty
    table gives an empty result; other columns are ignored.
    """
    folder = Scratch(spark, "tokens").path("ledger")
    docs = docs.select("text", "source", "lang")
    found = F.lit("und")
    now = docs.withColumn("lang", F.coalesce("lang", found))
    blank = ~F.coalesce(F.rlike("text", F.lit(WORD)), F.lit(False))
    batches = {"load": inserts(docs), "languages": revisions(docs.where("lang IS NULL"), lang=found), "blank": deletes(now.where(blank))}
    ledger = TokenLedger(spark, folder, tokenizer)
    for batch_id, changes in batches.items():
        ledger.commit(batch_id, changes)
        ledger.commit(batch_id, changes)
    TokenLedger(spark, folder, newer).commit("load", inserts(now.where(~blank)))
    ledger.compact()
    return rollups(ledger.totals())
