"""Statements from a language model: an injected provider, and a cache table in front of it.

The provider is any function of a list of texts that returns a list of answers; none that uses a network
is built in.  Answers are parsed by Spark; texts that were answered before are never asked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str]]
PROMPT = 'List every relationship that the text asserts as a JSON array of objects with "subject", "predicate" and "object". Text:\n'
ANSWER = "array<struct<subject: string, predicate: string, object: string>>"
CACHE = "key string, answer string, model string, prompt_version string, temperature double"


def cache_key(text: Column, model: str, prompt_version: str, temperature: float) -> Column:
    """32 hex digits over everything that an answer depends on."""
    return F.substring(F.sha2(F.to_json(F.array(text, F.lit(model), F.lit(prompt_version), F.lit(str(temperature)))), 256), 1, 32)


def parse_answer(answer: Column) -> Column:
    """Statements of an answer, code fences around it or not; null if it is no JSON array."""
    bare = F.regexp_replace(F.trim(answer), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return F.from_json(bare, ANSWER)


def mock_provider(answers: dict[str, str], default: str = "[]") -> Provider:
    """Answers by text, for tests and offline use."""
    return lambda prompts: [next((a for t, a in answers.items() if p.endswith(t)), default) for p in prompts]


def ask_provider(texts: DataFrame, provider: Provider) -> DataFrame:
    """key, answer of (key, text): one call a batch of texts, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = provider([PROMPT + t for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(answers, pa.string())], ["key", "answer"])

    return texts.select("key", "text").mapInArrow(run, "key string, answer string")


class CachedExtractor:
    """Extracts statements of segments through a cache table in a folder."""

    def __init__(self, spark: SparkSession, provider: Provider, folder: str, model: str = "mock", prompt_version: str = "1", temperature: float = 0.0):
        self.spark, self.provider, self.folder = spark, provider, folder
        self.model, self.prompt_version, self.temperature = model, prompt_version, temperature

    def cache(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(CACHE).parquet(self.folder) if there else self.spark.createDataFrame([], CACHE)

    def keyed(self, segments: DataFrame) -> DataFrame:
        return segments.withColumn("key", cache_key(F.col("text"), self.model, self.prompt_version, self.temperature))

    def fill(self, segments: DataFrame) -> int:
        """Ask for the texts that the cache lacks; their number."""
        missing = self.keyed(segments).select("key", "text").dropDuplicates(["key"]).join(self.cache().select("key"), "key", "left_anti")
        before = self.cache().count()
        rows = ask_provider(missing, self.provider)
        rows.select("key", "answer", F.lit(self.model).alias("model"), F.lit(self.prompt_version).alias("prompt_version"), F.lit(float(self.temperature)).alias("temperature")).write.mode("append").parquet(self.folder)
        return self.cache().count() - before

    def statements(self, segments: DataFrame) -> DataFrame:
        """artifact_id, seg_ord, stmt_pos, subject, predicate, target; a text whose answer cannot be parsed describes its artifact."""
        self.fill(segments)
        rows = self.keyed(segments).join(self.cache().select("key", "answer").dropDuplicates(["key"]), "key")
        fallback = F.array(F.struct(F.lit("Current Change").alias("subject"), F.lit("description").alias("predicate"), F.col("text").alias("object")))
        found = F.coalesce(parse_answer(F.col("answer")), fallback.cast(ANSWER))
        rows = rows.select("artifact_id", "seg_ord", F.posexplode(found).alias("stmt_pos", "s"))
        return rows.select("artifact_id", "seg_ord", "stmt_pos", "s.subject", "s.predicate", F.col("s.object").alias("target")).where("subject IS NOT NULL AND target IS NOT NULL")

    def hit_rate(self, segments: DataFrame) -> float:
        """Share of segments that the cache answers."""
        flags = self.keyed(segments).join(self.cache().select("key").distinct().withColumn("hit", F.lit(1)), "key", "left")
        row = flags.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
        return row["hits"] / row["n"] if row["n"] else 0.0
