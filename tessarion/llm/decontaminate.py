"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item window is ``window`` consecutive item words (or the whole of a shorter item).  Seen as a set of
shingles, a window is contained in a document only if all its shingles are, so the rarest one alone is
its necessary prefix.  Shingle frequencies are counted over all documents; the documents' shingles join
the rarest shingles only; length and position bound the candidates; the words decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are a-z: ASCII but for digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
END = -1


def lower_words(text: Column) -> Column:
    """Words with A-Z, and no other letters, in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() is faster and the same where all is ASCII
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, BETWEEN, -1), lambda w: w != "")


def shingle_hash(words: Column, at: Column, n: int) -> Column:
    """Hash of ``n`` words from 0-based ``at``."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, win, len): the distinct windows of each item."""
    words = items.where("item_id IS NOT NULL").select("item_id", lower_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    first = F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))))
    wins = words.select("item_id", "words", first.alias("at")).select("item_id", F.slice("words", F.col("at") + 1, window).alias("win"))
    return wins.groupBy("win").agg(F.collect_set("item_id").alias("items")).withColumn("len", F.size("win"))


def decontaminate(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """Per document row: doc_id, text_key, n_words, n_hit, item_ids (sorted as strings).

    docs (doc_id, text), items (item_id, text).  A document word inside any occurrence of a window is
    hit.  Null or wordless documents have no words and no hits; null or wordless items have no windows;
    either table may be empty; repeated rows each give a row; rows under a null id, or under one id with
    several texts, are told apart by their text; a null item_id is no item; other columns are ignored.

    The windows are broadcast in blocks of at most ``broadcast_bytes`` (measured before), and each
    block meets all documents; only hits are shuffled, one group a distinct document.
    """
    scratch = Scratch(spark, "decontaminate")
    wins = scratch.table(item_windows(items, window), "windows")
    lens = [r["n"] for r in wins.select(F.least("len", F.lit(SHINGLE)).alias("n")).distinct().collect()]

    # 1. Document frequency of the windows' shingles, over all documents.
    k = F.least(F.col("len"), F.lit(SHINGLE))
    by_len = lambda words, at, n: F.coalesce(*[F.when(n == m, shingle_hash(words, at, m)) for m in (1, 2, 3)])
    shingles = wins.select("win", "items", "len", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
    shingles = scratch.table(shingles.withColumn("shingle", by_len(F.col("win"), F.col("off"), F.col("k"))), "shingles")
    wanted = scratch.table(shingles.select("shingle").distinct(), "wanted")
    row_bytes = 24 + 16 * SHINGLE

    def blocks(df: DataFrame, key: str, width: int) -> list[DataFrame]:
        n = max(1, math.ceil(df.count() * width / broadcast_bytes))
        return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == b) if n > 1 else df for b in range(n)]

    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), lower_words(F.col("text")).alias("words"))
    words = words.withColumn("n_words", F.size("words"))
    # the position after the last word carries END, which keeps a row of every document in the join below
    placed = words.select("*", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("pos"))
    inside = lambda m: F.when(F.col("pos") + m <= F.col("n_words"), shingle_hash(F.col("words"), F.col("pos"), m))
    keyed = [placed.withColumn("shingle", F.when(F.col("pos") == F.col("n_words"), F.lit(END)).otherwise(inside(m))) for m in lens]

    df_counts = None
    for block in blocks(wanted, "shingle", 16) if lens else []:
        for part in keyed:
            seen = part.select("shingle").join(F.broadcast(block), "shingle").groupBy("shingle").agg(F.count("*").alias("df"))
            df_counts = seen if df_counts is None else df_counts.unionByName(seen)
    rarity = scratch.table(df_counts, "rarity") if df_counts is not None else wanted.withColumn("df", F.lit(0))

    # 2. The necessary prefix of each window: its rarest shingle.  Windows with a shingle that no document has cannot occur.
    ranked = shingles.join(rarity, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = (
        ranked.groupBy("win")
        .agg(F.min(F.struct("df", "off", "shingle", "items", "len", "k")).alias("p"))
        .select("win", "p.*")
        .where("df > 0")
    )
    prefix = scratch.table(prefix, "prefix")

    # 3. Join, bound, verify, within one generated loop over the positions: a position's row exists only
    # if it joins, so the words of a document are not copied for each.  The first join also meets the END of each document.
    end = prefix.sparkSession.range(1).select(
        F.array().cast("array<string>").alias("win"), F.lit(0).cast("bigint").alias("df"), F.lit(0).alias("off"), F.lit(END).alias("shingle"),
        F.array().cast(prefix.schema["items"].dataType).alias("items"), F.lit(0).alias("len"), F.lit(0).alias("k"),
    )
    at = F.col("pos") - F.col("off")
    rows = None
    for b, block in enumerate(blocks(prefix, "win", row_bytes + 40 * window)):
        for m, part in zip(lens, keyed, strict=True):
            side = block.where(F.col("k") == m)
            side = side.unionByName(end) if rows is None else side
            found = part.join(F.broadcast(side), "shingle").where((at >= 0) & (at + F.col("len") <= F.col("n_words")))
            found = found.where((F.col("len") > 0) | (F.col("pos") == F.col("n_words")))
            found = found.where(F.slice("words", F.greatest(at + 1, F.lit(1)), F.col("len")) == F.col("win"))
            found = found.select("doc_id", "text_key", at.alias("start"), "len", "items", "n_words")
            rows = found if rows is None else rows.unionByName(found)
    if rows is None:  # no windows at all
        rows = words.select("doc_id", "text_key", F.col("n_words").alias("start"), F.lit(0).alias("len"), F.array().cast(prefix.schema["items"].dataType).alias("items"), "n_words")

    # 4. Per distinct document: the union of its hit spans, and its items.
    spans = F.array_sort(F.collect_set(F.when(F.col("len") > 0, F.struct("start", "len"))))
    merged = rows.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("len") == 0).alias("copies"), spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["start"] + x["len"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(s["end"], x["start"]))).alias("n")),
    )["n"]
    out = merged.select("doc_id", "text_key", F.col("n_words").cast("bigint"), n_hit.cast("bigint").alias("n_hit"), F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("item_ids"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def clean_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without a hit, all columns as they are, whatever their names.

    A row is known by its id and its text, so rows under a null id, or under one id with several texts,
    are each judged by their own text.  A null text has no hit and stays.
    """
    found = decontaminate(spark, docs, items, **options)
    hit = Scratch(spark, "clean").table(found.where("n_hit > 0").select("doc_id", "text_key").distinct(), "hit")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    kept = rows.join(hit, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_anti")
    return kept.select("row.*")
