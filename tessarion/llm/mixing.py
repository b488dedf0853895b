"""Mixing sources to target weights, with DataFrame functions only.

Every source is one token stream: its documents in order of id, packed into blocks of ``block`` words.
Output shards draw their slots' sources by multinomial draws; the drawn totals are settled to the
targets; each source's slots run through a pseudorandom permutation of its block indices, one
permutation an epoch; slots and blocks then join by index.

Prefix sums over a source go through chunks of documents (never one window over a whole source), so a
source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, Scratch, unit_draw

ROUNDS = 24  # of the swap-or-not permutation
CHUNK = 512  # documents whose prefix sums one window computes, about


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Place of index ``x`` under a pseudorandom permutation of [0, n): swap-or-not, any n, no cycle walking.

    Each round is its own inverse, so the rounds in reverse order undo the permutation.
    """
    order = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def one_round(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        swap = F.pmod(F.xxhash64(key, r, F.greatest(at, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(order, x.cast("bigint"), one_round)


def prefix_sums(totals: DataFrame, group: str, at: str, total: str, wide: int, name: str) -> DataFrame:
    """(group, at, name): the sum of ``total`` over all smaller ``at`` of the group.

    By bands of ``wide`` neighbours: sums within each band and over the bands before it are windows of a
    square root of the rows, joined by band.
    """
    banded = totals.withColumn("band", F.floor(F.col(at) / wide))
    before = lambda keys, order, of: F.sum(of).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(of)
    bands = banded.groupBy(group, "band").agg(F.sum(total).alias("band_total"))
    bands = bands.select(group, "band", before([group], "band", "band_total").alias("band_from"))
    inner = banded.withColumn("inner", before([group, "band"], at, total))
    return inner.join(bands, [group, "band"]).select(group, at, (F.col("band_from") + F.col("inner")).cast("bigint").alias(name))


def first_above(sorted_: Column, field: str, x: Column, n: int) -> Column:
    """The first struct of a sorted array whose ``field`` is above ``x``, by binary search; null if none is. ``n`` bounds the array."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        small = (s["lo"] < s["hi"]) & (F.get(sorted_, middle)[field] <= x)
        return F.struct(F.when(small, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(small, s["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.size(sorted_).alias("hi")), halve)
    return F.get(sorted_, found["lo"])


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> + sid, weight, target.

    Water filling: a source is full when cap*size/weight is below the common level; the sources in
    order of that ratio let the level be read off running sums, which is what resharing again and
    again converges to.  The table has a row per source, so its windows are small.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_fill = W.orderBy("fill", "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    t = (
        sizes.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("want", F.sum("source_size").over(everything) * F.lit(float(share)))
        # were all sources before this one full and this one not, the level would be:
        .withColumn("full_before", F.coalesce(F.sum("most").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("want") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("open", F.col("level") <= F.col("fill"))
        # the first source that is not full fixes the level for all
        .withColumn("final", F.min(F.when(F.col("open"), F.struct("fill", "sid", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("most"), F.col("weight") * F.col("final"))
    return t.select("source", "source_size", "sid", "weight", F.coalesce(target, F.col("most")).alias("target"))


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 1024,
    slots_per_shard: int = 4096,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of ``docs`` (doc_id, text, source).

    Returns (documents, slots).  documents: a row per input row with doc_id, size, source, source_size,
    target and taken, the words of it that the mix takes.  slots: the mix itself, (shard, slot, source,
    block, words): slot by slot, the block of the source's stream and how many of its words are taken.

    Null texts and texts without words have size 0 and taken 0; a null source is a source of its own,
    after all others; an empty table gives empty results; repeated rows are separate documents (equal
    rows are interchangeable); other columns are ignored.  The words taken of a source are its target
    rounded down, and a document is taken at most ``ceil(cap)`` times over.
    """
    scratch = Scratch(spark, "mix")
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("text").alias("tie"),
    )
    sized = scratch.table(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per_source = scratch.table(per_source, "per-source")
    sources = source_targets(per_source.drop("n"), weights, share, cap)
    n_blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    sources = scratch.table(sources.withColumn("n_blocks", n_blocks), "sources")

    # 1. Streams: the start of every document in its source, through chunk totals.
    n_docs = sized.count()
    wide = max(1, math.ceil(math.sqrt(n_docs / CHUNK)))
    keyed = (
        sized.join(sources.select("source", "sid"), sized["source"].eqNullSafe(sources["source"]))
        .select("doc_id", "size", "tie", "sid", F.pmod(F.xxhash64("doc_id"), F.lit(wide * wide)).alias("chunk"))
    )
    in_chunk = W.partitionBy("sid", "chunk").orderBy("doc_id", "size", "tie")
    ranked = keyed.withColumn("nth", F.row_number().over(in_chunk)).withColumn("inner", F.sum("size").over(in_chunk.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    totals = keyed.groupBy("sid", "chunk").agg(F.sum("size").alias("total"))
    offsets = prefix_sums(totals, "sid", "chunk", "total", wide, "chunk_from")
    offsets = scratch.table(offsets, "offsets")
    placed = ranked.join(offsets, ["sid", "chunk"]).withColumn("start", F.col("chunk_from") + F.col("inner"))
    placed = scratch.table(placed.select("doc_id", "size", "sid", "chunk", "nth", "start"), "placed")

    # 2. Slots.  A source takes whole epochs of its blocks and then a part of one more; only its last
    # block is short, so the number of slots that reach the target has a closed form.
    taken = F.floor("target").cast("bigint")
    size, nb = F.col("source_size"), F.col("n_blocks")
    plan = (
        sources.where("n_blocks > 0")
        .withColumn("epochs", F.floor(taken / size).cast("bigint"))
        .withColumn("rest", taken - F.col("epochs") * size)
        .withColumn("short", nb * block - size)
        .withColumn("short_at", permuted(nb - 1, nb, F.xxhash64(F.lit(seed), F.col("sid"), F.col("epochs")), inverse=True))
    )
    rest = F.col("rest")
    full_slots = F.ceil(rest / block).cast("bigint")
    late = rest > F.col("short_at") * block  # the partial epoch reaches the short block
    plan = (
        plan.withColumn("rest_slots", F.when(late, F.ceil((rest + F.col("short")) / block).cast("bigint")).otherwise(full_slots))
        .withColumn("slots", F.col("epochs") * nb + F.col("rest_slots"))
        .withColumn("cut", F.when(F.col("rest_slots") > 0, F.col("rest_slots") * block - F.when(late, F.col("short")).otherwise(0) - rest).otherwise(0))
        .withColumn("upto", F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("all_slots", F.sum("slots").over(W.partitionBy()))
        .withColumn("from_slot", F.col("upto") - F.col("slots"))
    )
    plan = scratch.table(plan.select("sid", "source", "n_blocks", "source_size", "slots", "cut", "from_slot", "upto", "all_slots"), "plan")

    # 3. Multinomial draws: each slot of a shard takes a source with probability slots/all_slots, so the
    # counts of a shard are multinomial.  A source's slots are numbered through the shards.
    total = plan.agg(F.max("all_slots").alias("n")).first()["n"] or 0
    n_shards = max(1, math.ceil(total / slots_per_shard))
    shards = spark.range(n_shards).select(
        F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.least(F.lit(slots_per_shard), F.lit(total) - F.col("id") * slots_per_shard) - 1)).alias("slot")
    ) if total else spark.range(0).select(F.col("id").alias("shard"), F.col("id").alias("slot"))
    edges = plan.agg(F.sort_array(F.collect_list(F.struct("upto", "sid"))).alias("edges"))
    ticket = F.floor(unit_draw(F.lit(seed), F.col("shard"), F.col("slot")) * F.lit(float(total)))
    n_sources = plan.count()
    drawn = shards.withColumn("ticket", ticket).withColumn("edges", edges.scalar())
    drawn = drawn.select("shard", "slot", first_above(F.col("edges"), "upto", F.col("ticket"), n_sources)["sid"].alias("sid"))
    drawn = scratch.table(drawn, "drawn")
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("c"))
    counts = scratch.table(counts, "counts")
    numbered = prefix_sums(counts, "sid", "shard", "c", max(1, math.ceil(math.sqrt(n_shards))), "shard_from")
    in_shard = W.partitionBy("shard", "sid").orderBy("slot")
    slots = drawn.withColumn("nth", F.row_number().over(in_shard) - 1).join(numbered, ["shard", "sid"]).withColumn("i", F.col("shard_from") + F.col("nth"))

    # 4. Settle: slots beyond a source's number go, in order, to the sources that are short of theirs.
    drawn_totals = counts.groupBy("sid").agg(F.sum("c").alias("drawn"))
    gaps = (
        plan.select("sid", "slots")
        .join(drawn_totals, "sid", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("over", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)))
        .withColumn("under", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)))
        .withColumn("over_from", F.sum("over").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)) - F.col("over"))
        .withColumn("under_from", F.sum("under").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)) - F.col("under"))
    )
    gaps = scratch.table(gaps, "gaps")
    short = gaps.where("under > 0").withColumn("under_upto", F.col("under_from") + F.col("under"))
    wanting = short.agg(F.sort_array(F.collect_list(F.struct("under_upto", "under_from", "sid", "drawn"))).alias("wanting"))
    slots = slots.join(gaps.select("sid", "slots", "over_from"), "sid").withColumn("wanting", wanting.scalar())
    excess = F.col("over_from") + F.col("i") - F.col("slots")
    giver = first_above(F.col("wanting"), "under_upto", excess, n_sources)
    slots = slots.withColumn("to", F.when(F.col("i") >= F.col("slots"), giver)).select(
        "shard",
        "slot",
        F.coalesce(F.col("to.sid"), F.col("sid")).alias("sid"),
        F.coalesce(F.col("to.drawn") + excess - F.col("to.under_from"), F.col("i")).alias("i"),
    )

    # 5. Indices to blocks, epoch by epoch, and the words of each slot.
    slots = slots.join(plan.select("sid", "source", "n_blocks", "source_size", "slots", "cut"), "sid")
    epoch = F.floor(F.col("i") / nb)
    slots = slots.withColumn("block", permuted(F.col("i") % nb, nb, F.xxhash64(F.lit(seed), F.col("sid"), epoch)))
    length = F.least(F.lit(block).cast("bigint"), F.col("source_size") - F.col("block") * block)
    slots = slots.withColumn("words", length - F.when(F.col("i") == F.col("slots") - 1, F.col("cut")).otherwise(0))
    slots = scratch.table(slots.select("shard", "slot", "sid", "source", "block", "words"), "slots")

    # 6. Blocks back to documents: join by index.
    uses = slots.groupBy("sid", "block").agg(F.collect_list("words").alias("uses"))
    start, end = F.col("start"), F.col("start") + F.col("size")
    pieces = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(start / block), F.floor((end - 1) / block))).otherwise(F.array(F.lit(-1).cast("bigint")))))
    piece_from = F.greatest(start, F.col("block") * block)
    overlap = lambda used: F.greatest(F.lit(0).cast("bigint"), F.least(end, F.col("block") * block + used) - piece_from)
    pieces = pieces.join(uses, ["sid", "block"], "left").withColumn("taken", F.coalesce(F.aggregate("uses", F.lit(0).cast("bigint"), lambda s, u: s + overlap(u)), F.lit(0)))
    per_doc = pieces.groupBy("sid", "chunk", "nth", "doc_id", "size").agg(F.sum("taken").alias("taken"))
    documents = per_doc.join(sources.select("sid", "source", "source_size", "target"), "sid")
    return documents.select("doc_id", "size", "source", "source_size", "target", "taken"), slots.drop("sid")
