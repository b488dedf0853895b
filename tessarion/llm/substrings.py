"""Substring dedup by suffix automata of reference passages.

A window is ``WINDOW`` consecutive words.  A word goes if a window over it also starts in a document with
a smaller id.  Streaming every document through automata of the whole corpus would cost documents times
shards, so automata are built of what can repeat only:

1. Every window elects its least k-gram of words (winnowing).  Equal windows elect equal k-grams, so the
   stretch of windows that elect one k-gram (a segment, at most 2 * WINDOW - k words) meets everything it
   shares with other documents under that k-gram, its anchor.
2. Anchors in one document only are done with.  A segment whose words are those of a segment in a smaller
   document goes as a whole.
3. What is left are different segments under one anchor.  They are the reference shards: in order of
   document id each streams through a suffix automaton of the ones before, and where the matching
   statistic reaches the threshold the maximal span goes; then it joins the automaton.
4. An anchor with more than ``AUTOMATON`` different segments is too common for one automaton: its segments
   elect again, by longer grams (``GRAMS``), and 2 to 4 are done with the parts.  A gram of a whole window
   has one segment only, so this ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .words import buffers, mix, runs, slices, word_hashes

WINDOW = 50
GRAMS = (8, 24, WINDOW)
AUTOMATON = 2048  # different segments of one automaton at most
PER_SHARD = 16384  # segments that one task's automata hold, about


def electors(hashes: np.ndarray, off: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Segments of all documents: document, first word (from the document's), words, anchor, content hash."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n_words = np.diff(off)
    if not (n_words >= WINDOW).any():
        return none
    n = len(hashes)
    at = np.arange(n - gram + 1)
    grams = runs(hashes, at, np.full(len(at), gram))
    # order by hash; among equal grams of a window the last one: position counts down in the low bits
    low = np.uint64((1 << 24) - 1)
    here = (at % (1 << 24)).astype(np.uint64)
    best = (mix(grams, 5) & ~low) | (low - here)
    wide, span = 1, WINDOW - gram + 1
    while wide * 2 <= span:
        best = np.minimum(best[:-wide], best[wide:])
        wide *= 2
    if span > wide:
        best = np.minimum(best[: len(best) - (span - wide)], best[span - wide :])
    # windows that lie within one document
    starts = np.concatenate([np.arange(a, a + m - WINDOW + 1) for a, m in zip(off[:-1], n_words, strict=True) if m >= WINDOW])
    doc = np.repeat(np.arange(len(n_words)), np.maximum(n_words - WINDOW + 1, 0))
    chosen = best[starts]
    place = (low - (chosen & low)).astype(np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin, length = starts[first], starts[last] - starts[first] + WINDOW
    # the anchor's own place, from the low bits
    base = begin - begin % (1 << 24)
    anchor = base + place[first]
    anchor = np.where(anchor < begin, anchor + (1 << 24), anchor)
    return doc[first], begin - off[doc[first]], length, mix(grams[anchor], 9), runs(mix(hashes, 13), begin, length)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, text -> doc_id, text_key, start, len, anchor, content."""
    for b in slices(batches):
        doc, start, length, anchor, content = electors(*word_hashes(*buffers(b.column("text"))))
        if len(doc):
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(rows), b.column("text_key").take(rows), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                ["doc_id", "text_key", "start", "len", "anchor", "content"],
            )


def segment_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, wanted (start, len, anchor, content) -> anchor, content, first, words as hashes."""
    for b in slices(batches):
        hashes, off = word_hashes(*buffers(b.column("text")))
        wanted = b.column("wanted")
        out = []
        for k, (doc_id, ws) in enumerate(zip(b.column("doc_id").to_pylist(), wanted.to_pylist(), strict=True)):
            for w in ws:
                a = off[k] + w["start"]
                out.append((w["anchor"], w["content"], doc_id, hashes[a : a + w["len"]].view(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.list_(pa.int64()))],
                ["anchor", "content", "first", "words"],
            )


def elect_again(gram: int):
    """A function for mapInArrow: passages with their words -> the parts that elect one gram each, as passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("words")
            hashes = words.flatten().to_numpy().view(np.uint64)
            off = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))).astype(np.int64)
            doc, start, length, anchor, content = electors(hashes, off, gram)
            if len(doc):
                rows = pa.array(doc)
                base = b.column("base").to_numpy()[doc] + start
                at = np.repeat(off[doc] + start - (np.cumsum(length) - length), length) + np.arange(length.sum())
                parts = pa.ListArray.from_arrays(np.append(0, np.cumsum(length)).astype(np.int32), hashes.view(np.int64)[at])
                kept = [b.column(c).take(rows) for c in ("top_anchor", "top_content", "first")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(base, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), parts], ["top_anchor", "top_content", "first", "base", "anchor", "content", "words"])

    return run


PASSAGES = "top_anchor bigint, top_content bigint, first bigint, base int, anchor bigint, content bigint, words array<bigint>"


class Automaton:
    """Suffix automaton over word hashes, extended text by text."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words: list[int]) -> None:
        """Insert a text; every substring of it is a path from the root afterwards."""
        nxt, link, length, last = self.next, self.link, self.length, 0
        for w in words:
            known = nxt[last].get(w)
            if known is not None:  # a path of earlier texts
                last = known if length[last] + 1 == length[known] else self._split(last, w, known)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and w not in nxt[at]:
                nxt[at][w] = new
                at = link[at]
            if at >= 0:
                to = nxt[at][w]
                link[new] = to if length[at] + 1 == length[to] else self._split(at, w, to)
            last = new

    def _split(self, at: int, w: int, to: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[to]))
        link.append(link[to])
        length.append(length[at] + 1)
        link[to] = copy
        while at >= 0 and nxt[at].get(w) == to:
            nxt[at][w] = copy
            at = link[at]
        return copy

    def statistics(self, words: list[int]) -> list[int]:
        """For each word, the length of the longest text ending with it that the automaton knows."""
        nxt, link, length = self.next, self.link, self.length
        at, n, out = 0, 0, []
        for w in words:
            while at and w not in nxt[at]:
                at = link[at]
                n = length[at]
            to = nxt[at].get(w)
            if to is not None:
                at, n = to, n + 1
            out.append(n)
        return out


def known_spans(words: list[int], automaton: Automaton, least: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans (start, length) covered by matches of at least ``least`` words."""
    spans: list[tuple[int, int]] = []
    for end, n in enumerate(automaton.statistics(words), 1):
        if n >= least:
            start = end - n
            if spans and start <= spans[-1][0] + spans[-1][1]:
                start = min(start, spans[-1][0])
                spans[-1] = (start, end - start)
            else:
                spans.append((start, end - start))
    return spans


def match_shard(t):
    """One shard: for each anchor, segments in order of document id against those of smaller ids."""
    t = t.sort_by([("anchor", "ascending"), ("first", "ascending")])
    anchors, firsts = t.column("anchor").to_pylist(), t.column("first").to_pylist()
    contents, words = t.column("content").to_pylist(), t.column("words").to_pylist()
    out: list[tuple[int, int, int, int]] = []
    automaton, waiting = Automaton(), []
    for k, anchor in enumerate(anchors):
        if k and anchor != anchors[k - 1]:
            automaton, waiting = Automaton(), []
        elif k and firsts[k] != firsts[k - 1]:
            for j in waiting:
                automaton.add(words[j])
            waiting = []
        out += [(anchor, contents[k], s, n) for s, n in known_spans(words[k], automaton)]
        waiting.append(k)
    a, c, s, n = zip(*out, strict=True) if out else ((),) * 4
    return pa.table({"anchor": pa.array(a, pa.int64()), "content": pa.array(c, pa.int64()), "from": pa.array(s, pa.int32()), "n": pa.array(n, pa.int32())})


def decide(passages: DataFrame, scratch: Scratch, repeated: bool) -> tuple[DataFrame, DataFrame]:
    """(spans, passages that are too common) of passages under anchors.

    ``repeated``: some have the same words.  Of these the one with the smallest document stays to be matched,
    and the others go as a whole.  Spans are of the first passages' words: top_anchor, top_content, from, n.
    """
    versions = passages.select("anchor", "content", "first", "words")
    if repeated:
        versions = versions.groupBy("anchor", "content").agg(F.min_by("words", "first").alias("words"), F.min("first").alias("first"))
    sizes = versions.groupBy("anchor").agg(F.count("*").alias("n"))
    versions = scratch.table(versions.join(sizes, "anchor"), "passages")
    total = versions.count()
    shards = max(1, total // PER_SHARD, scratch.spark.sparkContext.defaultParallelism * 4)
    few = versions.where((F.col("n") > 1) & (F.col("n") <= AUTOMATON)).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    spans = scratch.table(few.groupBy("shard").applyInArrow(match_shard, "anchor bigint, content bigint, from int, n int"), "spans")
    key = ["anchor", "content"]
    at = (F.col("base") + F.col("from")).alias("from")
    if not repeated:
        found = passages.select("top_anchor", "top_content", "base", *key).join(spans, key).select("top_anchor", "top_content", at, "n")
        return found, passages.join(sizes.where(F.col("n") > AUTOMATON).select("anchor"), "anchor", "left_semi")
    least = versions.select(*key, F.col("first").alias("least"), (F.col("n") > AUTOMATON).alias("common"))
    placed = passages.join(least, key)
    whole = placed.where("first > least").select("top_anchor", "top_content", F.col("base").alias("from"), F.size("words").alias("n"))
    matched = placed.where("first = least").select("top_anchor", "top_content", "base", *key).join(spans, key).select("top_anchor", "top_content", at, "n")
    return whole.unionByName(matched), placed.where("first = least AND common").select(*passages.columns)


def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words, n_removed and the kept words joined by single spaces to doc_id, text_key, text, spans."""
    for b in slices(batches):
        texts, spans = b.column("text"), b.column("spans")
        kept, total, gone = [], [], []
        for k in range(b.num_rows):
            words = (texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b"").split()
            total.append(len(words))
            if spans[k].is_valid and len(spans[k]):
                keep = np.ones(len(words), bool)
                s = spans[k].values
                for a, n in zip(pc.struct_field(s, 0).to_pylist(), pc.struct_field(s, 1).to_pylist(), strict=True):
                    keep[a : a + n] = False
                words = [w for w, stay in zip(words, keep, strict=True) if stay]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in b.schema.names if c not in ("text", "spans")] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            [c for c in b.schema.names if c not in ("text", "spans")] + ["n_words", "n_removed", "kept_text"],
        )


def dedup_substrings(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, others (a struct of all other columns but text, so that no name clashes),
    n_words, n_removed and kept_text, the words that stay joined by single spaces.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none and stays empty; texts of fewer than
    ``WINDOW`` words lose nothing; windows of one document, or of rows with the same id, do not remove each
    other; a null id is before and after none, so its rows lose nothing and take nothing from others; an
    empty table gives an empty result.
    """
    scratch = Scratch(spark, "substrings")
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    seg = scratch.table(keyed.select("doc_id", "text_key", "text").mapInArrow(segments, "doc_id bigint, text_key bigint, start int, len int, anchor bigint, content bigint"), "segments")
    shared = seg.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), (F.min("content") != F.max("content")).alias("differ"))
    shared = scratch.table(shared.where("least < most").select("anchor", "differ"), "anchors")
    repeated = scratch.table(seg.join(shared, "anchor"), "repeated")
    scratch.drop(seg)

    # different segments and the first document of each
    versions = repeated.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "text_key", "start", "len")).alias("f"), F.first("differ").alias("differ"))
    versions = scratch.table(versions.select("anchor", "content", "f.*", "differ"), "versions")
    later = repeated.join(versions.select("anchor", "content", F.col("doc_id").alias("first")), ["anchor", "content"]).where("doc_id > first").select("doc_id", "text_key", "start", "len")

    # automata of the segments that differ under one anchor
    wanted = versions.where("differ").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "len", "anchor", "content")).alias("wanted"))
    passages = keyed.select("doc_id", "text_key", "text").join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    passages = passages.select("doc_id", "text", "wanted").mapInArrow(segment_words, "anchor bigint, content bigint, first bigint, words array<bigint>")
    passages = passages.select(F.col("anchor").alias("top_anchor"), F.col("content").alias("top_content"), "first", F.lit(0).alias("base"), "anchor", "content", "words")
    spans = None
    for k, gram in enumerate((*GRAMS[1:], None)):
        passages = scratch.table(passages, "wanted")
        found, common = decide(passages, scratch, repeated=k > 0)
        spans = found if spans is None else spans.unionByName(found)
        if gram is None or common.isEmpty():
            break
        passages = common.mapInArrow(elect_again(gram), PASSAGES)
    spans = scratch.table(spans.select(F.col("top_anchor").alias("anchor"), F.col("top_content").alias("content"), "from", "n"), "spans")

    firsts = versions.select("anchor", "content", "doc_id")
    partly = (
        repeated.join(firsts, ["anchor", "content", "doc_id"])
        .join(spans, ["anchor", "content"])
        .select("doc_id", "text_key", (F.col("start") + F.col("from")).alias("start"), F.col("n").alias("len"))
    )
    cuts = scratch.table(later.unionByName(partly), "cuts")
    scratch.drop(repeated)
    per_doc = cuts.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("others"))
    joined = rows.join(per_doc, ["doc_id", "text_key"], "left").select("doc_id", "text", "others", "spans")
    kind = joined.schema["others"].dataType.simpleString() if others else "struct<none:int>"
    return joined.mapInArrow(remove_spans, f"doc_id bigint, others {kind}, n_words bigint, n_removed bigint, kept_text string")
