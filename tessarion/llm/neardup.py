"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by
weighted Jaccard similarity, closed by distributed connected components.

Weights: a shingle that a document holds tf times weighs (1 + ln tf) * idf with
idf = 1 + IDF_SHARE * ln((1 + N) / (1 + df)) / ln(1 + N).  Document frequencies are counted exactly,
by 32-bit shingle hash, over all documents: slices of documents send their hashes to ranges of the hash
space and get back the frequencies of those in more than one document, so nothing is broadcast; the
share is small because the shingles of a passage with thousands of copies are common *because* of the
copies, and a full idf would hide exactly those groups.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .words import buffers, mix, runs, slices, word_hashes

SHINGLE = 5
IDF_SHARE = 0.25
SLICE = 1 << 21  # bytes of text of a slice of documents
SLICES = 8  # slices whose shingles one range of hashes holds about
CHUNK = 1 << 12  # of 64 bits: what one row of a partial filter holds
ROWS, BANDS = 3, 10
PART = 1024  # members of a part of a bucket; a task looks at two parts
BLOCK = 512  # members of one side of a block of similarities
DENSE = 32  # members of a block that hold a shingle, from which on it is a column of a matrix
ROUNDING = 1e-9  # sums in another order differ by less


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 32-bit shingle hashes with repeats, the document of each, and the offsets of documents.

    A text of one to four words has one shingle, all its words; a text without words has none.
    """
    hashes, off = word_hashes(*buffers(texts))
    n = np.diff(off)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + off[doc]
    h = runs(hashes, at, np.minimum(SHINGLE, n[doc])) if len(at) else np.zeros(0, np.uint64)
    packed = np.sort((doc.astype(np.uint64) << np.uint64(32)) | (mix(h, 3) >> np.uint64(32)))
    return packed.astype(np.uint32), (packed >> np.uint64(32)).astype(np.int64), np.append(0, np.cumsum(count))


def distinct_runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their counts, of sorted input."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return h[first], doc[first], np.diff(np.append(first, len(h)))


def cut_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, text -> number of a slice, drawn at random, doc_id, key, sorted shingle hashes with repeats; only of texts that have words."""
    for b in slices(batches, limit=SLICE):
        number = int.from_bytes(os.urandom(8)) >> 1
        h, _, off = shingle_sets(b.column("text"))
        some = np.flatnonzero(np.diff(off))
        rows = b.select(["doc_id", "key"]).take(pa.array(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), *rows.columns, pa.array([h[off[k] : off[k + 1]].tobytes() for k in some], pa.binary())], ["slice", "doc_id", "key", "shingles"])


def joined(blobs: pa.Array | pa.ChunkedArray, dtype: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The values of all blobs and the offsets between the blobs."""
    data = [x.as_buffer() for x in blobs]
    return np.frombuffer(b"".join(data), dtype), np.append(0, np.cumsum([x.size // 4 for x in data])).astype(np.int64)


def packed_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their differences, low bytes first, which compress."""
    return np.diff(h, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_hashes(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def slice_shingles(ranges: int):
    """A function for mapInArrow: slice, shingles -> range, slice, its shingles in the range, how many documents of it hold each."""
    bounds = np.ceil(np.arange(ranges + 1) * (2.0**32 / ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            number = whole.column("slice").to_numpy()
            ends = np.append(np.flatnonzero(number[1:] != number[:-1]) + 1, len(number)) if len(number) else number
            for at, to in zip(np.append(0, ends[:-1]), ends, strict=True) if len(ends) else ():
                h, off = joined(whole.column("shingles").slice(at, to - at))
                h, n = np.unique(distinct_runs(h, np.repeat(np.arange(to - at), np.diff(off)))[0], return_counts=True)
                n = n.astype(np.uint32)
                cuts = np.searchsorted(h, bounds)
                some = np.flatnonzero(np.diff(cuts))
                hashes = pa.array([packed_hashes(h[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())
                counts = pa.array([n[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), number[at])), hashes, counts], ["range", "slice", "h", "n"])

    return run


def range_frequencies(t: pa.Table) -> pa.Table:
    """Of a range: slice, its shingles that more than one document holds, their document frequencies."""
    n, off = joined(t.column("n"))
    h = np.concatenate([unpacked_hashes(x.as_buffer()) for x in t.column("h")])
    _, place = np.unique(h, return_inverse=True)
    df = np.bincount(place, weights=n)[place].astype(np.uint32)
    parts = [(h[a:b][df[a:b] > 1], df[a:b][df[a:b] > 1]) for a, b in zip(off[:-1], off[1:], strict=True)]
    out = pa.table({"slice": t.column("slice"), "h": pa.array([packed_hashes(x) for x, _ in parts], pa.binary()), "df": pa.array([x.tobytes() for _, x in parts], pa.binary())})
    return out.filter(pa.array([len(x) > 0 for x, _ in parts]))


def frequencies(sliced: DataFrame) -> DataFrame:
    """slice, h, df: the shingles of a slice that more than one document holds, with their document frequencies."""
    ranges = -(-sliced.select("slice").distinct().count() // SLICES)
    parts = sliced.select("slice", "shingles").mapInArrow(slice_shingles(max(1, ranges)), "range int, slice bigint, h binary, n binary")
    return parts.groupBy("range").applyInArrow(range_frequencies, "slice bigint, h binary, df binary")


class Idf:
    """idf of shingles, from the frequencies of those that more than one document holds."""

    def __init__(self, h: list[bytes], df: list[bytes], n: int):
        self.h, first = np.unique(np.concatenate([unpacked_hashes(x) for x in h] or [np.zeros(0, np.uint32)]), return_index=True)
        self.df, self.n = np.frombuffer(b"".join(df), np.uint32)[first].astype(np.int64), n

    def __call__(self, h: np.ndarray) -> np.ndarray:
        df = np.ones(len(h), np.int64)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            df = np.where(self.h[at] == h, self.df[at], 1)
        return (1 + IDF_SHARE * np.log((1 + self.n) / (1 + df)) / np.log(2 + self.n)).astype(np.float32)


def with_slices(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.table(docs.select("doc_id", "key", "text").mapInArrow(cut_slices, "slice bigint, doc_id bigint, key binary, shingles binary"), "slices")


def idf_table(docs: DataFrame, scratch: Scratch) -> tuple[Idf, int]:
    """The idf of all shingles of a small table, which is gathered for brute force, and the number of documents."""
    sliced = with_slices(docs.select(F.lit(0).cast("bigint").alias("doc_id"), F.unhex(F.lit("")).alias("key"), "text"), scratch)
    rows, n = frequencies(sliced).collect(), docs.count()
    return Idf([r["h"] for r in rows], [r["df"] for r in rows], n), n


def log_weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.log((1 + np.log(tf)).astype(np.float32) * idf)


class Sampler:
    """Improved consistent weighted sampling.

    For sample k, element x with weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash;
    t = floor(ln w / r + b); a = ln c - r * (t - b + 1).  The element with the least a is the sample,
    together with its t: two sets agree in it with the probability of their weighted Jaccard similarity.
    The draws come from tables of 4096 quantiles, indexed by hash bits.
    """

    def __init__(self, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        gamma = lambda: rng.permutation(np.sort(rng.gamma(2.0, 1.0, 4096))).astype(np.float32)
        self.r, self.c = gamma(), np.log(gamma())
        self.b = ((rng.permutation(4096) + 0.5) / 4096).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.seeds = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)

    def __call__(self, h: np.ndarray, lnw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (documents x k, uint32) of the runs of elements that begin at starts."""
        out = np.empty((len(starts), len(self.seeds)), np.uint32)
        base = mix(h.astype(np.uint64), 23)
        for k, s in enumerate(self.seeds):
            z = base * s
            z ^= z >> np.uint64(29)
            i = (z >> np.uint64(52)).astype(np.intp)
            beta = self.b[((z >> np.uint64(28)) & np.uint64(4095)).astype(np.intp)]
            t = np.floor(lnw * self.inverse[i] + beta)
            a = self.c[((z >> np.uint64(40)) & np.uint64(4095)).astype(np.intp)] - self.r[i] * (t - beta + 1)
            bits = a.view(np.uint32)  # order of floats as order of unsigned integers
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
            token = (z >> np.uint64(8)).astype(np.uint32) ^ (t.astype(np.int32).astype(np.uint32) * np.uint32(0x9E3779B1))
            packed = (bits.astype(np.uint64) << np.uint64(32)) | token
            out[:, k] = np.minimum.reduceat(packed, starts).astype(np.uint32)
        return out


def sketches(n: int):
    """A function for a cogroup of a slice's sets and frequencies: doc_id, key, hashes of the bands, idf of each shingle as bytes."""
    sampler = Sampler(ROWS * BANDS)

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        repeats, off = joined(t.column("shingles"))
        h, doc, tf = distinct_runs(repeats, np.repeat(np.arange(t.num_rows), np.diff(off)))
        idf = Idf(known.column("h").to_pylist(), known.column("df").to_pylist(), n)(h)
        s = sampler(h, log_weights(tf, idf), np.flatnonzero(np.append(True, doc[1:] != doc[:-1])))
        bands = mix(np.arange(BANDS, dtype=np.uint64)[None, :], 31)  # a bucket's hash holds its band
        for k in range(ROWS):
            bands = mix(bands ^ s[:, k::ROWS].astype(np.uint64), 37 + k)
        lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.ravel().view(np.int64))
        each = np.repeat(idf, tf)
        return pa.table([t.column("doc_id"), t.column("key"), lists, pa.array([each[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["doc_id", "key", "bands", "idf"])

    return run


def common_weight(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Weight that each document of ``rows`` has in common with each of ``cols``; elements are sorted by item.

    Items that many of these documents hold are columns of a matrix product, the others go pair by pair.
    """
    place = np.full((2, n), -1)
    place[0, rows], place[1, cols] = np.arange(len(rows)), np.arange(len(cols))
    left, right = np.flatnonzero(place[0, doc] >= 0), np.flatnonzero(place[1, doc] >= 0)
    m = int(item[-1]) + 1
    nl, nr = np.bincount(item[left], minlength=m), np.bincount(item[right], minlength=m)
    out = np.zeros((len(rows), len(cols)))
    many = np.flatnonzero((nl > 0) & (nr > 0) & (nl + nr > DENSE))
    for at in range(0, len(many), 4096):
        column = np.full(m, -1)
        column[many[at : at + 4096]] = np.arange(len(many[at : at + 4096]))
        sides = []
        for k, part in enumerate((left, right)):
            part = part[column[item[part]] >= 0]
            x = np.zeros((len((rows, cols)[k]), min(4096, len(many) - at)))
            x[place[k, doc[part]], column[item[part]]] = 1 if k == 0 else weight[part]
            sides.append(x)
        out += sides[0] @ sides[1].T
    left = left[(nr[item[left]] > 0) & (nl[item[left]] + nr[item[left]] <= DENSE)]
    first = np.cumsum(nr) - nr  # of an item's elements among ``right``
    times = nr[item[left]]
    done = np.append(0, np.cumsum(times))
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(done, done[at] + (1 << 20), side="right")) - 1)
        part, t = left[at:to], times[at:to]
        other = right[np.repeat(first[item[part]] - (done[at:to] - done[at]), t) + np.arange(t.sum())]
        out += np.bincount(np.repeat(place[0, doc[part]], t) * len(cols) + place[1, doc[other]], weights=weight[other], minlength=out.size).reshape(out.shape)
        at = to
    return out


def verified_links(threshold: float):
    """A function for applyInArrow: the links within one pair of parts of a bucket, summed up by text.

    All pairs are compared by weighted Jaccard similarity, exactly: (1 + ln tf) * idf is cut into the
    gains of each repeat, and the sum of least weights is the weight of the elements (shingle, repeat)
    in common.  A pair counts in the first band in which its samples agree.  Returned rows: a text, how
    many texts it is linked with here, and one text for all of its linked neighbourhood within the
    parts, which is an edge enough for components.
    """

    def run(key, t):
        band, _, i, j = (k.as_py() for k in key)
        side = t.column("part").to_numpy()
        keys, n = t.column("key"), t.num_rows
        bands = t.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[:, :band]
        h, off = joined(t.column("shingles"))
        doc = np.repeat(np.arange(n), np.diff(off))
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        start = np.flatnonzero(new)
        repeat = np.arange(len(h)) - start[np.cumsum(new) - 1] + 1
        weight = joined(t.column("idf"), np.float32)[0].astype(np.float64)
        more = repeat > 1
        weight[more] *= np.log(repeat[more] / (repeat[more] - 1))
        total = np.bincount(doc, weights=weight, minlength=n)
        packed = (h.astype(np.uint64) << np.uint64(32)) | repeat.astype(np.uint64)
        order = np.argsort(packed, kind="stable")
        packed, doc, weight = packed[order], doc[order], weight[order]
        item = np.cumsum(np.append(False, packed[1:] != packed[:-1]))
        rows, cols = np.flatnonzero(side == i), np.flatnonzero(side == j)
        count, low, pairs = np.zeros(n, np.int64), np.arange(n), []
        for at in range(0, len(rows), BLOCK):
            r = rows[at : at + BLOCK]
            for to in range(at if i == j else 0, len(cols), BLOCK):
                c = cols[to : to + BLOCK]
                common = common_weight(doc, item, weight, r, c, n)
                a, b = np.nonzero(common >= (threshold - ROUNDING) * (total[r][:, None] + total[c][None, :] - common))
                a, b = r[a], c[b]
                keep = (a < b) if i == j and at == to else np.ones(len(a), bool)
                keep &= ~(bands[a] == bands[b]).any(axis=1)
                a, b = a[keep], b[keep]
                count += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
                if len(a):
                    pairs.append((a, b))
        if pairs:  # least place that each text reaches within the parts
            a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
            while True:
                least = low.copy()
                np.minimum.at(least, a, low[b])
                np.minimum.at(least, b, low[a])
                least = least[least]
                if (least == low).all():
                    break
                low = least
        got = np.flatnonzero(count)
        return pa.table({"key": keys.take(pa.array(got)), "links": pa.array(count[got]), "low": keys.take(pa.array(low[got]))})

    return run


FILTER_BITS = 1 << 26  # of the Bloom filter at most, whatever the corpus


def filter_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(ids.view(np.uint64), k) & np.uint64(bits - 1)).astype(np.int64) for k in (41, 43, 47)]


def ids_of(b: pa.RecordBatch) -> np.ndarray:
    """The first half of each key (16 bytes) as a number."""
    return np.frombuffer(b"".join(b.column("key").to_pylist()), np.int64)[::2]


def fill_filter(bits: int):
    """A function for mapInArrow: the chunks of a task's Bloom filter of keys that are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(bits, bool)
        for b in batches:
            for places in filter_places(ids_of(b), bits):
                mask[places] = True
        packed = np.packbits(mask)
        size = 8 * CHUNK
        for k in range(0, len(packed), size):
            if packed[k : k + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([packed[k : k + size].tobytes()], pa.binary())], ["chunk", "bits"])

    return run


def join_filters(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitwise or of the parts of one chunk."""
    total, chunk = None, 0
    for b in parts:
        for x in b.column("bits"):
            one = np.frombuffer(x.as_buffer(), np.uint8)
            total = one.copy() if total is None else total | one
        chunk = b.column("chunk")[0].as_py()
    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "bits"])


def bloom_filter(ids: DataFrame, scratch: Scratch) -> np.ndarray:
    """A bit (as bool) for each place of the ids; what is not in it is surely not among them."""
    n = max(1, ids.count())
    bits = max(8 * 8 * CHUNK, min(FILTER_BITS, 1 << (16 * n).bit_length()))
    parts = ids.mapInArrow(fill_filter(bits), "chunk int, bits binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("chunk", "salt").applyInArrow(join_filters, "chunk int, bits binary")
    whole = scratch.table(some.groupBy("chunk").applyInArrow(join_filters, "chunk int, bits binary"), "filter")
    packed = np.zeros(bits // 8, np.uint8)
    for r in whole.collect():  # FILTER_BITS / 8 bytes at most
        part = np.frombuffer(r["bits"], np.uint8)
        packed[r["chunk"] * 8 * CHUNK : r["chunk"] * 8 * CHUNK + len(part)] = part
    return packed


def chosen_rows(batches: Iterator[pa.RecordBatch], packed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose key the filter lets pass."""
    bits = len(packed) * 8
    for b in batches:
        ids = ids_of(b)
        there = np.ones(len(ids), bool)
        for places in filter_places(ids, bits):
            there &= (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
        yield b.filter(pa.array(there))


def weighted_jaccard(x: bytes, y: bytes, idf: Idf) -> float:
    """Sum of least weights over sum of greatest weights."""
    a, na = np.unique(np.frombuffer(x, np.uint32), return_counts=True)
    b, nb = np.unique(np.frombuffer(y, np.uint32), return_counts=True)
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    weight = lambda h, tf: (1 + np.log(tf)) * idf(h)
    least = weight(both, np.minimum(na[ia], nb[ib])).sum()
    return float(least / (weight(a, na).sum() + weight(b, nb).sum() - least))


def near_dup_classes(spark: SparkSession, docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """Per document row: doc_id, key (hash of its text), class_id, n_copies, n_links, kept.

    docs (doc_id, text); shingles of five words ``[^\\x20\\x09-\\x0D]+``.  class_id is the least doc_id
    of the documents reachable by links of weighted Jaccard similarity >= ``threshold``; n_copies counts
    rows with equal text, n_links the other texts with a verified link to this one.  Exact copies are one
    text from the start.  Texts that are null or without words link with nothing.  Repeated rows are
    copies, all kept if one is.  Kept is the text with the least doc_id of its class (null after all others),
    or the one with the least key among these.  An empty table gives an empty result; other
    columns are ignored.

    All pairs of a bucket (a band of samples) are verified on the shingles, in blocks inside the task; what
    leaves it are a row for each linked text and no pairs.  A bucket is split into parts of about ``PART``
    members, and every pair of parts is its own task.
    """
    scratch = Scratch(spark, "neardup")
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("key", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))
    sliced = with_slices(keyed, scratch)
    known = frequencies(sliced)
    rows = sliced.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(sketches(docs.count()), "doc_id bigint, key binary, bands array<bigint>, idf binary")
    rows = scratch.table(rows, "sketches")
    # one row a distinct text.  Joins of tables that grow with the corpus are merge joins at every size.
    one = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
    one = scratch.table(one.select("key", "copies", "doc_id", "bands"), "distinct")
    banded = one.select("key", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = scratch.table(buckets.select("band", "bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "buckets")
    members = banded.join(buckets.hint("merge"), ["band", "bucket"])
    part = F.pmod(F.xxhash64("key", "bucket"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = scratch.table(members.select("band", "bucket", "key", part.alias("part"), other.alias("other")), "members")

    # the sets of the texts in buckets only: a filter of bounded size stands for their keys
    chosen = spark.sparkContext.broadcast(bloom_filter(members.select("key").distinct(), scratch))
    pick = lambda t, schema: t.mapInArrow(lambda it: chosen_rows(it, chosen.value), schema).dropDuplicates(["key"])
    sets = pick(sliced.select("key", "shingles"), "key binary, shingles binary")
    sets = scratch.table(sets.join(pick(rows.select("key", "bands", "idf"), "key binary, bands array<bigint>, idf binary").hint("merge"), "key"), "sets")
    scratch.drop(sliced, rows)
    sides = members.join(sets.hint("merge"), "key").withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")
    links = sides.groupBy("band", "bucket", "i", "j").applyInArrow(verified_links(threshold), "key binary, links bigint, low binary")
    links = scratch.table(links, "links")
    scratch.drop(sets, members)
    classes = connected_components(links, scratch, "key", "low").withColumnRenamed("id", "key")
    degree = links.groupBy("key").agg(F.sum("links").alias("links"))
    texts = one.select("key", "doc_id", "copies").join(classes, "key", "left").join(degree, "key", "left")
    texts = scratch.table(texts.select("key", "doc_id", "copies", F.coalesce("component", "key").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "texts")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    least = texts.groupBy("component").agg(first.alias("first"))
    texts = texts.join(least, "component").select("key", "copies", F.col("first.doc_id").alias("class_id"), "links", (F.col("key") == F.col("first.key")).alias("stands"))
    texts = scratch.table(texts, "classes")
    out = keyed.select("doc_id", "key").join(texts, "key", "left")
    return out.select(
        "doc_id",
        "key",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        (F.coalesce("stands", F.lit(True)) & F.col("doc_id").eqNullSafe(F.coalesce("class_id", "doc_id"))).alias("kept"),
    )
