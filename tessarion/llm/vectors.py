"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines in blocks,
distributed connected components.

What travels to the buckets, once a table, is narrow: unit vectors rounded to 16 bits a component and the
packed signs.  Rounding moves a cosine by less than a known margin, so a block decides all pairs outside
that margin; the few within it are decided on the vectors themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

PER_BUCKET = 8192  # vectors that a bucket holds on average
PART = 16384  # vectors of a part of a bucket; a task looks at two parts
BLOCK = 1024  # vectors of one side of a block of cosines
STEPS = 32767  # of a component's rounding


def tables_needed(threshold: float, bits: int, recall: float) -> int:
    """Tables for a pair at the threshold to collide in one at least, with probability ``recall``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def rounding_margin(dim: int) -> float:
    """What rounding to ``STEPS`` and a product in single precision move a cosine by, at most."""
    return 1.01 * math.sqrt(dim) / STEPS + 2e-7 * dim


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, v -> id, v, key: 16 bytes that stand for the vector, null if it links with nothing."""
    for b in batches:
        v = b.column("v")
        starts = np.asarray(v.offsets)
        values = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null is nan, -0.0 is 0.0
        good = np.append(np.isfinite(values), True)
        n = len(v)
        some = np.asarray(v.is_valid()) & np.asarray(b.column("id").is_valid()) & (np.diff(starts) > 0)
        keys = [None] * n
        for k in np.flatnonzero(some):
            x = values[starts[k] : starts[k + 1]]
            if good[starts[k] : starts[k + 1]].all() and x.any():
                keys[k] = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([b.column("id"), v, pa.array(keys, pa.binary())], ["id", "v", "key"])


def unit_vectors(v: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of length one in double precision; scaled by the largest component first, so squares neither overflow nor vanish."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signatures(batches: Iterator[pa.RecordBatch], planes: np.ndarray, tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    """key, times, v -> key, times, rounded unit vector, signature of every table (packed, and as a list)."""
    weights = 1 << np.arange(bits, dtype=np.int32)
    for b in batches:
        x = unit_vectors(b.column("v"), planes.shape[0])
        sig = ((x @ planes > 0).reshape(-1, tables, bits) @ weights).astype(np.int32)
        short = np.rint(x * STEPS).astype(np.int16)
        lists = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, tables, dtype=np.int32), sig.ravel())
        blobs = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (short, sig)]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("times"), *blobs, lists], ["key", "times", "short", "packed", "sigs"])


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Blobs of one size as rows."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), dtype).reshape(len(column), -1)


def merge(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least place of each group) after the groups of a and of b are joined."""
    a, b = low[a], low[b]
    apart = a != b
    a, b = a[apart], b[apart]
    if not len(a):
        return low
    to = np.arange(len(low))
    while True:
        least = np.minimum(to[a], to[b])
        if (to[a] == to[b]).all():
            return to[low]
        np.minimum.at(to, a, least)
        np.minimum.at(to, b, least)
        to = to[to]
        a, b = to[a], to[b]


def block_links(threshold: float, dim: int):
    """A function for applyInArrow: the links within one block pair, summed up by vector.

    A pair counts in the first table in which its signatures agree.  Returned rows: a vector, how many
    vectors it is linked with here, and one of its linked neighbourhood within the block pair, which is an
    edge enough for components; or, with null links, a pair within the margin of the rounding.
    """
    margin = rounding_margin(dim)

    def run(key, t):
        table, _, i, j = (k.as_py() for k in key)
        keys, times, side = t.column("key").combine_chunks(), t.column("times").to_numpy().astype(np.float64), t.column("part").to_numpy()
        x = matrix(t.column("short"), np.int16).astype(np.float32) / np.float32(STEPS)
        earlier = matrix(t.column("packed"), np.int32)[:, :table]
        n = t.num_rows
        rows, cols = np.flatnonzero(side == i), np.flatnonzero(side == j)
        count, low, close = np.zeros(n), np.arange(n), []
        for at in range(0, len(rows), BLOCK):
            r = rows[at : at + BLOCK]
            for to in range(at if i == j else 0, len(cols), BLOCK):
                c = cols[to : to + BLOCK]
                sim = x[r] @ x[c].T
                a, b = np.nonzero(sim >= threshold - margin)
                sure = sim[a, b] >= threshold + margin
                a, b = r[a], c[b]
                new = (a < b) if i == j and at == to else np.ones(len(a), bool)
                if table:
                    new &= ~(earlier[a] == earlier[b]).any(axis=1)
                near = new & ~sure
                close.append((a[near], b[near]))
                a, b = a[new & sure], b[new & sure]
                count += np.bincount(a, times[b], n) + np.bincount(b, times[a], n)
                low = merge(low, a, b)
        got = np.flatnonzero(count)
        a, b = (np.concatenate(p) for p in zip(*close, strict=True)) if close else (np.zeros(0, np.int64),) * 2
        take = lambda *places: keys.take(pa.array(np.concatenate(places)))
        links = pa.array(np.append(count[got], np.zeros(len(a))).astype(np.int64), mask=np.append(np.zeros(len(got), bool), np.ones(len(a), bool)))
        return pa.table({"key": take(got, a), "links": links, "low": take(low[got], b)})

    return run


def exact_links(batches: Iterator[pa.RecordBatch], threshold: float, dim: int) -> Iterator[pa.RecordBatch]:
    """Pairs (key, times, v and to_key, to_times, to_v) -> links of both of those at the threshold, in double precision."""
    for b in batches:
        cosine = (unit_vectors(b.column("v"), dim) * unit_vectors(b.column("to_v"), dim)).sum(axis=1)
        b = b.filter(pa.array(cosine >= threshold))
        one, two = b.column("key"), b.column("to_key")
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([one, two]), pa.concat_arrays([b.column("to_times"), b.column("times")]), pa.concat_arrays([two, one])], ["key", "links", "low"])


def vector_classes(spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.995, seed: int = 5) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors under a null id, nor vectors of different lengths with each other.  Equal vectors are one vector with a
    multiplicity from the start, so thousands of copies cost one row; a repeated row counts as a copy, and
    of an id that repeats with different vectors each is a vector of its own.  An empty table gives an
    empty result; other columns are ignored.

    Links of different vectors are found with probability ``recall`` at the threshold and more above
    it; none is below it in double precision.  A large bucket is split into parts and every pair of parts
    is its own task, so all its pairs are compared; no pairs are shipped but those within the rounding's margin.
    """
    scratch = Scratch(spark, "vectors")
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    v = v.mapInArrow(keys_of, f"id bigint, v {kind}, key binary")
    v = scratch.table(v, "vectors")
    distinct = v.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("times"), F.any_value("v").alias("v"))
    distinct = scratch.table(distinct.withColumn("dim", F.size("v")), "distinct")

    found = spark.createDataFrame([], "key binary, links bigint, low binary")
    for row in distinct.groupBy("dim").count().where("count > 1").collect():  # a row per vector length
        dim, n = row["dim"], row["count"]
        bits = max(1, round(math.log2(n / PER_BUCKET)) if n > PER_BUCKET else 1)
        tables = tables_needed(threshold, bits, recall)
        planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
        own = distinct.where(F.col("dim") == dim).select("key", "times", "v")
        signed = own.mapInArrow(lambda it, p=planes, t=tables, b=bits: signatures(it, p, t, b), "key binary, times bigint, short binary, packed binary, sigs array<int>")
        signed = scratch.table(signed, "signed")
        large = signed.select(F.posexplode("sigs").alias("table", "sig")).groupBy("table", "sig").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
        large = scratch.table(large, "large")
        keyed = signed.select("key", "times", "short", "packed", F.posexplode("sigs").alias("table", "sig")).join(large, ["table", "sig"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.pmod(F.xxhash64("key", "table"), F.col("parts")).cast("int")
        keyed = keyed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keyed = keyed.select("table", "sig", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "key", "times", "short", "packed")
        links = scratch.table(keyed.groupBy("table", "sig", "i", "j").applyInArrow(block_links(threshold, dim), "key binary, links bigint, low binary"), "links")
        side = lambda c: own.select(*[F.col(x).alias(c + x) for x in ("key", "times", "v")])
        close = links.where("links IS NULL").select("key", F.col("low").alias("to_key")).join(side(""), "key").join(side("to_"), "to_key")
        exact = close.mapInArrow(lambda it, d=dim: exact_links(it, threshold, d), "key binary, links bigint, low binary")
        found = found.unionByName(links.where("links IS NOT NULL")).unionByName(scratch.table(exact, "exact"))
    per = found.groupBy("key").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select("key", "low"), scratch, "key", "low").withColumnRenamed("id", "key")
    classes = distinct.select("key", "id", "times").join(per, "key", "left").join(comps, "key", "left")
    classes = scratch.table(classes.select("key", "id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "key").alias("component")), "classes")
    least = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = scratch.table(classes.join(least, "component").select("key", "n_links", "component_id"), "placed")
    out = v.select("id", "key").join(classes, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
