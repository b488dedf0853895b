"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes logarithmic counts of hashed byte trigrams, weighted by rarity, and a few ratios of its
words and lines.  A truncated singular value decomposition of a sample of labelled texts, in numpy, gives
the latent space.  The labelled vectors, bounded by ``sample``, go to every task; the cosines of every
document with all of them are exact, block by block, and the nearest vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, doc_crc_mod, unit_draw
from .words import buffers, slices, word_hashes

GRAMS = 1024  # hashed trigram columns
RATIOS = 10
LATENT = 48
NEIGHBOURS = 15
_LINE = np.zeros(256, bool)
_LINE[10] = True


def repeated(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Share of a text's pieces that it holds already."""
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    again = np.append(False, (h[1:] == h[:-1]) & (d[1:] == d[:-1])) if len(h) else np.zeros(0, bool)
    return np.bincount(d, again, len(n)) / np.maximum(1, n)


def features(texts: pa.Array) -> np.ndarray:
    """(texts x (GRAMS + RATIOS)): counts, then ratios in 0..1."""
    buf, off = buffers(texts)
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), GRAMS + RATIOS), np.float32)
    if len(buf) > 2:
        b = buf.astype(np.uint32)
        gram = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761) >> np.uint32(22)
        within = doc[:-2] == doc[2:]
        out[:, :GRAMS] = np.bincount(doc[:-2][within] * GRAMS + gram[within], minlength=len(n) * GRAMS).reshape(len(n), GRAMS)
    size = np.maximum(1, n)
    share = lambda mask: np.bincount(doc, mask, len(n)) / size
    words, word_off = word_hashes(buf, off)
    lines, line_off = word_hashes(buf, off, _LINE)
    n_words, n_lines = np.diff(word_off), np.diff(line_off)
    upper = share((buf >= 65) & (buf <= 90))
    digit = share((buf >= 48) & (buf <= 57))
    sign = share(((buf > 32) & (buf < 48)) | ((buf > 57) & (buf < 65)) | ((buf > 90) & (buf < 97)) | ((buf > 122) & (buf < 127)))
    stats = [
        upper,
        digit,
        sign,
        share((buf == 33) | (buf == 124) | (buf == 35) | (buf == 36) | (buf == 37) | (buf == 38) | (buf == 42)),
        share(buf > 127),
        repeated(words, word_off),
        repeated(lines, line_off),
        np.minimum(1, n / np.maximum(1, n_words) / 20),
        np.minimum(1, np.log1p(n_words) / 10),
        np.minimum(1, np.log1p(n_words / np.maximum(1, n_lines)) / 8),
    ]
    out[:, GRAMS:] = np.stack(stats, axis=1)
    return out


@dataclass
class Voters:
    """The latent space and the labelled vectors in it."""

    idf: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero for texts without features."""
        z = weighted(x, self.idf, self.mean, self.scale) @ self.axes
        return z / np.maximum(1e-12, np.linalg.norm(z, axis=1))[:, None]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        z = self.project(x)
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(z))
        for at in range(0, len(z), 256):
            sim = z[at : at + 256] @ self.vectors.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(sim, near, axis=1), 0) ** 4 + 1e-6
            out[at : at + 256] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def weighted(x: np.ndarray, idf: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    grams = np.log1p(x[:, :GRAMS]) * idf
    grams /= np.maximum(1e-12, np.linalg.norm(grams, axis=1))[:, None]
    return np.hstack([grams, (x[:, GRAMS:] - mean) * scale]).astype(np.float32)


def fit(x: np.ndarray, labels: np.ndarray) -> Voters:
    """Latent space and voters from features and 0/1 labels (one row at least)."""
    df = (x[:, :GRAMS] > 0).sum(axis=0)
    idf = (np.log((1 + len(x)) / (1 + df)) + 1).astype(np.float32)
    mean = x[:, GRAMS:].mean(axis=0)
    scale = (0.3 / np.maximum(0.02, x[:, GRAMS:].std(axis=0))).astype(np.float32)  # a ratio's spread is a third of a text's length
    w = weighted(x, idf, mean, scale).astype(np.float64)
    values, axes = np.linalg.eigh(w.T @ w)  # right singular vectors
    axes = axes[:, np.argsort(values)[::-1][:LATENT]].astype(np.float32)
    v = Voters(idf, mean, scale, axes, np.zeros((0, axes.shape[1]), np.float32), labels.astype(np.float64))
    v.vectors = v.project(x)
    return v


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample: int = 4000) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted.

    docs (doc_id, text), labels (doc_id, quality).  Learns from at most ``sample`` labelled documents
    outside the held-out fold, drawn by hashes of their ids; scores every text whole.  Null counts as
    empty; empty texts are scored by the same vote, from features of zeros.  Rows of ``labels`` whose quality is null
    are not learnt from, nor those of a document that is labelled both ways; ties among the nearest go by the
    order of a partition that is the same in every run; without any labels every score is 0.5.  Repeated rows are scored alike; an empty table
    gives an empty result; other columns are ignored.
    """
    scratch = Scratch(spark, "quality")
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & (doc_crc_mod(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    n = known.count()
    drawn = known.withColumn("draw", unit_draw(F.col("doc_id"), F.lit(203))).where(F.col("draw") < 1.5 * sample / max(1, n))
    picked = docs.select("doc_id", "text").join(drawn, "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(b.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("draw"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "draw", "x"])

    rows = scratch.table(picked.select("doc_id", F.col("quality").cast("int").alias("quality"), "draw", "text").mapInArrow(vectors, "doc_id bigint, quality int, draw double, x binary"), "sample")
    rows = sorted(rows.orderBy("draw", "doc_id").limit(sample).collect(), key=lambda r: (r["draw"], r["doc_id"], bytes(r["x"])))
    voters = fit(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), np.array([r["quality"] for r in rows])) if rows else None
    shared = spark.sparkContext.broadcast(voters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.score(features(b.column("text"))) if shared.value is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(predict, "doc_id bigint, score double")
    return scored.select("doc_id", (doc_crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
