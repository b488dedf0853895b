"""Language ID: a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; a document's probabilities are the mean over all its bytes.
Texts are cut into segments of ``SPAN`` bytes that run side by side through the network, so a step is one
matrix product for thousands of segments, whole texts are read, and memory follows the slice of a batch.
Trained in numpy by backpropagation through time with Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, doc_crc_mod, unit_draw
from .words import buffers, slices

SPAN = 64
HIDDEN = 8
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    """Per direction: byte -> gate inputs (256 x 3H: update, reset, candidate), hidden -> gates (H x 2H),
    hidden -> candidate (H x H), hidden -> labels (H x L); and a bias of the labels."""

    labels: list[str]
    inputs: list[np.ndarray]
    gates: list[np.ndarray]
    candidate: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        h, n = HIDDEN, len(labels)
        some = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        two = lambda *shape: [some(*shape) for _ in range(2)]
        return cls(labels, two(256, 3 * h), two(h, 2 * h), two(h, h), two(h, n), np.zeros(n, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.gates, *self.candidate, *self.out, self.bias]

    def logits(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Labels' logits (T x N x L) of bytes x (T x N); keep gets what the gradient needs."""
        h_n = HIDDEN
        total = np.zeros((*x.shape, len(self.labels)), np.float32) + self.bias
        for d, order in enumerate((range(len(x)), range(len(x) - 1, -1, -1))):
            h = np.zeros((x.shape[1], h_n), np.float32)
            for t in order:
                a = np.take(self.inputs[d], x[t], axis=0)
                zr = a[:, : 2 * h_n] + h @ self.gates[d]
                zr = sigmoid(zr)
                z, r = zr[:, :h_n], zr[:, h_n:]
                rh = r * h
                c = np.tanh(a[:, 2 * h_n :] + rh @ self.candidate[d])
                before = h
                h = h + z * (c - h)
                total[t] += h @ self.out[d]
                if keep is not None:
                    keep.append((d, t, before, z, r, rh, c, h))
        return total

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the valid bytes and its gradient, by backpropagation through time."""
        keep: list = []
        p = softmax(self.logits(x, keep))
        n = max(1.0, float(mask.sum()))
        picked = np.take_along_axis(p, y[None, :, None], axis=2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * mask).sum() / n)
        dl = p
        np.put_along_axis(dl, np.broadcast_to(y[None, :, None], (*x.shape, 1)), np.take_along_axis(dl, y[None, :, None], axis=2) - 1, axis=2)
        dl *= (mask / n)[..., None].astype(np.float32)
        grads = [np.zeros_like(q) for q in self.parameters()]
        g_in, g_gate, g_cand, g_out = grads[0:2], grads[2:4], grads[4:6], grads[6:8]
        grads[8] += dl.sum(axis=(0, 1))
        for d in (0, 1):
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            for _, t, before, z, r, rh, c, h in reversed([k for k in keep if k[0] == d]):
                g_out[d] += h.T @ dl[t]
                dh = dh + dl[t] @ self.out[d].T
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * z * (1 - z)
                drh = dc @ self.candidate[d].T
                dr = drh * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                g_cand[d] += rh.T @ dc
                g_gate[d] += before.T @ dzr
                np.add.at(g_in[d], x[t], np.concatenate([dzr, dc], axis=1))
                dh = dh * (1 - z) + drh * r + dzr @ self.gates[d].T
        return loss, grads


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=2, keepdims=True))
    return x / x.sum(axis=2, keepdims=True)


def segments(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (T x N), which of them are valid, and the document of each segment; every byte is in one."""
    n = -(-np.diff(off) // SPAN)
    doc = np.repeat(np.arange(len(n)), n)
    start = off[doc] + SPAN * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    at = start[None, :] + np.arange(SPAN)[:, None]
    valid = at < off[doc + 1][None, :]
    return np.where(valid, buf[np.minimum(at, max(0, len(buf) - 1))], 0) if len(buf) else np.zeros((SPAN, 0), np.uint8), valid, doc


def train(rows: list[tuple[str, str]], *, steps: int = 300, batch: int = 384, rate: float = 0.02, seed: int = 1) -> Network | None:
    """A network for (text, label) rows; None without rows.  Labels weigh alike."""
    rows = [r for r in rows if r[0]]
    if not rows:
        return None
    labels = sorted({label for _, label in rows})
    rng = np.random.default_rng(seed)
    net = Network.fresh(labels, rng)
    x, valid, doc = segments(*buffers(pa.array([t for t, _ in rows])))
    y = np.array([labels.index(label) for _, label in rows])[doc]
    by_label = [np.flatnonzero(y == k) for k in range(len(labels))]
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, max(1, batch // len(labels))) for own in by_label])
        _, grads = net.gradient(x[:, pick], valid[:, pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, 3 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (lr * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def probabilities(net: Network, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Labels' probabilities summed over the valid bytes of each segment (L x N).

    The same network as ``logits``, laid out for speed: units by segments, buffers used again, and the
    halves of sigmoid(x) = (1 + tanh(x / 2)) / 2 folded into the weights.
    """
    h_n, n, f = HIDDEN, x.shape[1], np.float32
    total = np.empty((len(x), len(net.labels), n), f)
    a, g, m, c = (np.empty((k * h_n, n), f) for k in (3, 2, 1, 1))
    for d, order in enumerate((range(len(x)), range(len(x) - 1, -1, -1))):
        halves = np.repeat([f(0.5), f(1)], [2 * h_n, h_n]).astype(f)
        table = np.ascontiguousarray((net.inputs[d] * halves).T)
        gates, candidate, out = (np.ascontiguousarray(w.T) for w in (net.gates[d] * f(0.5), net.candidate[d] * f(0.5), net.out[d]))
        h = np.zeros((h_n, n), f)
        for t in order:
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(gates, h, out=g)
            g += a[: 2 * h_n]
            np.tanh(g, out=g)
            g += f(1)  # twice the update and reset gates
            np.multiply(g[h_n:], h, out=m)
            np.matmul(candidate, m, out=c)
            c += a[2 * h_n :]
            np.tanh(c, out=c)
            c -= h
            c *= g[:h_n]
            c *= f(0.5)
            h += c
            if d:
                total[t] += out @ h
            else:
                np.matmul(out, h, out=total[t])
    total += net.bias[None, :, None]
    total -= total.max(axis=1, keepdims=True)
    np.exp(total, out=total)
    total *= (valid / total.sum(axis=1))[:, None, :].astype(f)
    return total.sum(axis=0)


def classify(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Most probable label and its pooled probability, for every text (label -1 for empty ones)."""
    buf, off = buffers(texts)
    x, valid, doc = segments(buf, off)
    pooled = np.zeros((len(texts), len(net.labels)))
    for at in range(0, len(doc), 2048):  # what fits into the cache
        part = slice(at, at + 2048)
        np.add.at(pooled, doc[part], probabilities(net, np.ascontiguousarray(x[:, part]).astype(np.intp), valid[:, part]).T.astype(np.float64))
    pooled /= np.maximum(1, np.diff(off))[:, None]
    return np.where(np.diff(off) > 0, pooled.argmax(axis=1), -1), pooled.max(axis=1)


def training_rows(docs: DataFrame, scratch: Scratch, per_label: int, chars: int) -> list[tuple[str, str]]:
    """At most ``per_label`` labelled rows of each language outside the held-out fold, drawn by hashes of
    their ids, and ``chars`` characters from a drawn place of each."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_crc_mod(F.col("doc_id"), 5) != 0))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = scratch.table(counts, "counts")
    draw = unit_draw(F.col("doc_id"), F.lit(101))
    picked = known.withColumn("draw", draw).join(counts, "lang").where(F.col("draw") < 2.0 * per_label / F.col("n"))
    place = (F.greatest(F.length("text") - chars, F.lit(0)) * unit_draw(F.col("doc_id"), F.lit(102))).cast("int") + 1
    rows = picked.select("lang", "draw", "doc_id", F.substr("text", place, F.lit(chars)).alias("text")).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["doc_id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return [(t, lang) for lang in sorted(out) for t in out[lang][:per_label]]


def detect_languages(spark: SparkSession, docs: DataFrame, *, per_label: int = 500, chars: int = 1024, carry: bool = False) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score.

    docs (doc_id, text, lang).  Learns from at most ``per_label`` rows a language, none of them held out, and
    of each from at most ``chars`` characters at one drawn place; predicts from the whole text alone.  Texts that are null or have no letter are ``und`` with score 0, and so
    are all texts if there is nothing to learn from.  Rows without lang are predicted but not learnt from;
    repeated rows are predicted alike; an empty table gives an empty result; other columns are ignored.
    With ``carry`` the whole input row comes along as the struct column ``doc``.
    """
    scratch = Scratch(spark, "language")
    net = train(training_rows(docs.select("doc_id", "text", "lang"), scratch, per_label, chars))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 18):
            if net is None:
                best, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            else:
                best, score = classify(net, b.column("text"))
            names = [None if k < 0 else net.labels[k] for k in best]
            kept = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*kept, "label", "p"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", letters.alias("letters"), "text", *([F.struct("*").alias("doc")] if carry else []))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    raw = rows.mapInArrow(predict, f"{kinds}, label string, p double")
    good = F.col("letters") & F.col("label").isNotNull()
    return raw.select(
        "doc_id",
        (doc_crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.when(good, F.col("label")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(good, F.col("p")).otherwise(F.lit(0.0)).alias("score"),
        *(["doc"] if carry else []),
    )
