"""Vectorised word hashing over Arrow string buffers (numpy only, no per-word Python objects)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(10, int(n).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of values[s:s+n] for each start and length: equal runs, equal hashes."""
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[starts + lengths] - total[starts]) * powers(inverse, len(values) + 1)[starts]


def _piece(buf: np.ndarray, cuts: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of buf; no word crosses a cut."""
    inside = ~sep[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    return mix(runs(buf.astype(np.uint64) + np.uint64(1), starts, np.flatnonzero(last) + 1 - starts)), starts


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after the other, and the offsets between the texts.

    Works through the buffer in pieces that end at a separator, so memory follows the number of words
    and not eight times the bytes, however long one text is.
    """
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + _PIECE)
        while end < len(buf):
            tail = np.flatnonzero(sep[buf[max(at, end - 4096) : end]])
            if len(tail):
                end = max(at, end - 4096) + int(tail[-1]) + 1
                break
            end = min(len(buf), end + _PIECE)
        lo, hi = np.searchsorted(off, [at, end])
        h, s = _piece(buf[at:end], off[lo:hi] - at, sep)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about ``limit`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield b.slice(at, end - at)
            at = end
