"""Texts as byte arrays: vectorised words, hashes and distinct values for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int):
    """Powers of the step and of its inverse, for positions below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        with np.errstate(over="ignore"):
            tables = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x)])) for x in (_STEP, _BACK)]
        _powers[:] = tables
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with full avalanche (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as UTF-8 (null: empty), in runs of about ``limit`` bytes; with the first row of each."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    start, run, size = 0, [], 0
    for i in range(len(texts)):
        value = texts[i].as_py() or b""
        run.append(value)
        size += len(value)
        if size >= limit:
            yield start, run
            start, run, size = i + 1, [], 0
    if run:
        yield start, run


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a byte array; equal bytes give equal hashes."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(int(np.searchsorted(ends, base + PIECE, "right")), lo + 1)
        part = buf[base : int(ends[hi - 1])]
        forward, back = _power_tables(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * forward[: len(part)], out=total[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = (total[e] - total[s]) * back[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(out)


def words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of anything but ASCII white space, A-Z lower-cased), and each text's count."""
    buf = LOWER[np.frombuffer(b" ".join(docs), np.uint8)]
    inside = ~SPACE[buf]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.searchsorted(starts, bounds)
    return hash_spans(buf, starts, ends), np.diff(at)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one run, an empty one has none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        value = np.full(n, np.uint64(size))
        for k in range(size):
            value = (value ^ hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            value ^= value >> np.uint64(32)
    return np.unique(mix(value))
