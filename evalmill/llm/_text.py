"""Vectorised text work on Arrow batches: bytes, words and word hashes as numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps on purpose."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


#: A random 64-bit value for each byte and an odd base for the word hash.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 1 << 64)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of them at least; only the longest are kept."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = np.full(size, _R, dtype=U64), np.full(size, _R_INV, dtype=U64)
            up[0] = down[0] = 1
            _powers[:] = [(np.cumprod(up), np.cumprod(down))]
    return _powers[0]


def released(work):
    """A task's function that gives memory back at the end, as Python workers live on between tasks."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            _powers.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and len + 1 offsets; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of at most ``limit`` text bytes, or one row: (rows, bytes, offsets)."""
    data, at = utf8(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_bounds(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and len + 1 offsets into them by text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~space[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = np.unique(at[(at > 0) & (at < n)])
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased, independent of where the word stands."""
    out = np.empty(len(starts), dtype=U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE_BYTES, side="right")))
        base = int(starts[lo])
        part = data[base : int(ends[hi - 1])]
        up, down = powers(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(BYTE_VALUE[LOWER[part]] * up[: len(part)], out=sums[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        lo = hi
    return out


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``width``-word shingle hashes of each text; fewer words count as one shingle, none as no shingle."""
    starts, ends, by = word_bounds(data, at)
    w = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        weight = BYTE_VALUE[:width] | U64(1)
        n = max(0, len(w) - width + 1)
        h = np.zeros(n, dtype=U64)
        for k in range(width):
            h += w[k : k + n] * weight[k]
        h = mix(h)
        out = []
        for lo, hi in zip(by[:-1], by[1:], strict=True):
            if hi - lo >= width:
                out.append(np.unique(h[lo : hi - width + 1]))
            elif hi > lo:
                short = (w[lo:hi] * weight[: hi - lo]).sum(dtype=U64) + U64(hi - lo) * U64(0x9E3779B97F4A7C15)
                out.append(mix(np.array([short], dtype=U64)))
            else:
                out.append(np.zeros(0, dtype=U64))
    return out
