"""Hashes of runs of words, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together, or one text.
PART = 1 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def scrambled(x: np.ndarray) -> np.ndarray:
    """64 bits of which each depends on all that were given; wraps on purpose."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_BYTE = scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _geometric(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base % (1 << 64), dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: its bytes' values by powers of a base, as a difference of running sums, moved to the word's own beginning."""
    n = len(data) + 1
    up, down = _geometric(_BASE, n), _geometric(pow(_BASE, -1, 1 << 64), n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1])])
        return scrambled((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, the distinct hashes of its runs of n words) of each text with as many; words are parted by ASCII white space."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    weights = _geometric(0xA24BAED4963EE407, n)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PART, side="right")) - 1)
        # a blank behind each text, so that words end with their text
        part = np.insert(raw[at[lo] : at[hi]], (at[lo + 1 : hi + 1] - at[lo]), 32)
        ends_at = at[lo + 1 : hi + 1] - at[lo] + np.arange(1, hi - lo + 1)
        inside = np.concatenate([[False], ~_BLANK[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        words = _word_hashes(part, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        by = np.concatenate([[0], np.searchsorted(starts, ends_at)])
        with np.errstate(over="ignore"):
            runs = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
            for k in range(n):
                runs += words[k : k + len(runs)] * weights[k]
        runs = scrambled(runs)
        for row, (a, b) in enumerate(zip(by[:-1], by[1:], strict=True), start=lo):
            if b - a >= n:
                yield row, np.unique(runs[a : b - n + 1])
        lo = hi
