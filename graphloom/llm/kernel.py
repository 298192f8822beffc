"""Array kernels over packed texts: words, hashes, windows. All are linear in the bytes they see.

A batch of texts is one byte array and its offsets. Words are maximal runs of bytes
other than 0x20 and 0x09-0x0D, found without a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random uint64, the same on every machine."""
    return mix(U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


_BYTE = stream(11, 256)
_P = int(stream(12, 1)[0]) | 1
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        n = max(n, BLOCK + 4096)
        for key, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            x = np.full(n, U(base))
            x[0] = 1
            _POW[key] = np.cumprod(x, dtype=U)
    return _POW["p"], _POW["i"]


def packed(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if off else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    if len(data):
        before[0] = False
        before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        after[-1] = False
        after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial."""
    out = np.empty(len(starts), U)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        b, e = int(starts[i]), int(ends[j - 1])
        p, inv = _powers(e - b + 1)
        s = np.zeros(e - b + 1, U)
        np.cumsum(_BYTE[data[b:e]] * p[: e - b], out=s[1:])
        out[i:j] = (s[ends[i:j] - b] - s[starts[i:j] - b]) * inv[starts[i:j] - b]
        i = j
    return mix(out + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, by the place of the first; len(h)-k+1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U(0x9FB21C651E98DF25)
        out += h[j : j + n]
    return mix(out + U(k))


def scattered(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column: counts[i] consecutive values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
