"""Vectorised word and byte grams over batches of texts (numpy only).

A batch is one byte buffer in which a separator byte ends every text, so that no gram can join two
texts unnoticed. Names (hashes) are 64-bit and depend on content alone, never on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the mixing steps (golden ratio and splitmix64 constants, fixed values).
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on at once: bounds what the temporaries take, whatever a batch of rows holds.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * MIX1
    x ^= x >> U(27)
    x *= MIX2
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * GOLD)
BASE = U(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("p", ())) < n:
        _cache["p"], _cache["i"] = _powers(BASE, n + (n >> 3)), _powers(INVERSE, n + (n >> 3))
    return _cache["p"][:n], _cache["i"][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers of BASE: any substring's name comes from two of them."""
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    p, _ = powers(len(data) + 1)
    np.cumsum(_BYTE[data] * p[: len(data)], out=out[1:])
    return out


def names(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the substrings [start, end)."""
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U) * GOLD)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about ``most`` bytes; a longer text is a run of its own, never cut."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, at: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (within ``data``) of the words ``[^\\x20\\x09-\\x0D]+`` of rows [a, b), and for each row
    the number of words before it."""
    lo, hi = int(at[a]), int(at[b])
    word = ~SPACE[data[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)
    edge[at[a : b + 1] - lo] = True  # a row's end also ends a word
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    begins = word & (~before | edge[:-1])
    starts = np.flatnonzero(begins)
    after = np.concatenate((word[1:], [False])) if len(word) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts + lo, ends + lo, np.searchsorted(starts, at[a : b + 1] - lo)


def word_grams(name: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of every k consecutive words that lie in one row, and the index of the first word of each.

    ``counts``: words before each row, as ``words`` gives them."""
    n = len(name)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, U)
    for j in range(k):
        total = total * BASE + name[j : n - k + 1 + j]
    ok = np.ones(n - k + 1, bool)
    for j in range(1, k):  # the last k - 1 words of a row begin no gram
        cut = counts[1:] - j
        cut = cut[(cut >= 0) & (cut < len(ok)) & (cut >= counts[:-1])]
        ok[cut] = False
    first = np.flatnonzero(ok)
    return mix(total[first] ^ (np.full(1, k, U) * GOLD)), first


def minimizers(value: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` consecutive values, the index of its smallest (the leftmost of equals)."""
    n = len(value) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, arg, span = value.copy(), np.arange(len(value)), 1
    while span * 2 <= w:  # windows of doubled width, then two that overlap
        m = len(best) - span
        right = best[span:] < best[:m]
        arg = np.where(right, arg[span:], arg[:m])
        best = np.where(right, best[span:], best[:m])
        span *= 2
    if span < w:
        d = w - span
        right = best[d : d + n] < best[:n]
        return np.where(right, arg[d : d + n], arg[:n])
    return arg[:n]
