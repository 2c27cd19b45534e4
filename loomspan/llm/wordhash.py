"""64-bit fingerprints of words and of word runs, over whole Arrow columns at once.

A word is `[^\\x20\\x09-\\x0D]+`, its A-Z lower-cased; in UTF-8 that needs bytes only. A word's fingerprint is a sum of
random byte values times powers of an odd number, mixed; a run's fingerprint mixes those of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time; a longer text is cut at white space.
SLICE = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES[_SPACE] = 0
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1 << 14


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_NEAR = _powers(_FAR, int(_BASE))
_FAR_BASE = pow(int(_BASE), _FAR, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value starts; the last entry is the end."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of values of about `limit` bytes together."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _slice_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = _SPACE[data]
    first = ~blank
    inner = breaks[breaks < len(data)]
    at_break = first[inner]
    first[1:] &= blank[:-1]
    first[inner] = at_break
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    values = _BYTES[data[starts[0] :]]
    lengths = np.diff(np.append(starts, len(data)))
    within = np.arange(len(values), dtype=np.int64) - np.repeat(starts - starts[0], lengths)
    if lengths.max() > _FAR:
        far = _powers(int(lengths.max()) // _FAR + 1, _FAR_BASE)
        values *= far[within // _FAR]
        within %= _FAR
    values *= _NEAR[within]
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its fingerprint. No word crosses a position in breaks."""
    starts, prints, i = [], [], 0
    while i < len(data):
        j = min(i + SLICE, len(data))
        if j < len(data):
            blank = np.flatnonzero(_SPACE[data[i:j]])
            while not len(blank) and j < len(data):
                blank = np.flatnonzero(_SPACE[data[j : j + SLICE]]) + (j - i)
                j = min(j + SLICE, len(data))
            j = i + int(blank[-1]) + 1 if len(blank) else len(data)
        s, h = _slice_words(data[i:j], breaks[(breaks >= i) & (breaks < j)] - i)
        starts.append(s + i)
        prints.append(h)
        i = j
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(prints)


def runs(prints: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the runs of n words that start at each word; the caller leaves out those that cross texts."""
    if len(prints) < n:
        return np.zeros(0, np.uint64)
    last = len(prints) - n + 1
    out = np.full(last, n, np.uint64) * _BASE
    for k in range(n):
        out = mix(out * _BASE + prints[k : k + last])
    return out


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct fingerprints of n-word runs; of the whole sequence where it has fewer words."""
    raw, at = column_bytes(column)
    for i, j in groups(at):
        local = at[i : j + 1] - at[i]
        starts, prints = words(raw[at[i] : at[j]], local[:-1])
        bounds = np.searchsorted(starts, local)
        every = runs(prints, n)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                yield np.zeros(0, np.uint64)
            elif b - a < n:
                yield runs(prints[a:b], int(b - a))
            else:
                yield np.unique(every[a : b - n + 1])
