"""Suffix order by the difference cover {1, 2} modulo 3, in whole-array steps.

Sampled suffixes (start not a multiple of 3) are named by the order of their first three symbols; while names repeat, the
string of names is sorted the same way. The remaining suffixes follow from their first symbol and the next one's rank,
and the two orders are merged: each remaining suffix counts the sampled ones before it by binary search.
"""

from __future__ import annotations

import numpy as np

#: Symbols and ranks are packed three to a 64-bit key.
_BITS = np.uint64(21)
MOST = (1 << 21) - 8


def _pack(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
    out = a.astype(np.uint64) << _BITS | b.astype(np.uint64)
    return out if c is None else out << _BITS | c.astype(np.uint64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s in ascending order. Symbols and len(s) are below MOST."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    if n >= MOST:
        raise ValueError("the string is too long to name its suffixes in 21 bits")
    t = np.zeros(n + 4, np.int64)
    t[:n] = s.astype(np.int64) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with n % 3 == 1 an empty suffix ends the first half
    sample = np.concatenate([one, two])
    keys = _pack(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(keys)  # equal keys get one name, in whatever order they come
    ranked = keys[order]
    fresh = np.concatenate([[False], ranked[1:] != ranked[:-1]])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    if fresh.sum() + 1 < len(sample):
        order = suffix_array(names)
        names[order] = np.arange(len(order))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names + 1
    sampled = sample[order]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_pack(t[zero], rank[zero + 1]))]
    firsts, seconds = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(_pack(t[firsts], rank[firsts + 1]), _pack(t[zero], rank[zero + 1])) + np.searchsorted(
        _pack(t[seconds], t[seconds + 1], rank[seconds + 2]), _pack(t[zero], t[zero + 1], rank[zero + 2])
    )
    total = len(zero) + len(sampled)
    at = before + np.arange(len(zero))
    out = np.empty(total, np.int64)
    rest = np.ones(total, bool)
    rest[at] = False
    out[at] = zero
    out[rest] = sampled
    return out[out < n]
