"""Repeated bytes where many texts have a gram in common and few a window."""

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import substrings


def _told(texts, rows=1 << 17):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "text"])
    (anchors,) = substrings._anchored(100)(iter([batch]))
    anchors = anchors.take(np.lexsort([anchors.column(k).to_numpy() for k in (3, 2, 1, 0)]))
    parts = [anchors.slice(i, rows) for i in range(0, anchors.num_rows, rows)]
    return [r for b in substrings._told_apart(iter(parts)) for r in b.to_pylist()]


def _texts(passages, n, lengths):
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    draw = lambda k: "".join(rng.choice(letters, k))
    common = [draw(300) for _ in range(passages)]
    texts = []
    for _ in range(n):
        p, k = common[rng.integers(passages)], rng.integers(*lengths)
        a = rng.integers(0, 300 - k)
        texts.append(draw(rng.integers(0, 120)) + p[a : a + k] + draw(rng.integers(0, 120)))
    return texts


def test_texts_with_only_a_gram_in_common_are_not_sorted():
    texts = _texts(3, 300, (20, 60))
    told = _told(texts)
    assert sum(r["kind"] == 1 for r in told) < len(texts) // 20 and not any(r["kind"] == 0 for r in told)


@pytest.mark.parametrize("compared", [1, 50, 1 << 17])
def test_every_shared_window_is_found(monkeypatch, compared):
    """Of texts that share runs of 60 to 180 bytes, also where a gram's rows stand in several parts."""
    monkeypatch.setattr(substrings, "COMPARED", compared, raising=False)
    texts = _texts(2, 250, (60, 180))
    first, found = {}, set()
    for r in _told(texts, 40):
        start, more = r["place"] >> 16, r["place"] >> 8 & 255
        if r["kind"] == 0:
            found |= {(r["doc"], start + k) for k in range(more + 1)}
        else:
            found |= {("kept", r["doc"], start + k) for k in range(more + 1)}
    for d, t in enumerate(texts):
        for p in range(len(t) - 99):
            lead = first.setdefault(t[p : p + 100], (d, p))
            if lead != (d, p):
                assert (d, p) in found or {("kept", d, p), ("kept", *lead)} <= found
