"""Exact removal of repeated byte strings, by suffix order.

Suffixes need to be told apart by their first `length` bytes only, so the text is dealt to blocks by content. Every
window of `length` bytes is owned by the least of its 16-byte grams (by fingerprint, the leftmost among equals). Equal
windows have equal owners at equal offsets, so windows of one gram, and only those, are to be compared. An anchor is an
occurrence of a gram with the run of windows that it owns; its context is the run's bytes, 100 to 184 of them.

1. Anchors go to the tasks by gram. Of equal contexts the earliest stays; the others' windows are all repeated. Grams
   with a single context end here, which is most of them. So do contexts that can't share a window with another of their
   gram: an anchor's windows fall into SIDES classes by the gram's offset, and a class's windows have a core in common, of
   79 bytes or more, whose fingerprints are compared. Without it, ever more pairs that agree in their gram alone would be sorted
   as the input grows.
2. What is left meets by gram in blocks of whole grams. A block's contexts are sorted as one string by the
   difference-cover algorithm (`suffix.py`); adjacent suffixes with a common prefix of `length` bytes form classes, and
   all windows of a class but the earliest are repeated.
3. A gram with more contexts than a block holds is dealt anew by the windows' own fingerprints, which spreads it over
   all tasks; its windows are summed to the earliest before the shuffle.

Spans are joined to the documents, whose other bytes stay.

Defined results: a null text is empty; a text shorter than `length` loses nothing; a null id ranks after all others and
stays null; rows with the same id, or none, rank by their order in the table, and each has its own spans; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common, wordhash
from loomspan.llm.suffix import suffix_array

LENGTH = 100
GRAM = 16
#: Window starts worked on at a time, and bytes of contexts sorted at a time.
SLICE, BLOCK = 1 << 20, 1 << 20
#: Classes of windows by their gram's offset, with 16 bits each in an anchor's sides; rows that are compared at a time.
SIDES, COMPARED = 4, 1 << 17
#: Contexts of one gram beyond which it is dealt by windows.
BLOCK_CONTEXTS = 4096
#: Ids of texts to read again: up to so many (8 MB) are broadcast to the scan, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

ANCHORS = "gram long, context long, doc long, place long, sides long"
RUNS = "kind int, gram long, doc long, place long"
CONTEXTS = "gram long, doc long, place long, bytes binary"
BLOCKS = "kind int, doc long, start long, n long, bytes binary"

_rng = np.random.Generator(np.random.PCG64(512))
_VALUE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SLICE + 4096), _powers(_INVERSE, SLICE + 4096)


def _anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the texts that begin at starts in data, at most SLICE + length bytes together:
    text number, gram, context, first window, windows - 1, gram's offset in the first window, sides."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none, none, none, none
    value = _VALUE[data]
    grams, k = value, 1
    while k < GRAM:
        grams = grams[: len(grams) - k] + np.uint64(pow(_BASE, k, 1 << 64)) * grams[k:]
        k *= 2
    grams = wordhash.mix(grams)
    key = grams & ~_POSITION | np.arange(len(grams), dtype=np.uint64)
    wide, k = length - GRAM + 1, 1
    while 2 * k <= wide:
        key = np.minimum(key[: len(key) - k], key[k:])
        k *= 2
    if k < wide:
        key = np.minimum(key[: len(key) - (wide - k)], key[wide - k :])
    owner = (key & _POSITION).astype(np.int64)[:n]
    ends = np.append(starts[1:], len(data))
    number = np.repeat(np.arange(len(starts)), ends - starts)[:n]
    inside = np.arange(n) + length <= ends[number]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
    lo = np.flatnonzero(first)
    if not len(lo):
        return none, none, none, none, none, none, none
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
    hi = np.flatnonzero(last)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value * _UP[: len(data)], out=sums[1:])
    context = (sums[hi + length] - sums[lo]) * _DOWN[lo]
    off = owner[lo] - lo
    shape = ((hi - lo) << 8 | off).astype(np.uint64)
    context = wordhash.mix(wordhash.mix(context ^ grams[owner[lo]]) + shape)
    sides = np.zeros(len(lo), np.uint64)
    for k in range(SIDES):
        a, b = k * wide // SIDES, (k + 1) * wide // SIDES - 1  # windows with the gram at a .. b share the bytes from the last's start to the first's end
        some = np.flatnonzero((off - (hi - lo) <= b) & (off >= a)) if a <= b else none
        begin = owner[lo[some]] - a
        core = wordhash.mix((sums[begin + length - (b - a)] - sums[begin]) * _DOWN[begin])
        sides[some] |= (core >> np.uint64(48) | np.uint64(1)) << np.uint64(16 * k)  # 0: no windows
    return number[lo], grams[owner[lo]].view(np.int64), context.view(np.int64), lo - starts[number[lo]], hi - lo, off, sides.view(np.int64)


def _texts(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Slices of a column: bytes, where texts start in them, the texts' numbers, and the first one's position."""
    for i, j in wordhash.groups(at, SLICE // 2):
        a, b = int(at[i]), int(at[j])
        if b - a <= SLICE:
            yield raw[a:b], at[i:j] - a, np.arange(i, j), 0
        else:  # one long text, cut so that each window lies in one slice
            for x in range(a, b - length + 1, SLICE // 2):
                yield raw[x : min(x + SLICE // 2 + length - 1, b)], np.zeros(1, np.int64), np.array([i]), x - a


def _anchored(length: int):
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, at = wordhash.column_bytes(batch.column(1))
            parts = []
            for data, starts, numbers, shift in _texts(raw, at, length):
                keep = np.append(starts[1:], len(data)) > starts  # empty texts own no bytes
                number, gram, context, lo, more, off, sides = _anchors(data, starts[keep], length)
                parts.append((gram, context, ids[numbers[keep][number]] if len(number) else number, (lo + shift) << 16 | more << 8 | off, sides))
            if not parts:
                continue
            gram, context, doc, place, sides = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
            if ((doc[1:] < doc[:-1]) | (doc[1:] == doc[:-1]) & (place[1:] < place[:-1])).any():
                order = np.lexsort((place, doc))
                gram, context, doc, place, sides = gram[order], context[order], doc[order], place[order], sides[order]
            order = np.argsort(context)
            ranked = context[order]
            heads = np.flatnonzero(np.append([True], ranked[1:] != ranked[:-1])) if len(order) else order
            lead = np.empty(len(order), np.int64)
            if len(order):
                lead[order] = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order))))
            again = (doc != doc[lead]) | (place >> 16 != place[lead] >> 16)
            # repeated in this batch already: dealt by document, with a mark in the place's sign
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(again, wordhash.mix(doc.view(np.uint64)).view(np.int64), gram)), pa.array(context), pa.array(doc), pa.array(np.where(again, ~place, place)), pa.array(np.where(again, 0, sides))],
                names=["gram", "context", "doc", "place", "sides"],
            )

    return anchored


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _alike(group: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which contexts agree in a class of windows with another of their group."""
    sides, of = sides.view(np.uint64), group.astype(np.uint64) << np.uint64(18)
    out = np.zeros(len(group), bool)
    for k in range(SIDES):
        core = sides >> np.uint64(16 * k) & np.uint64(0xFFFF)
        some = np.flatnonzero(core)
        _, inverse, counts = np.unique(of[some] | core[some], return_inverse=True, return_counts=True)
        out[some] |= counts[inverse] > 1
    return out


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of gram, context, doc, place. Out: repeated runs (kind 0), and the earliest of each context
    where a gram has several (kind 1), without those that are like no other where all of the gram is at hand.
    What it holds between the parts that it compares is one row of each kind."""
    gram_now = context_now = None
    lead = None  # earliest of the open context: doc, place
    waiting = None  # the open gram's only context so far
    for batch in _gathered(batches, COMPARED):
        gram, context, doc, place, sides = (batch.column(k).to_numpy() for k in range(5))
        marked = place < 0
        out = [(np.zeros(int(marked.sum()), np.int32), gram[marked], doc[marked], ~place[marked])]
        gram, context, doc, place, sides = gram[~marked], context[~marked], doc[~marked], place[~marked], sides[~marked]
        if len(gram):
            new_gram = np.append([gram_now is None or gram[0] != gram_now], gram[1:] != gram[:-1])
            new = new_gram | np.append([context_now is None or context[0] != context_now], context[1:] != context[:-1])
            run = np.cumsum(new)  # 0: the open context goes on
            heads = np.flatnonzero(new)
            lead_doc = np.append([lead[0] if lead else 0], doc[heads])[run]
            lead_at = np.append([lead[1] >> 16 if lead else 0], place[heads] >> 16)[run]
            again = ~new & ((doc != lead_doc) | (place >> 16 != lead_at))
            out.append((np.zeros(int(again.sum()), np.int32), gram[again], doc[again], place[again]))
            group = np.cumsum(new_gram)[heads]  # 0: the open gram goes on
            counts = np.bincount(group, minlength=(group[-1] if len(group) else 0) + 1)
            if counts[0] and waiting:
                out.append(tuple(np.array([x], t) for x, t in zip((1, *waiting), (np.int32, np.int64, np.int64, np.int64), strict=True)))
                waiting = None
            several = counts > 1
            several[0] = True
            stay = several[group]
            inner = np.flatnonzero(stay & (group > 0) & (group < group[-1])) if len(group) else group  # the rest may go on
            stay[inner] = _alike(group[inner], sides[heads[inner]])
            keep = heads[stay]
            out.append((np.ones(len(keep), np.int32), gram[keep], doc[keep], place[keep]))
            if len(group) and group[-1] > 0:
                waiting = (int(gram[heads[-1]]), int(doc[heads[-1]]), int(place[heads[-1]])) if counts[group[-1]] == 1 else None
            elif new_gram.any():
                waiting = None
            gram_now, context_now = gram[-1], context[-1]
            if len(heads):
                lead = (int(doc[heads[-1]]), int(place[heads[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["kind", "gram", "doc", "place"])


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                rows = batch.slice(i, 128)
                gram, doc, place, data = [], [], [], []
                for d, text, anchors in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    raw = text.encode()
                    for a in anchors:
                        lo, more = a["place"] >> 16, a["place"] >> 8 & 255
                        gram.append(a["gram"])
                        doc.append(d)
                        place.append(a["place"])
                        data.append(raw[lo : lo + more + length])
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(data, pa.binary())], names=["gram", "doc", "place", "bytes"])

    return cut


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes from a on equal those from b on. Neighbours in suffix order differ at the end first."""
    left = np.arange(len(a))
    for k in range(length - 1, -1, -8):
        left = left[data[a[left] + k] == data[b[left] + k]]
    views = np.lib.stride_tricks.sliding_window_view(data, length)
    out = np.zeros(len(a), bool)
    for i in range(0, len(left), 8192):
        part = left[i : i + 8192]
        out[part] = (views[a[part]] == views[b[part]]).all(axis=1)
    return out


def _repeated(doc: np.ndarray, place: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows in these contexts that an earlier one equals."""
    size = np.array([len(x) for x in data])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    joined = np.frombuffer(b"\xff".join(data) + b"\xff", np.uint8)  # no UTF-8 text has this byte
    windows = size - length + 1
    at = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    window = np.full(len(joined), -1, np.int32)  # the window that begins at a byte
    window[at] = np.arange(len(at), dtype=np.int32)
    order = window[suffix_array(joined)]
    order = order[order >= 0]
    of = np.repeat(np.arange(len(data)), windows)
    start = (place[of] >> 16) + at - begin[of]
    at, of, start = at[order], of[order], start[order]
    same = np.zeros(len(at), bool)
    same[1:] = _same(joined, at[1:], at[:-1], length)  # adjacent prefixes
    group = np.cumsum(~same)
    d = doc[of]
    order = np.lexsort((start, d, group))
    group, d, start = group[order], d[order], start[order]
    head = np.append([True], group[1:] != group[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (d != d[lead]) | (start != start[lead])
    return d[later], start[later]


def _blocks(length: int, most: int):
    def rows(kind: int, doc: np.ndarray, start: np.ndarray, n: np.ndarray, data: list | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(data or [None] * len(doc), pa.binary())],
            names=["kind", "doc", "start", "n", "bytes"],
        )

    def sort(held: list[tuple]) -> pa.RecordBatch:
        doc, start = _repeated(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), [h[2] for h in held], length)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        head = np.append([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)) if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(doc)) - 1
        return rows(0, doc[first], start[first], start[last] - start[first] + 1 if len(first) else start)

    def wide(held: list[tuple]) -> pa.RecordBatch:
        place = np.array([h[1] for h in held], np.int64)
        return rows(1, np.array([h[0] for h in held], np.int64), place >> 16, (place >> 8 & 255) + 1, [h[2] for h in held])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # whole grams
        group: list[tuple] = []  # the open one
        now, large, size = None, False, 0
        for batch in batches:
            for gram, doc, place, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if gram != now:
                    if large and group:
                        yield wide(group)
                    elif group:
                        done += group
                        size += sum(len(g[2]) + 1 for g in group)
                        if size >= BLOCK:
                            yield sort(done)
                            done, size = [], 0
                    group, now, large = [], gram, False
                group.append((doc, place, data))
                if len(group) >= most:
                    large = True
                    yield wide(group)
                    group = []
        if large and group:
            yield wide(group)
        elif group:
            done += group
        if done:
            yield sort(done)

    return blocks


def _windows(length: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                doc, start, n, data = (part.column(k).to_pylist() for k in range(4))
                a = [hashlib.blake2b(x[j : j + length], digest_size=16).digest() for x, k in zip(data, n, strict=True) for j in range(k)]
                n = np.array(n)
                more = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(np.repeat(np.array(doc, np.int64), n)), pa.array(np.repeat(np.array(start, np.int64), n) + more)], names=["print", "doc", "start"])

    return windows


def repeated_runs(docs: DataFrame, length: int = LENGTH, block_contexts: int = BLOCK_CONTEXTS) -> DataFrame:
    """docs: (doc, text). Returns (doc, start, n): the `length`-byte windows at start .. start + n - 1 are repeated."""
    anchors = common.map_arrow(docs, _anchored(length), ANCHORS)
    ordered = anchors.repartition("gram").sortWithinPartitions("gram", "context", "doc", "place")
    told = common.settle(common.map_arrow(ordered, _told_apart, RUNS), "substring-runs")
    place = F.col("place")
    plain = told.where("kind = 0").select("doc", F.shiftright(place, 16).alias("start"), (F.shiftright(place, 8).bitwiseAND(255) + 1).alias("n"))
    of_doc = common.settle(told.where("kind = 1").groupBy("doc").agg(F.collect_list(F.struct("gram", "place")).alias("anchors")), "substring-anchors")
    few = of_doc.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(of_doc.select("doc")), "doc", "left_semi") if few else docs
    contexts = common.map_arrow(wanted.join(of_doc, "doc").select("doc", "text", "anchors"), _cut(length), CONTEXTS)
    ordered = contexts.repartition("gram").sortWithinPartitions("gram", "doc", "place")
    blocks = common.settle(common.map_arrow(ordered, _blocks(length, block_contexts), BLOCKS), "substring-blocks")
    runs = plain.unionByName(blocks.where("kind = 0").select("doc", "start", "n"))
    large = blocks.where("kind = 1")
    if large.take(1):
        windows = common.settle(common.map_arrow(large.select("doc", "start", "n", "bytes"), _windows(length), "print binary, doc long, start long"), "substring-windows")
        first = windows.groupBy("print").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("of")).where("of > 1")
        again = windows.join(first, "print").where("doc <> first.doc or start <> first.start")
        runs = runs.unionByName(again.select("doc", "start", F.lit(1).cast("long").alias("n")))
    return runs


def _kept(length: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                rows = batch.slice(i, 128)
                texts, spans = [], []
                for text, found in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    raw, merged = text.encode(), []
                    for start, end in sorted((r["start"], min(len(raw), r["start"] + r["n"] - 1 + length)) for r in found or ()):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(end, merged[-1][1])
                        elif start < end:
                            merged.append([start, end])
                    edges = [0, *(x for m in merged for x in m), len(raw)]
                    texts.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t.encode()) for t in rows.column(1).to_pylist()], pa.int64()), pa.array(texts, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_bytes", "kept", "spans"])

    return kept


def _ranked(docs: DataFrame) -> DataFrame:
    """docs as (doc, doc_id, text), with doc the place of a row among all: its id, or where ids are null or repeat, its number
    by id and order in the table, in a settled table."""
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").take(1):
        return docs.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    ordered = docs.withColumn("row", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "row")
    return common.settle(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "substring-docs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_contexts: int = BLOCK_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): the bytes that stay, and the maximal removed runs [start, end) in the input."""
    docs = _ranked(common.texts(docs, id_col, text_col))
    of_doc = repeated_runs(docs.select("doc", "text"), length, block_contexts).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    out = common.map_arrow(docs.join(of_doc, "doc", "left").select("doc_id", "text", "runs"), _kept(length), "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
    return out.select("doc_id", "n_bytes", "kept", "spans")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
