"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Each input partition packs its own documents, group by group, in one pass without a shuffle: a group holds about
`group_sequences` sequences, its documents' estimated cost is linear plus quadratic in their length, and documents go in
descending cost to the lowest-cost sequence with room. What fits nowhere whole is cut over the sequences with room, so a
group wastes less than one sequence.

Defined results: a null text is empty and packs as its end id alone; a null id stays null; repeated rows are packed once
each; an empty table gives no pieces; columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common

SEQUENCE = 4096
END_ID = 2
GROUP_SEQUENCES = 256
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, as of a layer whose width is some thousands.
LINEAR, QUADRATIC = 1.0, 1.0 / 8192
#: Bytes of a worker's memory of chunks, in two generations; the older is dropped when the younger holds half. It only
#: saves time. Besides the characters and ids, an entry takes about OVERHEAD bytes.
MEMORY, OVERHEAD = 96 << 20, 200

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One a worker, kept from task to task; the first task of another operator drops it (see common.map_arrow)."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        common.keep(_encoders.clear)
        common.trim()  # reading a tokenizer takes several times the memory of the result
    return _encoders[path]


class Encoder:
    """ids of whole texts, equal to the tokenizer's own, by way of a memory of white-space separated chunks.

    The vocabulary's pre-tokenizer never joins characters across white space, so a chunk's ids don't depend on its
    neighbours. Texts with a special token's string, or where Python and the tokenizer may disagree on white space or
    case, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a worker: its threads' buffers would stay
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        ends = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.is_end = np.array([bool(t) and t.endswith("</w>") for t in ends])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """ids of unseen words, many in one call; a word's last id is the one whose token ends a word."""
        batches, out = [words[i : i + 64] for i in range(0, len(words), 64)], {}
        for batch, got in zip(batches, self.tokenizer.encode_batch_fast([" ".join(b) for b in batches], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            stops = np.flatnonzero(self.is_end[ids]) + 1
            if len(stops) != len(batch):
                for w in batch:
                    out[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            for w, a, b in zip(batch, [0, *stops[:-1]], stops, strict=True):
                out[w] = ids[a:b].tobytes()
        return out

    def _missing(self, chunks: set[str]) -> set[str]:
        """Those that are in no generation; those in the older one move to the younger."""
        missing = [c for c in chunks if c not in self.chunks]  # a difference of sets would walk all of the memory
        for c in missing:
            if c in self.older:
                self._keep(c, self.older[c])
        return {c for c in missing if c not in self.older}

    def _keep(self, chunk: str, ids: bytes) -> None:
        self.chunks[chunk] = ids
        self.held += len(chunk) + len(ids) + OVERHEAD

    def _split(self, chunk: str) -> list[str] | None:
        """A chunk as letters with a tail of marks, the common forms; None for all others."""
        core = chunk.rstrip(".,;:!?%&$*#|\"'")
        if not core:
            return [chunk] if "'" not in chunk else None
        if core.isalpha():
            tail = chunk[len(core) :]
            return None if "'" in tail else [core, tail] if tail else [core]
        return None

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if self.held > MEMORY // 2:
            self.chunks, self.older, self.held = {}, self.chunks, 0
        split: list[list[str] | None] = []
        unseen: set[str] = set()
        for text in texts:
            plain = "<|" not in text
            if plain and not text.isascii():
                try:
                    text.encode("latin-1")  # composed already, and lower-cased alike by both sides
                except UnicodeEncodeError:
                    plain = False
            if plain and any(c in text for c in "\x1c\x1d\x1e\x1f\x85"):
                plain = False
            if not plain:
                split.append(None)
                continue
            chunks = text.lower().split()
            split.append(chunks)
            unseen.update(chunks)
        parts = {c: self._split(c) for c in self._missing(unseen)}
        odd = [c for c, p in parts.items() if p is None]
        for w, ids in self._learn(sorted(self._missing({w for p in parts.values() if p for w in p}))).items():
            self._keep(w, ids)
        for c, p in parts.items():
            if p and len(p) == 2:
                self._keep(c, self.chunks[p[0]] + self.chunks[p[1]])
        if odd:
            for c, got in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                self._keep(c, np.array(got.ids, dtype="<u4").tobytes())
        ids_of = self.chunks.__getitem__
        return [
            b"".join(map(ids_of, chunks)) if chunks is not None else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for text, chunks in zip(texts, split, strict=True)
        ]


def balance(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; the sequences are ceil(sum / size) in number."""
    n = -(-sum(lengths) // size)
    cost_of = lambda k: LINEAR * k + QUADRATIC * k * k
    pieces, at, rest = [], 0, []
    for d, k in enumerate(lengths):
        full = k // size
        for j in range(full):
            pieces.append((d, j * size, size, at, 0))
            at += 1
        if k % size:
            rest.append((d, full * size, k % size))
    rest.sort(key=lambda x: (-x[2], x[0]))
    used = [0] * n
    heap = [(0.0, s) for s in range(at, n)]
    waiting = []
    for d, start, k in rest:
        passed = []
        while heap and used[heap[0][1]] + k > size:
            passed.append(heapq.heappop(heap))
        if heap:
            cost, s = heapq.heappop(heap)
            pieces.append((d, start, k, s, used[s]))
            used[s] += k
            if used[s] < size:
                heapq.heappush(heap, (cost + cost_of(k), s))
        else:
            waiting.append((d, start, k))
        for x in passed:
            heapq.heappush(heap, x)
    for d, start, k in waiting:  # cut over the sequences with room, the cheapest first
        while k:
            cost, s = heapq.heappop(heap)
            part = min(k, size - used[s])
            pieces.append((d, start, part, s, used[s]))
            used[s] += part
            start, k = start + part, k - part
            if used[s] < size:
                heapq.heappush(heap, (cost + cost_of(part), s))
    return pieces


def _packer(path: str, size: int, end_id: int, group_sequences: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(path)
        part = TaskContext.get().partitionId() << 32
        end = np.array([end_id], dtype="<u4").tobytes()
        names = [x.split()[0] for x in PIECES.split(", ")]
        ids: list[int | None] = []
        codes: list[bytes] = []
        held, made = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, codes, held, made
            lengths = [len(c) // 4 for c in codes]
            rows = balance(lengths, size)
            out = [
                [ids[d] for d, *_ in rows],
                [r[1] for r in rows],
                [r[2] for r in rows],
                [lengths[r[0]] for r in rows],
                [part | (made + r[3]) for r in rows],
                [r[4] for r in rows],
            ]
            cut = pa.array([codes[d][4 * a : 4 * (a + k)] for d, a, k, *_ in rows], pa.binary())
            made += -(-sum(lengths) // size)
            ids, codes, held = [], [], 0
            common.trim()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out), cut], names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                piece = batch.slice(i, 128)
                for doc_id, text in zip(piece.column(0).to_pylist(), encoder.encode_many(piece.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    codes.append(text + end)
                    held += len(text) // 4 + 1
                    if held >= group_sequences * size:
                        yield flush()
        if codes:
            yield flush()

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    group_sequences: int = GROUP_SEQUENCES,
) -> DataFrame:
    """One row per piece with its ids (unsigned, little-endian, 32 bits each). Every id lies in exactly one piece and
    sequences are filled without gaps. Sequence ids carry the partition's number in their upper half."""
    return common.map_arrow(common.texts(docs, id_col, text_col), _packer(tokenizer_path, sequence, end_id, group_sequences), PIECES, keeps=True)


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(docs if docs is not None else common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
