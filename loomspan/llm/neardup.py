"""Near-duplicate groups: HyperMinHash registers, banding, corrected estimate, then proof on full shingle sets.

A text's set holds its distinct runs of `n` words. One 64-bit fingerprint per run gives the bucket (its high part) and,
as the least fingerprint in a bucket, the register: 6 bits of leading-zero count and 10 mantissa bits. A bucket without
a run borrows from the first that has one in the bucket's own fixed order, so that registers of two sets agree as often
as their sets overlap, however small. Five registers make a band, 28 bands a sketch: two sets of similarity 0.8 share no
band with probability 1.5e-5, less for more similar ones.

Texts with one set are one class, and only its least id goes on. Sets of up to three runs can't reach 4/5 unless equal,
so they are not banded. In each band bucket the members are paired with its least id, the hub; each class is first tested
against the hub that it meets most often. Classes that resemble a hub then form clusters. A cluster that is not one
component by now is compared as a whole: the sets of its largest component and all others are dealt to blocks, every block
of others meets all blocks in one task each, and only links that join two components leave it. A family whose copies all
link to their hub costs nothing more; one with m texts outside of its largest component of n costs (n + m) * m / BLOCK rows. Classes of different clusters
that share a bucket by chance are tested one by one. Every accepted pair has been compared by its full sets.

Defined results: empty or null texts and texts of white space have an empty set and are linked with nothing; rows with a
null id have a null component and are kept; rows with the same id are one document, linked by their id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm import common, graph, wordhash

BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Part of the registers that agree by chance, times 2 ** MANTISSA, for sets of equal size.
CHANCE = 0.169919487159739
#: An estimate that is lower than the threshold by this is five standard deviations off.
MARGIN = 0.17
#: An estimate from which on a class belongs to its hub's cluster, and classes in a block of a cluster.
ALIKE, BLOCK = 0.4, 1024
#: A class that holds over a HEAVY-th of all documents is joined to its members by broadcast.
HEAVY = 10_000
#: Ids of texts to compare: up to so many (8 MB) are broadcast to the scan, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, registers binary"


def _orders() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(77))
    return np.stack([np.concatenate([[j], rng.permutation(np.delete(np.arange(REGISTERS), j))]) for j in range(REGISTERS)])


_ORDERS = _orders()
_EDGES = np.array([-(-(b << 32) // REGISTERS) << 32 for b in range(REGISTERS)], dtype=np.uint64)


def registers(prints: np.ndarray) -> bytes:
    """The sketch of a sorted, non-empty set of fingerprints."""
    at = np.searchsorted(prints, _EDGES)
    after = np.append(at[1:], len(prints))
    full = at < after
    least = prints[np.minimum(at, len(prints) - 1)]
    low = ((least >> np.uint64(32)) * np.uint64(REGISTERS)) & np.uint64(0xFFFFFFFF)
    x = ((low << np.uint64(32)) | (least & np.uint64(0xFFFFFFFF))) >> np.uint64(11)
    zeros = 53 - np.frexp(x.astype(np.float64))[1].astype(np.int64)
    mantissa = ((x << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 53) - 1)) >> np.uint64(53 - MANTISSA)
    values = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype("<u2")
    if not full.all():
        source = _ORDERS[np.arange(REGISTERS), np.argmax(full[_ORDERS], axis=1)]
        values = values[source]
    return values.tobytes()


def _sketcher(n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, a, b, regs = [], [], [], []
            for s in wordhash.shingle_sets(batch.column(1), n):
                size.append(len(s))
                m = wordhash.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                a.append(np.add.reduce(m))
                b.append(np.bitwise_xor.reduce(s) if len(s) else np.uint64(0))
                regs.append(registers(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "registers"],
            )

    return sketch


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Similarity of sketches, row by row, less what agrees by chance at those set sizes."""
    ratio = nx / ny
    chance = CHANCE * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return ((x == y).mean(axis=1) - chance) / (1 - chance)


def _scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in ("ra", "rb"))
            nx, ny = (batch.column(k).to_numpy().astype(float) for k in ("na", "nb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(estimate(x, y, nx, ny))], names=["a", "b", "likeness"])


def _proof(n: int, percent: int):
    def proof(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(wordhash.shingle_sets(batch.column(2), n), wordhash.shingle_sets(batch.column(3), n), strict=True):
                both = len(x) + len(y)
                shared = both - len(np.union1d(x, y))
                linked.append(100 * shared >= percent * (both - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return proof


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every two sets, by products of 0/1 matrices over `width` values at a time."""
    values, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = np.array([len(x) for x in (*left, *right)])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(values), width):
        i, j = np.searchsorted(codes, [first, first + width])
        dense = np.zeros((len(sizes), width), np.float32)
        dense[rows[i:j], codes[i:j] - first] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in wordhash.shingle_sets(batch.column(1), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "prints"])

    return sets


def _block_links(percent: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks: a link for each two components that have one."""
        group = group.sort_values(["block", "rep"])
        inner = group["lo"].iloc[0] == group["hi"].iloc[0]
        x = group if inner else group[group["block"] == group["lo"]]
        y = group if inner else group[group["block"] == group["hi"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"u": [], "v": []})
        a, b = ([np.frombuffer(v, np.uint64) for v in side["prints"]] for side in (x, y))
        both = np.array([len(v) for v in a])[:, None] + np.array([len(v) for v in b])[None, :]
        shared = shared_counts(a, b).astype(np.int64)
        i, j = np.nonzero((100 * shared >= percent * (both - shared)) & (x["part"].to_numpy()[:, None] != y["part"].to_numpy()[None, :]))
        out = pd.DataFrame({"u": x["rep"].to_numpy()[i], "v": y["rep"].to_numpy()[j], "p": x["part"].to_numpy()[i], "q": y["part"].to_numpy()[j]})
        return out.drop_duplicates(["p", "q"])[["u", "v"]]

    return links


def _scored(pairs: DataFrame, reps: DataFrame, label: str) -> DataFrame:
    """(a, b, likeness) of the pairs, by their registers."""
    marks = reps.select(F.col("rep").alias("id"), "n_shingles", "registers")
    wide = pairs.join(marks.toDF("a", "na", "ra"), "a").join(marks.toDF("b", "nb", "rb"), "b")
    return common.settle(common.map_arrow(wide, _scorer, "a long, b long, likeness double"), f"{label}-scored")


def _texts(ids: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """docs of the ids (doc_id), settled."""
    ids = common.settle(ids.distinct(), f"{label}-ids")
    return common.settle(docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id"), f"{label}-texts")


def _proved(pairs: DataFrame, docs: DataFrame, n: int, percent: int, label: str) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the threshold, as edges (u, v)."""
    found = _texts(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, label)
    both = pairs.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b")
    links = common.map_arrow(both.select("a", "b", "text_a", "text_b"), _proof(n, percent), "a long, b long")
    return common.settle(links.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{label}-links")


def _in_clusters(members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """members: (cluster, rep, part). Edges (u, v) between components of one cluster. Members of a cluster's largest
    component are dealt to blocks numbered from 0 down, all others from 1 up; every other block meets all blocks, so that
    the large component is never compared with itself and is read once for each BLOCK of the others."""
    parts = members.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    largest = parts.groupBy("cluster").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m"), F.sum("n").alias("all"))
    largest = largest.select("cluster", (-F.col("m.p")).alias("main"), F.col("m.n").alias("inside"), (F.col("all") - F.col("m.n")).alias("others")).where("others > 0")
    blocks = F.ceil(F.when(F.col("part") == F.col("main"), F.col("inside")).otherwise(F.col("others")) / BLOCK).cast("int")
    open_ = members.join(largest, "cluster").select("cluster", "rep", "part", (F.col("part") == F.col("main")).alias("in_main"), blocks.alias("own"), F.ceil(F.col("others") / BLOCK).cast("int").alias("rest"))
    dealt = F.pmod(F.xxhash64("rep"), F.col("own")).cast("int")
    open_ = common.settle(open_.withColumn("block", F.when(F.col("in_main"), -dealt).otherwise(dealt + 1)), "near-clusters")
    texts = _texts(open_.select(F.col("rep").alias("doc_id")), docs, "near-clusters")
    sets = common.map_arrow(texts.select("doc_id", "text"), _sets(n), "rep long, prints binary")
    main_blocks = open_.where("in_main").groupBy("cluster").agg(F.max("own").alias("mains"))
    # a block of others meets every block: those of the largest component, and the others' own
    other = F.when(F.col("in_main"), F.sequence(F.lit(1), F.col("rest"))).otherwise(F.sequence(1 - F.col("mains"), F.col("rest")))
    met = open_.join(main_blocks, "cluster").join(sets, "rep").withColumn("other", F.explode(other))
    met = met.select("cluster", "rep", "part", "prints", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return common.settle(met.groupBy("cluster", "lo", "hi").applyInPandas(_block_links(percent), "u long, v long"), "near-cluster-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    docs = common.texts(docs, id_col, text_col)
    sketch = common.settle(common.map_arrow(docs, _sketcher(n), SKETCH), "near-sketch")
    keys = ["n_shingles", "set_a", "set_b"]
    linkable = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = common.settle(linkable.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("of")), "near-classes")
    most = sketch.count() // HEAVY
    heavy = F.broadcast(classes.where(F.col("of") > most).drop("of"))  # under HEAVY rows by count; a class of many copies needs no shuffle
    light = classes.where(F.col("of") <= most).drop("of")
    rows = linkable.select("doc_id", *keys, "registers")
    member = common.settle(rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys)), "near-member")
    reps = common.settle(member.where("doc_id = rep").select("rep", "n_shingles", "registers").dropDuplicates(["rep", "n_shingles", "registers"]), "near-reps")
    member = member.select("doc_id", "rep")
    first_of = member.groupBy("doc_id").agg(F.min("rep").alias("first"))
    same_id = member.join(first_of, "doc_id").where("rep <> first").select(F.col("rep").alias("u"), F.col("first").alias("v"))

    width = 2 * ROWS
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("registers", 1 + b * width, width)) for b in range(BANDS)))
    banded = reps.where("n_shingles > 3").select("rep", "n_shingles", F.explode(bands).alias("key"))
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("key", "hub")
    met = common.settle(banded.join(hubs, "key"), "near-met")
    tried = met.where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    best = Window.partitionBy("rep").orderBy(F.desc("n"), "hub")
    first_pairs = tried.withColumn("k", F.row_number().over(best)).where("k = 1").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    scored = _scored(first_pairs, reps, "near-hub")
    links = _proved(scored.where(F.col("likeness") >= percent / 100 - MARGIN).select("a", "b"), docs, n, percent, "near-hub")
    found = links.unionByName(same_id)
    parts = common.settle(graph.components(found, "near-graph"), "near-parts")

    alike = scored.where(F.col("likeness") >= ALIKE).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(tried.where("n > 1").select(F.col("hub").alias("u"), F.col("rep").alias("v")))
    clusters = graph.components(alike, "near-alike").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    part_of = parts.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    members = common.settle(clusters.join(part_of, "rep", "left").select("cluster", "rep", F.coalesce("part", "rep").alias("part")), "near-members")
    inner = _in_clusters(members, docs, n, percent)

    placed = met.join(members, "rep", "left").join(part_of.withColumnRenamed("part", "own"), "rep", "left")
    placed = placed.select("key", "rep", "n_shingles", F.coalesce("part", "own", "rep").alias("part"), F.coalesce("cluster", "rep").alias("cluster"))
    mixed = placed.groupBy("key").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x <> y").select("key")
    open_ = common.settle(placed.join(mixed, "key", "left_semi"), "near-open")
    left, right = open_.toDF("key", "a", "na", "pa", "ca"), open_.toDF("key", "b", "nb", "pb", "cb")
    rest = left.join(right, "key").where("ca <> cb and pa <> pb and a < b and 100 * least(na, nb) >= %d * greatest(na, nb)" % percent).select("a", "b").distinct()
    rest = _scored(rest, reps, "near-rest").where(F.col("likeness") >= percent / 100 - MARGIN).select("a", "b")
    outer = _proved(rest, docs, n, percent, "near-rest")
    more = inner.unionByName(outer)
    parts = graph.components(found.unionByName(more), "near-graph") if more.take(1) else parts

    of_id = first_of.join(parts.withColumnRenamed("node", "first"), "first", "left").select("doc_id", F.coalesce("component", "first").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles").join(of_id, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op3_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    return near_duplicates(docs if docs is not None else common.table(spark, sf_dir, "documents"))
