"""Quality rules: counts per text, and a hashed n-gram likelihood ratio between trusted and raw text.

Words and word pairs are hashed into BUCKETS buckets. Their counts over all documents make the raw multinomial, those
over the documents that the labels call good the target one, both smoothed. A document's score is the mean over its
n-grams of log target minus log raw probability; it is kept from THRESHOLD on, if the base rules pass.

Only built-in functions. Counting is one aggregate over a bounded key range, summed before its shuffle; the weights, one
number for each bucket, go back into the plan as a literal, and scoring needs no shuffle at all.

Defined results: a null text has no words; texts under ten words fail the base rules; null ids stay null; repeated rows
are scored one by one; without trusted documents every score is 0 and only the base rules decide; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common
from loomspan.llm.spans import let

BUCKETS = 8192
SMOOTHING = 1.0
THRESHOLD = -0.1
#: Ids of trusted documents: up to so many (8 MB) are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(h: Column) -> Column:
    """Buckets of the words and of the pairs of adjacent words."""
    mask = F.lit(BUCKETS - 1).cast("long")
    pair = lambda x, y: F.shiftleft(x, 1).bitwiseXOR(y).bitwiseAND(mask)
    pairs = F.when(F.size(h) > 1, F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), pair)).otherwise(F.array().cast("array<long>"))
    return F.concat(F.transform(h, lambda x: x.bitwiseAND(mask)), pairs)


def weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """docs: (doc_id, text); trusted: (doc_id), distinct. Log ratio of each bucket; all 0 without trusted documents."""
    few = trusted.count() <= BROADCAST_IDS
    marked = docs.join(F.broadcast(trusted) if few else trusted, "doc_id", "left").select(F.coalesce("good", F.lit(0)).alias("good"), _hashed(words_of(F.col("text"))).alias("h"))
    grams = marked.select("good", F.explode_outer(_grams(F.col("h"))).alias("bucket")).where("bucket is not null")
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0.0] * BUCKETS
    level = math.log((all_raw + SMOOTHING * BUCKETS) / (all_target + SMOOTHING * BUCKETS))
    return [round(math.log((t + SMOOTHING) / (r + SMOOTHING)) + level, 6) for r, t in zip(raw, target, strict=True)]


def _repeat_words(h: Column, n: int = 5) -> Column:
    """Words inside n-word windows that occur twice or more. Most texts have none, which their distinct count tells."""
    last = F.size(h) - (n - 1)
    window = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n)))
    return F.when(last > 1, F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), window)).otherwise(F.array().cast("array<long>"))


def _covered(windows: Column, n: int = 5) -> Column:
    """Words covered by the windows whose value occurs again: sort by value, keep those beside an equal one, and
    sum the steps between their starts, each n at most."""
    tagged = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    equal = lambda s, x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
    beside = lambda s: F.transform(F.filter(s, lambda x, k: equal(s, x, k - 1) | equal(s, x, k + 1)), lambda x: x["i"])
    rest = lambda s: F.greatest(F.size(s) - 1, F.lit(0))
    steps = lambda s: F.zip_with(F.slice(s, 1, rest(s)), F.slice(s, 2, rest(s)), lambda a, b: F.least(b - a, F.lit(n)))
    starts = let(tagged, lambda s: F.array_sort(beside(s)))
    return let(starts, lambda s: F.aggregate(steps(s), F.lit(n).cast("long"), lambda acc, x: acc + x))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept of each row; with keep, docs' own rows that are kept, all columns."""
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", F.lit(1).alias("good"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = weights(rows, trusted)
    table = F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")
    columns = [F.struct(*(F.col(c) for c in docs.columns)).alias("d")] if keep else []
    wide = docs.select(*columns, F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    wide = wide.select("*", words_of(F.col("text")).alias("words"))
    wide = wide.select("*", _hashed(F.col("words")).alias("h"))
    wide = wide.select("*", _repeat_words(F.col("h")).alias("windows"), _grams(F.col("h")).alias("grams"))
    lines = F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(table, g.cast("int")))
    out = wide.select(
        *(["d"] if keep else []),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(again, _covered(F.col("windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.when(F.size("grams") > 0, F.round(total / F.size("grams"), 6)).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = ~failed & (F.col("score") >= threshold)
    if keep:  # a filter on a plain verdict would be pushed below the columns that it is made of, and compute them again
        verdict = verdict & (F.monotonically_increasing_id() >= 0)
    out = out.withColumn("base_failed", failed).withColumn("kept", verdict)
    return out.where("kept").select(*(F.col(f"d.{c}").alias(c) for c in docs.columns)) if keep else out


def op5_likelihood_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
