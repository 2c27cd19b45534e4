"""The corpus pipeline: quality rules, near-duplicates, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns; the last returns the
pieces of training sequences. SQL can't express the hashed weights, the sketches or the tokenizer, so the tests hold each
stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common
from loomspan.llm.decontaminate import decontaminate
from loomspan.llm.neardup import near_duplicates
from loomspan.llm.packing import op7_cost_balanced_packing
from loomspan.llm.pii import redact
from loomspan.llm.quality import quality

#: Ids of dropped documents: up to so many (8 MB) are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality(docs, common.table(spark, sf_dir, "labels"), keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least id. Where ids are null or repeat, rows stand for themselves:
    of equal rows one stays, whatever their ids. Texts without words are in no group."""
    named = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").take(1)
    names = docs.columns
    if not named:
        docs = common.settle(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.struct(*(F.col(c) for c in names)).alias("d")), "near-rows")
    gone = common.settle(near_duplicates(docs, n=5).where("not kept").select("doc_id").distinct(), "near-gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    return kept.select(*names) if named else kept.select(*(F.col(f"d.{c}").alias(c) for c in names))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_cost_balanced_packing(spark, sf_dir, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each one's result is written and read again before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
