"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import common


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """edges: (u, v) of longs. Returns (node, component), the component being its least node, for every node of an edge.

    Alternates large-star and small-star steps until nothing changes; each step is an aggregate and a join on a node, so
    that a node with very many edges is summed before it is shuffled and its join can be split. Each round ends in a
    written table, and only its count and checksum reach the driver.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = common.settle(pairs, label)
    before = _state(pairs)
    while before[0]:
        wide = _both_ways(pairs)
        least = wide.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = wide.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = common.settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        after = _state(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
