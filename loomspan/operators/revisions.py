"""Revisioned tables: upserts, as-of reads, unions by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def as_of(df: DataFrame, key: list[str], clock: str, at, *ties: Column) -> DataFrame:
    """The newest revision of each key that was known at `at`."""
    return latest(df.where(F.col(clock) <= F.lit(at)), key, F.col(clock).desc(), *ties)


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert(base: DataFrame, delta: DataFrame, key: list[str], *ties: Column) -> DataFrame:
    """base with delta's rows in place of theirs."""
    return latest(stack(base.withColumn("_seq", F.lit(0)), delta.withColumn("_seq", F.lit(1))), key, F.col("_seq").desc(), *ties).drop("_seq")
