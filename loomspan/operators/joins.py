"""Joins that Spark has no single operator for: as-of, interval, checked, next-open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool = True, forward: bool = False, prefix: str = "asof_") -> DataFrame:
    """Each left row with the latest right row of its key before it (at it too unless strict); forward: the earliest
    after it. One shuffle: both sides are stacked and the last right row is carried along the window, so the work is
    linear however many right rows a key has. Unmatched rows have nulls; ties on the right go to the greatest values."""
    carried = F.struct(F.col(on), *(F.col(v) for v in values))
    rows = left.select(F.struct("*").alias("l"), *by, F.col(on).alias("t"), F.lit(None).cast(right.select(carried.alias("r")).schema["r"].dataType).alias("r"), F.lit(0 if strict == (not forward) else 1).alias("side"))
    facts = right.where(F.col(on).isNotNull()).select(F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("l"), *by, F.col(on).alias("t"), carried.alias("r"), F.lit(1 if strict == (not forward) else 0).alias("side"))
    order = [F.col("t"), F.col("side"), F.col("r")]
    if forward:
        order = [F.col("t").desc(), F.col("side").desc(), F.col("r").desc()]
        rows, facts = rows.withColumn("side", F.lit(1 if strict else 0)), facts.withColumn("side", F.lit(0 if strict else 1))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.unionByName(facts).withColumn("m", F.last("r", ignorenulls=True).over(w)).where(F.col("l").isNotNull())
    return out.select("l.*", *(F.col(f"m.{c}").alias(f"{prefix}{c}") for c in [on, *values]))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, end: str, closed: bool = False, bucket_days: int = 64) -> DataFrame:
    """Rows of left with the right rows whose interval holds left.at; an open end is null. Both sides are cut into
    buckets of days, so that a long history of one key doesn't meet all of its rows; a right row is repeated for every
    bucket it spans within the dates of left."""
    bounds = left.agg(F.max(at).alias("hi"))
    day = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bucket_days)
    last = F.least(F.coalesce(F.col(end), F.col("hi")), F.col("hi"))
    spans = right.crossJoin(F.broadcast(bounds)).where(F.col(start) <= F.col("hi"))  # one row
    spans = spans.withColumn("_b", F.explode(F.sequence(day(F.col(start)), F.greatest(day(F.col(start)), day(last))))).drop("hi")
    joined = left.withColumn("_b", day(F.col(at))).join(spans, [*by, "_b"]).drop("_b")
    before = (F.col(end) >= F.col(at)) if closed else (F.col(end) > F.col(at))
    return joined.where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | before))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join whose keys are asserted unique on the right (m:1) or on both sides (1:1): a repeated key fails the job."""

    def unique(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*on))
        return df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated key on the {side}"))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")

    return (unique(left, "left") if validate == "1:1" else left).join(unique(right, "right"), on, how)


def changed_rows(new: DataFrame, old: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of new that old lacks or holds with another value, null-safe."""
    before = old.select(*key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    differs = ~F.lit(True)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(before, key, "left").where(F.col("_there").isNull() | differs).select(*new.columns)
