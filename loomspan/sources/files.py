"""Reading and writing: typed reads, union by name, atomic and partitioned sinks, gzip JSON envelopes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at path, or a typed empty one where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_merged(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*paths)


def write_once(df: DataFrame, path: str) -> None:
    """Fails where the path exists: published tables don't change."""
    df.write.option("compression", "zstd").mode("errorifexists").parquet(path)


def write_by_date(df: DataFrame, path: str, column: str) -> None:
    """One folder per date, each written by few tasks."""
    df.repartition(column).write.option("compression", "zstd").partitionBy(column).mode("errorifexists").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    if df.isEmpty():
        raise ValueError("an empty table doesn't replace another")
    df.write.mode("overwrite").parquet(path)


def write_envelopes(df: DataFrame, path: str, ingested: str) -> None:
    df.withColumn("ingest_date", F.lit(ingested)).write.partitionBy("ingest_date").json(path, compression="gzip")


def replay_envelopes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path).withColumn("object", F.col("_metadata.file_path"))


def columns_like(df: DataFrame, prefix: str, kind: str = "double") -> list[str]:
    return [f.name for f in df.schema.fields if f.name.startswith(prefix) and f.dataType.typeName() == kind]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name where all machines of the cluster can read; local only where spark.checkpoint.dir is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomspan/{label}-{uuid.uuid4().hex}"


def content(df: DataFrame) -> DataFrame:
    """Row count and a checksum of all columns that does not depend on the rows' order."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("checksum"))
