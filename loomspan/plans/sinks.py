"""Sinks (survey 2.1): each query writes a table to a new shared folder and returns what a reader finds there."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.plans.base import query, table, view
from loomspan.sources import files


@query("parquet_atomic_sink", "SELECT * FROM customer")
def parquet_atomic_sink(spark, sf_dir):
    path = files.shared_folder(spark, "atomic")
    files.write_once(table(spark, sf_dir, "customer"), path)
    return spark.read.parquet(path)


@query("copy_to_parquet_sink", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def copy_to_parquet_sink(spark, sf_dir):
    path = files.shared_folder(spark, "copy")
    files.write_once(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), path)
    return spark.read.parquet(path)


@query("immutable_parquet_sink", "SELECT TRUE AS same_content, TRUE AS second_write_refused")
def immutable_parquet_sink(spark, sf_dir):
    """A path is written once; the same rows again are told by a checksum that does not depend on their order."""
    rows, path = table(spark, sf_dir, "part"), files.shared_folder(spark, "immutable")
    files.write_once(rows, path)
    try:
        files.write_once(rows.limit(0), path)
        refused = False
    except Exception as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        refused = True
    stored, given = files.content(spark.read.parquet(path)), files.content(rows)
    return stored.join(given, ["n", "checksum"], "full_outer").agg((F.count("*") == 1).alias("same_content")).withColumn("second_write_refused", F.lit(refused))


@query("date_partitioned_sink", "SELECT trade_date, count(*) AS n, round(sum(cap), 2) AS cap FROM sup GROUP BY trade_date")
def date_partitioned_sink(spark, sf_dir):
    path = files.shared_folder(spark, "by-date")
    files.write_by_date(view(spark, sf_dir, "sup"), path, "trade_date")
    return spark.read.parquet(path).groupBy("trade_date").agg(F.count("*").alias("n"), F.round(F.sum("cap"), 2).alias("cap"))


@query("month_chunk_compaction", "SELECT date_trunc('month', ts) AS month, event_type, count(*) AS n FROM events GROUP BY date_trunc('month', ts), event_type")
def month_chunk_compaction(spark, sf_dir):
    """All months in one job, each in its own folder; nothing in a part depends on another part's rows."""
    path = files.shared_folder(spark, "months")
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), "event_type").agg(F.count("*").alias("n"))
    files.write_by_date(rows.withColumn("chunk", F.date_format("month", "yyyyMM")), path, "chunk")
    return spark.read.parquet(path).drop("chunk")


@query("silver_replace", "SELECT n_nationkey, n_name FROM nation")
def silver_replace(spark, sf_dir):
    path = files.shared_folder(spark, "replace")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    files.replace(nation.where("n_nationkey < 5"), path)
    files.replace(nation, path)
    return spark.read.parquet(path)


def _envelopes(spark, sf_dir) -> str:
    path = files.shared_folder(spark, "envelopes")
    files.write_envelopes(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("api"), F.struct("s_suppkey", "s_name").alias("item")), path, "2025-01-02")
    return path


_ENVELOPE = "api string, item struct<s_suppkey: bigint, s_name: string>"


@query("bronze_write", "SELECT 'supplier' AS api, DATE '2025-01-02' AS ingest_date, count(*) AS n FROM supplier")
def bronze_write(spark, sf_dir):
    return spark.read.schema(_ENVELOPE + ", ingest_date date").json(_envelopes(spark, sf_dir)).groupBy("api", "ingest_date").agg(F.count("*").alias("n"))


@query("bronze_replay", "SELECT s_suppkey, s_name FROM supplier")
def bronze_replay(spark, sf_dir):
    return files.replay_envelopes(spark, _envelopes(spark, sf_dir), _ENVELOPE).select("item.*")


@query("bronze_listing", "SELECT count(*) AS n, TRUE AS gzip FROM supplier")
def bronze_listing(spark, sf_dir):
    found = files.replay_envelopes(spark, _envelopes(spark, sf_dir), _ENVELOPE).groupBy("object").agg(F.count("*").alias("n"))
    return found.agg(F.sum("n").alias("n"), F.bool_and(F.col("object").endswith(".json.gz")).alias("gzip"))


@query("catalog_refresh", "SELECT r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def catalog_refresh(spark, sf_dir):
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"catalog_{name}")
    return spark.sql("SELECT r_name, count(*) AS n FROM catalog_nation JOIN catalog_region ON r_regionkey = n_regionkey GROUP BY r_name")


@query("artifact_adoption_scan", "SELECT o_orderkey, o_totalprice, 'r1' AS run_id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
def artifact_adoption_scan(spark, sf_dir):
    """A run written elsewhere, taken up by its id: filter and columns reach the scan."""
    path = files.shared_folder(spark, "artifact")
    files.write_once(table(spark, sf_dir, "orders"), f"{path}/run_id=r1")
    return spark.read.parquet(path).where("run_id = 'r1' AND o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'").select("o_orderkey", "o_totalprice", "run_id")
