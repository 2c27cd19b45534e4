"""Scans and stream extras (survey 2.1, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.plans.base import both, query, table
from loomspan.streaming.events import windowed_counts

both("parquet_full_read", "SELECT * FROM region")
both("parquet_lazy_scan_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'")
both("parquet_sql_scan", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")


@query("parquet_multi_file_union_by_name", "SELECT n_nationkey, n_name, n_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_regionkey, r_name FROM region")
def parquet_multi_file_union_by_name(spark, sf_dir):
    return table(spark, sf_dir, "nation").unionByName(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), allowMissingColumns=True)


@query("parquet_schema_probe", "SELECT l_discount, l_extendedprice, l_quantity, l_tax FROM lineitem")
def parquet_schema_probe(spark, sf_dir):
    from loomspan.sources.files import columns_like

    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*sorted(columns_like(rows, "l_")))


@query("rows_to_frame", "SELECT 1::BIGINT AS k, 'a' AS name UNION ALL SELECT 2, NULL")
def rows_to_frame(spark, sf_dir):
    return spark.createDataFrame([(1, "a"), (2, None)], "k long, name string")


@query("column_backfill_on_read", "SELECT n_nationkey, n_name, 0.0::DOUBLE AS risk_new FROM nation")
def column_backfill_on_read(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = spark.createDataFrame([], "n_nationkey int, n_name string, risk_new double")
    return old.unionByName(new, allowMissingColumns=True).fillna({"risk_new": 0.0})


both("bronze_replay_rebuild", "SELECT event_id, user_id, value FROM (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1")
both("copy_union_by_name", "SELECT asset_id, trade_date, round(px, 6) AS px FROM ev WHERE volume > 1 UNION ALL SELECT asset_id, trade_date, round(px, 6) FROM ev WHERE volume = 1")


@query("stream_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY date_trunc('day', ts), event_type")
def stream_windowed_counts(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
