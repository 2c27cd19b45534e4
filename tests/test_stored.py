"""Queries whose ranks, buckets and thresholds stand on last digits, on tables that Spark reads in many parts."""

import shutil

import duckdb
import pytest

from loomspan import catalog, plans
from tests.oracle import TABLES, connection, difference

assert plans
SMALL = "/root/testdata/sf0.01"
EVENTS = ("arg_max", "audit_universe_flags", "bucket_larger_first")
SUPPLIERS = ("liquidity_groups", "quintile_spread", "rank_lag_panel")


@pytest.fixture(scope="module")
def parted(tmp_path_factory):
    """Days of one mean and prices that stand twice, scattered over row groups."""
    top = tmp_path_factory.mktemp("parted")
    for t in set(TABLES) - {"events", "lineitem", "supplier"}:
        shutil.copy(f"{SMALL}/{t}.parquet", top)
    put = f"TO '{top}/{{}}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)"
    value = "CAST(30 + (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * ((i // 2) * 7 % 10 + u % 10) / 10.0 AS DOUBLE)"
    rows = f"SELECT u * 1000 + d * 100 + i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (d) DAY AS ts, u AS user_id, 'view' AS event_type, {value} AS value FROM range(200) a(u), range(4) b(d), range(14) c(i)"
    duckdb.sql(f"COPY (SELECT * FROM ({rows}) ORDER BY hash(event_id)) {put.format('events')}")
    duckdb.sql(f"COPY (SELECT * FROM '{SMALL}/supplier.parquet' UNION ALL SELECT * REPLACE (s_suppkey + 1000 AS s_suppkey) FROM '{SMALL}/supplier.parquet') {put.format('supplier')}")
    duckdb.sql(f"COPY (SELECT * REPLACE (l_suppkey + 1000 * i AS l_suppkey) FROM '{SMALL}/lineitem.parquet', range(2) r(i) ORDER BY i, hash(l_orderkey, l_linenumber, l_extendedprice)) {put.format('lineitem')}")
    return str(top)


@pytest.fixture()
def split(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("name", EVENTS + SUPPLIERS)
def test_sums_follow_the_stored_rows(split, parted, name):
    con = connection(parted)
    con.execute("SET threads=1")
    assert difference(catalog.QUERIES[name](split, parted), con, catalog.SQL[name]) == ""


@pytest.mark.parametrize("name", EVENTS)
def test_files_stand_in_the_order_of_their_names(split, parted, tmp_path, name):
    (tmp_path / "events.parquet").mkdir()
    for k, (lo, hi) in enumerate(((0, 1000), (1000, 9000), (9000, 11200))):
        duckdb.sql(f"COPY (SELECT * EXCLUDE (file_row_number) FROM read_parquet('{parted}/events.parquet', file_row_number = true) WHERE file_row_number >= {lo} AND file_row_number < {hi} ORDER BY file_row_number) TO '{tmp_path}/events.parquet/part-{k}.parquet' (FORMAT parquet)")
    got, want = (sorted(map(tuple, catalog.QUERIES[name](split, d).collect())) for d in (str(tmp_path), parted))
    assert got == want
