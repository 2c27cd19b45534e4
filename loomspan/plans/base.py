"""How queries are declared: SQL that both engines read, or a DataFrame function with its SQL twin.

Texts use a few spellings that differ between the engines: `PCT(x; p)` for an exact linear quantile, `DAYS(a; b)` for
days from b to a, `LASTNN(x)` for the last non-null value of a window. The market panels that the reference's operators
need are built from the order tables and the event stream (see VIEWS).

A sum of doubles depends on the order of its terms, which Spark leaves open; where a last digit decides a rank, a bucket or
a threshold, a query is declared `stored`: Spark then adds up each group in the order of the stored rows (see STORED).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Surrogate panels. ev: user by day; sup: supplier by month; prt: part by month; member: customer order intervals.
VIEWS = {
    "ev": "SELECT user_id AS asset_id, CAST(ts AS DATE) AS trade_date, avg(value) AS px, count(*) AS volume, sum(value) AS amount, max_by(event_type, event_id) AS state FROM events GROUP BY user_id, CAST(ts AS DATE)",
    "cal": "SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) AS BIGINT) AS k FROM (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events) d",
    "evr": "SELECT e.*, c.k, CASE WHEN lag(c.k) OVER (PARTITION BY e.asset_id ORDER BY e.trade_date) = c.k - 1 THEN px / nullif(lag(px) OVER (PARTITION BY e.asset_id ORDER BY e.trade_date), 0) - 1 END AS ret FROM ev e JOIN cal c ON c.trade_date = e.trade_date",
    "sup": "SELECT l.l_suppkey AS asset_id, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS trade_date, s.s_nationkey AS industry, n.n_regionkey AS board, sum(l.l_extendedprice) / sum(l.l_quantity) AS px, sum(l.l_extendedprice) AS cap, sum(l.l_quantity) AS vol, avg(l.l_discount) AS disc, count(*) AS trades FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY l.l_suppkey, CAST(date_trunc('month', l.l_shipdate) AS DATE), s.s_nationkey, n.n_regionkey",
    "mon": "SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) AS BIGINT) AS k FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date FROM lineitem) d",
    "supr": "SELECT p.*, m.k, p.px / nullif(lag(p.px) OVER (PARTITION BY p.asset_id ORDER BY p.trade_date), 0) - 1 AS ret, lag(p.cap) OVER (PARTITION BY p.asset_id ORDER BY p.trade_date) AS prior_cap FROM sup p JOIN mon m ON m.trade_date = p.trade_date",
    "prt": "SELECT l.l_partkey AS asset_id, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS trade_date, p.p_brand AS industry, p.p_type AS board, p.p_size AS size_code, sum(l.l_extendedprice) AS cap, sum(l.l_quantity) AS vol, avg(l.l_discount) AS disc, avg(l.l_tax) AS tax FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_partkey, CAST(date_trunc('month', l.l_shipdate) AS DATE), p.p_brand, p.p_type, p.p_size",
    "ord": "SELECT o_custkey AS asset_id, o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice, o_orderstatus, o_orderpriority FROM orders",
    "member": "SELECT asset_id, d AS from_d, lead(d) OVER (PARTITION BY asset_id ORDER BY d, o_orderkey) AS to_d, o_orderstatus AS label, o_orderkey FROM ord",
    "rev": "SELECT l_orderkey, l_linenumber, l_shipdate AS revision_at, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) AS BIGINT) AS rn FROM lineitem",
}

_EV = "PARTITION BY user_id, CAST(ts AS DATE) ORDER BY place"
_SUP = "PARTITION BY l.l_suppkey, CAST(date_trunc('month', l.l_shipdate) AS DATE), s.s_nationkey, n.n_regionkey ORDER BY l.place"

#: Spark's form of views for stored queries: running sums by place, of which the last row of each group stays.
STORED = {
    "ev": f"SELECT asset_id, trade_date, px, volume, amount, state FROM (SELECT user_id AS asset_id, CAST(ts AS DATE) AS trade_date, avg(value) OVER w AS px, count(*) OVER w AS volume, sum(value) OVER w AS amount, max_by(event_type, event_id) OVER w AS state, lead(place) OVER ({_EV}) IS NULL AS last FROM events_placed WINDOW w AS ({_EV} ROWS UNBOUNDED PRECEDING)) x WHERE last",
    "sup": f"SELECT asset_id, trade_date, industry, board, cap / vol AS px, cap, vol, disc, trades FROM (SELECT l.l_suppkey AS asset_id, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS trade_date, s.s_nationkey AS industry, n.n_regionkey AS board, sum(l.l_extendedprice) OVER w AS cap, sum(l.l_quantity) OVER w AS vol, avg(l.l_discount) OVER w AS disc, count(*) OVER w AS trades, lead(l.place) OVER ({_SUP}) IS NULL AS last FROM lineitem_placed l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey WINDOW w AS ({_SUP} ROWS UNBOUNDED PRECEDING)) x WHERE last",
}


def _needed(text: str) -> list[str]:
    """Views that a text reads, with those that they read, in order of definition."""
    found: set[str] = set()

    def add(t: str) -> None:
        for v, body in VIEWS.items():
            if v not in found and re.search(rf"\b(FROM|JOIN|ASOF JOIN|,)\s+{v}\b", t, re.I):
                found.add(v)
                add(body)

    add(text)
    return [v for v in VIEWS if v in found]


def _spelled(text: str, engine: str) -> str:
    spark = engine == "spark"
    text = re.sub(r"PCT\(([^;]*?); ?([0-9.]+)\)", r"percentile(\1, \2)" if spark else r"quantile_cont(\1, \2)", text)
    text = re.sub(r"DAYS\(([^;]*?); ?([^()]*(?:\([^()]*\))?[^()]*)\)", r"CAST(datediff(\1, \2) AS BIGINT)" if spark else r"date_diff('day', \2, \1)", text)
    return re.sub(r"LASTNN\(([^()]*)\)", r"last_value(\1) IGNORE NULLS" if spark else r"last_value(\1 IGNORE NULLS)", text)


def whole(text: str, engine: str, stored: bool = False) -> str:
    """The text with the views that it needs in front."""
    views = ", ".join(f"{v} AS ({(STORED if stored else VIEWS).get(v, VIEWS[v])})" for v in _needed(text))
    text = text.strip()
    if views:
        text = f"WITH {views}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {views} {text}"
    return _spelled(text, engine)


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place of each row in it: files by name, rows as they stand in them."""
    rows = table(spark, sf_dir, name)
    place = "_metadata.row_index" if len(rows.inputFiles()) < 2 else "struct(_metadata.file_path, _metadata.row_index)"
    return rows.selectExpr("*", f"{place} AS place")


def run_sql(spark: SparkSession, sf_dir: str, text: str, stored: bool = False) -> DataFrame:
    for t in TABLES:
        if re.search(rf"\b{t}\b", text) or any(re.search(rf"\b{t}\b", VIEWS[v]) for v in _needed(text)):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            if stored and any(f"{t}_placed" in STORED.get(v, "") for v in _needed(text)):
                placed(spark, sf_dir, t).createOrReplaceTempView(f"{t}_placed")
    return spark.sql(whole(text, "spark", stored))


def view(spark: SparkSession, sf_dir: str, name: str, stored: bool = False) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}", stored)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both(name: str, text: str, duck: str | None = None, stored: bool = False) -> None:
    """A query in SQL; duck is the twin where the dialects differ by more than spelling, stored adds up in the order of rows."""
    catalog.QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text, stored)
    catalog.SQL[name] = whole(duck or text, "duck")


def query(name: str, duck: str | None = None) -> Callable:
    """A query as a DataFrame function; without a twin only its rows can be checked."""

    def put(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        catalog.QUERIES[name] = function
        if duck:
            catalog.SQL[name] = whole(duck, "duck")
        return function

    return put
