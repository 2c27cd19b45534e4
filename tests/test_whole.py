"""Queries over all ids against brute force on the smallest tables."""

import bisect
from collections import defaultdict

import duckdb

from loomspan import catalog, plans

assert plans


def _rows(sf, text):
    return duckdb.sql(text.replace("{sf}", sf)).fetchall()


def _months(sf):
    return [m for (m,) in _rows(sf, "SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) m FROM '{sf}/lineitem.parquet' ORDER BY m")]


def _panel(sf):
    out = defaultdict(lambda: [0, 0])
    for k, m, price, n in _rows(sf, "SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE), l_extendedprice, l_quantity FROM '{sf}/lineitem.parquet'"):
        out[k, m][0] += price
        out[k, m][1] += n
    return out


def _suppliers(sf):
    return [k for (k,) in _rows(sf, "SELECT s_suppkey FROM '{sf}/supplier.parquet'")]


def test_open_rank_of_every_order(spark, sf):
    months = _months(sf)
    orders = _rows(sf, "SELECT o_orderkey, CAST(o_orderdate AS DATE) FROM '{sf}/orders.parquet'")
    want = {(o, bisect.bisect_left(months, d) + 1) for o, d in orders if d <= months[-1]}
    assert {tuple(r) for r in catalog.QUERIES["calendar_range_join"](spark, sf).collect()} == want
    assert len({o for o, _ in want if o % 10}) > 0


def test_every_supplier_without_a_price(spark, sf):
    panel = _panel(sf)
    want = {(m, k) for m in _months(sf) for k in _suppliers(sf) if (k, m) not in panel}
    got = [tuple(r) for r in catalog.QUERIES["not_exists_subquery"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_batch_of_all_suppliers(spark, sf):
    want = defaultdict(int)
    for (k, _), (cap, vol) in _panel(sf).items():
        want[k] += vol > 20 or cap > 40000
    got = {r["s_suppkey"]: r["n"] for r in catalog.QUERIES["bse_transfer_batch"](spark, sf).collect()}
    assert got == {k: n for k, n in want.items() if n} and any(k % 5 for k in got)
