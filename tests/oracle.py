"""Compares a query's rows with those of its SQL twin."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else 0.0 if x == 0 else float(f"{x:.10g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def difference(df, con, sql) -> str:
    """Empty if they agree."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    want = rows([d[0] for d in con.description], con.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if got[1] == want[1]:
        return ""
    return f"{sum(got[1].values())} rows against {sum(want[1].values())}; only here {list((got[1] - want[1]).items())[:2]}; only there {list((want[1] - got[1]).items())[:2]}"
