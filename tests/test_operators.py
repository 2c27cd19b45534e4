"""Joins, revisions, algebra and accounting on hand-made rows."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from loomspan.functions import dense
from loomspan.operators.joins import asof_join, checked_join, interval_join
from loomspan.operators.revisions import as_of, stack, upsert
from loomspan.plans.crosssection import decompose
from loomspan.plans.paths import fold_account
from loomspan.sources import files

D = dt.date


def test_asof_strict_and_not(spark):
    left = spark.createDataFrame([("a", D(2025, 1, 2)), ("a", D(2025, 1, 1)), ("b", D(2025, 1, 2)), (None, D(2025, 1, 2))], "k string, d date")
    right = spark.createDataFrame([("a", D(2025, 1, 1), 1.0), ("a", D(2025, 1, 2), 2.0), ("a", None, 9.0)], "k string, d date, v double")
    got = {(r["k"], r["d"]): r["asof_v"] for r in asof_join(left, right, ["k"], "d", ["v"]).collect()}
    assert got == {("a", D(2025, 1, 2)): 1.0, ("a", D(2025, 1, 1)): None, ("b", D(2025, 1, 2)): None, (None, D(2025, 1, 2)): None}
    got = {(r["k"], r["d"]): r["asof_v"] for r in asof_join(left, right, ["k"], "d", ["v"], strict=False).collect()}
    assert got[("a", D(2025, 1, 2))] == 2.0 and got[("a", D(2025, 1, 1))] == 1.0


def test_asof_forward(spark):
    left = spark.createDataFrame([("a", D(2025, 1, 1)), ("a", D(2025, 1, 3))], "k string, d date")
    right = spark.createDataFrame([("a", D(2025, 1, 1), 1), ("a", D(2025, 1, 2), 2)], "k string, d date, v int")
    got = {r["d"]: r["asof_v"] for r in asof_join(left, right, ["k"], "d", ["v"], strict=True, forward=True).collect()}
    assert got == {D(2025, 1, 1): 2, D(2025, 1, 3): None}


@pytest.mark.parametrize("closed,want", [(False, {(1, "y")}), (True, {(1, "x"), (1, "y")})])
def test_interval_conventions(spark, closed, want):
    left = spark.createDataFrame([("a", D(2023, 7, 1), 1)], "k string, d date, i int")
    right = spark.createDataFrame([("a", D(2020, 1, 1), D(2023, 7, 1), "x"), ("a", D(2023, 7, 1), None, "y"), ("a", D(2024, 1, 1), None, "z")], "k string, f date, t date, name string")
    assert {(r["i"], r["name"]) for r in interval_join(left, right, ["k"], "d", "f", "t", closed).collect()} == want


def test_checked_join_raises(spark):
    left = spark.createDataFrame([(1, "l")], "k int, x string")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, y string")
    with pytest.raises(Exception, match="repeated key"):
        checked_join(left, right, ["k"]).collect()


def test_as_of_ignores_the_future(spark):
    rows = [(1, dt.datetime(2024, 1, 1), "a"), (1, dt.datetime(2024, 6, 1), "b")]
    df = spark.createDataFrame(rows, "k int, revision_at timestamp, v string")
    assert [r["v"] for r in as_of(df, ["k"], "revision_at", dt.datetime(2024, 3, 1)).collect()] == ["a"]
    later = stack(df, spark.createDataFrame([(1, dt.datetime(2025, 1, 1), "c")], df.schema))
    assert [r["v"] for r in as_of(later, ["k"], "revision_at", dt.datetime(2024, 3, 1)).collect()] == ["a"]


def test_upsert_and_stack(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "c", 1.5)], "k int, v string, w double")
    assert {(r["k"], r["v"], r["w"]) for r in upsert(base, delta, ["k"]).collect()} == {(1, "a", None), (2, "c", 1.5)}


def _section(seed=3, n=60):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"trade_date": [D(2025, 1, 1)] * n, "asset_id": range(n), "board": np.arange(n) % 3, "industry": np.arange(n) % 5, "cap": np.exp(rng.normal(10, 1, n)), "ret": rng.normal(0, 0.02, n), "disc": rng.random(n), "vol": 1.0})


def test_constrained_fit_identities():
    g = _section()
    w = np.sqrt(g["cap"].to_numpy())
    x = np.column_stack([np.ones(len(g)), *((g["board"] == b).to_numpy(float) for b in range(3))])
    c = np.array([[0.0, *(w @ x[:, 1:])]])
    beta = dense.constrained_wls(x, g["ret"].to_numpy(), w, c)
    assert abs(c @ beta)[0] < 1e-10
    scaled = dense.constrained_wls(x * [1, 1000, 1, 1], g["ret"].to_numpy(), w, c * [1, 1000, 1, 1])
    assert np.allclose(scaled * [1, 1000, 1, 1], beta, atol=1e-10)


def test_decompose_adds_up():
    g = _section()
    out = decompose(g)
    assert abs(out.loc[out["name"] == "constraint", "value"].iloc[0]) < 1e-8
    assert len(out[out["product"] == "specific"]) == len(g)


def test_spectrum_trace_and_angle():
    r = np.random.default_rng(1).normal(size=(40, 10))
    values, edge = dense.spectrum(r)
    assert np.isclose(values.sum(), 10) and edge == (1 + np.sqrt(10 / 40)) ** 2
    assert dense.principal_angle(r[:, :3], r[:, :3] @ np.random.default_rng(2).normal(size=(3, 3))) < 1e-6


def test_newey_west_without_lag_is_plain():
    v = np.random.default_rng(0).normal(size=50)
    assert np.isclose(dense.newey_west(v, 0)[1], v.std() / np.sqrt(50))


def test_account_is_exact():
    g = pd.DataFrame({"o_custkey": [1, 1], "o_orderkey": [1, 2], "o_orderdate": [1, 2], "o_orderstatus": ["O", "F"], "price": [100.0, 110.0]})
    out = fold_account(g)
    assert list(out["traded"]) == [50, -50]
    assert out["cash"].iloc[0] == Decimal("494995.00") and out["cash"].iloc[1] == Decimal("500490.00")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2025, 1, 1))], "k int, d date")
    path = str(tmp_path / "t")
    assert files.read_or_empty(spark, path, df.schema).count() == 0
    files.write_once(df, path)
    assert files.read_or_empty(spark, path, df.schema).count() == 1
    with pytest.raises(Exception):
        files.write_once(df, path)
    with pytest.raises(ValueError):
        files.replace(df.where("false"), path)
    files.write_by_date(df, str(tmp_path / "by"), "d")
    assert spark.read.parquet(str(tmp_path / "by")).count() == 1
    files.write_envelopes(df, str(tmp_path / "raw"), "2025-01-01")
    assert files.replay_envelopes(spark, str(tmp_path / "raw"), df.schema).count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    from loomspan.streaming.events import append_new, read_stream

    folder = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").limit(200).write.parquet(folder)
    for _ in range(2):  # the second run finds nothing new
        append_new(read_stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
