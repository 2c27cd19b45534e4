"""Identities of the dense helpers and hand-made accounts."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomspan import catalog, plans
from loomspan.functions import dense
from loomspan.plans.crosssection import _correlated
from loomspan.plans.market import equity_account

assert plans


def test_null_space_is_orthonormal_and_annihilated():
    c = np.array([[1.0, 2.0, 3.0, 0.0], [2.0, 4.0, 6.0, 0.0]])
    basis = dense.null_space(c)
    assert basis.shape == (4, 3)
    assert np.allclose(c @ basis, 0) and np.allclose(basis.T @ basis, np.eye(3))


def test_leverage_sums_to_the_rank(spark, sf):
    total = catalog.QUERIES["projection_basis"](spark, sf).groupBy("trade_date").agg(F.sum("leverage").alias("s"))
    ranks = catalog.QUERIES["matrix_rank_scaled"](spark, sf)
    assert total.join(ranks, "trade_date").where("abs(s - rank) > 1e-4").count() == 0


def test_residual_has_mean_zero(spark, sf):
    sums = catalog.QUERIES["svd_projection_residual"](spark, sf).groupBy("trade_date").agg(F.sum("residual").alias("s"))
    assert sums.where("abs(s) > 1e-4").count() == 0


def test_derangement_moves_everyone(spark, sf):
    out = catalog.QUERIES["derangement"](spark, sf)
    alone = out.groupBy("trade_date").count().where("count = 1").select("trade_date")
    moved = out.join(alone, "trade_date", "left_anti")
    assert moved.where("asset_id = partner").count() == 0
    assert moved.select("trade_date", "partner").distinct().count() == moved.count()


def _orders(*rows):
    frame = pd.DataFrame(rows, columns=["o_orderkey", "o_orderdate", "o_orderstatus", "price"])
    return frame.assign(o_custkey=1)


def test_shares_are_sold_on_a_later_date_only():
    day = datetime.datetime(2025, 1, 2)
    out = equity_account()(_orders((1, day, "O", 10.0), (2, day, "F", 10.0), (3, day + datetime.timedelta(1), "F", 11.0)))
    assert list(out["traded"]) == [500, 0, -500]
    assert list(out["shares"]) == [500, 500, 0]
    # 5,000 bought for 5.00 + 0.05; 5,500 sold for 5.00 + 0.06 + 2.75
    assert [str(c) for c in out["cash"]] == ["494994.95", "494994.95", "500487.14"]


def test_a_price_beyond_the_limit_locks_trading():
    day = datetime.datetime(2025, 1, 2)
    out = equity_account()(_orders((1, day, "O", 10.0), (2, day + datetime.timedelta(1), "F", 20.0)))
    assert list(out["locked"]) == [False, True] and list(out["traded"]) == [500, 0]


def test_pairs_of_an_industry_are_never_rows(spark, sf):
    plan = catalog.QUERIES["grouped_residual_correlation"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "asset_id" in x and " < " in x]


def test_correlations_of_blocks_are_those_of_pairs():
    rng = np.random.default_rng(5)
    rows = []
    for a in range(600):
        ks = np.sort(rng.choice(40, rng.integers(3, 40), replace=False))
        es = rng.normal(size=len(ks)) + (a % 3) * 50
        if a % 50 == 0:
            es[:] = 0.1
        if a % 50 == 1:
            es[:-1] = 0.3  # equal on most shared dates
        if a == 7:
            es[0] = np.nan
        rows.append((3, a, ks, es, a // 300))
    g = pd.DataFrame(rows, columns=["industry", "asset_id", "ks", "es", "b"])
    pairs, kept = 0, {}
    for i in range(600):
        for j in range(i + 1, 600):
            _, x, y = np.intersect1d(rows[i][2], rows[j][2], assume_unique=True, return_indices=True)
            if len(x) >= 10:
                pairs += 1
                x, y = rows[i][3][x], rows[j][3][y]
                if np.isnan(x.sum() + y.sum()):
                    kept[i, j] = np.nan
                elif np.ptp(x) and np.ptp(y):
                    kept[i, j] = np.corrcoef(x, y)[0, 1]
    out = pd.concat([_correlated(g[g["b"].isin([p, q])].assign(p=p, q=q)) for p, q in ((0, 0), (0, 1), (1, 1))])
    known = [c for c in kept.values() if not np.isnan(c)]
    assert out["pairs"].sum() == pairs and out["defined"].sum() == len(known) and out["odd"].sum() == len(kept) - len(known) > 0
    assert len(known) < pairs and abs(out["total"].sum() - sum(known)) < 1e-6
