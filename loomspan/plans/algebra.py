"""Linear algebra of one cross-section or window, and the derivations around it (survey 2.2, 2.4 to 2.12).

Grouped functions get one date or one window at a time; what they need is projected first, so that only those columns
are shuffled. Everything that SQL can express has a twin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomspan.functions import dense
from loomspan.plans.base import both, query, view
from loomspan.shipping import ship

both("bse_code_canonicalize", "SELECT s.s_suppkey, coalesce(m.new_key, s.s_suppkey) AS canonical FROM supplier s LEFT JOIN (SELECT n_nationkey AS old_key, n_nationkey + 1000 AS new_key FROM nation) m ON m.old_key = s.s_suppkey")
both("safe_column_name", "SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9]', '_') AS name FROM part", "SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g') AS name FROM part")
both("active_factor_columns", "SELECT trade_date, board AS factor FROM sup GROUP BY trade_date, board HAVING count_if(cap <> 0) > 0")
both("pearson_corr_python", "SELECT trade_date, CASE WHEN count(*) >= 3 THEN round(covar_pop(disc, tax) / nullif(sqrt(var_pop(disc) * var_pop(tax)), 0), 6) END AS corr FROM prt GROUP BY trade_date")
both("python_ntile", "SELECT trade_date, asset_id, CAST(ntile(10) OVER (PARTITION BY trade_date ORDER BY cap, asset_id) AS BIGINT) AS bucket FROM sup")
both("trailing_120_bench_dates", "SELECT min(trade_date) AS start_date, count(*) AS n FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS rn FROM cal) x WHERE rn <= 120")
both("set_difference_python", "SELECT c_custkey AS asset_id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
both("shibor_daily_compound", "SELECT c_custkey, round(pow(1 + abs(c_acctbal) / 100000, CAST(1 AS DOUBLE) / 365) - 1, 10) AS daily FROM customer")
both("variance_model_fit", "SELECT round(regr_slope(ln(s), ln(c)), 5) AS slope, round(regr_intercept(ln(s), ln(c)), 4) AS intercept, count(*) AS n FROM (SELECT asset_id, stddev_samp(ret) AS s, avg(cap) AS c FROM supr GROUP BY asset_id HAVING count(ret) > 5) x WHERE s > 0")
both("ewma_half_life_derivation", "SELECT count(*) AS sessions, round(count(*) * ln(2) / 2, 6) AS half_life FROM cal")
both("alpha_risk_cross_gram", "SELECT trade_date, round(greatest(abs(sum(vol * tax * disc) / nullif(sqrt(sum(vol * tax * tax) * sum(vol * disc * disc)), 0)), abs(sum(vol * tax) / nullif(sqrt(sum(vol * tax * tax) * sum(vol)), 0))), 6) AS worst FROM prt GROUP BY trade_date")


def _grouped(rows, function, schema: str, key: str = "trade_date"):
    ship(rows.sparkSession)
    return rows.groupBy(key).applyInPandas(function, schema)


def _cross_section(spark, sf_dir):
    return view(spark, sf_dir, "supr").where("ret IS NOT NULL AND prior_cap > 0").select("trade_date", "asset_id", "board", "cap", "ret", "disc", "vol")


def _styles(g: pd.DataFrame) -> np.ndarray:
    """Country and three styles of one date: weighted mean 0, spread 1; a style without spread is all 0."""
    w = np.sqrt(g["cap"].to_numpy(float))
    columns = [np.ones(len(g))]
    for v in (np.log(g["cap"]), g["disc"], np.log(g["vol"].clip(lower=1e-9))):
        v = v.to_numpy(float)
        v = v - np.average(v, weights=w)
        sd = np.sqrt(np.average(v * v, weights=w))
        columns.append(v / sd if sd > 1e-12 else np.zeros(len(g)))
    return np.column_stack(columns)


def _one(g: pd.DataFrame, **values) -> pd.DataFrame:
    return pd.DataFrame({"trade_date": [g["trade_date"].iloc[0]], **{k: [v] for k, v in values.items()}})


@query("matrix_rank_scaled")
def matrix_rank_scaled(spark, sf_dir):
    return _grouped(_cross_section(spark, sf_dir), lambda g: _one(g, assets=len(g), rank=dense.scaled_rank(_styles(g))), "trade_date date, assets long, rank long")


@query("null_space_basis")
def null_space_basis(spark, sf_dir):
    """Dimension of the null space of the boards' weighted sum-zero constraint, and how far its basis is off."""

    def basis(g: pd.DataFrame) -> pd.DataFrame:
        c = g.groupby("board")["cap"].sum().sort_index().to_numpy(float)[None, :]
        found = dense.null_space(c)
        worst = max(float(np.abs(c @ found).max(initial=0.0) / np.abs(c).max()), float(np.abs(found.T @ found - np.eye(found.shape[1])).max(initial=0.0)))
        return _one(g, columns=c.shape[1], dimension=found.shape[1], holds=worst < 1e-10)

    return _grouped(_cross_section(spark, sf_dir), basis, "trade_date date, columns long, dimension long, holds boolean")


@query("gauss_jordan_solve")
def gauss_jordan_solve(spark, sf_dir):
    """Normal equations of the styles, solved by elimination; singular dates have null coefficients."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        x, y = _styles(g), g["ret"].to_numpy(float)
        full = dense.scaled_rank(x) == x.shape[1]
        beta = np.linalg.solve(x.T @ x, x.T @ y) if full else np.full(x.shape[1], np.nan)
        return pd.DataFrame({"trade_date": g["trade_date"].iloc[0], "k": np.arange(x.shape[1]), "beta": [round(float(b), 8) if full else None for b in beta]})

    return _grouped(_cross_section(spark, sf_dir), solve, "trade_date date, k long, beta double")


@query("projection_basis")
def projection_basis(spark, sf_dir):
    """Each asset's leverage: the squared length of its row in the left singular basis of the styles."""

    def leverage(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        u, s, _ = np.linalg.svd(_styles(g), full_matrices=False)
        u = u[:, s > 1e-10 * s.max(initial=0.0)]
        return pd.DataFrame({"trade_date": g["trade_date"], "asset_id": g["asset_id"], "leverage": (u * u).sum(axis=1).round(8)})

    return _grouped(_cross_section(spark, sf_dir), leverage, "trade_date date, asset_id long, leverage double")


@query("svd_projection_residual")
def svd_projection_residual(spark, sf_dir):
    """Equally weighted residual of the return on the styles that vary, by pseudo-inverse with cut-off 1e-10."""

    def rest(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        x = _styles(g)
        x = np.column_stack([np.ones(len(g)), x[:, 1:][:, np.ptp(x[:, 1:], axis=0) > 0]])
        y = g["ret"].to_numpy(float)
        e = y - x @ (np.linalg.pinv(x, rcond=1e-10) @ y)
        return pd.DataFrame({"trade_date": g["trade_date"], "asset_id": g["asset_id"], "residual": e.round(8) + 0.0})

    return _grouped(_cross_section(spark, sf_dir), rest, "trade_date date, asset_id long, residual double")


@query("smallest_eigen_direction")
def smallest_eigen_direction(spark, sf_dir):
    """The direction of the styles' Gram matrix of least eigenvalue, its largest entry positive."""

    def direction(g: pd.DataFrame) -> pd.DataFrame:
        x = _styles(g.sort_values("asset_id"))
        values, vectors = np.linalg.eigh(x.T @ x / len(x))
        v = vectors[:, 0]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        return pd.DataFrame({"trade_date": g["trade_date"].iloc[0], "k": np.arange(len(v)), "least": round(float(values[0]), 8), "loading": v.round(6)})

    return _grouped(_cross_section(spark, sf_dir), direction, "trade_date date, k long, least double, loading double")


@query("categorical_constrained_design")
def categorical_constrained_design(spark, sf_dir):
    """Ranks of the design with board dummies: alone, with the sum-zero row, and of the bordered (KKT) matrix."""

    def ranks(g: pd.DataFrame) -> pd.DataFrame:
        w = g["cap"].to_numpy(float) / g["cap"].sum()
        names = sorted(g["board"].unique())
        dummies = np.stack([(g["board"] == n).to_numpy(float) for n in names], axis=1)
        x = np.column_stack([_styles(g)[:, :2], dummies])
        c = np.concatenate([[0.0, 0.0], w @ dummies])[None, :]
        kkt = np.block([[x.T @ (x * w[:, None]), c.T], [c, np.zeros((1, 1))]])
        return _one(g, columns=x.shape[1], raw=dense.scaled_rank(x), stacked=dense.scaled_rank(np.vstack([x, c])), kkt=dense.scaled_rank(kkt))

    return _grouped(_cross_section(spark, sf_dir), ranks, "trade_date date, columns long, raw long, stacked long, kkt long")


@query("build_l1_day")
def build_l1_day(spark, sf_dir):
    """Long exposures of each date: country, board flags and styles, each style weighted to mean 0 and spread 1."""

    def day(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        wide = pd.DataFrame(_styles(g), columns=["country", "size", "discount", "volume"]).round(8)
        for b in sorted(g["board"].unique()):
            wide[f"board_{b}"] = (g["board"] == b).to_numpy(float)
        wide.insert(0, "asset_id", g["asset_id"].to_numpy())
        out = wide.melt("asset_id", var_name="factor", value_name="exposure")
        out.insert(0, "trade_date", g["trade_date"].iloc[0])
        return out

    return _grouped(_cross_section(spark, sf_dir), day, "trade_date date, asset_id long, factor string, exposure double")


@query("matrix_validation")
def matrix_validation(spark, sf_dir):
    """The factor covariance of each year's dates (returns by board): symmetric, no negative eigenvalue, positive diagonal."""
    rows = view(spark, sf_dir, "supr").where("ret IS NOT NULL").groupBy(F.year("trade_date").alias("y"), "trade_date", "board").agg(F.avg("ret").alias("ret"))

    def valid(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index="trade_date", columns="board", values="ret").dropna()
        cov = np.cov(wide.to_numpy(float), rowvar=False) if len(wide) > 1 and wide.shape[1] > 1 else np.zeros((1, 1))
        low = float(np.linalg.eigvalsh(cov).min())
        return pd.DataFrame({"y": [int(g["y"].iloc[0])], "factors": [cov.shape[0]], "symmetric": [bool(np.allclose(cov, cov.T))], "psd": [low >= -1e-12 * max(1.0, float(np.trace(cov)))], "positive": [bool((np.diag(cov) > 0).all())]})

    return _grouped(rows, valid, "y int, factors long, symmetric boolean, psd boolean, positive boolean", "y")


@query("principal_angle")
def principal_angle(spark, sf_dir):
    """Largest angle between the styles of each date and the date before, on the assets of both. Each row goes to its own
    date and the next, so that a group holds two dates."""
    rows = view(spark, sf_dir, "supr").where("ret IS NOT NULL AND prior_cap > 0").select("k", "asset_id", "cap", "disc", "vol")
    rows = rows.withColumn("pair", F.explode(F.array("k", F.col("k") + 1)))

    def angle(g: pd.DataFrame) -> pd.DataFrame:
        p = g["pair"].iloc[0]
        now, before = (g[g["k"] == k].set_index("asset_id").sort_index() for k in (p, p - 1))
        shared = now.index.intersection(before.index)
        if len(shared) < 5:
            return pd.DataFrame({"k": [], "assets": [], "angle": []})
        a, b = (_styles(x.loc[shared].reset_index()) for x in (now, before))
        return pd.DataFrame({"k": [p], "assets": [len(shared)], "angle": [round(dense.principal_angle(a, b), 6)]})

    return _grouped(rows, angle, "k long, assets long, angle double", "pair")


@query("subspace_r_squared")
def subspace_r_squared(spark, sf_dir):
    """Part of the return that the styles span, by date, with its class: none below 0.1, strong from 0.3."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        y = g["ret"].to_numpy(float)
        total = ((y - y.mean()) ** 2).sum()
        r2 = 1 - (dense.residualize(y, _styles(g), np.ones(len(g))) ** 2).sum() / total if total > 0 else 0.0
        return _one(g, r2=round(float(r2), 8), overlap="none" if r2 < 0.1 else "partial" if r2 < 0.3 else "strong")

    return _grouped(_cross_section(spark, sf_dir), fit, "trade_date date, r2 double, overlap string")


@query("daily_ic_context")
def daily_ic_context(spark, sf_dir):
    """What a date's neutral signal rests on: rank and condition of the styles, and the signal's spread after them."""

    def context(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        x = _styles(g)[:, [0, 1, 3]]
        rest = dense.residualize(g["disc"].to_numpy(float), x, np.ones(len(g)))
        kept = x[:, np.abs(x).max(axis=0) > 0]
        return _one(g, assets=len(g), rank=dense.scaled_rank(x), condition=round(float(np.linalg.cond(kept)), 4), spread=round(float(rest.std()), 8))

    return _grouped(_cross_section(spark, sf_dir), context, "trade_date date, assets long, rank long, condition double, spread double")
