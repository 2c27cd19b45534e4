"""Cross-section transforms and regressions (survey 2.9)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import dense
from loomspan.plans.base import both, query, view
from loomspan.shipping import ship

_D = "PARTITION BY trade_date"
both("mad_winsorize", f"SELECT asset_id, trade_date, round(least(greatest(cap, m - 3 * mad), m + 3 * mad), 4) AS w, CAST(cap < m - 3 * mad AS BOOLEAN) AS low, CAST(cap > m + 3 * mad AS BOOLEAN) AS high FROM (SELECT *, PCT(abs(cap - m); 0.5) OVER ({_D}) AS mad FROM (SELECT asset_id, trade_date, cap, PCT(cap; 0.5) OVER ({_D}) AS m FROM sup) x) y")
both("weighted_standardize", f"SELECT asset_id, trade_date, round((disc - mu) / nullif(sqrt(sum(vol * (disc - mu) * (disc - mu)) OVER ({_D}) / sum(vol) OVER ({_D})), 0), 5) AS z FROM (SELECT asset_id, trade_date, disc, vol, sum(vol * disc) OVER ({_D}) / sum(vol) OVER ({_D}) AS mu FROM prt) x WHERE vol > 0")
both("weighted_scale_only", f"SELECT asset_id, trade_date, round(disc / nullif(sqrt(sum(vol * disc * disc) OVER ({_D}) / sum(vol) OVER ({_D})), 0), 6) AS z FROM prt")
both("impute_industry_median", "SELECT asset_id, trade_date, round(coalesce(x, PCT(x; 0.5) OVER (PARTITION BY trade_date, industry), PCT(x; 0.5) OVER (PARTITION BY trade_date)), 6) AS filled, x IS NULL AS imputed FROM (SELECT asset_id, trade_date, industry, CASE WHEN size_code > 10 THEN disc END AS x FROM prt) y")
both("alpha_direction", "SELECT asset_id, trade_date, round(-1 * cap, 4) AS directed FROM sup")
both("r_squared_variants", "SELECT board, round(1 - sum(e * e) / nullif(sum(d * d), 0), 6) AS r2, round(1 - sum(cap * e * e) / nullif(sum(cap * d * d), 0), 6) AS weighted_r2 FROM (SELECT board, cap, ret - avg(ret) OVER (PARTITION BY trade_date) AS e, ret - avg(ret) OVER (PARTITION BY board) AS d FROM supr WHERE ret IS NOT NULL) x GROUP BY board")
both("attribution_identity", "SELECT trade_date, round(sum(w * ret), 6) AS total, round(sum(w * mkt), 6) AS explained, round(sum(w * (ret - mkt)), 6) AS specific, abs(sum(w * ret) - sum(w * mkt) - sum(w * (ret - mkt))) < 1e-9 AS ok FROM (SELECT trade_date, ret, prior_cap / sum(prior_cap) OVER (PARTITION BY trade_date) AS w, avg(ret) OVER (PARTITION BY trade_date) AS mkt FROM supr WHERE ret IS NOT NULL) x GROUP BY trade_date")
both("inverse_variance_weight", "SELECT asset_id, round(least(greatest(w / wm, 0.1), 10), 5) AS w FROM (SELECT asset_id, w, PCT(w; 0.5) OVER () AS wm FROM (SELECT asset_id, 1 / pow(greatest(s, 0.25 * sm), 2) AS w FROM (SELECT asset_id, s, PCT(s; 0.5) OVER () AS sm FROM (SELECT asset_id, stddev_samp(ret) AS s FROM supr GROUP BY asset_id HAVING count(ret) > 5) a) b) c) d")
both("momentum_descriptor", "SELECT asset_id, trade_date, CASE WHEN n >= 8 THEN round(exp(s) - 1, 4) END AS momentum FROM (SELECT asset_id, trade_date, count(r) OVER w AS n, sum(r) OVER w AS s FROM (SELECT asset_id, trade_date, CASE WHEN ret > -1 THEN ln(1 + ret) / 20 END AS r FROM supr) x WINDOW w AS (PARTITION BY asset_id ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)) y")
both("weight_metric_contract", "SELECT p.asset_id, p.trade_date, round(coalesce(w.w, sqrt(p.cap)), 5) AS weight FROM sup p LEFT JOIN (SELECT asset_id, avg(cap) / 1000 AS w FROM sup WHERE board < 2 GROUP BY asset_id) w ON w.asset_id = p.asset_id")
both("frozen_composite_residual", "SELECT trade_date, round(sxy / nullif(sxx, 0), 6) AS beta FROM (SELECT trade_date, regr_sxy(disc, tax) AS sxy, regr_sxx(disc, tax) AS sxx FROM prt GROUP BY trade_date) x")
both("weighted_normal_equations", "SELECT trade_date, round(sum(vol), 4) AS w, round(sum(vol * disc) + 1e-7, 3) AS wx, round(sum(vol * disc * disc) + 1e-7, 3) AS wxx, round(sum(vol * tax) + 1e-7, 3) AS wy, round(sum(vol * disc * tax) + 1e-7, 3) AS wxy FROM prt GROUP BY trade_date")

_BLOCK = 1024  # assets of a block
_TILE = 256  # rows that are worked out at once


def _on_dates(g: pd.DataFrame, dates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence, residuals (as distances from each asset's first finite one; absent: 0) and non-finite residuals, asset by date."""
    there, e, odd = (np.zeros((len(g), len(dates))) for _ in range(3))
    for i, (k, v) in enumerate(zip(g["ks"], g["es"], strict=True)):
        at, v = np.searchsorted(dates, k), np.asarray(v, float)
        fine = np.isfinite(v)
        there[i, at], odd[i, at] = 1, ~fine
        e[i, at] = np.where(fine, v - v[fine.argmax()], 0)
    return there, e, odd


def _correlated(g: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of an industry: pairs that share ten dates, those that aren't numbers, and the number and sum of the others that are defined."""
    g = g.sort_values("asset_id")
    left, right = g[g["b"] == g["p"]], g[g["b"] == g["q"]]
    same = g["p"].iloc[0] == g["q"].iloc[0]
    dates = np.unique(np.concatenate(g["ks"].to_list()))
    (ma, ea, oa), (mb, eb, ob) = _on_dates(left, dates), _on_dates(right, dates)
    pairs, odd, defined, total = 0, 0, 0, 0.0
    for lo in range(0, len(left), _TILE):
        m, e, o = (x[lo : lo + _TILE] for x in (ma, ea, oa))
        n = m @ mb.T
        wanted = n >= 10
        if same:
            wanted &= np.arange(lo, lo + len(m))[:, None] < np.arange(len(right))[None, :]
        n = np.maximum(n, 1)
        sa, sb, qa, qb = e @ mb.T / n, m @ eb.T / n, e**2 @ mb.T / n, m @ (eb**2).T / n
        va, vb = qa - sa * sa, qb - sb * sb
        cov = e @ eb.T / n - sa * sb
        # where little is left of the squares, from the shared dates themselves: equal residuals have no variance
        for i, j in np.argwhere(wanted & (((qa > 0) & (va <= 1e-8 * qa)) | ((qb > 0) & (vb <= 1e-8 * qb)))):
            both_there = (m[i] > 0) & (mb[j] > 0)
            x, y = e[i, both_there] - e[i, both_there][0], eb[j, both_there] - eb[j, both_there][0]
            x, y = x - x.mean(), y - y.mean()
            va[i, j], vb[i, j], cov[i, j] = x @ x / len(x), y @ y / len(y), x @ y / len(x)
        scale = np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))
        broken = wanted & (o @ mb.T + m @ ob.T > 0)
        known = wanted & ~broken & (scale > 0)
        pairs, odd, defined, total = pairs + int(wanted.sum()), odd + int(broken.sum()), defined + int(known.sum()), total + float((cov[known] / scale[known]).sum())
    return pd.DataFrame({"industry": [g["industry"].iloc[0]], "pairs": [pairs], "odd": [odd], "defined": [defined], "total": [total]})


@query("grouped_residual_correlation", "WITH r AS (SELECT asset_id, industry, trade_date, ret - avg(ret) OVER (PARTITION BY trade_date) AS e FROM supr WHERE ret IS NOT NULL), c AS (SELECT a.industry, a.asset_id AS i, b.asset_id AS j, covar_pop(a.e, b.e) / nullif(sqrt(var_pop(a.e) * var_pop(b.e)), 0) AS c FROM r a JOIN r b ON b.trade_date = a.trade_date AND b.industry = a.industry AND a.asset_id < b.asset_id GROUP BY a.industry, a.asset_id, b.asset_id HAVING count(*) >= 10) SELECT industry, count(*) AS pairs, round(avg(c), 5) AS mean_corr FROM c GROUP BY industry")
def grouped_residual_correlation(spark, sf_dir):
    """All pairs as products of matrices: blocks of an industry's assets meet two by two, rows of pairs are never made."""
    ship(spark)
    rest = view(spark, sf_dir, "supr").where("ret IS NOT NULL").selectExpr("industry", "asset_id", "k", "ret - avg(ret) OVER (PARTITION BY trade_date) AS e")
    assets = rest.groupBy("industry", "asset_id").agg(F.collect_list("k").alias("ks"), F.collect_list("e").alias("es"))
    numbered = assets.selectExpr("*", "row_number() OVER (PARTITION BY industry ORDER BY asset_id) AS at", "count(*) OVER (PARTITION BY industry) AS of")
    dealt = numbered.selectExpr("industry", "asset_id", "ks", "es", f"CAST((at - 1) div {_BLOCK} AS INT) AS b", f"explode(sequence(0, CAST((of - 1) div {_BLOCK} AS INT))) AS other")
    met = dealt.selectExpr("industry", "asset_id", "ks", "es", "b", "least(b, other) AS p", "greatest(b, other) AS q")
    sums = met.groupBy("industry", "p", "q").applyInPandas(_correlated, "industry int, pairs long, odd long, defined long, total double")
    return sums.groupBy("industry").agg(F.sum("pairs").alias("pairs"), F.expr("CASE WHEN sum(odd) > 0 THEN double('NaN') ELSE round(sum(total) / nullif(sum(defined), 0), 5) END").alias("mean_corr")).where("pairs > 0")


def _by_date(df: DataFrame, function, schema: str, key: str = "trade_date") -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(key).applyInPandas(function, schema)


def _design(g: pd.DataFrame, block: str, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Country, one column per present category, and standardised size; the categories' weighted sum is zero."""
    names = sorted(g[block].unique())
    dummies = np.stack([(g[block] == n).to_numpy(float) for n in names], axis=1)
    size = np.log(np.maximum(g["cap"].to_numpy(float), 1e-9))
    mean = np.average(size, weights=weight)
    sd = np.sqrt(np.average((size - mean) ** 2, weights=weight)) or 1.0
    x = np.column_stack([np.ones(len(g)), dummies, (size - mean) / sd])
    c = np.zeros((1, x.shape[1]))
    c[0, 1 : 1 + len(names)] = weight @ dummies
    return x, c, ["country", *(f"{block}_{n}" for n in names), "size"]


def _panel(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "supr").where("ret IS NOT NULL AND prior_cap > 0").select("trade_date", "asset_id", "board", "industry", "cap", "ret", "disc", "vol")


def decompose(g: pd.DataFrame) -> pd.DataFrame:
    """Huber-weighted constrained regression of one date: factor returns, specific returns and fit in one long result."""
    g = g.sort_values("asset_id")
    w = np.sqrt(g["cap"].to_numpy(float))
    x, c, names = _design(g, "board", w)
    y = g["ret"].to_numpy(float)
    beta, down = dense.huber(x, y, w, c)
    rest = y - x @ beta
    total = (w * (y - np.average(y, weights=w)) ** 2).sum()
    r2 = 1 - (w * rest**2).sum() / total if total > 0 else np.nan
    rows = [("factor", n, b) for n, b in zip(names, beta, strict=True)]
    rows += [("specific", str(a), e) for a, e in zip(g["asset_id"], rest, strict=True)]
    rows += [("weight", str(a), d) for a, d in zip(g["asset_id"], down, strict=True)]
    rows += [("fit", "r2", r2), ("fit", "constraint", float(abs(c @ beta)[0])), ("fit", "rank", float(dense.scaled_rank(x)))]
    out = pd.DataFrame(rows, columns=["product", "name", "value"])
    out.insert(0, "trade_date", g["trade_date"].iloc[0])
    out["value"] = out["value"].round(8)
    return out


_LONG = "trade_date date, product string, name string, value double"


@query("decompose_cross_section")
def decompose_cross_section(spark, sf_dir):
    return _by_date(_panel(spark, sf_dir), decompose, _LONG)


@query("huber_irls")
def huber_irls(spark, sf_dir):
    return _by_date(_panel(spark, sf_dir), decompose, _LONG).where("product = 'weight'")


@query("constrained_wls")
def constrained_wls(spark, sf_dir):
    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        w = np.sqrt(g["cap"].to_numpy(float))
        x, c, names = _design(g, "board", w)
        beta = dense.constrained_wls(x, g["ret"].to_numpy(float), w, c)
        return pd.DataFrame({"trade_date": g["trade_date"].iloc[0], "factor": names, "value": beta.round(8)})

    return _by_date(_panel(spark, sf_dir), fit, "trade_date date, factor string, value double")


@query("industry_constrained_design")
def industry_constrained_design(spark, sf_dir):
    def ranks(g: pd.DataFrame) -> pd.DataFrame:
        x, c, names = _design(g, "industry", np.sqrt(g["cap"].to_numpy(float)))
        return pd.DataFrame({"trade_date": [g["trade_date"].iloc[0]], "columns": [x.shape[1]], "raw_rank": [dense.scaled_rank(x)], "stacked_rank": [dense.scaled_rank(np.vstack([x, c]))]})

    return _by_date(_panel(spark, sf_dir), ranks, "trade_date date, columns long, raw_rank long, stacked_rank long")


@query("weighted_residualize", "SELECT trade_date, asset_id, round(disc - (my + b * (tax - mx)), 6) AS residual FROM (SELECT *, (swxy / sw - mx * my) / nullif(swxx / sw - mx * mx, 0) AS b FROM (SELECT trade_date, asset_id, disc, tax, sum(vol) OVER d AS sw, sum(vol * tax) OVER d / sum(vol) OVER d AS mx, sum(vol * disc) OVER d / sum(vol) OVER d AS my, sum(vol * tax * disc) OVER d AS swxy, sum(vol * tax * tax) OVER d AS swxx FROM prt WINDOW d AS (PARTITION BY trade_date)) x) y")
def weighted_residualize(spark, sf_dir):
    def project(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        x = np.column_stack([np.ones(len(g)), g["tax"]])
        rest = dense.residualize(g["disc"].to_numpy(float), x, g["vol"].to_numpy(float))
        return pd.DataFrame({"trade_date": g["trade_date"], "asset_id": g["asset_id"], "residual": rest.round(6) + 0.0})

    return _by_date(view(spark, sf_dir, "prt").select("trade_date", "asset_id", "disc", "tax", "vol"), project, "trade_date date, asset_id long, residual double")


@query("transform_style_column")
def transform_style_column(spark, sf_dir):
    def style(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        v, w = g["cap"].to_numpy(float), np.sqrt(g["cap"].to_numpy(float))
        m = np.median(v)
        mad = np.median(np.abs(v - m))
        v = np.clip(v, m - 5 * mad, m + 5 * mad) if mad > 0 else v
        mu = np.average(v, weights=w)
        z = (v - mu) / (np.sqrt(np.average((v - mu) ** 2, weights=w)) or 1.0)
        z = dense.residualize(z, np.column_stack([np.ones(len(g)), g["disc"]]), w)
        rms = np.sqrt(np.average(z**2, weights=w)) or 1.0
        return pd.DataFrame({"trade_date": g["trade_date"], "asset_id": g["asset_id"], "style": (z / rms).round(6)})

    return _by_date(_panel(spark, sf_dir), style, "trade_date date, asset_id long, style double")


@query("eigen_spectrum")
def eigen_spectrum(spark, sf_dir):
    """Windows of 24 months, every 6 months: each row goes to the windows that hold it, and each window is one group."""
    rows = view(spark, sf_dir, "supr").where("ret IS NOT NULL").select("asset_id", "k", "ret")
    ends = F.explode(F.sequence(F.ceil(F.greatest(F.col("k"), F.lit(24)) / 6).cast("long"), F.ceil((F.col("k") + 23) / 6).cast("long")))
    rows = rows.withColumn("w", ends).where("w * 6 >= k AND w * 6 - 24 < k")

    def window(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index="k", columns="asset_id", values="ret").dropna(axis=1).sort_index()
        if wide.shape[0] < 12 or wide.shape[1] < 3:
            return pd.DataFrame({"w": [], "assets": [], "top": [], "edge": [], "above": []})
        values, edge = dense.spectrum(wide.to_numpy())
        return pd.DataFrame({"w": [g["w"].iloc[0]], "assets": [wide.shape[1]], "top": [round(float(values[0]), 6)], "edge": [round(edge, 6)], "above": [int((values > edge).sum())]})

    return _by_date(rows, window, "w long, assets long, top double, edge double, above long", "w")


@query("incremental_r2")
def incremental_r2(spark, sf_dir):
    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        w, y = np.sqrt(g["cap"].to_numpy(float)), g["ret"].to_numpy(float)
        x, c, _ = _design(g, "board", w)
        total = (w * (y - np.average(y, weights=w)) ** 2).sum()
        r2 = [1 - (w * (y - m @ dense.constrained_wls(m, y, w, k)) ** 2).sum() / total if total > 0 else np.nan for m, k in ((x, c), (x[:, :-1], c[:, :-1]))]
        return pd.DataFrame({"trade_date": [g["trade_date"].iloc[0]], "full": [round(r2[0], 8)], "baseline": [round(r2[1], 8)], "gain": [round(r2[0] - r2[1], 8)]})

    return _by_date(_panel(spark, sf_dir), fit, "trade_date date, full double, baseline double, gain double")


@query("equilibrated_condition")
def equilibrated_condition(spark, sf_dir):
    def condition(g: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(g)), g["disc"], np.log(g["cap"])])
        gram = x.T @ x
        d = np.sqrt(np.diag(gram))
        d[d == 0] = 1.0
        return pd.DataFrame({"trade_date": [g["trade_date"].iloc[0]], "condition": [float(np.round(np.linalg.cond(gram / d[:, None] / d), 3))]})

    return _by_date(_panel(spark, sf_dir), condition, "trade_date date, condition double")
