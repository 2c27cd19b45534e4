"""Predictivity, inference and permutation statistics (survey 2.10) and risk models (2.11)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomspan.functions import dense
from loomspan.plans.base import both, query, view
from loomspan.shipping import ship

_RANKED = "SELECT asset_id, trade_date, k, x, y, rank() OVER (PARTITION BY trade_date ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, x) - 1) / CAST(2 AS DOUBLE) AS rx, rank() OVER (PARTITION BY trade_date ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, y) - 1) / CAST(2 AS DOUBLE) AS ry FROM (SELECT asset_id, trade_date, k, cap AS x, lead(ret) OVER (PARTITION BY asset_id ORDER BY trade_date) AS y FROM supr) p WHERE y IS NOT NULL"
_IC = f"SELECT trade_date, k, count(*) AS n, covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) AS ic FROM ({_RANKED}) r GROUP BY trade_date, k HAVING count(*) >= 3"

both("spearman_ic", f"SELECT trade_date, n, round(ic, 6) AS ic FROM ({_IC}) x")
both("vector_spearman", f"SELECT trade_date, round(ic, 6) AS ic, n FROM ({_IC}) x WHERE n >= 10")
both("rolling_oos_ic", f"SELECT trade_date, CASE WHEN count(ic) OVER w >= 12 THEN round(avg(ic) OVER w, 6) END AS expected, CASE WHEN count(ic) OVER w >= 12 THEN round(stddev_samp(ic) OVER w / sqrt(count(ic) OVER w), 6) END AS se FROM ({_IC}) x WINDOW w AS (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)")
both("alpha_decay_classifier", f"SELECT trade_date, CASE WHEN abs(ic) < 0.02 THEN 'needs_evidence' WHEN ic > 0 THEN 'riskification' ELSE 'pure_decay' END AS class FROM ({_IC}) x")
both("neutralization_fidelity", "SELECT trade_date, round(c2 / nullif(c1, 0), 4) AS retention, sign(c1) = sign(c2) AS same_sign FROM (SELECT trade_date, covar_pop(cap, ret) / nullif(sqrt(var_pop(cap) * var_pop(ret)), 0) AS c1, covar_pop(d, ret) / nullif(sqrt(var_pop(d) * var_pop(ret)), 0) AS c2 FROM (SELECT trade_date, cap, ret, cap - avg(cap) OVER (PARTITION BY trade_date, board) AS d FROM supr WHERE ret IS NOT NULL) x GROUP BY trade_date HAVING count(*) > 20) y")
both("purged_kfold", "SELECT f.fold, m.trade_date, CASE WHEN m.k BETWEEN f.lo AND f.hi THEN 'test' WHEN m.k BETWEEN f.lo - 2 AND f.hi + 3 THEN 'purged' ELSE 'train' END AS part FROM mon m CROSS JOIN (SELECT CAST(floor((k - 1) / 17.0) AS BIGINT) AS fold, min(k) AS lo, max(k) AS hi FROM mon GROUP BY floor((k - 1) / 17.0)) f")
_LAG = 3


def newey_west_text(series: str) -> str:
    """Mean and standard error of a series of (trade_date, ic)."""
    return f"SELECT round(m, 6) AS mean, round(sqrt(greatest(v + 2 * ({' + '.join(f'{1 - j / (_LAG + 1)} * c{j}' for j in range(1, _LAG + 1))}), 0) / n), 6) AS se FROM (SELECT max(m) AS m, count(*) AS n, avg(d * d) AS v, {', '.join(f'sum(d * d{j}) / count(*) AS c{j}' for j in range(1, _LAG + 1))} FROM (SELECT d, m, {', '.join(f'lag(d, {j}) OVER (ORDER BY trade_date) AS d{j}' for j in range(1, _LAG + 1))} FROM (SELECT trade_date, avg(ic) OVER () AS m, ic - avg(ic) OVER () AS d FROM ({series}) x) y) z) u"


both("newey_west_mean", newey_west_text(_IC))
both("summarize_ic", f"SELECT count(*) AS n, round(avg(ic), 6) AS mean, round(PCT(ic; 0.5), 6) AS median, round(stddev_samp(ic), 6) AS sd, round(avg(ic) / nullif(stddev_samp(ic), 0), 5) AS ir FROM ({_IC}) x")
both("rolling_mean_series", f"SELECT trade_date, CASE WHEN count(*) OVER w = 6 THEN round(avg(ic) OVER w, 6) END AS m FROM ({_IC}) x WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
both("serial_autocorrelation", f"SELECT round(covar_pop(ic, p) / nullif(sqrt(var_pop(ic) * var_pop(p)), 0), 5) AS ac1 FROM (SELECT ic, lag(ic) OVER (ORDER BY trade_date) AS p FROM ({_IC}) x) y WHERE p IS NOT NULL")
both("linear_quantile", f"SELECT round(PCT(ic; 0.05), 6) AS q05, round(PCT(ic; 0.95), 6) AS q95 FROM ({_IC}) x")
_CURVE = " UNION ALL ".join(f"SELECT CAST({j} AS BIGINT) AS off, covar_pop(a.cap, b.ret) / nullif(sqrt(var_pop(a.cap) * var_pop(b.ret)), 0) AS c FROM supr a JOIN supr b ON b.asset_id = a.asset_id AND b.k = a.k + {j} WHERE b.ret IS NOT NULL" for j in range(4))
both("alignment_curve", f"SELECT off, round(c, 5) AS c FROM ({_CURVE}) x")
both("centered_peak_gate", f"SELECT bool_and(off = 0 OR abs(c) <= top) AS peak_at_zero FROM (SELECT off, c, max(CASE WHEN off = 0 THEN abs(c) END) OVER () AS top FROM ({_CURVE}) x) y")
both("half_life", f"SELECT min(off) AS half_life FROM (SELECT off, c, max(abs(c)) OVER () AS peak FROM ({_CURVE}) x) y WHERE abs(c) <= peak / 2")
both("ic_term_structure", f"SELECT off AS horizon, round(c, 5) AS ic, round(abs(c), 5) AS strength FROM ({_CURVE}) x")
both("shifted_exposure_diagnostic", f"SELECT round(max(CASE WHEN off = 0 THEN abs(c) END) - max(CASE WHEN off = 1 THEN abs(c) END), 5) AS decline FROM ({_CURVE}) x")
both("icir_weights", "SELECT board, round(greatest(ir, 0) / nullif(sum(greatest(ir, 0)) OVER (), 0), 5) AS w FROM (SELECT board, avg(m) / nullif(stddev_samp(m), 0) AS ir FROM (SELECT board, trade_date, avg(ret) AS m FROM supr WHERE ret IS NOT NULL GROUP BY board, trade_date) x GROUP BY board) y")
_P = "SELECT asset_id, exp(-abs(avg(ret) / nullif(stddev_samp(ret) / sqrt(count(ret)), 0))) AS p FROM supr GROUP BY asset_id HAVING count(ret) > 5"
both("benjamini_hochberg", f"SELECT asset_id, rn <= coalesce(max(CASE WHEN p <= 0.2 * rn / n THEN rn END) OVER (), 0) AS passed FROM (SELECT asset_id, p, row_number() OVER (ORDER BY p, asset_id) AS rn, count(*) OVER () AS n FROM ({_P}) x) y")
both("bh_q_values", f"SELECT asset_id, round(least(min(p * n / rn) OVER (ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) AS q FROM (SELECT asset_id, p, row_number() OVER (ORDER BY p, asset_id) AS rn, count(*) OVER () AS n FROM ({_P}) x) y")
both("group_temporal_variance", "SELECT board, round(var_pop(m), 8) AS v, count(*) AS days FROM (SELECT board, trade_date, avg(ret) AS m FROM supr WHERE ret IS NOT NULL GROUP BY board, trade_date HAVING count(*) >= 5) x GROUP BY board")
both("group_stat_v1", "SELECT board, round(var_pop(m) / nullif(avg(iv), 0), 5) AS ratio FROM (SELECT board, trade_date, avg(ret) AS m, var_pop(ret) / count(*) AS iv FROM supr WHERE ret IS NOT NULL GROUP BY board, trade_date HAVING count(*) >= 3) x GROUP BY board")
both("robust_prepare", "SELECT asset_id, trade_date, round(least(greatest((ret - m) / nullif(1.4826 * mad, 0), -5), 5), 5) AS z FROM (SELECT *, PCT(abs(ret - m); 0.5) OVER (PARTITION BY asset_id) AS mad FROM (SELECT asset_id, trade_date, ret, PCT(ret; 0.5) OVER (PARTITION BY asset_id) AS m FROM supr WHERE ret IS NOT NULL) x) y")
both("drop_small_groups", "SELECT asset_id, trade_date, industry FROM (SELECT asset_id, trade_date, industry, count(*) OVER (PARTITION BY trade_date, industry) AS n FROM sup) x WHERE n >= 4")
both("negative_control_gate", "SELECT board, ratio BETWEEN 0.5 AND 2 AS inside FROM (SELECT board, stddev_samp(ret) / nullif(avg(abs(ret)), 0) AS ratio FROM supr GROUP BY board) x")
both("label_change_summary", "SELECT count_if(n > 1) AS changed, count(*) AS assets FROM (SELECT asset_id, count(DISTINCT label) AS n FROM member GROUP BY asset_id) x")
both("stratified_label_permutation", "SELECT a.asset_id, a.trade_date, b.asset_id AS donor FROM (SELECT asset_id, trade_date, board, row_number() OVER (PARTITION BY trade_date, board ORDER BY asset_id) AS rn FROM sup) a JOIN (SELECT asset_id, trade_date, board, row_number() OVER (PARTITION BY trade_date, board ORDER BY (asset_id * 7919) % 104729, asset_id) AS rn FROM sup) b ON b.trade_date = a.trade_date AND b.board = a.board AND b.rn = a.rn")
both("whole_date_time_shuffle", "SELECT e.asset_id, e.trade_date, m.src FROM sup e JOIN (SELECT a.trade_date, b.trade_date AS src FROM mon a JOIN (SELECT trade_date, row_number() OVER (ORDER BY (k * 7919) % 104729, k) AS rn FROM mon) b ON b.rn = a.k) m ON m.trade_date = e.trade_date")
both("cross_chain_validation", "SELECT a.board, round(a.m / nullif(b.m, 0), 4) AS ratio, a.m / nullif(b.m, 0) BETWEEN 0.2 AND 5 AS ok FROM (SELECT board, avg(ret) AS m FROM supr WHERE k < 40 GROUP BY board) a JOIN (SELECT board, avg(ret) AS m FROM supr WHERE k >= 40 GROUP BY board) b ON b.board = a.board")
both("replay_summary", f"SELECT count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd, round(stddev_samp(ic) / sqrt(count(*)), 6) AS mc_se, round(PCT(ic; 0.025), 6) AS lo, round(PCT(ic; 0.975), 6) AS hi FROM ({_IC}) x")
_Z = 1.959963984540054
both("wilson_interval", f"SELECT round((p + {_Z * _Z} / (2 * n)) / d - h, 6) AS lo, round((p + {_Z * _Z} / (2 * n)) / d + h, 6) AS hi FROM (SELECT p, n, 1 + {_Z * _Z} / n AS d, {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n) AS h FROM (SELECT avg(CAST(CASE WHEN ic > 0 THEN 1 ELSE 0 END AS DOUBLE)) AS p, CAST(count(*) AS DOUBLE) AS n FROM ({_IC}) a) x) y")
# A canary knows the next return but for noise from a hash; a placebo is that noise alone. Leaks show as a canary that the
# next return does not explain, or a placebo that it does.
_NOISE = "CAST(({h} % 2001) - 1000 AS DOUBLE) / 1000"
_CANARY = "SELECT trade_date, covar_pop(y + 0.5 * sd * z, y) / nullif(sqrt(var_pop(y + 0.5 * sd * z) * var_pop(y)), 0) AS canary, covar_pop(z, y) / nullif(sqrt(var_pop(z) * var_pop(y)), 0) AS placebo FROM (SELECT trade_date, y, z, stddev_pop(y) OVER (PARTITION BY trade_date) AS sd FROM (SELECT trade_date, lead(ret) OVER (PARTITION BY asset_id ORDER BY trade_date) AS y, " + _NOISE.format(h="((asset_id * 7919 + k * 104729) * 31337 + asset_id * k * 613)") + " AS z FROM supr) a WHERE y IS NOT NULL) b GROUP BY trade_date HAVING count(*) >= 5"
both("pit_canary", f"SELECT count(*) AS dates, round(avg(canary), 6) AS canary_ic, round(avg(placebo), 6) AS placebo_ic, avg(canary) > 0.5 AND abs(avg(placebo)) < 4 * stddev_samp(placebo) / sqrt(count(placebo)) AS ok FROM ({_CANARY}) c")


@query("fama_macbeth")
def fama_macbeth(spark, sf_dir):
    from loomspan.plans.crosssection import constrained_wls

    daily = constrained_wls(spark, sf_dir).where("factor IN ('country', 'size')")

    def trailing(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("trade_date")
        mean, se = dense.newey_west(g["value"].to_numpy(float), 2)
        return pd.DataFrame({"factor": [g["factor"].iloc[0]], "n": [len(g)], "mean": [round(mean, 8)], "se": [round(se, 8)]})

    return daily.groupBy("factor").applyInPandas(trailing, "factor string, n long, mean double, se double")


@query("permutation_means")
def permutation_means(spark, sf_dir):
    """200 within-date shuffles of the label, each seeded by (experiment, repetition, date), so that no result depends on
    how rows are dealt. Only sums leave each date."""
    ship(spark)
    rows = view(spark, sf_dir, "supr").where("ret IS NOT NULL").select("trade_date", "k", "asset_id", "cap", "ret")

    def shuffled(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("asset_id")
        x, y = g["cap"].rank().to_numpy(), g["ret"].rank().to_numpy()
        if len(g) < 5:
            return pd.DataFrame({"rep": [], "ic": []})
        out = [np.corrcoef(x, np.random.default_rng([11, r, int(g["k"].iloc[0])]).permutation(y))[0, 1] for r in range(200)]
        return pd.DataFrame({"rep": range(200), "ic": out})

    daily = rows.groupBy("trade_date").applyInPandas(shuffled, "rep long, ic double")
    return daily.groupBy("rep").agg(F.round(F.avg("ic"), 8).alias("mean_ic"), F.count("*").alias("days"))


@query("permutation_test_v2")
def permutation_test_v2(spark, sf_dir):
    observed = view(spark, sf_dir, "supr").where("ret IS NOT NULL").groupBy("trade_date").agg(F.corr(F.col("cap") + 0.0, F.col("ret") + 0.0).alias("c"), F.count("*").alias("n")).where("n > 4").agg(F.abs(F.avg("c")).alias("obs"))
    null = permutation_means(spark, sf_dir)
    return null.crossJoin(F.broadcast(observed)).agg(F.round((1 + F.count_if(F.abs("mean_ic") >= F.col("obs"))) / (F.count("*") + 1), 6).alias("p"), F.round(F.percentile("mean_ic", F.lit(0.95)), 6).alias("null_q95"))


@query("synthetic_panel_generator")
def synthetic_panel_generator(spark, sf_dir):
    """128 assets, 60 days of an AR(1) factor panel; each asset's stream is seeded by its own number."""
    ship(spark)

    def asset(g: pd.DataFrame) -> pd.DataFrame:
        i = int(g["id"].iloc[0])
        common = np.random.default_rng([5, 0]).normal(size=60)
        own = np.random.default_rng([5, 1 + i]).normal(size=60)
        f = np.zeros(60)
        for t in range(1, 60):
            f[t] = 0.5 * f[t - 1] + common[t]
        return pd.DataFrame({"asset_id": i, "day": range(60), "ret": (0.01 * (f * (1 + i % 5) / 5 + own)).round(10)})

    return spark.range(128).groupBy("id").applyInPandas(asset, "asset_id long, day long, ret double")


# 2.11 risk
both("ewma_weights", "SELECT trade_date, round(pow(5e-1, (n - k) / 12e0) / sum(pow(5e-1, (n - k) / 12e0)) OVER (), 8) AS w FROM (SELECT trade_date, k, max(k) OVER () AS n FROM mon) x")
_FACTOR = "SELECT board, m.k, avg(ret) AS f FROM supr s JOIN mon m ON m.trade_date = s.trade_date WHERE ret IS NOT NULL GROUP BY board, m.k".replace("SELECT board, m.k", "SELECT s.board, m.k").replace("GROUP BY board, m.k", "GROUP BY s.board, m.k")
both("ewma_factor_covariance", f"WITH f AS (SELECT x.board, x.k, x.f, pow(5e-1, (max(x.k) OVER () - x.k) / 12e0) AS w FROM ({_FACTOR}) x), c AS (SELECT board, k, f - sum(w * f) OVER (PARTITION BY board) / sum(w) OVER (PARTITION BY board) AS d, w FROM f) SELECT a.board AS i, b.board AS j, round(sum(a.w * a.d * b.d) / sum(a.w), 7) AS cov FROM c a JOIN c b ON b.k = a.k GROUP BY a.board, b.board")
both("sigma_ratio_summary", "SELECT board, round(PCT(r; 0.5), 5) AS med, round(avg(least(r, 5)), 5) AS mean FROM (SELECT board, abs(ret) / nullif(avg(abs(ret)) OVER (PARTITION BY asset_id), 0) AS r FROM supr WHERE ret IS NOT NULL) x GROUP BY board")
both("bias_test", "SELECT board, round(stddev_samp(z), 5) AS bias, stddev_samp(z) BETWEEN 0.5 AND 1.5 AS ok FROM (SELECT board, ret / nullif(stddev_samp(ret) OVER (PARTITION BY asset_id ORDER BY trade_date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0) AS z, count(ret) OVER (PARTITION BY asset_id ORDER BY trade_date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n FROM supr) x WHERE n >= 12 GROUP BY board")
both("freeze_decision", "SELECT board, CASE WHEN n < 50 THEN 'defer' WHEN s > 2 THEN 'reject' ELSE 'freeze' END AS decision FROM (SELECT board, count(ret) AS n, stddev_samp(ret) AS s FROM supr GROUP BY board) x")
both("portfolio_variance", f"WITH f AS ({_FACTOR}), c AS (SELECT a.board AS i, b.board AS j, covar_pop(a.f, b.f) AS cov FROM f a JOIN f b ON b.k = a.k GROUP BY a.board, b.board), s0 AS (SELECT board, sum(cap) AS c FROM sup WHERE trade_date = DATE '2000-01-01' GROUP BY board), x AS (SELECT board, c / (SELECT sum(c) FROM s0) AS e FROM s0) SELECT round(sum(a.e * b.e * c.cov), 7) AS factor_variance FROM c JOIN x a ON a.board = c.i JOIN x b ON b.board = c.j")
both("asset_total_variance", "SELECT s.asset_id, round(f.v + d.v, 6) AS total FROM (SELECT DISTINCT asset_id, board FROM sup) s JOIN (SELECT board, var_pop(m) AS v FROM (SELECT board, trade_date, avg(ret) AS m FROM supr WHERE ret IS NOT NULL GROUP BY board, trade_date) x GROUP BY board) f ON f.board = s.board JOIN (SELECT asset_id, var_pop(ret) AS v FROM supr GROUP BY asset_id) d ON d.asset_id = s.asset_id")
both("portfolio_pair", "SELECT trade_date, CASE WHEN count(*) = count(ret) THEN round(avg(ret), 6) END AS equal_weight FROM supr GROUP BY trade_date")
both("standardized_summary", "SELECT round(stddev_samp(z), 5) AS sd, round(avg(z), 5) AS mean, round(sqrt(avg(z * z)), 5) AS rms, round(avg(CAST(CASE WHEN abs(z) > 2 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS tail FROM (SELECT (ret - avg(ret) OVER (PARTITION BY asset_id)) / nullif(stddev_samp(ret) OVER (PARTITION BY asset_id), 0) AS z FROM supr WHERE ret IS NOT NULL) x")
both("rolling_250_calibration", "SELECT asset_id, trade_date, CASE WHEN count(ret) OVER w = 24 THEN round(stddev_samp(ret) OVER w, 5) END AS s FROM supr WINDOW w AS (PARTITION BY asset_id ORDER BY trade_date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
both("admission_criteria", "SELECT bool_and(s < 100) AS all_pass, bool_or(s > 1000) AS hard_stop FROM (SELECT asset_id, stddev_samp(ret) AS s FROM supr GROUP BY asset_id HAVING count(ret) > 3) x")
# Products of every two assets' residuals, summed as pairs on one side and through moments on the other.
_RESID = "SELECT trade_date, asset_id, ret - avg(ret) OVER (PARTITION BY trade_date) AS z FROM supr WHERE ret IS NOT NULL"
both(
    "residual_moment_identity",
    f"SELECT trade_date, round(sum(z * z), 5) AS diagonal, round((sum(z) * sum(z) - sum(z * z)) / 2, 4) AS pairs FROM ({_RESID}) x GROUP BY trade_date",
    f"SELECT d.trade_date, round(d.dd, 5) AS diagonal, round(coalesce(p.pp, 0), 4) AS pairs FROM (SELECT trade_date, sum(z * z) AS dd FROM ({_RESID}) x GROUP BY trade_date) d LEFT JOIN (SELECT a.trade_date, sum(a.z * b.z) AS pp FROM ({_RESID}) a JOIN ({_RESID}) b ON b.trade_date = a.trade_date AND a.asset_id < b.asset_id GROUP BY a.trade_date) p ON p.trade_date = d.trade_date",
)
both("metric_statistics", "SELECT trade_date, round(sum(cap * disc) / sum(cap), 6) AS wmean, round(stddev_samp(disc), 6) AS sd FROM sup GROUP BY trade_date")
both("target_admission", "SELECT asset_id, concat_ws(',', CASE WHEN e > 0.02 THEN 'exposure' END, CASE WHEN s > 3 THEN 'variance' END) AS reasons FROM (SELECT asset_id, max(share) AS e, stddev_samp(ret) AS s FROM (SELECT asset_id, ret, cap / sum(cap) OVER (PARTITION BY trade_date) AS share FROM supr) x GROUP BY asset_id) y")
both("industry_interval_availability", "SELECT asset_id, from_d, greatest(from_d, coalesce(lead(from_d) OVER (PARTITION BY asset_id ORDER BY from_d, o_orderkey), from_d)) AS available FROM member")
both("calibration_report", "SELECT board, count(*) AS pairs, bool_and(later > trade_date) AS ordered FROM (SELECT board, trade_date, lead(trade_date) OVER (PARTITION BY asset_id ORDER BY trade_date) AS later FROM supr) x WHERE later IS NOT NULL GROUP BY board")


@query("ewma_specific_variance")
def ewma_specific_variance(spark, sf_dir):
    """Each asset's own history: clip at the prior median +- 5 MAD (at least 12 of up to 36 prior rows), then EWMA of squares
    with half-life 12, shrunk to the asset's mean square by 24 observations."""
    ship(spark)
    rows = view(spark, sf_dir, "supr").where("ret IS NOT NULL").select("asset_id", "trade_date", "ret")

    def asset(g: pd.DataFrame) -> pd.DataFrame:
        r = g.sort_values("trade_date")["ret"].to_numpy(float)
        out = r.copy()
        for t in range(12, len(r)):
            prior = r[max(0, t - 36) : t]
            m = np.median(prior)
            mad = np.median(np.abs(prior - m))
            out[t] = np.clip(r[t], m - 5 * mad, m + 5 * mad)
        w = 0.5 ** (np.arange(len(r))[::-1] / 12)
        own, mean = (w * out**2).sum() / w.sum(), (out**2).mean()
        return pd.DataFrame({"asset_id": [g["asset_id"].iloc[0]], "n": [len(r)], "variance": [round((len(r) * own + 24 * mean) / (len(r) + 24), 8)]})

    return rows.groupBy("asset_id").applyInPandas(asset, "asset_id long, n long, variance double")


@query("rolling_risk_state", "SELECT asset_id, count(ret) AS n, round(sum(pow(0.9, c - rn) * ret * ret) / sum(pow(0.9, c - rn)), 6) AS ewma FROM (SELECT asset_id, ret, row_number() OVER (PARTITION BY asset_id ORDER BY trade_date) AS rn, count(*) OVER (PARTITION BY asset_id) AS c FROM supr WHERE ret IS NOT NULL) x GROUP BY asset_id")
def rolling_risk_state(spark, sf_dir):
    """One pass per asset: the state is a weighted sum and its weight."""
    ship(spark)
    rows = view(spark, sf_dir, "supr").where("ret IS NOT NULL").select("asset_id", "trade_date", "ret")

    def asset(g: pd.DataFrame) -> pd.DataFrame:
        total = weight = 0.0
        for r in g.sort_values("trade_date")["ret"]:
            total, weight = 0.9 * total + r * r, 0.9 * weight + 1
        return pd.DataFrame({"asset_id": [g["asset_id"].iloc[0]], "n": [len(g)], "ewma": [round(total / weight, 6)]})

    return rows.groupBy("asset_id").applyInPandas(asset, "asset_id long, n long, ewma double")
