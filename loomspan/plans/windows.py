"""Window functions (survey 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.stats import average_rank
from loomspan.plans.base import both, query, view

_A = "PARTITION BY asset_id ORDER BY trade_date"

both("lag_by_asset", f"SELECT asset_id, trade_date, round(px / nullif(lag(px) OVER ({_A}), 0) - 1, 6) AS r FROM ev")
both("gap_guarded_return", "SELECT asset_id, trade_date, round(ret, 6) AS r FROM evr")
both("forward_fill", f"SELECT asset_id, trade_date, round(LASTNN(p) OVER ({_A} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS filled FROM (SELECT asset_id, trade_date, CASE WHEN volume > 1 THEN px END AS p FROM ev) x")
both("suspension_aware_return", f"SELECT asset_id, trade_date, CASE WHEN prior IS NULL THEN NULL WHEN halted THEN 0.0 ELSE round(px / nullif(prior, 0) - 1, 6) END AS r, CASE WHEN prior IS NULL THEN 'first' WHEN halted THEN 'suspension' WHEN was THEN 'resumption' ELSE 'price' END AS src FROM (SELECT asset_id, trade_date, px, halted, lag(halted) OVER ({_A}) AS was, LASTNN(p) OVER ({_A} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (SELECT asset_id, trade_date, px, volume < 2 AS halted, CASE WHEN volume >= 2 THEN px END AS p FROM ev) x) y", f"SELECT asset_id, trade_date, CASE WHEN prior IS NULL THEN NULL WHEN halted THEN 0.0::DOUBLE ELSE round(px / nullif(prior, 0) - 1, 6) END AS r, CASE WHEN prior IS NULL THEN 'first' WHEN halted THEN 'suspension' WHEN was THEN 'resumption' ELSE 'price' END AS src FROM (SELECT asset_id, trade_date, px, halted, lag(halted) OVER ({_A}) AS was, LASTNN(p) OVER ({_A} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (SELECT asset_id, trade_date, px, volume < 2 AS halted, CASE WHEN volume >= 2 THEN px END AS p FROM ev) x) y")
both("last_value_ignore_nulls_prior", f"SELECT asset_id, trade_date, round(LASTNN(c) OVER ({_A} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS prior_cap FROM (SELECT asset_id, trade_date, CASE WHEN trades > 2 THEN cap END AS c FROM sup) x")
both("cumulative_product_index", f"SELECT asset_id, trade_date, round(1000.0 * exp(sum(ln(1.0 + r)) OVER ({_A} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 3) AS idx FROM (SELECT asset_id, trade_date, coalesce(ret, 0) / 50 AS r FROM supr) x WHERE r > -1")
_INDEX = """WITH daily AS (SELECT trade_date, board, sum(prior_cap * ret) / nullif(sum(prior_cap), 0) AS board_return, count(*) FILTER (WHERE ret IS NOT NULL AND prior_cap > 0) AS constituents, count(*) FILTER (WHERE ret IS NULL OR prior_cap IS NULL OR prior_cap <= 0) AS excluded FROM supr GROUP BY trade_date, board)
SELECT trade_date, board, round(board_return, 6) AS board_return, constituents, excluded, round(ln(1000.0) + sum(ln(1.0 + board_return)) OVER (PARTITION BY board ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS log_index FROM daily WHERE board_return IS NOT NULL"""
both("cap_weighted_board_index", _INDEX)
both("row_number_latest_version", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM rev WHERE rn = 1")
both("row_number_rank_dates", "SELECT trade_date, k AS open_rank FROM mon")
both("row_number_within_scope", "SELECT asset_id, trade_date, scoped, CAST(row_number() OVER (PARTITION BY asset_id, scoped ORDER BY trade_date) AS BIGINT) AS n FROM (SELECT asset_id, trade_date, volume > 1 AS scoped FROM ev) x")
both("first_row_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) x WHERE rn = 1")
both("resumption_flag", f"SELECT asset_id, trade_date, coalesce(state <> 'click' AND lag(state) OVER ({_A}) = 'click', FALSE) AS resumed FROM ev")
both("lead_forward_label", f"SELECT asset_id, trade_date, round((1 + r1) * (1 + r2) * (1 + r3) - 1, 6) AS fwd3, r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL AS complete FROM (SELECT asset_id, trade_date, lead(ret, 1) OVER ({_A}) AS r1, lead(ret, 2) OVER ({_A}) AS r2, lead(ret, 3) OVER ({_A}) AS r3 FROM evr) x")
both("multi_offset_lead_lag", "SELECT asset_id, trade_date, " + ", ".join(f"round({'lead' if k > 0 else 'lag'}(ret, {abs(k)}) OVER ({_A}), 6) AS {'p' if k > 0 else 'm'}{abs(k)}" for k in (-2, -1, 1, 2, 3)) + " FROM evr")
both("next_snapshot_date", "SELECT DISTINCT s.trade_date, s.board, n.nx FROM sup s JOIN (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nx FROM mon) n ON n.trade_date = s.trade_date")
both("rolling_sum_min_samples", f"SELECT asset_id, trade_date, CASE WHEN count(r) OVER w >= 10 THEN round(1 - exp(sum(r) OVER w), 6) END AS reversal FROM (SELECT asset_id, trade_date, ln(1 + ret) AS r FROM supr WHERE ret > -1 OR ret IS NULL) x WINDOW w AS ({_A} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)")
both("rolling_mean_shifted_adv", f"SELECT asset_id, trade_date, CASE WHEN count(volume) OVER w = 5 THEN round(avg(volume) OVER w, 6) END AS adv FROM ev WINDOW w AS ({_A} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
both("rolling_momentum_panel", f"SELECT asset_id, trade_date, CASE WHEN count(r) OVER w >= 8 THEN round(sum(r) OVER w, 6) END AS mom FROM (SELECT asset_id, trade_date, CASE WHEN ret > -1 THEN ln(1 + ret) END AS r FROM supr) x WINDOW w AS ({_A} ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)")
both("rolling_stddev_window", f"SELECT asset_id, trade_date, CASE WHEN count(ret) OVER w >= 3 THEN round(stddev_samp(ret) OVER w, 5) END AS vol, count(ret) OVER w AS n FROM supr WINDOW w AS ({_A} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)")
both("rolling_stddev_pop_prior", f"SELECT asset_id, trade_date, CASE WHEN count(ret) OVER w >= 3 THEN round(stddev_pop(ret) OVER w, 5) END AS vol FROM supr WINDOW w AS ({_A} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)")
both("trailing_robust_sigma", f"SELECT asset_id, trade_date, CASE WHEN n >= 12 THEN round(m / 0.67449, 5) END AS sigma FROM (SELECT asset_id, trade_date, count(ret) OVER ({_A} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n, PCT(abs(ret); 0.5) OVER ({_A} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m FROM supr) x")
both("momentum_12_1", f"SELECT asset_id, trade_date, CASE WHEN count(r) OVER w >= 9 THEN round(exp(sum(r) OVER w) - 1, 4) END AS mom FROM (SELECT asset_id, trade_date, CASE WHEN ret > -1 THEN ln(1 + ret) / 10 END AS r FROM supr) x WINDOW w AS ({_A} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")
both("reversal_1m", f"SELECT asset_id, trade_date, CASE WHEN count(r) OVER w >= 4 THEN round(sum(r) OVER w, 6) END AS rev FROM (SELECT asset_id, trade_date, CASE WHEN ret > -1 THEN ln(1 + ret) END AS r FROM evr) x WINDOW w AS ({_A} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
both("ntile_deciles", "SELECT asset_id, trade_date, CAST(ntile(10) OVER (PARTITION BY trade_date ORDER BY cap, asset_id) AS BIGINT) AS decile FROM sup")
both("ntile_with_tiebreak", "SELECT asset_id, trade_date, CAST(ntile(5) OVER (PARTITION BY trade_date ORDER BY volume, asset_id) AS BIGINT) AS q FROM ev")
both("liquidity_groups", "SELECT asset_id, trade_date, CAST(ntile(10) OVER (PARTITION BY trade_date ORDER BY disc, asset_id) AS BIGINT) AS g FROM sup", stored=True)
both("bucket_larger_first", "SELECT asset_id, trade_date, CAST(ntile(4) OVER (PARTITION BY trade_date ORDER BY px, asset_id) AS BIGINT) AS g FROM ev", stored=True)
both("floor_rank_bins", "SELECT asset_id, trade_date, least(CAST(floor((rn - 1) * 7.0 / n) AS BIGINT), 6) AS bin FROM (SELECT asset_id, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY cap, asset_id) AS rn, count(*) OVER (PARTITION BY trade_date) AS n FROM sup) x")


@query("average_rank", "SELECT asset_id, trade_date, rank() OVER (PARTITION BY trade_date ORDER BY volume) + (count(*) OVER (PARTITION BY trade_date, volume) - 1) / 2.0::DOUBLE - 1 AS r FROM ev")
def average_rank_query(spark, sf_dir):
    return view(spark, sf_dir, "ev").select("asset_id", "trade_date", (average_rank("volume", ["trade_date"]) - 1).cast("double").alias("r"))


both("percentile_rank_liquidity", "SELECT asset_id, trade_date, round((rank() OVER (PARTITION BY trade_date ORDER BY volume) + (count(*) OVER (PARTITION BY trade_date, volume) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY trade_date), 6) AS pr FROM ev")
both("share_of_partition", "SELECT trade_date, board, n, round(n / CAST(sum(n) OVER (PARTITION BY trade_date) AS DOUBLE), 6) AS share, n = sum(n) OVER (PARTITION BY trade_date) AS whole FROM (SELECT trade_date, board, count(*) AS n FROM sup GROUP BY trade_date, board) x")
both("demean_over", "SELECT asset_id, trade_date, round(cap - avg(cap) OVER (PARTITION BY asset_id), 3) AS d FROM sup")
both("rolling_mean_ic", "SELECT trade_date, CASE WHEN count(m) OVER w = 5 THEN round(avg(m) OVER w, 6) END AS rolling FROM (SELECT trade_date, avg(ret) AS m FROM supr GROUP BY trade_date) x WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
both("daily_change_lag", "SELECT trade_date, n, n - lag(n) OVER (ORDER BY trade_date) AS change FROM (SELECT trade_date, count(*) AS n FROM ev GROUP BY trade_date) x")
both("month_boundary_flag", "SELECT trade_date, coalesce(month(trade_date) <> month(lag(trade_date) OVER (ORDER BY trade_date)), FALSE) AS boundary FROM cal")
both("gap_fill_intervals", "SELECT asset_id, from_d, to_d, CASE WHEN label = next_label THEN 'filled' WHEN next_label IS NULL THEN 'open' ELSE 'gap' END AS kind FROM (SELECT asset_id, from_d, to_d, label, lead(label) OVER (PARTITION BY asset_id ORDER BY from_d, o_orderkey) AS next_label FROM member) x")
both("price_consistency_window", f"SELECT count_if(abs(ret - (px / prev - 1)) > 1e-9) AS bad, count(*) AS n FROM (SELECT ret, px, lag(px) OVER ({_A}) AS prev FROM supr) x WHERE prev IS NOT NULL AND ret IS NOT NULL")
both("persistent_crossing", f"SELECT asset_id, min(k) AS first_k FROM (SELECT asset_id, k, min(CASE WHEN volume >= 2 THEN 1 ELSE 0 END) OVER ({_A} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ok, lead(k, 4) OVER ({_A}) AS k4 FROM evr) x WHERE ok = 1 AND k4 = k + 4 GROUP BY asset_id")
both("one_way_turnover", "WITH w AS (SELECT p.asset_id, m.k, p.cap / sum(p.cap) OVER (PARTITION BY m.k) AS w FROM sup p JOIN mon m ON m.trade_date = p.trade_date), both_ AS (SELECT asset_id, k, w, CAST(0 AS DOUBLE) AS prev FROM w UNION ALL SELECT asset_id, k + 1, CAST(0 AS DOUBLE), w FROM w) SELECT k, round(0.5 * sum(abs(d)), 6) AS turnover FROM (SELECT asset_id, k, sum(w) - sum(prev) AS d FROM both_ GROUP BY asset_id, k) x GROUP BY k")


@query("rank_lag_panel", "SELECT asset_id, trade_date, rank() OVER (PARTITION BY trade_date ORDER BY cap DESC) AS r FROM sup")
def rank_lag_panel(spark, sf_dir):
    from pyspark.sql import Window

    return view(spark, sf_dir, "sup", stored=True).select("asset_id", "trade_date", F.rank().over(Window.partitionBy("trade_date").orderBy(F.desc("cap"))).cast("long").alias("r"))
