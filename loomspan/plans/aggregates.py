"""Aggregations (survey 2.4) and scalar functions (2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.stats import guarded_corr
from loomspan.plans.base import both, query, table, view

both("group_last_by_order", "SELECT asset_id, round(max_by(px, trade_date), 6) AS anchor FROM ev GROUP BY asset_id")
both("group_last_non_null", "SELECT asset_id, round(max_by(ret, CASE WHEN ret IS NOT NULL THEN trade_date END), 6) AS last_ret FROM evr GROUP BY asset_id")
both("filtered_count", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n_disc, count(*) FILTER (WHERE l_quantity < 10) AS n_small FROM lineitem GROUP BY l_returnflag")
both("count_distinct", "SELECT count(DISTINCT l_suppkey) AS n_supp, count(DISTINCT l_partkey) AS n_part FROM lineitem")
both("count_distinct_tuple", "SELECT count(*) - count(DISTINCT struct(l_orderkey, l_linenumber)) AS duplicates FROM lineitem", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
both("group_having_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
both("weighted_mean_return", "SELECT board, trade_date, round(sum(prior_cap * ret) / nullif(sum(prior_cap), 0), 6) AS board_return FROM supr GROUP BY board, trade_date")
both("weighted_mean_same_support", "SELECT trade_date, round(sum(CASE WHEN ret IS NOT NULL AND prior_cap > 0 THEN prior_cap * ret END) / nullif(sum(CASE WHEN ret IS NOT NULL AND prior_cap > 0 THEN prior_cap END), 0), 6) AS market FROM supr GROUP BY trade_date")
both("bool_any_agg", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f FROM orders GROUP BY o_custkey")
both("bool_all_agg", "SELECT trade_date, bool_and(volume >= 1 AND px > 1) AS all_valid FROM ev GROUP BY trade_date")
both("max_case_flag", "SELECT asset_id, CAST(max(CASE WHEN state = 'click' THEN 1 ELSE 0 END) AS BOOLEAN) AS clicked FROM ev GROUP BY asset_id")
both("ols_sufficient_stats", "SELECT asset_id, n, round(beta, 5) AS beta, round((sy - beta * sx) / n, 5) AS alpha FROM (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS beta FROM (SELECT asset_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM (SELECT r.asset_id, r.ret AS y, m.ret AS x FROM supr r JOIN (SELECT trade_date, avg(ret) AS ret FROM supr GROUP BY trade_date) m ON m.trade_date = r.trade_date WHERE r.ret IS NOT NULL AND m.ret IS NOT NULL) p GROUP BY asset_id) q) z WHERE n >= 20")
both("mean_then_log", "SELECT asset_id, CASE WHEN count(*) >= 15 THEN round(ln(avg(amount)), 6) END AS log_turnover FROM ev GROUP BY asset_id")
both("group_median", "SELECT industry, trade_date, round(PCT(cap; 0.5), 4) AS med FROM prt GROUP BY industry, trade_date")
both("quantile_cont_agg", "SELECT p_brand, " + ", ".join(f"round(PCT(p_retailprice; {q}), 4) AS q{int(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM part GROUP BY p_brand")
both("nearest_quantile", "SELECT p_brand, p_retailprice AS q99 FROM (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) x WHERE rn = 1 + CAST(floor(0.99 * (n - 1) + 0.5) AS BIGINT)")
both("median_filter", "SELECT l_returnflag, round(PCT(CASE WHEN l_discount > 0.02 THEN l_extendedprice END; 0.5), 4) AS med FROM lineitem GROUP BY l_returnflag")
both("stddev_samp", "SELECT trade_date, count(ret) AS n, round(stddev_samp(ret), 6) AS dispersion FROM supr GROUP BY trade_date HAVING count(ret) > 2")
both("population_sigma", "SELECT trade_date, round(stddev_pop(ret), 6) AS sigma FROM supr WHERE ret IS NOT NULL GROUP BY trade_date")
_MOMENTS = "SELECT board, n, round(s, 6) AS sigma, round(ma, 6) AS mean_abs, round(CASE WHEN s > 0 THEN m3 / (s * s * s) ELSE 0 END, 4) AS skew, round(CASE WHEN s > 0 THEN m4 / (s * s * s * s) ELSE 0 END, 4) AS kurt FROM (SELECT board, count(*) AS n, sqrt(avg(d * d)) AS s, avg(abs(ret)) AS ma, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM (SELECT board, ret, ret - avg(ret) OVER (PARTITION BY board) AS d FROM supr WHERE ret IS NOT NULL) x GROUP BY board) y"


@query("arg_max", "SELECT asset_id, max_by(trade_date, px) AS peak_date, min_by(trade_date, px) AS trough_date FROM ev GROUP BY asset_id")
def arg_max(spark, sf_dir):
    """Of equal extremes the earliest date counts; null dates and values don't count."""
    known = "CASE WHEN trade_date IS NOT NULL AND px IS NOT NULL THEN {} END"
    peak, trough = known.format("struct(NOT isnan(px), -px, trade_date)"), known.format("struct(px, trade_date)")
    return view(spark, sf_dir, "ev", stored=True).groupBy("asset_id").agg(F.expr(f"min_by(trade_date, {peak})").alias("peak_date"), F.expr(f"min_by(trade_date, {trough})").alias("trough_date"))


@query("cross_section_moments", _MOMENTS)
def cross_section_moments(spark, sf_dir):
    r = view(spark, sf_dir, "supr").where("ret IS NOT NULL").groupBy("board")
    s = F.stddev_pop("ret")
    out = r.agg(F.count("*").alias("n"), F.round(s, 6).alias("sigma"), F.round(F.avg(F.abs("ret")), 6).alias("mean_abs"), F.skewness("ret").alias("g"), F.kurtosis("ret").alias("k"))
    return out.select("board", "n", "sigma", "mean_abs", F.round(F.coalesce("g", F.lit(0.0)), 4).alias("skew"), F.round(F.coalesce(F.col("k") + 3, F.lit(0.0)), 4).alias("kurt"))


both("excess_kurtosis_two_pass", "SELECT round(avg(pow(ret - m, 4)) / nullif(pow(max(v), 2), 0) - 3, 4) AS excess FROM supr CROSS JOIN (SELECT avg(ret) AS m, var_pop(ret) AS v FROM supr) s WHERE ret IS NOT NULL")


@query("pearson_corr", "SELECT trade_date, round(covar_pop(ret, disc) / nullif(sqrt(var_pop(ret) * var_pop(disc)), 0), 6) AS c FROM supr WHERE ret IS NOT NULL AND disc IS NOT NULL GROUP BY trade_date HAVING count(*) > 3")
def pearson_corr(spark, sf_dir):
    r = view(spark, sf_dir, "supr").where("ret IS NOT NULL")
    return r.groupBy("trade_date").agg(F.round(guarded_corr(F.col("ret"), F.col("disc")), 6).alias("c"), F.count("*").alias("n")).where("n > 3").drop("n")


both("pearson_corr_scalar", "SELECT asset_id, CASE WHEN count(*) >= 3 THEN round(covar_pop(px, volume) / nullif(sqrt(var_pop(px) * var_pop(volume)), 0), 6) END AS c FROM ev GROUP BY asset_id")
both("weighted_corr", "SELECT trade_date, round((sxy / w - sx * sy / (w * w)) / nullif(sqrt((sxx / w - sx * sx / (w * w)) * (syy / w - sy * sy / (w * w))), 0), 5) AS wc FROM (SELECT trade_date, sum(vol) AS w, sum(vol * disc) AS sx, sum(vol * tax) AS sy, sum(vol * disc * disc) AS sxx, sum(vol * tax * tax) AS syy, sum(vol * disc * tax) AS sxy FROM prt GROUP BY trade_date) x")
both("regr_slope_r2", "SELECT trade_date, round(regr_slope(cap, vol), 5) AS slope, round(regr_r2(cap, vol), 6) AS r2 FROM sup GROUP BY trade_date HAVING count(*) > 5 AND var_pop(vol) > 0")
both("rmse_maxabs_reconcile", "SELECT round(sqrt(avg(d * d)), 4) AS rmse, round(max(abs(d)), 4) AS max_abs, count(CASE WHEN abs(d) > 10 THEN 1 END) AS n_changed FROM (SELECT l_extendedprice - l_quantity * p_retailprice AS d FROM lineitem JOIN part ON p_partkey = l_partkey) x")
both("mean_abs_change", "SELECT a.k, round(avg(abs(b.cap - a.cap)) + 1e-6, 2) AS mean_change FROM supr a JOIN supr b ON b.asset_id = a.asset_id AND b.k = a.k + 1 GROUP BY a.k")
both("board_count_boundaries", "SELECT trade_date, count(DISTINCT board) AS n, CAST(CASE WHEN trade_date < DATE '1995-01-01' THEN 0 ELSE 5 END AS BIGINT) AS expected FROM sup GROUP BY trade_date")
_STACK = "SELECT dim, bucket, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM (SELECT 'board' AS dim, CAST(board AS STRING) AS bucket, ret FROM supr UNION ALL SELECT 'industry', CAST(industry AS STRING), ret FROM supr) x WHERE ret IS NOT NULL GROUP BY dim, bucket"


@query("multi_dimension_stack", _STACK.replace("STRING", "VARCHAR"))
def multi_dimension_stack(spark, sf_dir):
    dims = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("bucket")) for d in ("board", "industry"))))
    r = view(spark, sf_dir, "supr").where("ret IS NOT NULL").select("ret", dims.alias("d"))
    return r.groupBy("d.dim", "d.bucket").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"))


both("string_agg_distinct_ordered", "SELECT o_custkey, array_join(sort_array(collect_set(o_orderpriority)), ',') AS p FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_custkey")
both("mode_with_stability", "SELECT asset_id, state, round(n * 1.0 / total, 6) AS share FROM (SELECT asset_id, state, n, sum(n) OVER (PARTITION BY asset_id) AS total, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, state) AS rn FROM (SELECT asset_id, state, count(*) AS n FROM ev GROUP BY asset_id, state) c) x WHERE rn = 1", "SELECT asset_id, state, CAST(round(n * 1.0 / total, 6) AS DOUBLE) AS share FROM (SELECT asset_id, state, n, sum(n) OVER (PARTITION BY asset_id) AS total, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, state) AS rn FROM (SELECT asset_id, state, count(*) AS n FROM ev GROUP BY asset_id, state) c) x WHERE rn = 1".replace("n * 1.0 / total", "CAST(n AS DOUBLE) / total"))
both("row_waterfall", "SELECT count(*) AS total, count_if(ret IS NULL) AS no_return, count_if(ret IS NOT NULL AND volume < 2) AS thin, count_if(ret IS NOT NULL AND volume >= 2) AS kept, count(*) = count_if(ret IS NULL) + count_if(ret IS NOT NULL AND volume < 2) + count_if(ret IS NOT NULL AND volume >= 2) AS identity_ok FROM evr")
both("exclusion_reason_counts", "SELECT reason, count(*) AS n FROM (SELECT concat_ws(';', CASE WHEN px < 20 THEN 'LOW' END, CASE WHEN volume < 2 THEN 'THIN' END) AS reason FROM ev) x GROUP BY reason")
both("variant_sensitivity_counts", "SELECT board, count_if(a AND NOT b) AS removed, count_if(b AND NOT a) AS added FROM (SELECT board, cap > 30000 AS a, vol > 25 AS b FROM sup) x GROUP BY ROLLUP (board)")
both("universe_move_topk", "SELECT trade_date, n, change FROM (SELECT trade_date, n, n - lag(n) OVER (ORDER BY trade_date) AS change FROM (SELECT trade_date, count(*) AS n FROM sup GROUP BY trade_date) x) y WHERE change IS NOT NULL ORDER BY abs(change) DESC, trade_date LIMIT 10")
both("industry_min_members", "SELECT trade_date, min(n) AS fewest FROM (SELECT trade_date, industry, count(*) AS n FROM prt GROUP BY trade_date, industry) x GROUP BY trade_date")
both("inventory_counts", "SELECT CAST(sum(CASE WHEN px < 20 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN volume < 2 THEN 1 ELSE 0 END) AS BIGINT) AS thin, count(*) AS n FROM ev")
both("nested_scalar_subqueries", "SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) AS n_customers, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS last_order")
both("histogram_density", "SELECT bin, n, round(n / (total * CAST(50 AS DOUBLE)), 8) AS density FROM (SELECT least(CAST(floor(value / 50.0) AS BIGINT), 9) AS bin, count(*) AS n FROM events GROUP BY least(CAST(floor(value / 50.0) AS BIGINT), 9)) x CROSS JOIN (SELECT count(*) AS total FROM events) t", "SELECT bin, count(*) AS n, CAST(round(count(*) / (max(total) * 50.0::DOUBLE), 8) AS DOUBLE) AS density FROM (SELECT least(CAST(floor(value / 50.0) AS BIGINT), 9) AS bin, count(*) OVER () AS total FROM events) x GROUP BY bin")
both("effective_sample_size", "SELECT trade_date, round(sum(cap) * sum(cap) / nullif(sum(cap * cap), 0), 4) AS ess, round(max(cap) / nullif(PCT(cap; 0.5), 0), 4) AS max_to_median FROM sup GROUP BY trade_date")
both("simple_ols_with_se", "SELECT board, round(b, 6) AS slope, round(a, 4) AS intercept, round(sqrt(greatest(syy - b * sxy, 0) / nullif(n - 2, 0) / nullif(sxx, 0)), 6) AS se FROM (SELECT board, count(*) AS n, regr_slope(cap, vol) AS b, regr_intercept(cap, vol) AS a, regr_sxx(cap, vol) AS sxx, regr_syy(cap, vol) AS syy, regr_sxy(cap, vol) AS sxy FROM sup GROUP BY board) x")
both("downweight_by_group", "SELECT board, round(avg(CASE WHEN abs(ret) > 0.5 THEN 1e0 ELSE 0e0 END), 6) AS rate, round(avg(abs(ret)), 6) AS mean_abs FROM supr WHERE ret IS NOT NULL GROUP BY board", "SELECT board, round(avg(CASE WHEN abs(ret) > 0.5 THEN 1 ELSE 0 END), 6) AS rate, round(avg(abs(ret)), 6) AS mean_abs FROM supr WHERE ret IS NOT NULL GROUP BY board")
both("strategy_correlation_matrix", "WITH b AS (SELECT board, trade_date, avg(ret) AS r FROM supr WHERE ret IS NOT NULL GROUP BY board, trade_date) SELECT x.board AS a, y.board AS b, round(covar_pop(x.r, y.r) / nullif(sqrt(var_pop(x.r) * var_pop(y.r)), 0), 5) AS c FROM b x JOIN b y ON y.trade_date = x.trade_date GROUP BY x.board, y.board")
both("table_window_coverage", "SELECT 'orders' AS t, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders UNION ALL SELECT 'events', min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), count(DISTINCT CAST(ts AS DATE)) FROM events")
both("quintile_spread", "SELECT trade_date, round(avg(CASE WHEN rn > n - q THEN ret END) - avg(CASE WHEN rn <= q THEN ret END), 6) AS spread FROM (SELECT trade_date, ret, row_number() OVER (PARTITION BY trade_date ORDER BY disc, asset_id) AS rn, count(*) OVER (PARTITION BY trade_date) AS n, greatest(1, CAST(floor(count(*) OVER (PARTITION BY trade_date) / 5) AS BIGINT)) AS q FROM supr WHERE ret IS NOT NULL) x GROUP BY trade_date", stored=True)
both("net_of_cost_return", "SELECT board, round(avg(r - 0.001), 6) AS net_mean, round(exp(sum(ln(greatest(1 + r - 0.001, 1e-9)))) - 1, 4) AS net_total FROM (SELECT board, trade_date, sum(prior_cap * ret) / nullif(sum(prior_cap), 0) / 100 AS r FROM supr GROUP BY board, trade_date) x WHERE r IS NOT NULL GROUP BY board")

# 2.8 scalar functions
both("string_fns", "SELECT p_partkey, lower(p_brand) AS lo, left(p_type, 3) AS l3, right(p_brand, 2) AS r2, replace(p_brand, 'Brand#', '') AS bare, lpad(CAST(p_partkey AS STRING), 8, '0') AS filled, p_brand LIKE 'Brand#1%' AS starts FROM part", "SELECT p_partkey, lower(p_brand) AS lo, left(p_type, 3) AS l3, right(p_brand, 2) AS r2, replace(p_brand, 'Brand#', '') AS bare, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS filled, p_brand LIKE 'Brand#1%' AS starts FROM part")
both("string_concat_lineage", "SELECT o_orderkey, 'order:' || CAST(o_orderkey AS STRING) || '@' || o_orderstatus AS lineage FROM orders", "SELECT o_orderkey, 'order:' || CAST(o_orderkey AS VARCHAR) || '@' || o_orderstatus AS lineage FROM orders")
both("date_fns", "SELECT o_orderkey, CAST(month(d) AS BIGINT) AS mo, CAST(day(d) AS BIGINT) AS da, CAST(year(d) AS BIGINT) AS yr, DAYS(d; DATE '1995-01-01') AS since, d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AS inside FROM ord")
both("listing_age_calendar_days", "SELECT asset_id, trade_date, DAYS(trade_date; first_d) AS age FROM (SELECT asset_id, trade_date, min(trade_date) OVER (PARTITION BY asset_id) AS first_d FROM ev) x")
both("listing_age_trading_days", "SELECT asset_id, trade_date, k - min(k) OVER (PARTITION BY asset_id) + 1 AS age FROM evr")
both("math_fns", "SELECT event_id, round(ln(value), 6) AS l, round(ln(1 + value), 6) AS l1, round(exp(-value / 100), 6) AS e, round(sqrt(value), 6) AS s, floor(value) AS f, least(greatest(value, 5), 100) AS clipped, abs(value - 50) AS a FROM events WHERE value > 0", "SELECT event_id, round(ln(value), 6) AS l, round(ln(1 + value), 6) AS l1, round(exp(-value / 100), 6) AS e, round(sqrt(value), 6) AS s, CAST(floor(value) AS BIGINT) AS f, least(greatest(value, 5), 100) AS clipped, abs(value - 50) AS a FROM events WHERE value > 0")
both("market_cap_derivation", "SELECT p_partkey, round(p_size * 10000 * p_retailprice, 2) AS cap FROM part")
both("adjusted_price_indices", "SELECT asset_id, trade_date, round(px * f + 1e-8, 4) AS gross, round(px * f / anchor + 1e-8, 4) AS qfq FROM (SELECT asset_id, trade_date, px, 1 + 0.01 * k AS f, max(1 + 0.01 * k) OVER (PARTITION BY asset_id) AS anchor FROM evr) x", "SELECT asset_id, trade_date, round(px * f + 1e-8, 4) AS gross, round(px * f / anchor + 1e-8, 4) AS qfq FROM (SELECT asset_id, trade_date, px, CAST(1 + 0.01 * k AS DOUBLE) AS f, CAST(max(1 + 0.01 * k) OVER (PARTITION BY asset_id) AS DOUBLE) AS anchor FROM evr) x")
both("daily_compound_rate", "SELECT l_orderkey, l_linenumber, l_tax, round(pow(1 + l_tax, 1e0 / 365) - 1, 9) AS daily FROM lineitem")
both("safe_inverse_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN round(1 / l_discount, 6) END AS inv FROM lineitem")


@query("hash_json_sha256", "SELECT n_nationkey, sha256('{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}') AS id FROM nation")
def hash_json_sha256(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))), 256).alias("id"))


@query("row_hash_seeded")
def row_hash_seeded(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.xxhash64(F.lit(7), "n_nationkey", "n_name").alias("h"))


both("json_list_columns", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
both("struct_distinct_array_agg", "SELECT l_orderkey, CAST(size(collect_set(l_suppkey)) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, CAST(len(list(DISTINCT l_suppkey)) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey")
both("decimal_money", "SELECT l_returnflag, CAST(sum(round(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(6,4)), 2)) AS DOUBLE) AS rebate FROM lineitem GROUP BY l_returnflag")
both("tz_clock_conversion", "SELECT event_id, from_utc_timestamp(ts, 'Asia/Shanghai') AS local_ts FROM events", "SELECT event_id, ts + INTERVAL 8 HOUR AS local_ts FROM events")
