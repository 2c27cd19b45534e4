"""Domain pipelines, data quality, point-in-time reads (survey 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators.revisions import as_of, upsert
from loomspan.plans.base import both, query, table, view

_A = "PARTITION BY asset_id ORDER BY trade_date"
both("financial_pit_normalize", "SELECT o_orderkey, l_linenumber, first_seen, CASE WHEN n = 1 THEN 'original' ELSE 'revised' END AS policy, next_open FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, min(CAST(revision_at AS DATE)) AS first_seen, count(*) AS n, min(m.trade_date) AS next_open FROM rev JOIN mon m ON m.trade_date > CAST(revision_at AS DATE) AND m.trade_date <= CAST(revision_at AS DATE) + INTERVAL 45 DAY GROUP BY l_orderkey, l_linenumber) x")
both("statement_pit_normalize", "SELECT l_orderkey, count(*) AS n, sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) > 0 AS has_revision FROM rev GROUP BY l_orderkey")
both("book_feature_as_of", "SELECT asset_id, d, amt FROM (SELECT asset_id, d, round(o_totalprice, 2) AS amt, row_number() OVER (PARTITION BY asset_id ORDER BY d DESC, o_orderkey DESC) AS rn FROM ord WHERE d <= DATE '1999-12-31' AND o_orderstatus = 'F') x WHERE rn = 1")
both("security_daily_state", f"SELECT g.asset_id, g.trade_date, CASE WHEN e.asset_id IS NULL THEN 'MISSING' WHEN e.volume < 2 THEN 'HALTED' WHEN e.state = 'click' THEN 'WATCH' ELSE 'TRADED' END AS observation_state FROM (SELECT s.asset_id, c.trade_date FROM (SELECT asset_id, min(trade_date) AS f, max(trade_date) AS t FROM ev GROUP BY asset_id) s JOIN cal c ON c.trade_date BETWEEN s.f AND s.t) g LEFT JOIN ev e ON e.asset_id = g.asset_id AND e.trade_date = g.trade_date")
both("daily_state_incremental", "SELECT asset_id, CASE WHEN volume < 2 THEN 'HALTED' ELSE 'TRADED' END AS observation_state FROM ev WHERE trade_date = (SELECT max(trade_date) FROM cal)")
both("incremental_returns", "SELECT e.asset_id, round(e.px / nullif(p.px, 0) - 1, 6) AS r FROM ev e JOIN (SELECT asset_id, max_by(px, trade_date) AS px FROM ev WHERE trade_date < (SELECT max(trade_date) FROM cal) GROUP BY asset_id) p ON p.asset_id = e.asset_id WHERE e.trade_date = (SELECT max(trade_date) FROM cal)")
both("tradable_universe", f"WITH aged AS (SELECT asset_id, trade_date, board, cap, vol, row_number() OVER ({_A}) AS age, avg(cap) OVER ({_A} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS adv FROM sup), flagged AS (SELECT asset_id, trade_date, board, age < 3 AS young, adv < 20000 AS illiquid, vol < 10 AS thin FROM aged) SELECT asset_id, trade_date, board, young, illiquid, thin, NOT (young OR illiquid OR thin) AS eligible, concat_ws(';', CASE WHEN young THEN 'LISTING_AGE' END, CASE WHEN illiquid THEN 'ADV' END, CASE WHEN thin THEN 'THIN' END) AS reasons FROM flagged")
both("market_universe_matrix", "SELECT p.asset_id, p.trade_date, round(p.px, 5) AS px, round(p.cap, 2) AS cap, n.n_name, r.r_name FROM sup p JOIN nation n ON n.n_nationkey = p.industry JOIN region r ON r.r_regionkey = p.board WHERE p.trade_date = DATE '1999-05-01'")
both("market_matrix_publish", "SELECT trade_date, count(*) AS n, count_if(px IS NULL) AS null_px, count(DISTINCT asset_id) = count(*) AS keys_ok FROM sup GROUP BY trade_date")
both("realized_returns_artifact", f"SELECT asset_id, trade_date, round(ret, 6) AS total_return, CASE WHEN ret IS NULL THEN 'gap' WHEN lag(state) OVER ({_A}) = 'click' THEN 'resumption' ELSE 'price' END AS return_source FROM evr")
both("forward_labels_artifact", f"SELECT asset_id, trade_date, round((1 + r1) * (1 + r2) - 1, 6) AS label, CAST(CASE WHEN r1 IS NULL THEN 1 ELSE 0 END + CASE WHEN r2 IS NULL THEN 1 ELSE 0 END AS BIGINT) AS missing FROM (SELECT asset_id, trade_date, lead(ret, 1) OVER ({_A}) AS r1, lead(ret, 2) OVER ({_A}) AS r2 FROM evr) x")
both("market_return_dispersion_artifact", "SELECT trade_date, count(ret) AS n, CASE WHEN count(ret) >= 30 THEN round(stddev_samp(ret), 6) END AS sigma FROM evr GROUP BY trade_date")
both("probe_signal_artifact", f"SELECT asset_id, trade_date, CASE WHEN count(r) OVER w >= 5 THEN round(1 - exp(sum(r) OVER w), 6) END AS signal, count(r) OVER w AS n FROM (SELECT asset_id, trade_date, CASE WHEN ret > -1 THEN ln(1 + ret) END AS r FROM evr) x WINDOW w AS ({_A} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
both("board_benchmark", "SELECT trade_date, board, round(sum(prior_cap * ret) / nullif(sum(prior_cap), 0), 6) AS r, 'CUSTOM_' || CAST(board AS STRING) || '_ALL' AS benchmark_id FROM supr WHERE ret IS NOT NULL GROUP BY trade_date, board", "SELECT trade_date, board, round(sum(prior_cap * ret) / nullif(sum(prior_cap), 0), 6) AS r, 'CUSTOM_' || CAST(board AS VARCHAR) || '_ALL' AS benchmark_id FROM supr WHERE ret IS NOT NULL GROUP BY trade_date, board")
both("benchmark_membership_history", "SELECT s.asset_id, s.trade_date AS effective_from, n.nx AS effective_to FROM sup s JOIN (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nx FROM mon) n ON n.trade_date = s.trade_date")
both("concept_change_scan", "SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, CASE WHEN a.asset_id IS NULL THEN 'ADD' ELSE 'REMOVE' END AS event FROM (SELECT asset_id FROM sup WHERE trade_date = DATE '1998-01-01') a FULL OUTER JOIN (SELECT asset_id FROM sup WHERE trade_date = DATE '1998-02-01') b ON b.asset_id = a.asset_id WHERE a.asset_id IS NULL OR b.asset_id IS NULL")
both("daily_quality_checks", "SELECT 'keys' AS check_name, count(*) - count(DISTINCT event_id) AS bad FROM events UNION ALL SELECT 'value_positive', count_if(value <= 0) FROM events UNION ALL SELECT 'type_known', count_if(event_type IS NULL) FROM events UNION ALL SELECT 'fk_customer', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)")
both("history_quality_checks", "SELECT 'dup_line' AS check_name, count(*) AS bad FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) a UNION ALL SELECT 'ship_before_order', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'negative_price', count(*) FROM lineitem WHERE l_extendedprice <= 0")
both("factor_data_quality", "SELECT board, count(*) AS n, count_if(cap IS NULL OR cap <= 0) AS bad_cap, count_if(abs(ret) > 50) AS wild FROM supr GROUP BY board")
both("incremental_validation", "SELECT count(*) > 0 AS rows_ok, count(DISTINCT asset_id) = count(*) AS unique_ok, count_if(px IS NULL) = 0 AS px_ok FROM ev WHERE trade_date = (SELECT max(trade_date) FROM cal)")
both("board_quality", "SELECT n_regionkey AS board, count(*) AS members, count(p.asset_id) AS covered FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT DISTINCT asset_id FROM sup) p ON p.asset_id = s_suppkey GROUP BY n_regionkey")
both("industry_quality", "SELECT trade_date, round(count_if(industry IS NOT NULL) / CAST(count(*) AS DOUBLE), 6) AS coverage, count_if(industry IS NOT NULL) / CAST(count(*) AS DOUBLE) >= 0.97 AS ok FROM sup GROUP BY trade_date")
both("l0_readiness", "SELECT (SELECT count(*) FROM events) > 0 AS has_events, (SELECT count(*) FROM orders WHERE o_totalprice IS NULL) = 0 AS prices_ok, (SELECT count(DISTINCT n_regionkey) FROM nation) = (SELECT count(*) FROM region) AS regions_ok")
both("l2_product_validation", "SELECT trade_date, count(*) AS n, abs(sum(z)) < 1e-6 AS centred FROM (SELECT trade_date, ret - avg(ret) OVER (PARTITION BY trade_date) AS z FROM supr WHERE ret IS NOT NULL) x GROUP BY trade_date")
_KEY, _REST = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ORDER = ", ".join(f"{c} DESC" for c in _REST)


@query("as_of_relation", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, {_ORDER}) AS rn FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-30 00:00:00') x WHERE rn = 1")
def as_of_relation(spark, sf_dir):
    known = as_of(table(spark, sf_dir, "lineitem"), _KEY, "l_shipdate", F.to_timestamp(F.lit("1998-06-30 00:00:00")), *(F.col(c).desc() for c in _REST))
    return known.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("silver_upsert", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01 00:00:00' THEN 1 ELSE 0 END DESC, {_ORDER}) AS rn FROM lineitem) x WHERE rn = 1")
def silver_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    split = F.to_timestamp(F.lit("1999-01-01 00:00:00"))
    merged = upsert(rows.where(F.col("l_shipdate") < split), rows.where(F.col("l_shipdate") >= split), _KEY, *(F.col(c).desc() for c in _REST))
    return merged.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


both("revision_append", "SELECT CAST(date_trunc('month', revision_at) AS DATE) AS part, count(*) AS n, count(DISTINCT l_orderkey) AS orders_ FROM rev GROUP BY CAST(date_trunc('month', revision_at) AS DATE)")
both("g0_history_report", "SELECT board, count(*) AS n, count(DISTINCT trade_date) AS days, round(PCT(cap; 0.05), 2) AS q05, round(PCT(cap; 0.5), 2) AS q50, round(PCT(cap; 0.95), 2) AS q95 FROM sup GROUP BY board")
both("report_diff", "SELECT coalesce(a.board, b.board) AS board, a.n AS before_n, b.n AS after_n, a.n IS DISTINCT FROM b.n AS changed FROM (SELECT board, count(*) AS n FROM sup WHERE trade_date < DATE '1998-01-01' GROUP BY board) a FULL OUTER JOIN (SELECT board, count(*) AS n FROM sup WHERE trade_date >= DATE '1998-01-01' GROUP BY board) b ON b.board = a.board")
both("new_listing_window", f"SELECT age, count(s) AS n, round(PCT(s; 0.5), 5) AS med_vol FROM (SELECT row_number() OVER ({_A}) AS age, stddev_samp(ret) OVER ({_A} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s FROM supr) x WHERE age <= 24 GROUP BY age")
both("external_fact_lookup", "SELECT o_orderkey, f.rate FROM ord JOIN (SELECT DATE '1900-01-01' AS a, DATE '1997-06-30' AS b, 0.001 AS rate UNION ALL SELECT DATE '1997-07-01', DATE '2100-01-01', 0.0005) f ON d BETWEEN f.a AND f.b", "SELECT o_orderkey, f.rate FROM ord JOIN (SELECT DATE '1900-01-01' AS a, DATE '1997-06-30' AS b, CAST(0.001 AS DECIMAL(4,4)) AS rate UNION ALL SELECT DATE '1997-07-01', DATE '2100-01-01', CAST(0.0005 AS DECIMAL(4,4))) f ON d BETWEEN f.a AND f.b")
both("legacy_base_validation", f"SELECT count(*) AS n, count_if(abs(ret - r2) > 1e-9) AS mismatched FROM (SELECT ret, px / nullif(lag(px) OVER ({_A}), 0) - 1 AS r2 FROM supr) x WHERE ret IS NOT NULL")
both("market_catchup_coverage", "SELECT c.trade_date, count(e.asset_id) AS n FROM cal c LEFT JOIN ev e ON e.trade_date = c.trade_date GROUP BY c.trade_date")
both("calendar_completeness", "SELECT d FROM (SELECT explode(sequence(min(d), max(d), INTERVAL 1 DAY)) AS d FROM ord) g WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT d AS x FROM ord) o WHERE o.x = g.d)", "SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series((SELECT min(d) FROM ord), (SELECT max(d) FROM ord), INTERVAL 1 DAY)) AS d) g WHERE NOT EXISTS (SELECT 1 FROM ord o WHERE o.d = CAST(g.d AS DATE))")
both("calendar_backfill", "SELECT count(*) AS days, DAYS(max(trade_date); min(trade_date)) + 1 = count(*) AS complete FROM cal")
both("industry_observation_publish", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN to_d IS NULL THEN 'open' WHEN to_d = from_d THEN 'empty' ELSE 'closed' END AS kind FROM member) x GROUP BY kind")
both("concept_full_snapshot", "SELECT n_name, expected, observed, expected - observed AS shortfall FROM (SELECT n_nationkey, n_name, count(s_suppkey) AS expected FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name) e JOIN (SELECT n_nationkey AS k, count(DISTINCT asset_id) AS observed FROM nation LEFT JOIN sup ON industry = n_nationkey AND trade_date = DATE '1999-01-01' GROUP BY n_nationkey) o ON o.k = e.n_nationkey")
both("evaluation_review_states", "SELECT board, concat_ws(',', CASE WHEN n < 1000 THEN 'SMALL' END, CASE WHEN s > 1 THEN 'VOLATILE' END) AS reasons, n >= 1000 AND s <= 1 AS passed FROM (SELECT board, count(ret) AS n, stddev_samp(ret) AS s FROM supr GROUP BY board) x")
both("research_attempt_ledger", "SELECT event_type, count(*) AS attempts, count(DISTINCT user_id) AS researchers FROM events GROUP BY event_type")
both("predictivity_runner", "SELECT board, trade_date, count(*) AS n, round(covar_pop(cap, ret) / nullif(sqrt(var_pop(cap) * var_pop(ret)), 0), 6) AS ic FROM supr WHERE ret IS NOT NULL GROUP BY board, trade_date HAVING count(*) >= 5")


@query("bse_transfer_batch", "SELECT s_suppkey, n FROM supplier JOIN (SELECT asset_id, count(*) AS n FROM (SELECT asset_id, trade_date FROM sup WHERE vol > 20 UNION SELECT asset_id, trade_date FROM sup WHERE cap > 40000) u GROUP BY asset_id) o ON o.asset_id = s_suppkey")
def bse_transfer_batch(spark, sf_dir):
    panel = view(spark, sf_dir, "sup")
    seen = panel.where("vol > 20").select("asset_id", "trade_date").union(panel.where("cap > 40000").select("asset_id", "trade_date")).distinct()
    n = seen.groupBy(F.col("asset_id").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "supplier").join(n, "s_suppkey").select("s_suppkey", "n")
