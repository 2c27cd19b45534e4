"""Projections, filters, joins, set operations, sorts (survey 2.2, 2.3, 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators.joins import asof_join, changed_rows, checked_join, interval_join
from loomspan.operators.revisions import stack
from loomspan.plans.base import both, query, run_sql, table, view

# 2.2 projections, filters, reshaping
both(
    "parse_yyyymmdd",
    "SELECT o_orderkey, CAST(try_to_timestamp(CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE date_format(o_orderdate, 'yyyyMMdd') END, 'yyyyMMdd') AS DATE) AS d FROM orders",
    "SELECT o_orderkey, CAST(try_strptime(CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y%m%d') END, '%Y%m%d') AS DATE) AS d FROM orders",
)
both("code_canonicalize", "SELECT s_suppkey, coalesce(m.new_code, s_name) AS code FROM supplier LEFT JOIN (SELECT s_suppkey AS k, 'N' || CAST(s_suppkey AS STRING) AS new_code FROM supplier WHERE s_suppkey % 3 = 0) m ON m.k = s_suppkey", "SELECT s_suppkey, coalesce(m.new_code, s_name) AS code FROM supplier LEFT JOIN (SELECT s_suppkey AS k, 'N' || CAST(s_suppkey AS VARCHAR) AS new_code FROM supplier WHERE s_suppkey % 3 = 0) m ON m.k = s_suppkey")


@query("security_normalize", "SELECT c_custkey AS asset_id, c_name AS name, c_mktsegment AS market, 'L' AS list_status FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'D' FROM supplier")
def security_normalize(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("market"), F.lit("L").alias("list_status"))
    gone = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("name"), F.lit("D").alias("list_status"))
    return stack(listed, gone)


both("calendar_normalize", "SELECT trade_date, CAST(CASE WHEN k % 7 < 5 THEN 1 ELSE 0 END AS TINYINT) AS is_open FROM cal")
both("price_limits_normalize", "SELECT asset_id, trade_date, up_limit FROM (SELECT user_id AS asset_id, CAST(ts AS DATE) AS trade_date, value * 1.1 AS up_limit, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1")
both("listed_as_of_filter", "SELECT o_orderkey, from_d, to_d FROM member WHERE from_d <= DATE '1998-01-01' AND (to_d IS NULL OR to_d > DATE '1998-01-01')")
both(
    "board_classify_case",
    "SELECT p_partkey, CASE WHEN coalesce(p_type, '') LIKE '%BRASS%' THEN 'STAR' WHEN coalesce(p_brand, '') LIKE 'Brand#1%' THEN 'CHINEXT' WHEN p_size > 40 THEN 'BSE' WHEN p_size IS NOT NULL THEN 'MAIN' END AS board_id FROM part",
)
both("board_classify_sql", "SELECT s_suppkey, CASE WHEN s_name LIKE '%1' OR right(s_name, 1) = '3' THEN 'STAR' WHEN left(s_name, 9) = 'Supplier#' AND s_nationkey < 10 THEN 'CHINEXT' ELSE 'MAIN' END AS board_id FROM supplier")
both("board_source_expr", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'vendor_market' ELSE 'symbol_rule' END AS source FROM part")
both(
    "universe_reason_flags",
    "SELECT asset_id, trade_date, low_px, thin, halted, NOT (low_px OR thin OR halted) AS eligible FROM (SELECT asset_id, trade_date, px < 20 AS low_px, volume < 2 AS thin, state = 'click' AS halted FROM ev) x",
)
both("exclusion_reason_string", "SELECT asset_id, trade_date, concat_ws(';', CASE WHEN px < 20 THEN 'LOW_PRICE' END, CASE WHEN volume < 2 THEN 'THIN' END, CASE WHEN state = 'click' THEN 'HALTED' END) AS reasons FROM ev")
both("one_price_limit_predicate", "SELECT asset_id, trade_date, NOT (lo >= 90 AND hi >= 90) AS can_buy, NOT (lo <= 10 AND hi <= 10) AS can_sell FROM (SELECT user_id AS asset_id, CAST(ts AS DATE) AS trade_date, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id, CAST(ts AS DATE)) x")
both("limit_locked_domain", "SELECT asset_id, trade_date, coalesce(locked, FALSE) AS locked, volume >= 2 AND NOT coalesce(locked, FALSE) AS in_domain FROM (SELECT asset_id, trade_date, volume, CASE WHEN volume > 1 THEN px > 100 END AS locked FROM ev) x")
both("label_policy_filter", "SELECT asset_id, trade_date, CASE WHEN rn = 1 THEN 'first_day' WHEN ret IS NULL THEN 'invalid_return' WHEN state = 'click' THEN 'resumption' ELSE 'ok' END AS reason, rn > 1 AND ret IS NOT NULL AND abs(ret) < 1e300 AND state <> 'click' AS label_eligible FROM (SELECT asset_id, trade_date, ret, state, row_number() OVER (PARTITION BY asset_id ORDER BY trade_date) AS rn FROM evr) x")
both("audit_universe_flags", "SELECT asset_id, trade_date, a, b, c, NOT (a OR b OR c) AS clean FROM (SELECT asset_id, trade_date, volume < 2 AS a, px < 30 AS b, amount > 500 AS c FROM ev) x", stored=True)
both("sample_role_label", "SELECT trade_date, CASE WHEN trade_date < DATE '1996-01-01' THEN 'excluded_pre_modern' WHEN trade_date < DATE '1997-01-01' THEN 'burn_in' WHEN trade_date < DATE '2000-01-01' THEN 'research' WHEN trade_date < DATE '2001-06-01' THEN 'holdout' ELSE 'out_of_model' END AS role, trade_date >= DATE '1997-01-01' AND trade_date < DATE '2000-01-01' AS estimation_ok FROM mon")
both("sample_calendar", "SELECT trade_date, k, CASE WHEN k <= 12 THEN 'burn_in' ELSE 'live' END AS role FROM mon WHERE trade_date >= DATE '1995-06-01'")


@query("feature_unpivot", "SELECT asset_id, trade_date, feature_id, value FROM (SELECT asset_id, trade_date, 'px' AS feature_id, round(px, 6) AS value FROM ev UNION ALL SELECT asset_id, trade_date, 'amount', round(amount, 6) FROM ev) x")
def feature_unpivot(spark, sf_dir):
    wide = view(spark, sf_dir, "ev").select("asset_id", "trade_date", F.round("px", 6).alias("px"), F.round("amount", 6).alias("amount"))
    return wide.unpivot(["asset_id", "trade_date"], ["px", "amount"], "feature_id", "value")


@query("pivot_wide_panel", "SELECT trade_date, " + ", ".join(f"round(sum(CASE WHEN board = {b} THEN cap END), 2) AS b{b}" for b in range(5)) + " FROM sup GROUP BY trade_date")
def pivot_wide_panel(spark, sf_dir):
    wide = view(spark, sf_dir, "sup").groupBy("trade_date").pivot("board", list(range(5))).agg(F.round(F.sum("cap"), 2))
    return wide.select("trade_date", *(F.col(str(b)).alias(f"b{b}") for b in range(5)))


both("one_hot_encode", "SELECT s_suppkey, " + ", ".join(f"CAST(CASE WHEN n_regionkey = {b} THEN 1 ELSE 0 END AS INT) AS r{b}" for b in range(5)) + " FROM supplier JOIN nation ON n_nationkey = s_nationkey")
both("universe_variant", "SELECT asset_id, trade_date, age >= 5 AS d120, age >= CASE WHEN board = 0 THEN 3 WHEN board = 1 THEN 8 ELSE 5 END AS derived, first_d = DATE '1995-01-01' AS frozen_d0 FROM (SELECT asset_id, trade_date, board, row_number() OVER (PARTITION BY asset_id ORDER BY trade_date) AS age, min(trade_date) OVER (PARTITION BY asset_id) AS first_d FROM sup) x")
both("derived_threshold_expr", "SELECT o.o_orderkey, r.threshold FROM ord o JOIN (SELECT DATE '1900-01-01' AS f, DATE '1997-01-01' AS t, 20 AS threshold UNION ALL SELECT DATE '1997-01-01', DATE '2000-01-01', 60 UNION ALL SELECT DATE '2000-01-01', NULL, 120) r ON o.d >= r.f AND (r.t IS NULL OR o.d < r.t)".replace("o.o_orderkey, r.", "o_orderkey, r."))


@query("column_safety_projection", "SELECT * EXCLUDE (o_orderstatus, o_orderpriority) FROM orders")
def column_safety_projection(spark, sf_dir):
    return table(spark, sf_dir, "orders").drop("o_orderstatus", "o_orderpriority")


@query("literal_tagging", "SELECT *, 'v1' AS version, 'd120' AS variant FROM nation")
def literal_tagging(spark, sf_dir):
    return table(spark, sf_dir, "nation").withColumns({"version": F.lit("v1"), "variant": F.lit("d120")})


both("seal_proxy_signal", "SELECT asset_id, trade_date, round(CASE WHEN px > 100 THEN 1.0 ELSE 0.0 END * (1 - rk / n), 6) AS seal FROM (SELECT asset_id, trade_date, px, rank() OVER (PARTITION BY trade_date ORDER BY volume) + (count(*) OVER (PARTITION BY trade_date, volume) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY trade_date) AS n FROM ev) x")


@query("risk_column_selector", "SELECT l_orderkey, l_linenumber, l_discount, l_extendedprice, l_quantity, l_tax FROM lineitem")
def risk_column_selector(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", *sorted(f.name for f in df.schema.fields if f.dataType.typeName() == "double"))


# 2.3 joins
both("left_equi_join_chain", "SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")


@query("validated_join", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def validated_join(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    right = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return checked_join(left, right, ["k"]).select("s_suppkey", "n_name")


both("inner_equi_join", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, s_name, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 45")
both("using_join_with_date_shift", "SELECT a.asset_id, a.trade_date, round(b.px, 6) AS next_px FROM evr a JOIN evr b ON b.asset_id = a.asset_id AND b.k = a.k + 1")
both("anti_join_suspension", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")


@query("anti_join_coverage", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def anti_join_coverage(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(sold, "p_partkey", "left_anti").select("p_partkey")


both("exists_correlated_subquery", "SELECT asset_id, trade_date FROM (SELECT asset_id, trade_date, ret, max(trade_date) OVER (PARTITION BY asset_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM evr) x WHERE ret IS NULL AND earlier IS NOT NULL", "SELECT asset_id, trade_date FROM evr r WHERE ret IS NULL AND EXISTS (SELECT 1 FROM ev q WHERE q.asset_id = r.asset_id AND q.trade_date < r.trade_date)")
both("semi_join_filter", "SELECT o_orderkey, o_custkey FROM orders LEFT SEMI JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'", "SELECT o_orderkey, o_custkey FROM orders SEMI JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")

_ASOF_DUCK = "SELECT e.asset_id, e.trade_date, o.d AS asof_d, o.amt AS asof_amt FROM (SELECT * FROM ev) e ASOF LEFT JOIN (SELECT asset_id, d, round(max(o_totalprice), 2) AS amt FROM ord WHERE d < DATE '2030-01-01' GROUP BY asset_id, d) o ON o.asset_id = e.asset_id AND e.trade_date {op} o.d"


def _asof_sides(spark, sf_dir):
    left = view(spark, sf_dir, "ev").select("asset_id", F.col("trade_date").alias("d"))
    right = view(spark, sf_dir, "ord").groupBy("asset_id", "d").agg(F.round(F.max("o_totalprice"), 2).alias("amt"))
    return left, right


@query("asof_backward_strict", _ASOF_DUCK.format(op=">"))
def asof_backward_strict(spark, sf_dir):
    left, right = _asof_sides(spark, sf_dir)
    return asof_join(left, right, ["asset_id"], "d", ["amt"]).withColumnRenamed("d", "trade_date")


@query("asof_left_join_sql", _ASOF_DUCK.format(op=">="))
def asof_left_join_sql(spark, sf_dir):
    left, right = _asof_sides(spark, sf_dir)
    return asof_join(left, right, ["asset_id"], "d", ["amt"], strict=False).withColumnRenamed("d", "trade_date")


@query("next_open_date_lookup", "SELECT o_orderkey, d, (SELECT min(m.trade_date) FROM mon m WHERE m.trade_date > o.d) AS next_open FROM ord o")
def next_open_date_lookup(spark, sf_dir):
    days = view(spark, sf_dir, "mon").select(F.lit(1).alias("one"), F.col("trade_date").alias("d"))
    orders = view(spark, sf_dir, "ord").select("o_orderkey", "d", (F.col("o_orderkey") % 1 + 1).cast("int").alias("one"))
    distinct = orders.select("one", "d").distinct()
    found = asof_join(distinct, days, ["one"], "d", [], strict=True, forward=True)
    return orders.join(F.broadcast(found), ["one", "d"]).select("o_orderkey", "d", F.col("asof_d").alias("next_open"))


_INTERVAL = "SELECT e.o_orderkey AS left_key, m.o_orderkey AS right_key FROM ord e JOIN member m ON m.asset_id = e.asset_id AND m.from_d <= e.d AND (m.to_d IS NULL OR m.to_d {op} e.d)"


def _interval(closed):
    def run(spark, sf_dir):
        left = view(spark, sf_dir, "ord").select("asset_id", "d", F.col("o_orderkey").alias("left_key"))
        right = view(spark, sf_dir, "member").select("asset_id", "from_d", "to_d", F.col("o_orderkey").alias("right_key"))
        return interval_join(left, right, ["asset_id"], "d", "from_d", "to_d", closed).select("left_key", "right_key")

    return run


query("interval_join_half_open", _INTERVAL.format(op=">"))(_interval(False))
query("interval_join_as_of_industry", _INTERVAL.format(op=">="))(_interval(True))
both("interval_join_closed_dedup", "SELECT left_key, right_key FROM (SELECT e.o_orderkey AS left_key, m.o_orderkey AS right_key, row_number() OVER (PARTITION BY e.o_orderkey ORDER BY m.from_d DESC, m.o_orderkey DESC) AS rn FROM ord e JOIN member m ON m.asset_id = e.asset_id AND m.from_d <= e.d AND (m.to_d IS NULL OR m.to_d >= e.d)) x WHERE rn = 1")
both("board_as_of", "SELECT asset_id, label FROM (SELECT asset_id, label, row_number() OVER (PARTITION BY asset_id ORDER BY from_d DESC, o_orderkey DESC) AS rn FROM member WHERE from_d <= DATE '1999-06-30' AND (to_d IS NULL OR to_d > DATE '1999-06-30')) x WHERE rn = 1")
both("calendar_grid_interval_join", "SELECT s.asset_id, m.trade_date FROM (SELECT asset_id, min(trade_date) AS f, max(trade_date) AS t FROM sup GROUP BY asset_id) s JOIN mon m ON m.trade_date BETWEEN s.f AND s.t")
both("cross_join_grid", "SELECT s.s_suppkey, c.trade_date, round(p.cap, 2) AS cap FROM supplier s CROSS JOIN mon c LEFT JOIN sup p ON p.asset_id = s.s_suppkey AND p.trade_date = c.trade_date")
both("scalar_bounds_cross_join", "SELECT c.trade_date FROM cal c CROSS JOIN (SELECT min(trade_date) AS lo, max(trade_date) AS hi FROM evr WHERE ret IS NOT NULL) b WHERE c.trade_date BETWEEN b.lo AND b.hi")
both("self_join_lag_k", "SELECT a.asset_id, a.k, round(b.cap - a.cap, 2) AS change5 FROM supr a JOIN supr b ON b.asset_id = a.asset_id AND b.k = a.k + 5")
both("next_return_date_map", "SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM cal")
both("global_exposure_date_shift", "SELECT e.asset_id, e.trade_date, c.trade_date AS label_date FROM evr e JOIN cal c ON c.k = e.k + 2")
both("prior_year_self_join", "SELECT a.asset_id, a.trade_date, round(a.cap / nullif(b.cap, 0) - 1, 6) AS growth FROM sup a JOIN sup b ON b.asset_id = a.asset_id AND b.trade_date = CAST(add_months(a.trade_date, -12) AS DATE)", "SELECT a.asset_id, a.trade_date, round(a.cap / nullif(b.cap, 0) - 1, 6) AS growth FROM sup a JOIN sup b ON b.asset_id = a.asset_id AND b.trade_date = CAST(a.trade_date - INTERVAL 12 MONTH AS DATE)")
both("execution_fact_join", "SELECT a.asset_id, a.trade_date, b.volume AS next_volume, coalesce(b.state <> 'click', FALSE) AS can_trade FROM evr a LEFT JOIN evr b ON b.asset_id = a.asset_id AND b.k = a.k + 1")
both("full_outer_diff_by_key", "SELECT coalesce(a.c, b.c) AS cust, CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change FROM (SELECT asset_id AS c, count(*) AS n FROM ord WHERE d < DATE '1998-01-01' GROUP BY asset_id) a FULL OUTER JOIN (SELECT asset_id AS c, count(*) AS n FROM ord WHERE d >= DATE '1998-01-01' GROUP BY asset_id) b ON a.c = b.c")


@query("changed_rows_detect", "SELECT n.asset_id, n.n, n.st FROM (SELECT asset_id, count(*) AS n, max(o_orderstatus) AS st FROM ord GROUP BY asset_id) n LEFT JOIN (SELECT asset_id, count(*) AS n, max(o_orderstatus) AS st FROM ord WHERE d < DATE '2001-01-01' GROUP BY asset_id) o ON o.asset_id = n.asset_id WHERE o.asset_id IS NULL OR n.n IS DISTINCT FROM o.n OR n.st IS DISTINCT FROM o.st")
def changed_rows_detect(spark, sf_dir):
    orders = view(spark, sf_dir, "ord")
    state = lambda df: df.groupBy("asset_id").agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("st"))
    return changed_rows(state(orders), state(orders.where("d < DATE '2001-01-01'")), ["asset_id"], ["n", "st"])


# 2.6 sorts, limits, sampling
both("sort_multi_key", "SELECT asset_id, trade_date, round(px, 6) AS px FROM ev ORDER BY asset_id, trade_date")
both("topk_by_value", "SELECT asset_id, trade_date, round(cap, 2) AS cap FROM sup ORDER BY cap DESC, asset_id LIMIT 12")
both("tail_dates", "SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS rn FROM mon WHERE trade_date <= DATE '2000-06-30') x WHERE rn <= 10")
both("trailing_bench_dates", "SELECT min(trade_date) AS start_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS rn FROM mon) x WHERE rn <= 24")
both("balanced_round_robin_sample", "SELECT asset_id, board, rn FROM (SELECT s_suppkey AS asset_id, n_regionkey AS board, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS BIGINT) AS rn FROM supplier JOIN nation ON n_nationkey = s_nationkey) x ORDER BY rn, board LIMIT 25")
both("frozen_date_sample", "SELECT p.asset_id, p.trade_date, round(p.cap, 2) AS cap FROM sup p WHERE p.trade_date IN (DATE '1996-03-01', DATE '1998-05-01', DATE '2000-07-01')")
both("pagination_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
both("scores_by_board_limit", "SELECT asset_id, rk FROM (SELECT s_suppkey AS asset_id, s_nationkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS rk FROM supplier) x WHERE s_nationkey < 10 ORDER BY rk LIMIT 200")
both("even_spaced_examples", "SELECT trade_date, top_asset FROM (SELECT m.k, p.trade_date, max_by(p.asset_id, p.cap) AS top_asset FROM sup p JOIN mon m ON m.trade_date = p.trade_date GROUP BY m.k, p.trade_date) x WHERE k IN (1, 21, 42, 62, 83)")

# 2.7 set operations
both("union_all_by_name", "SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS STRING) AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT 'region' AS extra, r_name AS name, r_regionkey AS k FROM region")
both("union_distinct", "SELECT asset_id, trade_date FROM ev WHERE px > 50 UNION SELECT asset_id, trade_date FROM ev WHERE volume > 2")
both("union_all_grid", "SELECT asset_id, trade_date, 'listed' AS part FROM sup UNION ALL SELECT s_suppkey, DATE '1994-12-01', 'pre' FROM supplier")


@query("diagonal_concat", "SELECT n_nationkey AS k, CAST(NULL AS DOUBLE) AS bal, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def diagonal_concat(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    return stack(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"))).select("k", "bal", "name")


both("set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
both("set_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
both("symmetric_change_sets", "WITH a AS (SELECT DISTINCT asset_id FROM ord WHERE d < DATE '1998-01-01'), b AS (SELECT DISTINCT asset_id FROM ord WHERE d >= DATE '2000-01-01') SELECT asset_id, 'ADD' AS change FROM (SELECT asset_id FROM b EXCEPT SELECT asset_id FROM a) x UNION ALL SELECT asset_id, 'REMOVE' FROM (SELECT asset_id FROM a EXCEPT SELECT asset_id FROM b) y")
both("distinct_keys", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x")
both("event_fold_to_state", "SELECT asset_id, last_type FROM (SELECT user_id AS asset_id, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id) x WHERE last_type <> 'click'")


@query("suspension_semi_union", "SELECT asset_id FROM ev WHERE volume > 4 UNION SELECT asset_id FROM ev WHERE px > 150")
def suspension_semi_union(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT DISTINCT asset_id FROM ev WHERE volume > 4 OR px > 150")


@query("calendar_range_join", "SELECT o_orderkey, min(m.k) AS open_rank FROM ord JOIN mon m ON m.trade_date >= d GROUP BY o_orderkey")
def calendar_range_join(spark, sf_dir):
    """The forward as-of as an equal join: each open date stands for the days after the one before it."""
    orders, opened = view(spark, sf_dir, "ord"), view(spark, sf_dir, "mon")
    first = orders.agg(F.min("d").alias("first"))
    before = opened.select(F.date_add("trade_date", 1).alias("since"), (F.col("k") + 1).alias("k"))
    spans = opened.join(before, "k", "left").crossJoin(F.broadcast(first))  # one row
    spans = spans.withColumn("since", F.coalesce("since", F.least("first", "trade_date")))
    days = spans.select(F.col("k").alias("open_rank"), F.explode(F.sequence("since", "trade_date")).alias("d"))
    return orders.join(F.broadcast(days), "d").groupBy("o_orderkey").agg(F.min("open_rank").alias("open_rank"))


@query("not_exists_subquery", "SELECT c.trade_date, s_suppkey FROM mon c CROSS JOIN supplier s WHERE NOT EXISTS (SELECT 1 FROM sup p WHERE p.asset_id = s.s_suppkey AND p.trade_date = c.trade_date)")
def not_exists_subquery(spark, sf_dir):
    grid = table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(F.broadcast(view(spark, sf_dir, "mon").select("trade_date")))
    priced = view(spark, sf_dir, "sup").select("trade_date", F.col("asset_id").alias("s_suppkey"))
    return grid.join(priced, ["trade_date", "s_suppkey"], "left_anti").select("trade_date", "s_suppkey")
