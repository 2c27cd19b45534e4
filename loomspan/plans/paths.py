"""Backtest, accounting and path analytics (survey 2.13)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.fees import affordable, cents, commission, commission_column, money
from loomspan.plans.base import both, query, view
from loomspan.shipping import ship

_C = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_RATED = "CAST(floor((2 * CAST(round(100 * {x}) AS BIGINT) * 1854 + 10000000) / 20000000) AS BIGINT)"
_PART = "CAST(floor((2 * CAST(round(100 * {x}) AS BIGINT) * {r} + 10000000) / 20000000) AS BIGINT)"
_COMMISSION = f"CASE WHEN {{x}} = 0 THEN 0 ELSE greatest(500, {_RATED}) END"
both("commission", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_COMMISSION.format(x='l_extendedprice')} / 100.0 AS fee FROM lineitem", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST({_COMMISSION.format(x='l_extendedprice')} AS DOUBLE) / 100 AS fee FROM lineitem")
_FEES = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST({_COMMISSION.format(x='l_extendedprice')} AS DOUBLE) / 100 AS commission_, CAST({_PART.format(x='l_extendedprice', r=100)} AS DOUBLE) / 100 AS transfer_, CAST(CASE WHEN l_returnflag = 'R' THEN {_PART.format(x='l_extendedprice', r=5000)} ELSE 0 END AS DOUBLE) / 100 AS stamp FROM lineitem"
both("fees_for", _FEES)
# the largest of the three steps around the closed form whose rounded cost fits; cents throughout
_BUY = "k * 1050 * step"
_COST = f"({_BUY} + CASE WHEN k = 0 THEN 0 ELSE greatest(500, CAST(floor((2 * {_BUY} * 1854 + 10000000) / 20000000) AS BIGINT)) END + CAST(floor((2 * {_BUY} * 100 + 10000000) / 20000000) AS BIGINT))"
_BUDGET = "SELECT c_custkey, CAST(greatest(round(100 * c_acctbal), 0) AS BIGINT) AS budget, CASE WHEN c_nationkey = 1 THEN 1 ELSE 100 END AS step, CASE WHEN c_nationkey = 1 THEN 200 ELSE 100 END AS least_ FROM customer"
_TRIES = f"SELECT b.*, greatest(CAST(floor(least(budget / (1050 * step * 1.0001954), (budget - 500) / (1050 * step * 1.00001))) AS BIGINT) + t.i, 0) AS k FROM ({_BUDGET}) b CROSS JOIN (SELECT -1 AS i UNION ALL SELECT 0 UNION ALL SELECT 1) t"
both("affordable_quantity", f"SELECT c_custkey, CAST(CASE WHEN max(k * step) >= max(least_) THEN max(k * step) ELSE 0 END AS BIGINT) AS shares FROM ({_TRIES}) x WHERE k = 0 OR {_COST} <= budget GROUP BY c_custkey")
both("rank_targets", "SELECT trade_date, asset_id, CAST(floor(0.8 * cap / (px * 100)) AS BIGINT) * 100 AS shares FROM (SELECT trade_date, asset_id, cap, px, row_number() OVER (PARTITION BY trade_date ORDER BY disc DESC, asset_id) AS rn FROM sup) x WHERE rn = 1")
both("signal_snapshot", "SELECT asset_id, trade_date, state FROM ev WHERE trade_date = (SELECT min(trade_date) FROM cal)")
both("target_actual_gap", "SELECT p_partkey, round(coalesce(t.q, 0) - coalesce(a.q, 0), 4) AS gap FROM part LEFT JOIN (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey) t ON t.k = p_partkey LEFT JOIN (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey) a ON a.k = p_partkey")
both("ledger_audit", f"SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_C} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS balance FROM orders")
both("execution_invariants", f"SELECT o_custkey, bool_and(coalesce(o_orderdate >= prev, TRUE)) AS ordered, bool_and(o_totalprice >= 0) AS priced FROM (SELECT o_custkey, o_orderdate, o_totalprice, lag(o_orderdate) OVER ({_C}) AS prev FROM orders) x GROUP BY o_custkey")
_NAV = "SELECT board, trade_date, k, exp(sum(ln(1 + r)) OVER (PARTITION BY board ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS nav, r FROM (SELECT s.board, s.trade_date, s.k, greatest(avg(s.ret) / 20, -0.9) AS r FROM supr s WHERE s.ret IS NOT NULL GROUP BY s.board, s.trade_date, s.k) x"
_PEAK = "max(nav) OVER (PARTITION BY board ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
both("drawdown_path", f"SELECT board, trade_date, round(nav, 5) AS nav, round(1 - nav / {_PEAK}, 6) AS drawdown, nav < {_PEAK} AS underwater FROM ({_NAV}) n")
both("path_durations", f"SELECT board, spell, count(*) AS days, round(sum(dd), 5) AS area FROM (SELECT board, dd, sum(CASE WHEN dd = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY board ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spell FROM (SELECT board, trade_date, 1 - nav / {_PEAK} AS dd FROM ({_NAV}) n) a) b WHERE dd > 0 GROUP BY board, spell", f"SELECT board, CAST(spell AS BIGINT) AS spell, count(*) AS days, round(sum(dd), 5) AS area FROM (SELECT board, dd, sum(CASE WHEN dd = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY board ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spell FROM (SELECT board, trade_date, 1 - nav / {_PEAK} AS dd FROM ({_NAV}) n) a) b WHERE dd > 0 GROUP BY board, spell")
both("log_quadratic_variation", f"SELECT board, round(sum(ln(1 + r) * ln(1 + r)), 6) AS qv, round(max(nav) , 5) AS top FROM ({_NAV}) n GROUP BY board")
both("capacity_adv", "SELECT asset_id, trade_date, CAST(floor(adv * 0.01 / 10) AS BIGINT) * 10 AS capacity, CAST(ceil(1000 / nullif(floor(adv * 0.01 / 10) * 10, 0)) AS BIGINT) AS sessions FROM (SELECT asset_id, trade_date, avg(cap) OVER (PARTITION BY asset_id ORDER BY trade_date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS adv FROM sup) x WHERE adv IS NOT NULL")
_EP = "SELECT user_id AS episode, event_id, value / 100 AS reward, CASE WHEN event_type = 'click' THEN 0.75 / 0.5 ELSE 0.25 / 0.5 END AS ratio, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events"
_W = "exp(sum(ln(ratio)) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
both("off_policy_evaluation", f"SELECT round(avg(w * total), 5) AS is_value, round(sum(w * total) / nullif(sum(w), 0), 5) AS wis, round(avg(pdis), 5) AS pdis, round(sum(w) * sum(w) / nullif(sum(w * w), 0), 5) AS ess FROM (SELECT episode, max_by(cw, step) AS w, sum(reward) AS total, sum(cw * reward) AS pdis FROM (SELECT episode, step, reward, {_W} AS cw FROM ({_EP}) e) x GROUP BY episode) y")
both("backtest_bars", "SELECT asset_id, trade_date, volume * 100 AS shares, round(amount * 1000, 2) AS amount_yuan, CASE WHEN count(volume) OVER w = 2 THEN avg(volume * 100) OVER w END AS adv FROM ev WINDOW w AS (PARTITION BY asset_id ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)")
both("describe_returns", "SELECT board, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 5) AS sharpe, round(PCT(ret; 0.05), 6) AS var5 FROM supr WHERE ret IS NOT NULL GROUP BY board")
both("conditional_value_at_risk", "SELECT board, round(avg(ret), 6) AS cvar FROM (SELECT board, ret, PCT(ret; 0.05) OVER (PARTITION BY board) AS q FROM supr WHERE ret IS NOT NULL) x WHERE ret <= q GROUP BY board")
both("acf_rolling_vol", "SELECT board, round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 5) AS acf1 FROM (SELECT board, a, lag(a) OVER (PARTITION BY board ORDER BY trade_date) AS b FROM (SELECT board, trade_date, abs(avg(ret)) AS a FROM supr WHERE ret IS NOT NULL GROUP BY board, trade_date) x) y WHERE b IS NOT NULL GROUP BY board")
both("ensemble_quantile_fan", "SELECT trade_date, round(PCT(ret; 0.05), 6) AS q05, round(PCT(ret; 0.5), 6) AS q50, round(PCT(ret; 0.95), 6) AS q95 FROM supr WHERE ret IS NOT NULL GROUP BY trade_date")
_MID = "SELECT p_partkey, round(100 * (below + CAST(0.5 AS DOUBLE) * count(*) OVER (PARTITION BY p_brand, p_retailprice)) / count(*) OVER (PARTITION BY p_brand), 4) AS pct FROM (SELECT p_partkey, p_brand, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS below FROM part) x"
both("mid_rank_percentile", _MID, "SELECT a.p_partkey, round(100 * (count_if(b.p_retailprice < a.p_retailprice) + CAST(0.5 AS DOUBLE) * count_if(b.p_retailprice = a.p_retailprice)) / count(*), 4) AS pct FROM part a JOIN part b ON b.p_brand = a.p_brand GROUP BY a.p_partkey")

def _money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"), ROUND_HALF_UP)


class Account:
    """Buys with what cash allows in lots of 10, at most five; F orders sell all that is held. Cents throughout."""

    def __init__(self) -> None:
        self.cash, self.shares = 50_000_000, 0

    def step(self, price: int, status: str) -> tuple[int, int]:
        """Shares traded and the fee."""
        if status == "F" and self.shares:
            traded = -self.shares
        else:
            traded = min(affordable(self.cash, price, 10, 10, transfer=False), 50) if self.cash > 0 and price > 0 else 0
        fee = commission(abs(traded) * price)
        self.cash -= traded * price + fee
        self.shares += traded
        return traded, fee


_ACCOUNT = ["o_custkey", "o_orderkey", "price", "traded", "fee", "cash", "shares"]


def fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (o_custkey, o_orderkey, o_orderstatus, price in cents), each account's together and in time. What it holds
    between batches is one account's state, however many orders the account has."""
    now, account = None, Account()
    for batch in batches:
        rows = []
        for owner, key, status, price in zip(*(batch[c].tolist() for c in ("o_custkey", "o_orderkey", "o_orderstatus", "price")), strict=True):
            if owner != now:
                now, account = owner, Account()
            traded, fee = account.step(price, status)
            rows.append((owner, key, price, traded, fee, account.cash, account.shares))
        yield pd.DataFrame(rows, columns=_ACCOUNT)


def fold_account(g: pd.DataFrame) -> pd.DataFrame:
    """One account's orders, prices in units of money: cash, shares and value are exact to the cent."""
    g = g.sort_values(["o_orderdate", "o_orderkey"]).assign(price=lambda d: [cents(x) for x in d["price"]])
    out = next(fold_sorted(iter([g])))
    out["nav"] = out["cash"] + out["price"] * out["shares"]
    for c in ("fee", "cash", "nav"):
        out[c] = [money(x) for x in out[c]]
    return out[["o_custkey", "o_orderkey", "traded", "fee", "cash", "shares", "nav"]]


def _ledger(spark, sf_dir):
    """The accounts' rows in cents. Accounts share tasks and come sorted, so that no group is gathered."""
    ship(spark)
    price = (F.col("o_totalprice") / 1000).cast("decimal(18,2)") * 100
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", price.cast("long").alias("price"))
    ordered = rows.repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")
    return ordered.mapInPandas(fold_sorted, "o_custkey long, o_orderkey long, price long, traded long, fee long, cash long, shares long")


def _money_column(c):
    return (c.cast("decimal(18,0)") / 100).cast("decimal(18,2)")


@query("accounting_engine")
def accounting_engine(spark, sf_dir):
    out = _ledger(spark, sf_dir)
    nav = F.col("cash") + F.col("price") * F.col("shares")
    return out.select("o_custkey", "o_orderkey", "traded", _money_column(F.col("fee")).alias("fee"), _money_column(F.col("cash")).alias("cash"), "shares", _money_column(nav).alias("nav"))


@query("equity_fixture_audit")
def equity_fixture_audit(spark, sf_dir):
    """Each account recomputed from its trades and prices alone, by running sums with fees from the decimal expression:
    rows whose fee, cash or shares differ from the fold's, oversold and overdrawn ones."""
    rows = _ledger(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate"), "o_orderkey")
    notional = F.abs("traded") * F.col("price")
    fee = (commission_column((notional / 100).cast("decimal(18,2)")) * 100).cast("long")
    so_far = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = rows.withColumn("fee2", fee).withColumn("cash2", 50_000_000 - F.sum(F.col("traded") * F.col("price") + F.col("fee2")).over(so_far)).withColumn("shares2", F.sum("traded").over(so_far))
    off = lambda a, b: F.count_if(F.col(a) != F.col(b))
    return again.groupBy("o_custkey").agg(F.count("*").alias("rows"), off("fee", "fee2").alias("fee_off"), off("cash", "cash2").alias("cash_off"), off("shares", "shares2").alias("shares_off"), F.count_if(F.col("shares2") < 0).alias("oversold"), F.count_if(F.col("cash2") < 0).alias("overdrawn"))


@query("ensemble_paths")
def ensemble_paths(spark, sf_dir):
    daily = view(spark, sf_dir, "evr").where("ret IS NOT NULL").groupBy("trade_date").agg(F.avg("ret").alias("m"))
    draws = daily.crossJoin(F.broadcast(spark.range(50).withColumnRenamed("id", "path")))
    noise = (F.pmod(F.xxhash64("path", "trade_date"), F.lit(2000)) - 1000) / 100000.0
    return draws.groupBy("path").agg(F.round(F.sum(F.log(1 + F.greatest(F.col("m") / 20, F.lit(-0.9)) + noise)), 8).alias("log_wealth"))
