"""Weights, costs and a session-by-session backtest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.sessions import GROUP_CELLS, in_sessions, largest_grid
from panelforge.sources.shared import saved


def top_quantile(df: DataFrame, score: str, fraction: float, gross: float = 1.0, net: float = 0.0, min_names: int = 1, time: str = "timestamp", security: str = "security") -> DataFrame:
    """Equal weights for the best and worst ``fraction`` of a date's scored names; ties go by security."""
    w = W.partitionBy(time)
    rows = df.where(F.col(score).isNotNull()).withColumn("_rn", F.row_number().over(w.orderBy(score, security))).withColumn("_n", F.count("*").over(w))
    k = F.greatest(F.lit(min_names), F.floor(F.col("_n") * fraction))
    long, short = F.col("_rn") > F.col("_n") - k, F.col("_rn") <= k
    return rows.select(time, security, F.when(long, (gross + net) / 2 / k).when(short, -(gross - net) / 2 / k).otherwise(0.0).alias("weight"))


def rank_weights(df: DataFrame, score: str, gross: float = 1.0, net: float = 0.0, time: str = "timestamp", security: str = "security") -> DataFrame:
    """Weights in proportion to centred ranks, both sides scaled to their budgets."""
    w = W.partitionBy(time)
    rows = df.where(F.col(score).isNotNull()).withColumn("_c", F.row_number().over(w.orderBy(score, security)) / F.count("*").over(w) - 0.5)
    up, down = F.sum(F.greatest("_c", F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("_c"), F.lit(0.0))).over(w)
    weight = F.when(F.col("_c") > 0, F.try_divide(F.col("_c"), up) * (gross + net) / 2).when(F.col("_c") < 0, F.try_divide(F.col("_c"), down) * (gross - net) / 2).otherwise(0.0)
    return rows.select(time, security, weight.alias("weight"))


def capped_simplex(df: DataFrame, weight: str, cap: float, budget: float = 1.0, time: str = "timestamp", security: str = "security") -> DataFrame:
    """Nearest weights in [0, cap] that sum to the budget: each is the given one less a shift of its date, cut to the bounds. Null weights count as 0; a cap too small for the budget is an error when rows are read.

    As the shift falls, a weight starts to grow at its own value and stops a cap below it. Between these points the sum is linear, so running sums over a date's points in falling order give the exact shift.
    """
    x = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    grows, stops = F.struct(F.lit(0).alias("stop"), x.alias("t")), F.struct(F.lit(1).alias("stop"), (x - cap).alias("t"))
    points = df.select(time, security, x.alias("_x"), F.explode(F.array(grows, stops)).alias("_p")).select(time, security, "_x", F.col("_p.stop").alias("_stop"), F.col("_p.t").alias("_t"))
    falling = W.partitionBy(time).orderBy(F.desc("_t")).rangeBetween(W.unboundedPreceding, 0)
    growing, whole = F.sum(1 - 2 * F.col("_stop")).over(falling), F.sum("_stop").over(falling)
    total = F.sum((1 - 2 * F.col("_stop")) * F.col("_x")).over(falling) + cap * whole  # less the shift for each that grows
    summed = points.withColumns({"_n": growing, "_sum": total})
    date = W.partitionBy(time)
    reached = F.col("_sum") - F.col("_n") * F.col("_t") <= budget
    at = F.min_by(F.struct("_t", "_n", "_sum"), F.when(reached, F.col("_t"))).over(date)
    shift = F.when(at["_n"] > 0, (at["_sum"] - budget) / at["_n"]).otherwise(at["_t"])
    fits = F.when(cap * F.count("*").over(date) / 2 < budget - 1e-12, F.raise_error(F.lit("the cap is too small for the budget")).cast("double")).otherwise(shift)
    out = summed.withColumn("_shift", fits).where("_stop = 0")
    return out.select(time, security, F.least(F.greatest(F.col("_x") - F.col("_shift"), F.lit(0.0)), F.lit(float(cap))).alias("weight"))


def one_way_turnover(df: DataFrame, time: str = "timestamp", security: str = "security") -> DataFrame:
    by = W.partitionBy(security).orderBy(time)
    moved = df.withColumn("_d", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(by), F.lit(0.0))))
    return moved.groupBy(time).agg((F.sum("_d") / 2).alias("turnover"), F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))


@dataclass(frozen=True)
class CostSpec:
    commission_bps: float = 3.0
    min_commission: float = 5.0
    stamp_bps: float = 10.0
    half_spread_bps: float = 2.0
    slippage_bps: float = 1.0
    impact: float = 0.1
    exponent: float = 0.5


def trade_cost(notional: Column, is_sell: Column, participation: Column, volatility: Column, spec: CostSpec = CostSpec()) -> Column:
    """Commission (with a minimum), stamp on sales, half spread, slippage and impact; nothing for no trade."""
    n = F.abs(notional)
    flat = F.greatest(n * spec.commission_bps / 1e4, F.lit(spec.min_commission)) + n * (spec.half_spread_bps + spec.slippage_bps) / 1e4
    return F.when(n == 0, 0.0).otherwise(flat + F.when(is_sell, n * spec.stamp_bps / 1e4).otherwise(0.0) + spec.impact * F.pow(participation, F.lit(spec.exponent)) * volatility * n)


NAV = "portfolio_id long, timestamp date, gross_nav double, net_nav double, cost double, n_fills long"


def backtest(targets: DataFrame, capital: float = 1e6, lot: float = 1.0, participation: float = 0.1, cost_bps: float = 5.0, group_cells: int | None = GROUP_CELLS) -> DataFrame:
    """NAV by session from (portfolio_id, timestamp, security, weight, price, amount).

    Path dependent, so each portfolio is one ordered run; portfolios run in parallel. If one has more than ``group_cells`` cells, all are stepped session by session,
    with each session spread over its securities; both ways give the same, up to the order of sums. Rows of a null portfolio or security are left out. Without ``group_cells`` nothing is counted or stepped. Orders of a session follow the weights of the session before
    and fill at its price, at most ``participation`` of the prior session's amount, in whole lots towards zero. gross - net is the cost paid.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp", "security"])
        price = pdf.pivot(index="timestamp", columns="security", values="price")
        weight = pdf.pivot(index="timestamp", columns="security", values="weight").fillna(0.0).shift(1)
        capacity = (pdf.pivot(index="timestamp", columns="security", values="amount").shift(1) * participation).fillna(0.0)
        marks = price.ffill()
        held, cash, paid, out = np.zeros(price.shape[1]), capital, 0.0, []
        for k, day in enumerate(price.index):
            p, m = price.iloc[k].to_numpy(float), marks.iloc[k].fillna(0.0).to_numpy(float)
            nav, fills = cash + held @ m, 0
            if k and np.isfinite(weight.iloc[k].to_numpy(float)).all():
                can = np.isfinite(p) & (p > 0)
                wanted = np.where(can, weight.iloc[k].to_numpy(float) * nav / np.where(can, p, 1.0), held)
                change = np.clip(wanted - held, -capacity.iloc[k].to_numpy(float) / np.where(can, p, 1.0), capacity.iloc[k].to_numpy(float) / np.where(can, p, 1.0))
                change = np.where(can, np.trunc(change / lot) * lot, 0.0)
                fills = int((change != 0).sum())
                cash -= float(change @ np.where(can, p, 0.0))
                paid += float(np.abs(change) @ np.where(can, p, 0.0)) * cost_bps / 1e4
                held = held + change
            gross = cash + held @ m
            out.append((pdf["portfolio_id"].iloc[0], day, gross, gross - paid, paid, fills))
        return pd.DataFrame(out, columns=["portfolio_id", "timestamp", "gross_nav", "net_nav", "cost", "n_fills"])

    targets = targets.where("portfolio_id is not null and security is not null")
    if group_cells is not None and largest_grid(targets, "portfolio_id", "timestamp", "security") > group_cells:
        return stepped(targets, F.lit(float(capital)), lot, participation, cost_bps)
    return targets.groupBy("portfolio_id").applyInPandas(run, NAV)


def stepped(targets: DataFrame, capital: Column, lot: float = 1.0, participation: float = 0.1, cost_bps: float = 5.0) -> DataFrame:
    """``backtest`` with holdings as a table: a session is a join of it with the session's rows, and two sums by portfolio. ``capital`` may depend on the portfolio, whose id may be of any type."""
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    targets = saved(targets.select("portfolio_id", "timestamp", "security", "weight", "price", "amount"))
    purse = [saved(targets.select("portfolio_id").distinct().withColumns({"cash": capital, "paid": zero}))]

    def step(rows: DataFrame, hint, k: int, path: str) -> DataFrame:
        rows = rows.withColumn("mark", F.coalesce("price", "mark"))
        sums = rows.groupBy("portfolio_id").agg(F.max("timestamp").alias("_day"), F.sum(F.col("held") * F.coalesce("mark", zero)).alias("_value"), F.max(F.coalesce(F.abs("w") == np.inf, F.lit(False))).alias("_bad"))
        known = sums.where("_day IS NOT NULL").join(hint(purse[0].select("portfolio_id", "cash", "paid")), "portfolio_id").withColumn("_nav", F.col("cash") + F.col("_value")).select("portfolio_id", "_day", "_nav", "_bad")
        can = (F.col("price") > 0) & (F.col("price") < np.inf) & ~F.col("_bad") & F.lit(k > 1)
        room = F.coalesce(F.col("a") * participation, zero) / F.col("price")
        change = F.least(F.greatest(F.col("w") * F.col("_nav") / F.col("price") - F.col("held"), -room), room) / lot
        moved = rows.join(hint(known), "portfolio_id").withColumn("change", F.coalesce(F.when(can, (change - change % 1) * lot), zero))
        state = saved(moved.select("portfolio_id", "security", (F.col("held") + F.col("change")).alias("held"), "mark", F.coalesce("weight", zero).alias("w"), F.col("amount").alias("a"), "change", "price", F.col("_day").alias("timestamp")))
        spent = F.col("change") * F.coalesce("price", zero)
        done = state.groupBy("portfolio_id", "timestamp").agg(
            F.sum(spent).alias("_spent"), (F.sum(F.abs(spent)) * cost_bps / 1e4).alias("_cost"), F.count_if(F.col("change") != 0).alias("n_fills"), F.sum(F.col("held") * F.coalesce("mark", zero)).alias("_value")
        )
        cash, paid = F.col("cash") - F.col("_spent"), F.col("paid") + F.col("_cost")
        purse[0] = saved(done.join(hint(purse[0].select("portfolio_id", "cash", "paid")), "portfolio_id").select("portfolio_id", "timestamp", (cash + F.col("_value")).alias("gross_nav"), (cash + F.col("_value") - paid).alias("net_nav"), paid.alias("paid"), cash.alias("cash"), "n_fills"), path)
        return state.drop("change", "price", "timestamp")

    start = {"held": zero, "mark": none, "w": none, "a": none}
    paths = in_sessions(targets, "portfolio_id", "timestamp", "security", ["weight", "price", "amount"], start, step)
    return targets.sparkSession.read.schema(purse[0].schema).parquet(*paths).withColumnRenamed("paid", "cost").select(*(c.split()[0] for c in NAV.split(", ")))


def performance(nav: DataFrame, column: str = "net_nav", periods: float = 12.0, keys: tuple[str, ...] = ("portfolio_id",)) -> DataFrame:
    """Growth, volatility, Sharpe and worst drawdown by portfolio."""
    by = W.partitionBy(*keys).orderBy("timestamp")
    rows = nav.withColumn("_r", F.try_divide(F.col(column), F.lag(column).over(by)) - 1).withColumn("_peak", F.max(column).over(by.rowsBetween(W.unboundedPreceding, 0)))
    n = F.count("_r")
    return rows.groupBy(*keys).agg(
        (F.pow(F.try_divide(F.max_by(column, "timestamp"), F.min_by(column, "timestamp")), periods / n) - 1).alias("cagr"), (F.stddev_samp("_r") * F.sqrt(F.lit(periods))).alias("volatility"),
        (F.try_divide(F.avg("_r"), F.stddev_samp("_r")) * F.sqrt(F.lit(periods))).alias("sharpe"), F.min(F.try_divide(F.col(column), F.col("_peak")) - 1).alias("max_drawdown"), F.avg((F.col("_r") > 0).cast("double")).alias("win_rate"),
    )
