"""Checks of a finished signal or portfolio: permutations, holding periods, fills, marginal return, scenarios and regimes."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.operators.portfolio import backtest, performance, stepped
from panelforge.operators.sessions import GROUP_CELLS, largest_grid
from panelforge.sources.panels import AXIS_ROWS
from panelforge.sources.shared import saved

#: Shuffled signals that a date holds at once, in cells.
TRIAL_CELLS = 1 << 20
#: Fills of a task that matches lots, on average.
TASK_FILLS = 250_000


def permutation_test(df: DataFrame, signal: str, label: str, trials: int, seed: int, least: int = 5, time: str = "timestamp", security: str = "security") -> DataFrame:
    """(observed, trials, p): two-sided p-value of the mean rank IC against signals shuffled within each date.

    A date draws from its own seeded stream, so partitions don't matter. Only a date's ICs by trial leave its task. Trials without any IC don't count.
    """
    if trials < 20:
        raise ValueError("at least 20 trials")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(security)
        rng, s = np.random.default_rng([seed, zlib.crc32(str(pdf[time].iloc[0]).encode())]), pdf[signal].to_numpy(float)
        y = pdf[label].to_numpy(float)
        ok = np.isfinite(y)
        if ok.sum() < least:
            return pd.DataFrame({"trial": pd.Series(dtype="int32"), "ic": pd.Series(dtype=float)})
        b = pd.Series(y[ok]).rank().to_numpy()
        b -= b.mean()
        ics, size = np.empty(trials + 1), (b**2).sum()
        width = max(1, TRIAL_CELLS // len(s))
        for at in range(0, trials + 1, width):  # the stream goes on from one part to the next, so their width doesn't matter
            n = min(width, trials + 1 - at)
            drawn = np.repeat(s[:, None], n, 1)
            own = int(at == 0)  # the first column is the signal itself
            drawn[:, own:] = rng.permuted(drawn[:, own:], axis=0)
            a = pd.DataFrame(drawn[ok]).rank().to_numpy()
            a -= a.mean(0)
            scale = np.sqrt((a**2).sum(0) * size)
            ics[at : at + n] = np.where(scale > 0, b @ a / np.where(scale > 0, scale, 1), np.nan)
        return pd.DataFrame({"trial": np.arange(trials + 1), "ic": ics})

    rows = df.where(F.col(signal).isNotNull() & ~F.isnan(signal)).select(time, security, signal, label)
    means = rows.groupBy(time).applyInPandas(run, "trial int, ic double").groupBy("trial").agg(F.avg(stats.finite(F.col("ic"))).alias("ic")).where("ic is not null")
    seen = F.max(F.when(F.col("trial") == 0, F.col("ic")))
    null = F.collect_list(F.when(F.col("trial") > 0, F.col("ic")))  # one number for each trial
    out = means.agg(seen.alias("observed"), null.alias("_null"))
    beyond = F.size(F.filter("_null", lambda v: F.abs(v) >= F.abs(F.col("observed"))))
    return out.select("observed", F.size("_null").alias("trials"), F.when(F.col("observed").isNotNull() & (F.size("_null") > 0), (1 + beyond) / (F.size("_null") + 1)).alias("p"))


def _opened_and_closed(fills: DataFrame, calendar: DataFrame, portfolio: str, security: str, time: str, order: str) -> DataFrame:
    """Fills with their session ``_k`` (``_last``: the last one) and the shares they close of the position before them and open anew."""
    axis = calendar.select(time).distinct().withColumn("_k", F.row_number().over(W.orderBy(time)) - 1)  # one row for each session
    axis = axis.withColumn("_last", F.max("_k").over(W.partitionBy()))
    axis = saved(axis)
    short = F.broadcast(axis) if axis.count() <= AXIS_ROWS else axis  # else fills would be dealt out by their few sessions
    rows = fills.join(short, time).select(portfolio, security, "_k", "_last", order, F.coalesce(F.col("shares").cast("double"), F.lit(0.0)).alias("_q"))
    rows = rows.repartition(1 + fills.count() // TASK_FILLS, portfolio, security)  # so that a task's sorts don't grow with the table
    before = W.partitionBy(portfolio, security).orderBy("_k", order).rowsBetween(W.unboundedPreceding, -1)
    held = rows.withColumn("_held", F.coalesce(F.sum("_q").over(before), F.lit(0.0)))
    closed = F.when(F.signum("_q") * F.signum("_held") < 0, F.least(F.abs("_q"), F.abs("_held"))).otherwise(0.0)
    return held.withColumn("_closed", closed).withColumn("_opened", F.abs("_q") - F.col("_closed"))


def holding_sessions(fills: DataFrame, calendar: DataFrame, portfolio: str = "portfolio_id", security: str = "security", time: str = "timestamp", order: str = "fill_id") -> DataFrame:
    """(portfolio, sessions): average age of shares from first in to first out; lots still open count up to the last session.

    ``fills`` holds signed ``shares``; fills outside the calendar are left out, null shares are none. Each opened share is closed once or is open at the end, so the ages add up to the
    closing sessions less the opening ones, whichever share meets which; ``matched_lots`` has the pairs.
    """
    rows = _opened_and_closed(fills, calendar, portfolio, security, time, order)
    age = F.sum(F.col("_closed") * F.col("_k") - F.col("_opened") * F.col("_k") + (F.col("_opened") - F.col("_closed")) * F.col("_last"))
    return rows.groupBy(portfolio).agg(F.try_divide(age, F.sum("_opened")).alias("sessions"))


def matched_lots(fills: DataFrame, calendar: DataFrame, portfolio: str = "portfolio_id", security: str = "security", time: str = "timestamp", order: str = "fill_id") -> DataFrame:
    """(portfolio, security, opened, closed, shares): shares by the sessions (numbered from 0) in which they were opened and closed, first in first out; ``closed`` is null for open ones.

    Opened and closed shares are intervals of two running sums. All ends in one order cut them into parts, and a part belongs to the first interval of either sum that reaches its end, so one ordered pass matches them.
    """
    rows = _opened_and_closed(fills, calendar, portfolio, security, time, order)
    upto = W.partitionBy(portfolio, security).orderBy("_k", order).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumns({"_o": F.sum("_opened").over(upto), "_c": F.sum("_closed").over(upto)})
    none = F.lit(None).cast("int")
    opens = F.when(F.col("_opened") > 0, F.struct(F.col("_o").alias("_end"), F.col("_k").alias("_open"), none.alias("_close")))
    closes = F.when(F.col("_closed") > 0, F.struct(F.col("_c").alias("_end"), none.alias("_open"), F.col("_k").alias("_close")))
    each = summed.select(portfolio, security, F.inline(F.array_compact(F.array(opens, closes))))
    ends = each.groupBy(portfolio, security, "_end").agg(F.min("_open").alias("_open"), F.min("_close").alias("_close"))
    falling = W.partitionBy(portfolio, security).orderBy(F.desc("_end"))
    later = falling.rowsBetween(W.unboundedPreceding, 0)  # this end and those above it, nearest last
    part = F.col("_end") - F.coalesce(F.lead("_end").over(falling), F.lit(0.0))
    made = ends.select(portfolio, security, F.last("_open", ignorenulls=True).over(later).alias("opened"), F.last("_close", ignorenulls=True).over(later).alias("closed"), part.alias("shares"))
    return made.where("shares > 1e-12").groupBy(portfolio, security, "opened", "closed").agg(F.sum("shares").alias("shares"))


def fill_ratio(orders: DataFrame, portfolio: str = "portfolio_id") -> DataFrame:
    """(portfolio, fill_ratio): absolute shares filled over those requested; null where none were requested."""
    return orders.groupBy(portfolio).agg(F.try_divide(F.sum(F.abs(F.coalesce("filled", F.lit(0.0)))), F.sum(F.abs("requested"))).alias("fill_ratio"))


def marginal_contribution(df: DataFrame, base: str, candidate: str, by: str, periods: float = 252.0) -> DataFrame:
    """(by, n, beta, residual_annual, corr): the candidate's return regressed on the base's, over rows with both; null below three rows.

    Least squares leave residuals of mean zero, so the residual return is the intercept.
    """
    both = df.where(F.col(base).isNotNull() & F.col(candidate).isNotNull())
    enough = F.count("*") >= 3
    out = both.groupBy(by).agg(
        F.count("*").alias("n"), F.when(enough, F.regr_slope(candidate, base)).alias("beta"), F.when(enough, F.regr_intercept(candidate, base) * periods).alias("residual_annual"),
        F.when(enough, stats.safe_corr(F.col(base), F.col(candidate))).alias("corr"),
    )
    return out


def marginal_admission(df: DataFrame, base: str, candidate: str, by: str, time: str = "timestamp", periods: float = 252.0, least_residual: float = 0.0, least_ratio: float = 0.0) -> DataFrame:
    """``marginal_contribution`` with the candidate's metrics less the base's over the same rows, and ``admitted``: whether the residual return and the gain in information ratio both pass their bounds.

    ``return_delta``: of mean returns a year; ``ratio_delta``: of information ratios (null where a side doesn't vary); ``drawdown_delta``: of the worst falls of compounded returns from their peak.
    A return of -1 or less ends its side's figures. What is undefined admits none.
    """
    both = df.where(F.col(base).isNotNull() & F.col(candidate).isNotNull()).select(by, time, base, candidate)
    upto = W.partitionBy(by).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    rows = both
    for k, c in enumerate((base, candidate)):
        grown = F.sum(F.when(F.col(c) > -1, F.log1p(c))).over(upto)
        rows = rows.withColumn(f"_g{k}", F.when(F.min(c).over(upto) > -1, grown)).withColumn(f"_fall{k}", F.exp(F.col(f"_g{k}") - F.greatest(F.max(f"_g{k}").over(upto), F.lit(0.0))) - 1)
    year = [F.avg(c) * periods for c in (base, candidate)]
    ratio = [F.when(F.min(c) != F.max(c), F.avg(c) / F.stddev_samp(c) * periods**0.5) for c in (base, candidate)]
    fall = [F.when(F.count(f"_fall{k}") == F.count("*"), F.min(f"_fall{k}")) for k in (0, 1)]
    deltas = rows.groupBy(by).agg((year[1] - year[0]).alias("return_delta"), (ratio[1] - ratio[0]).alias("ratio_delta"), (fall[1] - fall[0]).alias("drawdown_delta"))
    out = marginal_contribution(both, base, candidate, by, periods).join(deltas, by)
    passes = (F.col("residual_annual") > least_residual) & (F.col("ratio_delta") > least_ratio)
    return out.withColumn("admitted", F.coalesce(passes, F.lit(False)))


def capital_and_delay(targets: DataFrame, capital: float, capitals: list[float], delays: list[int], group_cells: int = GROUP_CELLS) -> DataFrame:
    """NAVs of the base run, of each other capital and of each delay of the weights in sessions, with ``scenario`` and ``value``. Scenarios are a handful.

    Portfolios of more than ``group_cells`` cells are stepped, all scenarios together: each step's scenarios are portfolios of their own.
    """
    by = W.partitionBy("portfolio_id", "security").orderBy("timestamp")
    runs = [("base", capital, capital, targets)]
    runs += [("capital", float(c), c, targets) for c in capitals]
    runs += [("delay", float(d), capital, targets.withColumn("weight", F.lag("weight", d, 0.0).over(by))) for d in delays]
    sound = targets.where("portfolio_id is not null and security is not null")
    if largest_grid(sound, "portfolio_id", "timestamp", "security") <= group_cells:
        navs = [(name, value, backtest(df, money, group_cells=None)) for name, value, money, df in runs]
        return reduce(DataFrame.unionByName, [nav.withColumns({"scenario": F.lit(name), "value": F.lit(value)}) for name, value, nav in navs])
    lagged = {f"_w{k}": F.lag("weight", d, 0.0).over(by) for k, d in enumerate(delays)}
    weights = [F.col("weight")] * (1 + len(capitals)) + [F.col(c) for c in lagged]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("run"), w.alias("weight")) for k, w in enumerate(weights))))
    dealt = sound.withColumns(lagged).withColumn("_run", each)
    dealt = dealt.select(F.struct(F.col("_run.run").alias("run"), "portfolio_id").alias("portfolio_id"), "timestamp", "security", F.col("_run.weight").alias("weight"), "price", "amount")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("portfolio_id.run") + 1)
    nav = stepped(dealt, of([float(r[2]) for r in runs]))
    told = nav.withColumns({"scenario": of([r[0] for r in runs]), "value": of([float(r[1]) for r in runs])})
    return told.withColumn("portfolio_id", F.col("portfolio_id.portfolio_id"))


def regime_slices(nav: DataFrame, regimes: DataFrame, column: str = "net_nav", periods: float = 12.0) -> DataFrame:
    """Performance by portfolio and regime (``regime``, ``start``, ``stop``, both inclusive); null figures below two sessions. Regimes are a handful of rows."""
    cut = nav.join(F.broadcast(regimes), F.col("timestamp").between(F.col("start"), F.col("stop")))
    return performance(cut, column, periods, ("portfolio_id", "regime"))
