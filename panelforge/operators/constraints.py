"""Weights under exposure limits, the turnover ramp and checks of finished portfolios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.sessions import GROUP_CELLS, in_sessions, largest_grid
from panelforge.sources.shared import saved

TOLERANCE = 1e-7
#: To which the conditions of the nearest weights hold.
EXACT = 1e-11


def nearest(start: np.ndarray, exposures: np.ndarray, limits: np.ndarray, net: float, low: float, high: float, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Nearest weights in the box with the given sum and ``abs(exposures @ w) <= limits``, and the multipliers of the sum, of the upper limits and of the lower ones.

    Weights follow from a multiplier for the sum and two for each exposure, none of the latter below 0: the start less the multipliers' exposures, cut to the box. The multipliers
    are found by Newton steps on those that aren't held at 0, each step as long as it raises the dual value. The result meets all optimality conditions to ``EXACT``. Limits that no weights meet
    are proven so by multipliers whose exposures no point of the box can balance; running out of ``rounds`` without either is an error of its own.
    """
    sides = np.vstack((np.ones(len(start)), exposures, -exposures))
    bound = np.concatenate(([net], limits, limits))
    free = np.arange(len(bound)) == 0
    scale = np.maximum(1.0, np.abs(sides).max(axis=1, initial=0.0))  # rows of different sizes count alike
    sides, bound = sides / scale[:, None], bound / scale

    def at(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        w = np.clip(start - sides.T @ m, low, high)
        excess = sides @ w - bound
        return w, excess, float(((w - start) ** 2).sum() / 2 + m @ excess)

    m = np.zeros(len(bound))
    w, excess, value = at(m)
    for _ in range(rounds):
        if np.abs(np.where(free | (m > 0), excess, np.maximum(excess, 0))).max() <= EXACT:
            return w, m / scale
        if _unmet(sides, bound, m, low, high):
            raise ValueError("no weights meet the risk limits")
        use = free | (m > 0) | (excess > 0)
        part = sides[use][:, (w > low) & (w < high)]
        step = np.zeros(len(m))
        step[use] = np.linalg.solve(part @ part.T + 1e-12 * max(1, len(start)) * np.eye(use.sum()), excess[use])
        length = 1.0
        while True:
            tried = np.where(free, m + length * step, np.maximum(m + length * step, 0))
            new = at(tried)
            if new[2] >= value + 1e-4 * excess @ (tried - m) or length < 1e-18:
                break
            length /= 2
        m, (w, excess, value) = tried, new
    raise RuntimeError("the risk projection did not converge")


def _unmet(sides: np.ndarray, bound: np.ndarray, m: np.ndarray, low: float, high: float) -> bool:
    """Whether multipliers prove that no point of the box meets all sides: their sum of sides is above their sum of bounds everywhere."""
    if np.abs(m).max() < 1e3:
        return False
    y = m / np.abs(m).max()
    c = sides.T @ y
    return bool(np.where(c > 0, low * c, high * c).sum() > y @ bound + 1e-9)


def risk_projection(
    df: DataFrame, weight: str, limits: dict[str, float], cap: float, gross: float = 1.0, net: float = 0.0, long_only: bool = False, known: dict[str, str] | None = None, time: str = "timestamp", security: str = "security"
) -> DataFrame:
    """Each date's nearest weights that meet the limits, scaled down to ``gross`` where they exceed it.

    Rows without a weight take no part. A missing exposure, or one whose ``known`` column is null or after the date, fails the job, as do limits that can't be met.
    One group is a date's cross-section, so it grows with the number of securities only.
    """
    names, known = list(limits), known or {}

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[names].to_numpy(float).T
        late = any((pdf[c].isna() | (pd.to_datetime(pdf[c]) > pd.to_datetime(pdf[time]))).any() for c in known.values())
        if late or not np.isfinite(x).all():
            raise ValueError("an exposure is missing or not known at the signal")
        w = nearest(pdf[weight].to_numpy(float), x, np.array([limits[n] for n in names]), net, 0.0 if long_only else -cap, cap)[0]
        w *= min(1.0, gross / max(np.abs(w).sum(), 1e-300))
        return pdf[[time, security]].assign(weight=w)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.where(F.col(weight).isNotNull()).select(time, security, weight, *names, *known.values())
    return rows.groupBy(time).applyInPandas(project, f"{time} {kinds[time]}, {security} {kinds[security]}, weight double")


def turnover_ramp(df: DataFrame, most: float, portfolio: str = "portfolio_id", time: str = "timestamp", security: str = "security", group_cells: int = GROUP_CELLS) -> DataFrame:
    """Moves towards each date's target weights by at most ``most`` one-way turnover (half the absolute change).

    A date starts from the weights reached on the one before, so a portfolio is one ordered run; portfolios run in parallel. A missing weight is 0.
    If a portfolio has more than ``group_cells`` cells, all are stepped date by date, with each date spread over its securities; both ways give the same, up to the order of sums. Rows of a null portfolio or security are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        target = pdf.pivot(index=time, columns=security, values="weight").fillna(0.0)
        now, out = np.zeros(target.shape[1]), []
        for row in target.to_numpy(float):
            turnover = np.abs(row - now).sum() / 2
            now = row if turnover <= most else now + most / turnover * (row - now)
            out.append(now)
        long = pd.DataFrame(out, index=target.index, columns=target.columns).stack().rename("weight").reset_index()
        return long.assign(**{portfolio: pdf[portfolio].iloc[0]})[[portfolio, time, security, "weight"]]

    df = df.where(F.col(portfolio).isNotNull() & F.col(security).isNotNull())
    if largest_grid(df, portfolio, time, security) > group_cells:
        return _ramp_stepped(df, most, portfolio, time, security)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(portfolio).applyInPandas(run, f"{portfolio} {kinds[portfolio]}, {time} {kinds[time]}, {security} {kinds[security]}, weight double")


def _ramp_stepped(df: DataFrame, most: float, portfolio: str, time: str, security: str) -> DataFrame:
    zero, columns = F.lit(0.0), [portfolio, time, security, "weight"]

    def step(rows: DataFrame, hint, k: int, path: str) -> DataFrame:
        gap = F.coalesce("weight", zero) - F.col("now")
        sums = rows.groupBy(portfolio).agg(F.max(time).alias("_day"), (F.sum(F.abs(gap)) / 2).alias("_t")).where("_day IS NOT NULL")
        reached = F.when(F.col("_t") <= most, F.coalesce("weight", zero)).otherwise(F.col("now") + most / F.col("_t") * gap)
        return saved(rows.join(hint(sums), portfolio).select(portfolio, F.col("_day").alias(time), security, reached.alias("weight")), path).select(portfolio, security, F.col("weight").alias("now"))

    paths = in_sessions(saved(df.select(*columns)), portfolio, time, security, ["weight"], {"now": zero}, step)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{c} {'double' if c == 'weight' else kinds[c]}" for c in columns)
    return df.sparkSession.read.schema(schema).parquet(*paths)


def broken_conditions(df: DataFrame, gross: float, net: float, cap: float, turnover: float, time: str = "timestamp", security: str = "security") -> DataFrame:
    """(timestamp, code): dates whose weights break the gross, net, single-weight or turnover limit by more than the tolerance. None for a sound portfolio."""
    by = W.partitionBy(security).orderBy(time)
    rows = df.withColumn("_d", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(by), F.lit(0.0))))
    sums = rows.groupBy(time).agg(F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n"), F.max(F.abs("weight")).alias("c"), (F.sum("_d") / 2).alias("t"))
    tests = {"gross": F.col("g") > gross + TOLERANCE, "net": F.abs(F.col("n") - net) > TOLERANCE, "weight": F.col("c") > cap + TOLERANCE, "turnover": F.col("t") > turnover + TOLERANCE}
    return sums.select(time, F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in tests.items())))).alias("code"))
