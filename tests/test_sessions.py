"""Backtests and ramps stepped session by session give what one group per portfolio gives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import constraints, portfolio, robustness, sessions

SCHEMA = "portfolio_id long, timestamp date, security long, weight double, price double, amount double"


def cells(spark):
    """Two portfolios with other calendars; missing cells, prices and weights, a price of 0, and small amounts that limit fills."""
    rng, rows = np.random.default_rng(5), []
    for p, days in ((1, range(1, 7)), (2, range(3, 6))):
        for d in days:
            for s in range(9):
                if rng.random() < 0.15:
                    continue
                price = [float(rng.uniform(5, 50)), None, math.nan, 0.0][rng.choice(4, p=[0.8, 0.08, 0.06, 0.06])]
                weight = [float(rng.normal() / 5), None, math.nan][rng.choice(3, p=[0.9, 0.05, 0.05])]
                rows.append((p, f"2024-01-0{d}", s, weight, price, [float(rng.uniform(1e3, 1e7)), None][rng.choice(2, p=[0.9, 0.1])]))
    return spark.createDataFrame(rows, SCHEMA.replace("date", "string")).withColumn("timestamp", F.to_date("timestamp"))


def by_day(df, *columns):
    return {(r["portfolio_id"], r["timestamp"], *(r[c] for c in columns if c == "security")): [r[c] for c in columns if c != "security"] for r in df.collect()}


def test_backtest_by_sessions(spark):
    df, columns = cells(spark), ("gross_nav", "net_nav", "cost", "n_fills")
    whole, stepped = by_day(portfolio.backtest(df), *columns), by_day(portfolio.backtest(df, group_cells=0), *columns)
    assert len(whole) == 9 and whole.keys() == stepped.keys() and sum(v[3] for v in whole.values()) > 10
    for key, values in whole.items():
        assert stepped[key] == pytest.approx(values, rel=1e-9)


def test_an_infinite_weight_stops_a_session(spark):
    df = cells(spark).selectExpr("portfolio_id", "timestamp", "security", "IF(day(timestamp) = 4 AND security < 5, double('inf'), weight) AS weight", "price", "amount")
    whole, stepped = by_day(portfolio.backtest(df), "net_nav", "n_fills"), by_day(portfolio.backtest(df, group_cells=0), "net_nav", "n_fills")
    assert [v[1] for k, v in sorted(stepped.items()) if k[1].day == 5] == [0, 0]
    for key, values in whole.items():
        assert stepped[key] == pytest.approx(values, rel=1e-9)


def test_ramp_by_sessions(spark):
    df = cells(spark).select("portfolio_id", "timestamp", "security", "weight")
    whole, stepped = (by_day(constraints.turnover_ramp(df, 0.2, group_cells=n), "security", "weight") for n in (10**6, 0))
    assert whole.keys() == stepped.keys() and len(whole) == 81
    for key, values in whole.items():
        assert stepped[key] == pytest.approx(values, abs=1e-12)


def test_repeated_cells_and_empty_tables(spark):
    df = cells(spark)
    with pytest.raises(Exception, match="duplicate_key:1"):
        portfolio.backtest(df.unionAll(df.where("portfolio_id = 1 AND security = 0").limit(1)), group_cells=0).collect()
    assert portfolio.backtest(df.where("security > 99")).count() == 0
    assert constraints.turnover_ramp(df.where("security > 99"), 0.2).count() == 0


def test_sessions_are_not_sent_to_the_driver(spark):
    """A session's rows meet the state by a shuffle, however small they are."""
    plans = []

    def step(rows, hint, k, path):
        plans.append(rows._jdf.queryExecution().sparkPlan().toString())
        return sessions.saved(rows.select("portfolio_id", "security", "held"), path)

    sessions.in_sessions(cells(spark), "portfolio_id", "timestamp", "security", ["weight"], {"held": F.lit(0.0)}, step)
    assert len(plans) == 6 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_scenarios_by_sessions(spark):
    """All scenarios stepped together give what each gives as one group, in one run over the sessions."""
    df = cells(spark)
    whole, stepped = ({(r["scenario"], r["value"], r["portfolio_id"], r["timestamp"]): [r["gross_nav"], r["net_nav"], r["cost"], r["n_fills"]] for r in robustness.capital_and_delay(df, 1e6, [1e5, 1e8], [1, 3], n).collect()} for n in (10**6, 0))
    assert whole.keys() == stepped.keys() and len(whole) == 45
    for key, values in whole.items():
        assert stepped[key] == pytest.approx(values, rel=1e-9)
