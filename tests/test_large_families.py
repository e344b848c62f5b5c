"""Steps over large groups: running figures instead of frames that are added up anew for each row."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import records, robustness, selection
from panelforge.queries import QUERIES

#: How a plan shows a frame that is computed again for each row.
FORWARD = "currentrow$(), unboundedfollowing$()"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_q_values_are_running_minima(spark):
    """Ties, nulls and ends of a family against a plain loop, without a frame that reaches forward."""
    rng = np.random.default_rng(4)
    rows = [(int(k), int(k % 2), None if k % 11 == 0 else float(rng.integers(0, 40)) / 200) for k in rng.permutation(120)]
    df = selection.benjamini_hochberg(spark.createDataFrame(rows, "name int, family int, p double").repartition(5), "p", "name", "family")
    assert FORWARD not in plan(df)
    got = {r["name"]: r["q"] for r in df.collect()}
    for family in (0, 1):
        own = sorted((1.0 if p is None else p, name) for name, f, p in rows if f == family)
        least = 1.0
        for k in range(len(own), 0, -1):
            least = min(least, own[k - 1][0] * len(own) / k)
            assert got[own[k - 1][1]] == pytest.approx(least, abs=1e-15)


@pytest.mark.parametrize("by", [("family",), ()])
def test_large_families_are_spread(spark, monkeypatch, by):
    """Ranges of p give the q-values of whole families: ties, nulls, a null family, many small ones, ranges that cut families."""
    rng = np.random.default_rng(5)
    family = [None, *range(40)]
    rows = [(int(k), family[int(rng.integers(0, 41))] if k % 2 else 3, None if k % 17 == 0 else float(rng.integers(0, 60)) / 300) for k in range(900)]
    df = spark.createDataFrame(rows, "name int, family int, p double").repartition(6)
    whole = selection.benjamini_hochberg(df, "p", "name", *by)
    monkeypatch.setattr(selection, "RANGE_ROWS", 70)
    spread = selection.benjamini_hochberg(df, "p", "name", *by)
    assert spread.dtypes == whole.dtypes and FORWARD not in plan(spread)
    assert sorted(map(str, spread.collect())) == sorted(map(str, whole.collect()))
    windows = [line for line in plan(spread).splitlines() if "Window [" in line]
    assert windows and all("_range#" in line and "_p#" not in line for line in windows)  # ranges of p only, and not p itself, are put in one order for a family


def test_a_campaign_has_no_forward_frame(spark):
    attempts = spark.createDataFrame([(1, k % 7, k, k, None if k == 3 else k / 20) for k in range(15)], "family int, candidate int, attempt int, attempt_id int, p double")
    df = records.campaign_tests(attempts, "family", "candidate")
    assert FORWARD not in plan(df) and df.count() == 7


@pytest.mark.parametrize("name", ["k1_benjamini_hochberg", "k2_p_values"])
def test_queries_of_families_have_no_forward_frame(spark, sf, name):
    assert FORWARD not in plan(QUERIES[name](spark, sf))


def test_lots_of_many_tasks_are_those_of_a_plain_queue(spark, monkeypatch):
    """Fills that turn a position round, on as many tasks as the fills ask for and without a frame that reaches forward."""
    rng = np.random.default_rng(9)
    rows = [(int(k % 2), int(k % 5), int(rng.integers(0, 12)), k, float(rng.integers(-30, 31))) for k in range(200)]
    fills = spark.createDataFrame(rows, "portfolio_id int, security int, timestamp int, fill_id int, shares double")
    monkeypatch.setattr(robustness, "TASK_FILLS", 20)
    df = robustness.matched_lots(fills, fills.select("timestamp"))
    assert FORWARD not in plan(df) and "RepartitionByExpression [portfolio_id" in plan(df) and ", 11" in plan(df)
    day = {t: k for k, t in enumerate(sorted({r[2] for r in rows}))}
    want, open_ = Counter(), {}
    for p, s, t, _, q in sorted(rows, key=lambda r: (r[2], r[3])):
        lots = open_.setdefault((p, s), [])
        while q and lots and lots[0][1] * q < 0:
            n = min(abs(q), abs(lots[0][1]))
            want[p, s, lots[0][0], day[t]] += n
            q, lots[0][1] = q - np.sign(q) * n, lots[0][1] - np.sign(lots[0][1]) * n
            if not lots[0][1]:
                lots.pop(0)
        if q:
            lots.append([day[t], q])
    for (p, s), lots in open_.items():
        for k, q in lots:
            want[p, s, k, None] += abs(q)
    assert {tuple(r)[:4]: r[4] for r in df.collect()} == pytest.approx(dict(want))


def test_permutations_in_parts_are_those_of_one(spark, monkeypatch):
    """The observed and shuffled ICs don't depend on how many trials a date holds at once, which is bounded; ties and missing labels stay in."""
    rng = np.random.default_rng(6)
    rows = [(t, s, float(rng.integers(0, 9)), None if rng.random() < 0.2 else float(rng.normal())) for t in range(3) for s in range(25)]
    df = spark.createDataFrame(rows, "timestamp int, security int, s double, y double")
    whole = robustness.permutation_test(df, "s", "y", 50, 7).first()
    date = df.where("timestamp = 0").toPandas().sort_values("security")
    drawn = np.random.default_rng([7, zlib.crc32(b"0")]).permuted(np.repeat(date["s"].to_numpy()[:, None], 50, 1), axis=0)
    ok = date["y"].notna().to_numpy()
    ics = [np.corrcoef(pd.Series(x[ok]).rank(), date["y"][ok].rank())[0, 1] for x in (date["s"].to_numpy(), *drawn.T)]
    one = robustness.permutation_test(df.where("timestamp = 0"), "s", "y", 50, 7).first()
    assert one["observed"] == pytest.approx(ics[0]) and one["p"] == pytest.approx((1 + sum(abs(x) >= abs(ics[0]) for x in ics[1:])) / 51)
    for cells in (1, 60, 300):
        monkeypatch.setattr(robustness, "TRIAL_CELLS", cells)
        assert robustness.permutation_test(df, "s", "y", 50, 7).first() == pytest.approx(whole)
