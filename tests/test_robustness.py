"""Limits, ramps, lots, permutations and shortlists against plain expectations."""

import numpy as np
import pytest

from panelforge.operators import constraints, robustness, selection, shortlist


def test_projection_is_the_nearest_feasible_point():
    rng = np.random.default_rng(1)
    start, x = rng.normal(size=12) / 5, rng.normal(size=(2, 12))
    made = constraints.nearest(start, x, np.array([0.05, 0.1]), 0.0, -0.3, 0.3)[0]
    assert abs(made.sum()) < 1e-7 and np.abs(made).max() <= 0.3 + 1e-12 and (np.abs(x @ made) <= np.array([0.05, 0.1]) + 1e-7).all()
    for _ in range(20):  # the nearest point of a convex set: no feasible point lies beyond it as seen from the start
        other = constraints.nearest(rng.normal(size=12) / 5, x, np.array([0.05, 0.1]), 0.0, -0.3, 0.3)[0]
        assert (start - made) @ (other - made) < 1e-6
    with pytest.raises(ValueError):
        constraints.nearest(start, x, np.array([0.05, 0.1]), 10.0, -0.3, 0.3)


def test_ramp_stops_at_the_cap(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0), (1, 1, "b", 0.0), (1, 2, "a", 0.0), (1, 2, "b", 1.0), (2, 1, "a", 0.1)], "portfolio_id int, timestamp int, security string, weight double")
    got = {(r[0], r[1], r[2]): r[3] for r in constraints.turnover_ramp(df, 0.25).collect()}
    assert got == pytest.approx({(1, 1, "a"): 0.5, (1, 1, "b"): 0.0, (1, 2, "a"): 1 / 3, (1, 2, "b"): 1 / 3, (2, 1, "a"): 0.1})


def test_lots_leave_first_in_first_out(spark):
    days = spark.createDataFrame([(k,) for k in range(5)], "timestamp int")
    fills = spark.createDataFrame([(1, "a", 0, 1, 10.0), (1, "a", 1, 2, 10.0), (1, "a", 2, 3, -15.0), (1, "a", 3, 4, -10.0), (1, "b", 9, 5, 7.0)], "portfolio_id int, security string, timestamp int, fill_id int, shares double")
    got = robustness.holding_sessions(fills, days).collect()
    # 10 shares held 2 sessions, 5 held 1, 5 held 2, and 5 short from session 3 to the last one
    assert [tuple(r) for r in got] == [(1, pytest.approx((20 + 5 + 10 + 5) / 25))]


def test_permutation_finds_a_real_signal_and_no_other(spark):
    rng = np.random.default_rng(3)
    rows = [(t, s, float(x := rng.normal()), float(x + rng.normal() / 2), float(rng.normal())) for t in range(12) for s in range(30)]
    df = spark.createDataFrame(rows, "timestamp int, security int, s double, y double, z double")
    real, none = (robustness.permutation_test(df, "s", c, 100, 7).first() for c in ("y", "z"))
    assert real["trials"] == 100 and real["p"] == pytest.approx(1 / 101) and none["p"] > 0.02
    assert real == robustness.permutation_test(df.repartition(5), "s", "y", 100, 7).first()
    with pytest.raises(ValueError):
        robustness.permutation_test(df, "s", "y", 5, 7)


def test_objectives_take_turns(spark):
    frontier = spark.createDataFrame([(1, "a", 9.0, 5.0), (1, "b", 8.0, 4.0), (1, "c", 1.0, 1.0), (1, "d", 0.5, 0.9)], "campaign int, id string, gain double, cost double")
    pairs = spark.createDataFrame([(1, "a", "b", 0.9), (1, "a", "c", 0.1), (1, "a", "d", -0.2), (1, "c", "d", 0.3)], "campaign int, left string, right string, corr double")
    got = {r["id"]: (r["place"], r["reason"]) for r in shortlist.diverse(frontier, pairs, "campaign", "id", ["gain"], ["cost"], 3, 0.5).collect()}
    assert got == {"a": (1, "selected"), "d": (2, "selected"), "b": (None, "correlation"), "c": (3, "selected")}


def test_bootstrap_has_trials_for_its_family(spark, monkeypatch):
    """One real series among 120 survives the correction, and too few trials are refused; batches don't change what is drawn."""
    rng = np.random.default_rng(8)
    rows = [(s, t, float(rng.normal() + (3 if s == 7 else 0))) for s in range(120) for t in range(40)]
    df = spark.createDataFrame(rows, "security int, timestamp int, x double")
    got = {r["security"]: r["p"] for r in selection.block_bootstrap(df, "x", "security", "timestamp", 5, None, 1).collect()}
    assert got[7] == 1 / 2401 and got[7] * len(got) < 0.06
    monkeypatch.setattr(selection, "BATCH_CELLS", 1000)
    assert got == {r["security"]: r["p"] for r in selection.block_bootstrap(df, "x", "security", "timestamp", 5, 2400, 1).collect()}
    for few in (500, 2399):
        with pytest.raises(ValueError):
            selection.block_bootstrap(df, "x", "security", "timestamp", 5, few, 1)
