"""Frontiers against plain comparison of all pairs."""

import numpy as np
import pytest

from panelforge.operators import selection, shortlist, skyline


def rows_of(rng, n, d, steps):
    x = rng.integers(0, steps, (n, d)) / 4.0
    return [(k, *map(float, r)) for k, r in enumerate(x)]


def dominates(o, c, epsilon):
    gain = [o[1] - c[1], o[2] - c[2], c[3] - o[3]]
    return all(g >= -epsilon for g in gain), any(g > epsilon for g in gain)


@pytest.mark.parametrize(("epsilon", "steps"), [(0.0, 9), (0.0, 60), (0.5, 12), (0.25, 60)])
def test_frontier_is_that_of_all_pairs(spark, monkeypatch, epsilon, steps):
    """Ties, repeated vectors, tolerance, rows with a null or NaN objective; small blocks, so that many meet."""
    monkeypatch.setattr(skyline, "BLOCK", 8)
    rows = rows_of(np.random.default_rng(steps), 300, 3, steps)
    odd = [(900, None, 1.0, 1.0), (901, float("nan"), 99.0, 0.0), (902, 99.0, 99.0, None)]
    df = spark.createDataFrame(rows + odd, "id long, a double, b double, v0 double").repartition(5)
    got = {r.id for r in selection.frontier(df, "id", ["a", "b"], ["v0"], epsilon).collect()}
    want = {c[0] for c in rows if not any(all(dominates(o, c, epsilon)) for o in rows)}
    assert got == want | {900, 901, 902}
    old = rows_of(np.random.default_rng(1), 40, 3, steps)
    held = spark.createDataFrame(old, "id long, a double, b double, v0 double")
    got = {r.id for r in shortlist.progressed(df, held, "id", ["a", "b"], ["v0"], epsilon).collect()}
    assert got == {c[0] for c in rows if c[0] >= 40 and not any(dominates(o, c, epsilon)[0] for o in old)} | {900, 901, 902}
    assert selection.frontier(df.where("id < 0"), "id", ["a", "b"], ["v0"], epsilon).count() == 0


def test_a_million_candidates(spark):
    """A large table, and one whose points are all on the frontier; no nested loop or cartesian product in any plan."""
    n = 1_000_000
    x = np.random.default_rng(3).random((n, 3))
    df = spark.createDataFrame(__import__("pandas").DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})).repartition(8)
    out = selection.frontier(df, "id", ["a", "b", "c"], [])
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted(r.id for r in out.collect())
    order = np.argsort(-x.sum(1))
    kept = []
    for k in order:
        if not kept or not (x[kept] >= x[k]).all(1).any():
            kept.append(k)
    assert got == sorted(kept)
    arc = spark.range(30_000).selectExpr("id", "cos(id / 30000) AS a", "sin(id / 30000) AS b")
    assert selection.frontier(arc, "id", ["a", "b"], []).count() == 30_000
