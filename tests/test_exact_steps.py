"""Residuals, exponential means, lots, capped weights and cycle checks against plain versions."""

from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import constraints, evaluate, frames, intervals, market, portfolio, postprocess, robustness


@pytest.mark.parametrize("ridge", [0.0, 0.3])
def test_residuals_on_several_exposures(spark, ridge):
    """Against a pseudo-inverse a date: values that aren't finite, an exposure that repeats another, a constant one, dates that are too short."""
    rng = np.random.default_rng(1)
    rows = [(d, k, *map(float, rng.normal(100 * d, 1 + d, 3))) for d in range(5) for k in range(3 if d == 4 else 25)]
    rows = [(d, k, y, a, a * 2 - 5 if d == 1 else 7.0 if d == 2 else b) for d, k, y, a, b in rows]
    rows[3] = (*rows[3][:2], None, 1.0, 2.0)
    rows[30] = (*rows[30][:2], float("nan"), 1.0, 2.0)
    rows[60] = (*rows[60][:2], 1.0, float("inf"), 2.0)
    df = spark.createDataFrame(rows, "timestamp int, security int, y double, a double, b double").repartition(4)
    got = {(r.timestamp, r.security): r.y for r in postprocess.neutralize_many(df, "y", ["a", "b"], ridge).collect()}
    assert len(got) == len(rows)
    for d in range(5):
        part = [r for r in rows if r[0] == d]
        x = np.array([[np.nan if v is None else v for v in r[2:]] for r in part])
        ok = np.isfinite(x).all(1)
        design = np.column_stack((np.ones(ok.sum()), x[ok, 1:] - x[ok, 1:].mean(0)))
        rest = x[ok, 0] - design @ (np.linalg.pinv(design.T @ design + np.diag([0, ridge, ridge]), rcond=1e-12) @ (design.T @ x[ok, 0]))
        want = np.full(len(part), np.nan)
        if ok.sum() > 3:
            want[ok] = rest
        mine = np.array([np.nan if (v := got[r[:2]]) is None else v for r in part])
        assert np.allclose(mine, want, atol=1e-7, equal_nan=True)


def test_incremental_ic_on_two_references(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 30, 4))
    x[2, :, 0] = x[2, :, 1] - 3 * x[2, :, 2]  # nothing is left of the signal
    x[3, :, 3] = 1.0  # a constant label
    rows = [(d, *map(float, x[d, k])) for d in range(4) for k in range(30)] + [(9, 1.0, 2.0, 3.0, 4.0)]
    got = {r.timestamp: (r.n, r.rank_ic) for r in evaluate.incremental_ic(spark.createDataFrame(rows, "timestamp int, s double, a double, b double, y double"), "s", ["a", "b"], "y").collect()}
    assert set(got) == {0, 1}
    for d, (n, ic) in got.items():
        design = np.column_stack((np.ones(30), x[d, :, 1:3]))
        rest = x[d, :, 0] - design @ np.linalg.lstsq(design, x[d, :, 0], rcond=None)[0]
        assert n == 30 and ic == pytest.approx(np.corrcoef(pd.Series(rest).rank(), pd.Series(x[d, :, 3]).rank())[0, 1])


@pytest.mark.parametrize("span", [1, 3, 40])
def test_exponential_means_in_chunks(spark, span):
    """A security that is cut into many chunks over several tasks, with gaps longer than a chunk, equals one pass."""
    rng = np.random.default_rng(span)
    rows = []
    for name, n in (("a", 400), ("b", 30), ("c", 3), ("d", 60)):
        for t in range(n):
            gap = rng.random() < 0.3 or name == "a" and 50 <= t < 110 or name == "d"
            rows.append((name, t, None if gap and t % 3 else float("nan") if gap else float(rng.normal(5)), "kept"))
    df = spark.createDataFrame(rows, "security string, timestamp int, x double, other string").repartition(7)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = postprocess.ewm(df, "x", span)
        assert got.columns == ["security", "timestamp", "x", "other", "ewm"]
        got = {(r.security, r.timestamp): r.ewm for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert len(got) == len(rows)
    plain = pd.DataFrame(rows, columns=["security", "timestamp", "x", "other"])
    for name, part in plain.groupby("security"):
        want = part["x"].astype(float).ewm(span=span, adjust=False, min_periods=span).mean()
        mine = np.array([np.nan if got[name, t] is None else got[name, t] for t in part["timestamp"]])
        assert np.allclose(mine, want.to_numpy(), equal_nan=True)
    assert postprocess.ewm(df.where("timestamp < 0"), "x", span).count() == 0


def test_lots_are_those_of_a_queue(spark):
    """Positions that turn from long to short and back, fills of nothing, fractions of shares."""
    rng = np.random.default_rng(8)
    fills = [(int(rng.integers(2)), f"s{rng.integers(3)}", int(rng.integers(12)), k, None if k % 17 == 0 else float(rng.integers(-20, 21)) / 4) for k in range(300)]
    days = spark.createDataFrame([(t,) for t in range(12)], "timestamp int")
    df = spark.createDataFrame(fills, "portfolio_id int, security string, timestamp int, fill_id int, shares double").repartition(5)
    want, ages = defaultdict(float), defaultdict(lambda: [0.0, 0.0])
    for p, s in sorted({f[:2] for f in fills}):
        lots = deque()
        for _, _, t, _, q in sorted((f for f in fills if f[:2] == (p, s)), key=lambda f: (f[2], f[3])):
            q = q or 0.0
            while q and lots and q * lots[0][0] < 0:
                part = min(abs(q), abs(lots[0][0]))
                want[p, s, lots[0][1], t] += part
                lots[0][0] -= np.sign(lots[0][0]) * part
                q -= np.sign(q) * part
                if not lots[0][0]:
                    lots.popleft()
            if q:
                lots.append([q, t])
        for q, t in lots:
            want[p, s, t, None] += abs(q)
    for (p, _, start, end), n in want.items():
        ages[p][0] += n * ((11 if end is None else end) - start)
        ages[p][1] += n
    got = {(r.portfolio_id, r.security, r.opened, r.closed): r.shares for r in robustness.matched_lots(df, days).collect()}
    assert got == pytest.approx(dict(want))
    assert {r.portfolio_id: r.sessions for r in robustness.holding_sessions(df, days).collect()} == pytest.approx({p: a / n for p, (a, n) in ages.items()})


def test_capped_weights_are_the_nearest(spark):
    """Sums to the budget within the bounds, and no shift by bisection comes nearer; ties, nulls, a cap that leaves no choice."""
    rng = np.random.default_rng(6)
    rows = [(d, k, None if k == 5 else round(float(rng.normal(0.1, 0.4)), 1)) for d in range(6) for k in range(8)] + [(6, k, float(k)) for k in range(4)]
    df = spark.createDataFrame(rows, "timestamp int, security int, w double").repartition(3)
    got = {(r.timestamp, r.security): r.weight for r in portfolio.capped_simplex(df, "w", 0.25).collect()}
    assert len(got) == len(rows)
    for d in range(7):
        x = np.array([w or 0.0 for t, _, w in rows if t == d])
        lo, hi = x.min() - 2, x.max() + 1
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(x - mid, 0, 0.25).sum() > 1 else (lo, mid)
        mine = np.array([got[d, k] for t, k, _ in rows if t == d])
        assert np.allclose(mine, np.clip(x - hi, 0, 0.25), atol=1e-9) and mine.sum() == pytest.approx(1.0)


def test_edges_that_close_cycles(spark):
    """Against a walk from each new parent, in a graph that has a cycle already, with null ends and repeated edges."""
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2))] + [(41, 42), (42, 41), (None, 3), (3, None)]
    new = [(int(a), int(b)) for a, b in rng.integers(0, 43, (60, 2))] + [(5, 5), (None, 1), (1, None)]
    up = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            up[a].add(b)

    def above(node):
        seen, todo = set(), [node]
        while todo:
            for b in up[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    schema = "child int, parent int"
    got = {(r.child, r.parent): r.closes for r in market.closing_edges(spark.createDataFrame(edges, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {(a, b): None not in (a, b) and (a == b or a in above(b)) for a, b in new}
    some = spark.createDataFrame([(1,), (41,), (99,)], "n int")
    pairs = {tuple(r) for r in market.ancestors(spark.createDataFrame(edges, schema), of=some).collect()}
    assert pairs == {(n, a) for n in (1, 41) for a in above(n)}


def conditions(w, m, start, exposures, limits, net, low, high):
    """The largest breach of the optimality conditions: the weights are the start less the multipliers' pull, cut to the box; limits hold, multipliers are not negative, and only tight limits have one."""
    room = np.concatenate((limits - exposures @ w, limits + exposures @ w))
    pull = m[0] + (m[1 : 1 + len(limits)] - m[1 + len(limits) :]) @ exposures
    return max(np.abs(w - np.clip(start - pull, low, high)).max(), abs(w.sum() - net), -room.min(), -m[1:].min(), np.minimum(room, m[1:]).max())


def test_risk_projection_meets_its_conditions():
    """Random portfolios with one to three exposures, some tight; infeasible limits are told apart from too few rounds."""
    rng = np.random.default_rng(12)
    proven = 0
    for k in range(150):
        n, many = int(rng.integers(4, 40)), int(rng.integers(1, 4))
        exposures, start = rng.normal(size=(many, n)) * 10.0 ** rng.integers(-1, 3), rng.normal(size=n) / n
        limits, cap = np.abs(exposures @ start) * rng.choice([0.0, 0.2, 0.8, 2.0], many), float(rng.choice([0.05, 0.2, 1.0]))
        low, net = (0.0, 1.0) if k % 3 == 0 else (-cap, 0.0)
        args = (start, exposures, limits, net, low, cap)
        try:
            w, m = constraints.nearest(*args)
        except ValueError:
            proven += 1
            assert cap * n < net or low == 0.0  # a net of 0 is always met by no weights at all
            continue
        assert conditions(w, m, *args) < 1e-8
    assert proven
    with pytest.raises(ValueError, match="no weights"):
        constraints.nearest(np.zeros(5), np.ones((1, 5)), np.array([0.1]), 1.0, -1.0, 1.0)
    with pytest.raises(RuntimeError, match="converge"):
        constraints.nearest(rng.normal(size=30), rng.normal(size=(2, 30)), np.array([0.01, 0.01]), 0.0, -0.5, 0.5, rounds=1)


def test_pairs_of_fifty_factors(spark):
    """Against ranks and correlations pair by pair: domains, gaps, ties, a constant factor, one that isn't finite, a date with one row."""
    rng = np.random.default_rng(21)
    n, wide = 40, 50
    x = rng.normal(size=(2, n, wide)).round(1) * 10.0 ** rng.integers(-3, 6, wide)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, :, 7], x[0, :, 8] = 3.0, np.nan
    x[1, 0, 9] = np.inf
    inside = rng.random((2, n, 2)) < 0.8
    rows = [(d, *(None if np.isnan(v) else float(v) for v in x[d, k]), bool(inside[d, k, 0]), bool(inside[d, k, 1]) if k else None) for d in range(2) for k in range(n)] + [(2, *map(float, range(wide)), True, True)]
    columns = [f"f{k}" for k in range(wide)]
    df = spark.createDataFrame(rows, f"timestamp int, {', '.join(f'{c} double' for c in columns)}, a boolean, b boolean").repartition(3)
    domains = ["a" if k % 2 else "b" for k in range(wide)]
    out = evaluate.pair_diagnostics(df, columns, domains, least=3).collect()
    assert len(out) == 3 * wide * (wide - 1) // 2
    inside[:, 0, 1] = False
    for r in out:
        i, j = int(r.left[1:]), int(r.right[1:])
        if r.timestamp == 2:
            assert (r.common_domain, r.common, r.coverage, r.pearson, r.spearman) == (1, 1, 1.0, None, None)
            continue
        a, b, dom = x[r.timestamp, :, i], x[r.timestamp, :, j], inside[r.timestamp, :, 1 - i % 2] & inside[r.timestamp, :, 1 - j % 2]
        ok = dom & np.isfinite(a) & np.isfinite(b)
        assert (r.common_domain, r.common, r.coverage) == (dom.sum(), ok.sum(), pytest.approx(ok.sum() / dom.sum()))
        if ok.sum() < 3 or np.ptp(a[ok]) == 0 or np.ptp(b[ok]) == 0:
            assert r.pearson is None and r.spearman is None
        else:
            assert r.pearson == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1], abs=1e-9)
            assert r.spearman == pytest.approx(np.corrcoef(pd.Series(a[ok]).rank(), pd.Series(b[ok]).rank())[0, 1], abs=1e-9)


def test_overlaps_are_those_of_all_pairs(spark):
    """Points, intervals of very different lengths, negative ends, touching and repeated ones, nulls and reversed ends; with and without a key; no nested loop."""
    rng = np.random.default_rng(31)

    def rows(n):
        starts, lengths = rng.integers(-500, 500, n), rng.choice([0, 1, 2, 3, 7, 8, 60, 900], n)
        made = [(int(rng.integers(2)), int(s), int(s + e)) for s, e in zip(starts, lengths, strict=True)]
        return [*made, made[0], (0, None, 3), (1, 4, None), (0, 9, 8), (None, 0, 9), (0, -1, -1), (0, 0, 0)]

    left, right = rows(120), rows(90)
    a, b = spark.createDataFrame(left, "k int, s long, e long"), spark.createDataFrame(right, "k int, s2 long, e2 long")

    def meet(x, y):
        return None not in (*x[1:], *y[1:]) and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]

    made = intervals.overlaps(a, b, ("s", "e"), ("s2", "e2"), ["k"])
    plan = made._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and made.columns == ["k", "s", "e", "s2", "e2"]
    assert sorted(map(tuple, made.collect())) == sorted((*x, *y[1:]) for x in left for y in right if x[0] is not None and x[0] == y[0] and meet(x, y))
    free = intervals.overlaps(a.drop("k"), b.drop("k"), ("s", "e"), ("s2", "e2"))
    assert sorted(map(tuple, free.collect())) == sorted((*x[1:], *y[1:]) for x in left for y in right if meet(x, y))
    assert intervals.overlaps(a.where("k > 5"), b, ("s", "e"), ("s2", "e2"), ["k"]).count() == 0


def test_compared_tables(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([("x", 1), (None, 2), (None, 2), ("w", 4)], "v string, k int")
    assert sorted(map(tuple, frames.compared(a, b).collect())) == [(1, "x", "both"), (2, None, "both"), (3, "z", "left"), (4, "w", "right")]


def test_admission(spark):
    """A candidate that adds return of its own is admitted; a copy, a constant, one that loses all and one with two rows aren't."""
    rng = np.random.default_rng(3)
    base = rng.normal(0.001, 0.01, 60)
    made = {"good": base * 0.2 + rng.normal(0.002, 0.002, 60), "copy": base, "flat": np.full(60, 0.001), "lost": np.append(np.full(59, 0.02), -1.0), "short": base[:2] * 2}
    rows = [(name, t, float(base[t]), float(v)) for name, y in made.items() for t, v in enumerate(y)] + [("good", 99, None, 5.0), ("good", 98, 5.0, None)]
    got = {r.c: r for r in robustness.marginal_admission(spark.createDataFrame(rows, "c string, t int, x double, y double"), "x", "y", "c", "t").collect()}
    assert {name for name, r in got.items() if r.admitted} == {"good"}
    y, fall = made["good"], []
    for x in (base, y):
        nav = np.cumprod(1 + x)
        fall.append((nav / np.maximum(np.maximum.accumulate(nav), 1) - 1).min())
    ratio = [x.mean() / x.std(ddof=1) * 252**0.5 for x in (base, y)]
    assert (got["good"].n, got["good"].drawdown_delta, got["good"].ratio_delta) == (60, pytest.approx(fall[1] - fall[0]), pytest.approx(ratio[1] - ratio[0]))
    assert got["flat"].ratio_delta is None and got["lost"].drawdown_delta is None and got["short"].residual_annual is None


def test_quality_of_applicable_rows(spark):
    rows = [(k, "a", None if k < 5 else float(k), k >= 4) for k in range(10)] + [(20, "a", float("inf"), False), (21, "a", None, None)]
    df = spark.createDataFrame(rows, "timestamp int, security string, v double, used boolean")
    found = {r.code: r.n for r in market.quality_report(df, ["timestamp", "security"], "v", 0.0, 8.5, applicable="used").collect()}
    assert found == {"missing_values": 1, "value_above_maximum": 1}
    assert {r.code for r in market.quality_report(df, ["timestamp", "security"], "v", 0.0, 8.5).collect()} == {"excessive_missing_values", "infinite_numeric_value", "value_above_maximum"}
    assert market.quality_report(df.where("used is null"), ["timestamp", "security"], "v", 0.0, 1.0, applicable="used").count() == 0
