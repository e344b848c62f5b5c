"""The circular block bootstrap against a plain loop over the same draws."""

import numpy as np
import pytest

from panelforge.operators import selection


def plain_p(x, block, key, trials):
    """Draws value by value."""
    n, mean, hits = len(x), np.mean(x), 0
    count = -(-n // block)
    for trial in range(trials):
        starts = selection.draw_starts(key, trial, 1, count, n)[0]
        drawn = [x[(s + k) % n] - mean for s in starts for k in range(block)][:n]
        hits += np.mean(drawn) >= mean
    return (1 + hits) / (trials + 1)


@pytest.mark.parametrize("block", [1, 5, 7, 40])
def test_p_values_are_those_of_a_plain_loop(spark, monkeypatch, block):
    """Nulls, short series, a block longer than the series; ranges of trials of any size give the same."""
    rng = np.random.default_rng(block)
    rows = [(f"s{k}", t, float(v)) for k in range(4) for t, v in enumerate(rng.normal(0.05 * k, 1, 20 + k))]
    rows += [("s1", 50, None), ("one", 0, 3.0), ("none", 0, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "security string, t int, x double").repartition(6)
    got = {r.security: r.p for r in selection.block_bootstrap(df, "x", "security", "t", block, None, 9).collect()}
    assert got.pop("one") == got.pop("none") == 1.0
    for name, p in got.items():
        x = np.array([v for s, _, v in sorted(r for r in rows if r[2] is not None) if s == name])
        assert p == plain_p(x, block, selection.stream_key(9, name), 2000)
    monkeypatch.setattr(selection, "TRIALS", 333)
    again = {r.security: r.p for r in selection.block_bootstrap(df, "x", "security", "t", block, 2000, 9).collect()}
    assert {k: again[k] for k in got} == got
    assert selection.block_bootstrap(df.where("t < 0"), "x", "security", "t", block, None, 9).count() == 0


def test_starts_are_even():
    starts = selection.draw_starts(selection.stream_key(1, "a"), 0, 20_000, 5, 7)
    assert np.abs(np.bincount(starts.ravel(), minlength=7) / starts.size - 1 / 7).max() < 0.005
    assert np.abs(np.corrcoef(starts.T) - np.eye(5)).max() < 0.03
    assert (selection.draw_starts(5, 100, 50, 3, 9) == selection.draw_starts(5, 0, 150, 3, 9)[100:]).all()


@pytest.mark.parametrize("n", [2, 83, 5000])
def test_few_trials_need_their_starts(monkeypatch, n):
    """Hits are those of the drawn starts, though of a short series hardly any trial has its starts drawn one by one."""
    x, asked, own = np.random.default_rng(n).normal(0.1, 1, n), [], selection._starts
    starts = selection.draw_starts(7, 11, 3000, -(-n // 5), n)
    count, sums = n // 5, np.concatenate(([0.0], np.cumsum(np.resize(x - x.mean(), n + 5))))
    drawn = (sums[starts[:, :count] + 5] - sums[starts[:, :count]]).sum(axis=1)
    if n % 5:
        drawn += sums[starts[:, count] + n % 5] - sums[starts[:, count]]
    monkeypatch.setattr(selection, "_starts", lambda key, trials, *rest: asked.append(len(trials)) or own(key, trials, *rest))
    assert selection.bootstrap_hits(x, 5, 7, 11, 3000) == (drawn / n >= x.mean()).sum()
    assert n > 100 or sum(asked) < 3000 / 20


@pytest.mark.parametrize("n, block", [(16, 5), (16, 4), (83, 5), (9, 20), (2000, 1900)])
def test_hits_of_a_family_are_those_of_each_series(monkeypatch, n, block):
    """Sums that only equal the bound, series of zeros and constants, far means, NaN; trials from within an epoch over several, in parts of any size; a family's trials are drawn once."""
    rng = np.random.default_rng(n)
    x = np.concatenate((rng.normal(0.1, 1, (21, n)), rng.integers(-2, 3, (9, n)), np.zeros((1, n)), np.full((1, n), -3.0), rng.normal(1e6, 1, (1, n)), rng.normal(0, 1, (1, n)) * 1e-30))
    x[25:30] += np.round(x[25:30].mean(axis=1, keepdims=True)) - x[25:30].mean(axis=1, keepdims=True)
    keys, drawn, own = [selection.stream_key(3, k) for k in range(len(x))], [], selection._common_starts
    monkeypatch.setattr(selection, "ORDER_BITS", 9)
    full, rest = divmod(n, block)
    want = []
    for row, key in zip(x, keys, strict=True):
        starts, sums = selection.draw_starts(key, 300, 1500, -(-n // block), n), np.concatenate(([0.0], np.cumsum(np.resize(row - row.mean(), n + block))))
        total = (sums[starts[:, :full] + block] - sums[starts[:, :full]]).sum(axis=1)
        if rest:
            total += sums[starts[:, full] + rest] - sums[starts[:, full]]
        want.append(np.count_nonzero(total / n >= row.mean()))
    monkeypatch.setattr(selection, "_common_starts", lambda stream, trials, *args: drawn.append(len(trials)) or own(stream, trials, *args))
    assert selection.family_hits(x, block, keys, 300, 1500).tolist() == want
    assert sum(drawn) == 1500
    monkeypatch.setattr(selection, "BATCH_CELLS", 700)
    monkeypatch.setattr(selection, "COUNT_CELLS", 40 * n)
    assert selection.family_hits(x, block, keys, 300, 1500).tolist() == want
    hole = np.where(np.arange(n) == 1, np.nan, x[:1])
    assert selection.family_hits(np.concatenate((x[:1], hole)), block, keys[:2], 300, 1500).tolist() == [want[0], 0]


@pytest.mark.parametrize("trials", [1000, 200_000])
def test_copies_of_a_series_err_on_their_own(trials):
    """The draws that a family has in common leave the errors of its series unrelated: hits of copies under other keys spread as those of separate draws do."""
    x = np.random.default_rng(2).normal(0.1, 1, 40)
    hits = selection.family_hits(np.tile(x, (600, 1)), 5, [selection.stream_key(8, k) for k in range(600)], 0, trials)
    p = hits.mean() / trials
    assert 0.05 < p < 0.95 and 0.8 < hits.var() / (trials * p * (1 - p)) < 1.25


def test_tasks_have_few_series_and_ranges(spark, monkeypatch):
    """Series of several lengths on as many tasks as they ask for give the p-values of one task."""
    rows = [(k, t, float(v)) for k in range(30) for t, v in enumerate(np.random.default_rng(k).normal(0.1, 1, 10 + k % 3))]
    df = spark.createDataFrame(rows, "security int, t int, x double")
    whole = sorted(map(tuple, selection.block_bootstrap(df, "x", "security", "t", 5, None, 1).collect()))
    monkeypatch.setattr(selection, "TASK_SERIES", 7)
    monkeypatch.setattr(selection, "TRIALS", 700)
    dealt = selection.block_bootstrap(df, "x", "security", "t", 5, None, 1)
    assert ", 15" in next(line for line in dealt._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line)
    assert sorted(map(tuple, dealt.collect())) == whole
