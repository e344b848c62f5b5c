"""The formula language and its compiler on small panels."""

import datetime

import numpy as np
import pandas as pd
import pytest

from panelforge.plans import dsl
from panelforge.plans.compile import compile_formulas

FIELDS = {"Returns", "Amount"}


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("Amount[0]", "syntax_node_forbidden:Subscript"), ("Rolling(Amount, 4)", "operator_not_registered:Rolling"), ("TsStd(Amount, 0)", "window_must_be_positive:TsStd:0"),
        ("Add(Amount, forward_gap)", "future_field_forbidden:forward_gap"), ("TsDelta(Amount, 400)", "window_too_long:TsDelta:400"), ("Mul(Amount)", "wrong_number_of_arguments:Mul:1"),
        ("Neg('x')", "constant_not_numeric"), ("TsMean(Amount, Returns)", "window_must_be_integer_literal"), ("Neg(x=Amount)", "keyword_arguments_forbidden"), ("3", "result_must_be_a_panel"), ("Add(Amount,", "syntax_error"),
        ("Sub(Amount, Turnover)", "field_not_registered:Turnover"), ("Neg(Neg(Neg(Neg(Neg(Neg(Neg(Amount)))))))", "call_depth_exceeded:7"),
    ],
)
def test_refused(text, reason):
    why = dsl.reasons_against(text, FIELDS | {"forward_gap"})
    assert why and any(reason in w for w in why)


def test_budgets():
    """Windows count double for operators of second order, calls without one count 1; each limit is enforced by itself."""
    c = dsl.measure("Add(TsCorr(Returns, Amount, 20), CsRank(TsMean(Returns, 5)))")
    assert (c.nodes, c.calls, c.depth, c.window, c.fields, c.operations) == (9, 4, 3, 20, FIELDS, 1 + 40 + 1 + 5)
    assert (c.state_bytes, c.flops) == (20 * 2 * 8, 47)
    for name, most, value in (("state_bytes", 319, 320), ("flops", 46, 47), ("operations", 46, 47), ("nodes", 8, 9), ("fields", 1, 2)):
        assert c.over(dsl.Budget(**{name: most})) == [f"budget_exceeded:{name}:{value}>{most}"]
    assert not c.over(dsl.Budget()) and dsl.measure("Returns").state_bytes == 0
    assert dsl.reasons_against("TsMean(Returns, 200)", FIELDS, dsl.Budget(state_bytes=1000)) == ["budget_exceeded:state_bytes:1600>1000"]


def test_equal_formulas_have_one_hash():
    assert dsl.semantic_hash("Add(Returns, Mul(Amount, Returns))") == dsl.semantic_hash("Add(Mul(Returns, Amount), Returns)")
    assert dsl.semantic_hash("Sub(Returns, Amount)") != dsl.semantic_hash("Sub(Amount, Returns)")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    wide = pd.DataFrame((rng.normal(size=(12, 5)) * 4).round() / 4, index=[datetime.datetime(2020, 1, d + 1) for d in range(12)], columns=list("abcde"))
    wide.iloc[4, 2] = np.nan
    rows = [(t.to_pydatetime(), s, None if np.isnan(v) else float(v)) for t, row in wide.iterrows() for s, v in row.items()]
    return wide, spark.createDataFrame(rows, "timestamp timestamp_ntz, security string, Returns double")


def run(df, text, wide):
    got = compile_formulas(df, {"v": text}, {"Returns"}).select("timestamp", "security", "v").toPandas()
    return got.pivot(index="timestamp", columns="security", values="v").astype(float).reindex(index=wide.index)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CsRank(TsMean(Returns, 2))", lambda w: w.rolling(2, min_periods=2).mean().rank(axis=1, pct=True)),
        ("TsStd(Returns, 3)", lambda w: w.rolling(3, min_periods=3).std()),
        ("TsRank(Returns, 4)", lambda w: w.rolling(4, min_periods=4).rank(pct=True)),
        ("TsSkew(Returns, 5)", lambda w: w.rolling(5, min_periods=5).skew()),
        ("TsKurt(Returns, 5)", lambda w: w.rolling(5, min_periods=5).kurt()),
        ("TsDelta(Returns, 2)", lambda w: w - w.shift(2)),
    ],
)
def test_against_pandas(panel, text, want):
    wide, df = panel
    pd.testing.assert_frame_equal(run(df, text, wide), want(wide), check_names=False, check_freq=False, atol=1e-9)


def test_masks(spark):
    """A security left out of today's cross-section keeps its history; a masked one is null, not the false branch."""
    day = [datetime.datetime(2020, 1, 1), datetime.datetime(2020, 1, 2)]
    rows = [(day[0], "a", -0.2, True, True), (day[0], "b", 0.1, True, True), (day[1], "a", -0.3, True, True), (day[1], "b", -0.01, True, False), (day[1], "i", -0.9, False, False)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, security string, Returns double, hist boolean, xs boolean")
    got = compile_formulas(df, {"v": "CsRank(IfElse(Less(Returns, 0), Mul(Returns, Returns), 0))", "w": "TsMean(Returns, 2)"}, {"Returns"}, hist="hist", xs="xs").collect()
    v = {(r.timestamp.day, r.security): r.v for r in got}
    assert v == {(1, "a"): 1.0, (1, "b"): 0.5, (2, "a"): 1.0, (2, "b"): None, (2, "i"): None}
