"""Lifecycles, registration, feedback, roles, masks as of a date and the made-up panel on small fixtures."""

import datetime

import numpy as np
import pytest

from panelforge.operators import candidates, market
from panelforge.sources.synthetic import synthetic_panel


def test_refused_events_leave_a_history_where_it_stands(spark):
    histories = {"a": ["validated", "registered", "registered", "rejected", "validated", "deprecated", "validated"], "b": ["registered"], "c": ["validated"], "d": ["registered", "deprecated", "validated"]}
    df = spark.createDataFrame([(f, k, s) for f, states in histories.items() for k, s in enumerate(states)], "factor string, seq int, state string")
    got = {r["factor"]: (r["seq"], r["state"], r["accepted"]) for r in candidates.lifecycle(df).collect()}
    assert got == {"a": (5, "deprecated", 3), "b": (0, "registered", 1), "d": (1, "deprecated", 2)}
    assert candidates.lifecycle(df.limit(0)).count() == 0


def test_a_registry_refuses_what_it_has(spark):
    df = spark.createDataFrame([("x", 1, "f", 1), ("y", 1, "f", 2), ("x", 1, "g", 3), ("x", 2, "h", 4)], "name string, version int, body string, seq int")
    got = [r["status"] for r in candidates.registrable(df, "name", "version", "body", "seq").orderBy("seq").collect()]
    assert got == ["registered", "duplicate_definition", "duplicate_version", "registered"]


def test_feedback_tells_coarse_reasons_only(spark):
    rows = [
        (True, None, True, ["cost_failure"], "local_gate_pass", "promote"),
        (True, [], False, None, "weak_signal", "retire"),
        (True, [], False, ["secret gate", "cost_failure"], "weak_signal,cost_failure", "repair"),
        (True, [], False, ["excess_turnover", "raw_2020_ic_not_positive"], "sign_instability,regime_instability,excess_turnover", "retire"),
        (True, [], False, ["redundant_signal", "cost_failure"], "cost_failure,redundant_signal", "diversify"),
        (False, [], True, [], "data_contract_failure", "technical_reject"),
        (None, ["unsupported_operator"], None, [], "invalid_expression", "technical_reject"),
        (False, ["unsupported_operator", "else"], False, ["cost_failure"], "invalid_expression,data_contract_failure", "technical_reject"),
    ]
    df = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(rows)], "k int, technical_pass boolean, technical_failures array<string>, research_pass boolean, research_failures array<string>")
    got = [(",".join(r["reasons"]), r["disposition"]) for r in candidates.feedback(df).orderBy("k").collect()]
    assert got == [r[4:] for r in rows]


def test_roles_resolve_or_fail(spark):
    parts = spark.createDataFrame([("h1", "data"), ("h2", "cost")], "hash string, kind string")
    bound = spark.createDataFrame([(1, "d", "h1"), (1, "c", "h2"), (2, "d", "h1")], "owner int, role string, hash string")
    assert sorted((r["owner"], r["role"], r["kind"]) for r in candidates.resolve_roles(bound, parts, "owner", "role", "hash").collect()) == [(1, "c", "cost"), (1, "d", "data"), (2, "d", "data")]
    for extra, word in (((1, "d", "h2"), "role_bound_twice"), ((3, "d", "h9"), "unknown_component")):
        bad = bound.union(spark.createDataFrame([extra], bound.schema))
        with pytest.raises(Exception, match=word):
            candidates.resolve_roles(bad, parts, "owner", "role", "hash").collect()


def test_masks_are_carried_forward_and_never_back(spark):
    targets = spark.createDataFrame([(t, s) for t in (1, 2, 3, 5) for s in "abc"], "timestamp int, security string")
    mask = spark.createDataFrame([(2, "a", True), (2, "b", None), (4, "b", True)], "timestamp int, security string, eligible boolean")
    got = {(r["timestamp"], r["security"]) for r in candidates.aligned_mask(targets, mask, "eligible").where("eligible").collect()}
    assert got == {(2, "a"), (3, "a"), (5, "b")}  # the list of 4 has no "a"
    every = spark.createDataFrame([(0, s, True) for s in "ab"], mask.schema)
    clean = candidates.clean_universe(targets, mask, every)
    assert {(r["timestamp"], r["security"]) for r in clean.where("eligible").collect()} == got
    audit = candidates.universe_audit(clean, mask, every).first()
    assert (audit["securities"], audit["in_both"], audit["unmapped"], audit["ever_eligible"], audit["excluded"]) == (3, 2, 1, 2, 1)
    assert (audit["eligible_cells"], audit["cells"], audit["dates"], audit["dates_before_master"], audit["dates_before_fast"]) == (3, 12, 4, 1, 0)
    assert not candidates.clean_universe(targets, mask.limit(0), every).where("eligible").count()


def test_state_counts_from_when_it_is_in_effect_and_known(spark):
    events = spark.createDataFrame([("a", 1, 5, "X"), ("a", 3, 3, "Y"), ("a", 3, 3, "Z"), ("b", 9, 9, "X"), ("c", None, 1, "X")], "key string, effective_at int, known_at int, status string")
    dates = spark.createDataFrame([(2,), (3,), (5,), (9,), (9,)], "date int")
    got = {(r["key"], r["date"]): r["status"] for r in market.state_at(events, dates, "key").collect()}
    assert got == {("a", 3): "Z", ("a", 5): "Z", ("a", 9): "Z", ("b", 9): "X"}


def test_made_up_panel(spark):
    df = synthetic_panel(spark).cache()
    days = sorted(r[0] for r in df.select("timestamp").distinct().collect())
    assert len(days) == 100 and days[0] == datetime.date(2020, 1, 2) and days == [d.item() for d in np.busday_offset("2020-01-02", np.arange(100))]
    assert df.count() == 4100 and df.where("returns is null").count() == 3
    mean, spread, amount = df.selectExpr("avg(returns)", "stddev(returns)", "avg(ln(amount))").first()
    assert abs(mean) < 0.001 and abs(spread - 0.012) < 0.001 and abs(amount - 14) < 0.05
    assert sorted(df.repartition(7).collect()) == sorted(df.collect())
    assert synthetic_panel(spark, 2, 1, None, None, "2024-06-01").agg({"timestamp": "min"}).first()[0] == datetime.date(2024, 6, 3)
