"""Error paths and special cases of data checks, assembly, declared factors, families and lineage."""

import math

import numpy as np
import pytest

from panelforge.operators import factor, frames, market, selection


def test_assemble_refuses(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert frames.assemble([a, a.where("k > 5")], ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate_key:1"):
        frames.assemble([a, a.where("k = 1")], ["k"]).collect()
    with pytest.raises(ValueError, match="batch_schema_mismatch"):
        frames.assemble([a, a.selectExpr("k", "1 AS v")], ["k"])


def test_domain_outside_universe(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, None), (3, None, False)], "k long, universe boolean, d boolean")
    from pyspark.sql import functions as F

    assert [r.universe for r in frames.narrow(df, "universe", F.col("d")).orderBy("k").collect()] == [True, False, False]
    with pytest.raises(Exception, match="domain_outside_universe"):
        frames.narrow(df.where("k = 3"), "universe", F.lit(True)).collect()


@pytest.mark.parametrize(
    ("spec", "why"),
    [
        (factor.FactorSpec("TsMean(a, 3)", frozenset({"a", "b"}), (("neutralize", "b"),), daily=("close60", "mean")), "neutralize_after"),
        (factor.FactorSpec("TsMean(a, 3)", frozenset({"a", "b"})), "required_fields_differ:b"),
        (factor.FactorSpec("TsMean(a, 3)", frozenset({"a"}), direction=0), "direction"),
    ],
)
def test_factor_declarations(spec, why):
    with pytest.raises(ValueError, match=why):
        factor.check(spec)


def test_family_counts_all_members(spark):
    rng = np.random.default_rng(1)
    values = [("good", k, float(-0.5 + rng.normal() / 3)) for k in range(60)] + [("short", k, 1.0) for k in range(3)] + [("flat", k, 0.25) for k in range(60)]
    family = spark.createDataFrame([("good", -1), ("short", 1), ("flat", 1), ("gone", 1)], "candidate string, sign int")
    frame = spark.createDataFrame(values, "candidate string, timestamp long, value double")
    got = {r.candidate: r for r in selection.family_significance(family, frame, 24, 2).collect()}
    assert {c: r.status for c, r in got.items()} == {"good": "tested", "short": "insufficient_observations", "flat": "degenerate", "gone": "missing"}
    assert got["good"]["mean"] > 0.3 and got["good"].p < 1e-6 and got["good"].q == pytest.approx(4 * got["good"].p)
    assert all(got[c].p == got[c].q == 1 for c in ("short", "flat", "gone"))
    with pytest.raises(Exception, match="outside_family:other"):
        selection.family_significance(family, frame.union(spark.createDataFrame([("other", 1, 1.0)], frame.schema)), 24, 2).collect()


def test_normal_tail():
    x = np.linspace(-6, 9, 1001)
    assert np.allclose(selection._erfc(x), [math.erfc(v) for v in x], rtol=1e-9, atol=1e-15)


def test_lineage(spark):
    nodes = spark.createDataFrame([(k,) for k in range(60)], "node long")
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, 50)] + [(2, 0), (50, 99), (51, 50), (52, 53), (53, 52), (54, 53)], "child long, parent long")
    got = {r.node: (r.depth, r.status) for r in market.lineage_depth(nodes, edges).collect()}
    assert all(got[k] == (k, "ok") for k in range(50)) and got[55] == (0, "ok")
    assert got[50][1] == got[51][1] == "missing_parent" and got[52][1] == got[54][1] == "cycle"
    up = {(r.node, r.ancestor) for r in market.ancestors(edges).collect()}
    assert {a for n, a in up if n == 49} == set(range(49)) and {a for n, a in up if n == 52} == {52, 53}
