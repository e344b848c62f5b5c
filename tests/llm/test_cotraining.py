"""Co-training against a plain loop, and what it does for held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import quality


def plain_limits(z, calibration, rate, spec):
    steps = np.floor((np.clip(z, -30, 30) + 30) * quality.STEPS).astype(int)
    ordered = np.sort(steps)
    low = ordered[int(np.ceil(max(1, spec.quota * (1 - rate) * len(z)))) - 1] + 1
    above = total = len(z)
    high = next(s for s in range(60 * quality.STEPS + 2) if (ordered <= s).sum() > total - max(1, spec.quota * rate * above))
    low, high = low / quality.STEPS - 30, max(low, high) / quality.STEPS - 30
    sure = np.log(spec.confidence / (1 - spec.confidence))
    if calibration[1] > 0:
        low, high = max(low, (-sure - calibration[0]) / calibration[1]), min(high, (sure - calibration[0]) / calibration[1])
    return low, high


def test_rounds_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    kinds = rng.random(500) < 0.7
    texts = [" ".join(rng.choice(["good", "fine", "text", "same"] if k else ["zz", "qq", "junk!", "same"], rng.integers(3, 40))) for k in kinds]
    langs = ["en" if k == (rng.random() < 0.8) else "xx" for k in kinds]
    sources = [f"s{rng.integers(3)}" for _ in kinds]
    sizes = [len(t) for t in texts]
    docs = spark.createDataFrame(list(zip(range(500), texts, langs, sources, sizes, strict=True)), "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(kinds[k])) for k in range(160)], "doc_id long, quality int")
    spec = quality.CoTrainSpec(confidence=0.9, quota=0.2)
    model = quality.train(docs, labels, spec)
    t, m = quality.features([x.encode() for x in texts], langs, sources, sizes)
    x = [quality.text_matrix(t).astype(float), m.astype(float)]
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").collect()]
    y = kinds[order].astype(float)
    place = np.zeros(len(y), int)
    for label in (0, 1):
        place[y == label] = np.arange((y == label).sum())
    own, hold, pool = [k for k, p in zip(order, place, strict=True) if p % 4 != 1], [k for k, p in zip(order, place, strict=True) if p % 4 == 1], np.arange(160, 500)
    weights = [quality.fit_logistic(v[own], kinds[own].astype(float)) for v in x]
    handed, kept = [], []
    for _ in range(spec.rounds):
        teachers = list(weights)
        cuts = [plain_limits(v[pool] @ w, quality.fit_logistic(np.column_stack((np.ones(len(hold)), v[hold] @ w)), kinds[hold].astype(float), 1e-2), kinds[own].mean(), spec) for v, w in zip(x, teachers, strict=True)]
        n = [0, 0]
        for _ in range(spec.steps):
            fresh = []
            for k in (0, 1):
                z, (low, high) = x[1 - k][pool] @ teachers[1 - k], cuts[1 - k]
                given = [(i, float(v >= high)) for i, v in zip(pool, z, strict=True) if v <= low or v >= high]
                n[k] = len(given)
                slope = sum(x[k][i] * (quality.sigmoid(x[k][i] @ weights[k]) - label) for i, label in given)
                fresh.append(quality.learned(x[k][own], kinds[own].astype(float), weights[k], n[k], slope, spec))
            weights = fresh
        better = tuple(not quality.worse(v[hold], kinds[hold].astype(float), w, old) for v, w, old in zip(x, weights, teachers, strict=True))
        weights = [w if ok else old for w, old, ok in zip(weights, teachers, better, strict=True)]
        handed.append(tuple(n))
        kept.append(better)
    assert model.handed == handed and model.kept == kept and min(map(min, handed)) > 0
    assert all(np.allclose(a, b, atol=2e-3) for a, b in zip(model.views, weights, strict=True))


@pytest.fixture(scope="module")
def held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    test = {r.doc_id: r.q for r in labels.where(part == 0).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("top")).where("q = top").collect()}
    return docs, labels.where(part != 0), test


def losses(docs, model, test):
    rows = [(test[r.doc_id], r) for r in quality.score(docs, model).collect() if r.doc_id in test]
    y = np.array([q for q, _ in rows], float)
    out = {}
    for name in ("score", "text_score", "meta_score"):
        p = np.clip([r[name] for _, r in rows], 1e-9, 1 - 1e-9)
        out[name] = ((p >= 0.5) == y).mean(), -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    return out


def test_both_views_hand_over_and_metadata_learns(held_out):
    """On labels apart: both views hand labels over in each round, metadata gets better by the text's, and both views together are right at least as often as the text alone."""
    docs, labels, test = held_out
    model, alone = quality.train(docs, labels), quality.train(docs, labels, quality.CoTrainSpec(rounds=0))
    assert len(model.handed) == 2 and min(map(min, model.handed)) > 0
    assert all(meta for _, meta in model.kept)
    assert model.calibration[1][1] > 0 and model.combine[2] > 0
    with_rounds, without = losses(docs, model, test), losses(docs, alone, test)
    assert with_rounds["meta_score"][1] < without["meta_score"][1]
    assert with_rounds["score"][0] >= with_rounds["text_score"][0] > 0.99
