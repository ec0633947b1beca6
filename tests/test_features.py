"""The models of group E against plain numpy, and the queries that use them."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemara.operators import features
from telemara.plans import detection, queries

SF = "/root/testdata/sf0.001"
F3 = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 3))
    x[:, 2] = x[:, 0] + 0.1 * x[:, 2]
    x[0] = (8.0, -8.0, 8.0)
    x[1] = (0.0, 0.0, 5.0)
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(5)


def test_split_takes_the_least_hashes_of_each_label(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(103)]
    got = {r.id for r in features.stratified_split(spark.createDataFrame(rows, "id long, k string"), "k", "id").where("is_test").collect()}
    want = set()
    for label in "ab":
        ids = sorted((i for i, k in rows if k == label), key=lambda i: (zlib.crc32(f"{i}-42".encode()), i))
        want |= set(ids[: len(ids) // 4])
    assert got == want


def depth_of(tree, x, depth=0):
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree[0]


def test_isolation_equals_plain_traversal(cloud):
    x, df = cloud
    model = features.iforest_fit(df, F3, trees=30)
    again = features.iforest_fit(df.repartition(2), F3, trees=30)
    assert model == again and model["size"] == 256 and len(model["trees"]) == 30
    n = 256
    norm = 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    raw = np.array([2 ** (-np.mean([depth_of(t, r) for t in model["trees"]]) / norm) for r in x])
    assert model["cut"] == pytest.approx(np.percentile(raw, 95))
    got = {r.id: (r.iso_score, r.iso_flag) for r in features.iforest_score(df, model).collect()}
    assert all(got[i][0] == pytest.approx(min(1.0, max(0.0, 0.5 + s - model["cut"])), abs=6e-5) and got[i][1] == (s > model["cut"]) for i, s in enumerate(raw))
    assert raw.argmax() == 0 and got[0][1]


def test_reconstruction_equals_principal_components(cloud):
    x, df = cloud
    model = features.reconstruction_fit(df.where("id > 1"), F3, k=2)
    base = x[2:]
    scale = lambda v: (v - base.mean(axis=0)) / (base.std(axis=0) + 1e-6)
    _, axes = np.linalg.eigh(np.cov(scale(base).T))
    axes = axes[:, ::-1][:, :2]
    error = (scale(x) - scale(x) @ axes @ axes.T) ** 2
    mse = error.mean(axis=1)
    assert model["threshold"] == pytest.approx(mse[2:].mean() + 3 * mse[2:].std())
    for r in features.top_attributions(features.reconstruction_score(df, model), 2).collect():
        assert r.mse == pytest.approx(mse[r.id]) and r.ae_flag == (mse[r.id] >= model["threshold"])
        share = error[r.id] / error[r.id].sum()
        assert [a.feature for a in r.attributions] == [F3[k] for k in np.argsort(-share, kind="stable")] and len(r.top) == 2
        assert r.top[0].share == pytest.approx(share.max(), abs=6e-5)
    assert mse[1] >= model["threshold"]


def test_forest_beats_the_majority(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float((a > 0) + (b > 0.5))) for i, (a, b) in enumerate(x)], "id long, a double, b double, label double")
    model = features.classify_fit(df, ["a", "b"], "label", trees=10, depth=5)
    out = features.classify(df, model, ["none", "one", "two"]).collect()
    named = ["none", "one", "two"]
    assert np.mean([r.predicted == named[int(r.label)] for r in out]) > 0.95
    assert all(r.predicted == max(r.probabilities, key=r.probabilities.get) or r.confidence < 0.51 for r in out) and all(abs(sum(r.probabilities.values()) - 1) < 2e-3 and r.confidence == pytest.approx(max(r.probabilities.values()), abs=6e-5) for r in out)
    weights = features.feature_importance(spark, model, ["a", "b"], n=8).collect()
    assert [r.feature for r in weights] == sorted(["a", "b"], key=lambda f: -next(r.importance for r in weights if r.feature == f)) and sum(r.importance for r in weights) == pytest.approx(1.0)


def test_ensemble_is_its_formula(spark):
    rows = [(m, i, a, s, p, c) for m in (0.1, 3.0) for i in (0.2, 0.9) for a in (False, True) for s in (False, True) for p, c in (("NOMINAL", 0.99), ("X", 0.75), ("X", 0.76))]
    df = spark.createDataFrame(rows, "mse double, iso_score double, ae_flag boolean, iso_flag boolean, predicted string, confidence double")
    for r in features.ensemble_decision(df, 2.0).collect():
        assert r.ensemble_score == pytest.approx(0.5 * min(r.mse / 2, 1) + 0.5 * r.iso_score) and r.is_anomaly == (r.ae_flag or r.iso_flag or (r.predicted != "NOMINAL" and r.confidence > 0.75))


def test_queries_cover_every_tick(spark):
    q, n = queries(), detection.ticks(spark, SF).count()
    for name in ("isolation_forest", "reconstruction_error", "classify_archetype", "ensemble_decision"):
        assert q[f"{name}_ticks"](spark, SF).count() == n
    assert q["stratified_split"](spark, SF).where("is_test").count() == sum(r["n"] // 4 for r in detection.series(spark, SF).groupBy("k").agg(F.count("*").alias("n")).collect())
    assert 0 < q["feature_importance_ticks"](spark, SF).count() <= 8
