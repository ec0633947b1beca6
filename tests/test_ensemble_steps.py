"""the cheaper steps of the ensemble give what the plain ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemara.operators import features, reconstruction, scan


def plain(tree, x):
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree[0]


def test_all_rows_step_through_a_tree_as_each_does():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    tree = features._grow(x, rng, 0, 8)
    x[:5, 0], x[5:9, 2] = np.nan, np.inf
    padded = np.hstack([x, np.zeros((300, 1))])
    assert np.array_equal(features._depths(features._laid_out(tree, 4), padded), [plain(tree, r) for r in x])


def test_errors_and_scales_are_those_of_whole_vectors(spark):
    x = np.random.default_rng(4).normal(size=(500, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(5)
    p = reconstruction.initial(3, 4, 2, 1)
    mse = ((reconstruction.forward(p, x)[-1] - x) ** 2).mean(axis=1)
    n, mean, deviation = reconstruction.error_moments(reconstruction.packed(df, list("abc"), 2), p)
    assert n == 500 and mean == pytest.approx(mse.mean()) and deviation == pytest.approx(mse.std())
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (3.0,)], "a double")
    want = [r.a for r in features.standardise(odd, {"a": (1.0, 4.0)}).collect()]
    assert reconstruction.scaled(np.array([[np.nan], [np.nan], [np.inf], [-np.inf], [3.0]]), ["a"], {"a": (1.0, 4.0)}).ravel().tolist() == want


def test_blocks_cut_by_position_roll_as_numbered_ones(spark, monkeypatch):
    df = spark.range(103).select(F.lit("t").alias("k"), (F.col("id") % 3).alias("s"), "id", *[F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(features.BASE)])
    real = features.in_blocks
    monkeypatch.setattr(features, "in_blocks", lambda *a, **kw: real(*a, rows=10, **kw))
    rows = lambda at: sorted(map(tuple, features.vector_features(df, ["k", "s"], ["id"], at=at).collect()))
    assert rows(("id", 3)) == rows(None)


def test_few_values_left_are_sorted_and_not_halved_further(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.sin("id").alias("v"))
    got = {(r.k, r["rank"]): r.value for r in scan.ranked_values(df, ["k"], "v", lambda n: F.array(F.lit(0), F.lit(1234), n - 1), small=400).collect()}
    want = {k: np.sort(np.array([r.v for r in df.where(f"k = {k}").collect()])) for k in (0, 1)}
    assert got == {(k, i): want[k][i] for k in (0, 1) for i in (0, 1234, 2499)}
