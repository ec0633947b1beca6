import numpy as np
import pytest
from pyspark.sql import functions as F

from telemara.operators import features


def test_cut_of_the_isolation_trees_is_selected_and_not_gathered(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(400, 2))], "a double, b double")
    for n, q in ((400, 0.97), (401, 0.5), (1, 0.97), (7, 1.0), (7, 0.0)):
        some = spark.createDataFrame([(float(v),) for v in rng.integers(0, 90, n)], "v double")
        assert features.exact_percentile(some, "v", q) == some.agg(F.percentile("v", q)).first()[0]
    model = features.iforest_fit(df, ["a", "b"], trees=5, contamination=0.03)
    assert model["cut"] == pytest.approx(features._isolation(df, model).agg(F.percentile("iso_raw", 0.97)).first()[0], rel=1e-15)

    def gathered(*_):
        raise AssertionError("one task holds all values")

    monkeypatch.setattr(F, "percentile", gathered)
    assert features.iforest_fit(df, ["a", "b"], trees=5, contamination=0.03)["cut"] == model["cut"]
