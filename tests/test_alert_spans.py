import math
import random

import pytest
from pyspark.sql import functions as F

from telemara.operators import metrics


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(metrics, "SPAN", 7)


def rate(samples, e, window, step):
    """Of samples (t, v) in rising order, by the definition."""
    here = [(t, v) for t, v in samples if math.ceil(t / step) * step in range(e - window + step, e + step, step)]
    if len(here) < 2:
        return None
    falls = sum(a for (_, a), (_, b) in zip(here, here[1:]) if a > b)
    (t0, v0), (t1, v1) = here[0], here[-1]
    grown, span = v1 - v0 + falls, t1 - t0
    mean = span / (len(here) - 1)
    near = lambda x: x if x < mean * 1.1 else mean / 2
    head = near(t0 - (e - window))
    head = min(head, span * v0 / grown) if grown > 0 and v0 >= 0 else head
    return grown * (span + head + near(e - t1)) / span / window


def test_rates_hold_across_spans_and_resets(spark, short):
    rng, rows = random.Random(3), []
    for key in ("a", "b", None):
        t, v = -40.0, 0.0
        for _ in range(120):
            t, v = t + rng.choice([1.0, 2.5, 5.0, 80.0 if rng.random() < 0.1 else 3.0]), 0.0 if rng.random() < 0.1 else v + rng.randint(0, 9)
            rows += [(key, 0.5, t, v), (key, 0.5, t, v - 1)]  # of one time the larger counts
    got = {(r.k, r.evaluated): r.rate for r in metrics.range_rate(spark.createDataFrame(rows, "k string, le double, t double, v double"), ["k", "le"], "t", "v", 60, 5).collect()}
    want = {}
    for key in ("a", "b", None):
        own = sorted({r[2]: r[3] for r in reversed(rows) if r[0] == key}.items())
        for e in range(-100, int(own[-1][0]) + 100, 5):
            if (x := rate(own, e, 60, 5)) is not None:
                want[key, e] = x
    assert got == pytest.approx(want, rel=1e-12)


def test_gauges_and_alerts_hold_across_spans(spark, short):
    times = [0, 3, 11, 30, 200, 202, 600]
    got = {r.evaluated: r.value for r in metrics.as_of(spark.createDataFrame([("s", t, float(t)) for t in times], "k string, t int, v double"), ["k"], "t", "v", 5, 50).collect()}
    assert got == {e: float(max(t for t in times if t <= e)) for e in range(0, 700, 5) if any(t <= e < t + 50 for t in times)}
    on = [*range(0, 300, 5), *range(310, 400, 5)]
    states = {r.evaluated: r.state for r in metrics.active_alerts(spark.createDataFrame([("s", e) for e in on], "k string, evaluated long"), ["k"], 60).collect()}
    assert states == {e: "firing" if 60 <= e < 300 or e >= 370 else "pending" for e in on}


def test_samples_move_once(spark):
    df = spark.range(50).select(F.lit("s").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"), F.col("id").alias("evaluated"))
    for made in (metrics.range_rate(df, ["k"], "t", "v", 300, 5), metrics.as_of(df, ["k"], "t", "v"), metrics.active_alerts(df, ["k"], 60)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Scan ExistingRDD" not in plan
