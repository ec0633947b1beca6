"""The full detection engine against plain Python, and the class in the ensemble."""

import math
from collections import defaultdict

import numpy as np
import pytest

from telemara.operators import detect
from telemara.plans import detection, queries

SF = "/root/testdata/sf0.001"


def brute_signals(rows, engine, mean, inverse, features, crit):
    """Signals of one series, snapshot by snapshot, in the order of the detectors: (id, metric, detector, sigma)."""
    charts = {m: detect.Chart(lam=lam, direction=way) for m, lam, way in engine.ewma}
    beyond = lambda z, edge, way: z >= edge if way == "upper" else z <= -edge
    out = []
    for i, r in enumerate(rows):
        past = rows[max(0, i - 60) : i]
        for m, way in engine.zscore:
            xs = [p[m] for p in past]
            if len(xs) >= 15 and beyond(z := (r[m] - np.mean(xs)) / (np.std(xs, ddof=1) + 1e-6), 3.0, way):
                out.append((r.id, m, "z_score", z))
        for m, way in engine.mad:
            xs = [p[m] for p in past]
            if len(xs) >= 15 and beyond(z := 0.6745 * (r[m] - np.median(xs)) / (np.median(np.abs(xs - np.median(xs))) + 1e-6), 3.5, way):
                out.append((r.id, m, "modified_z_score", z))
        for m, chart in charts.items():
            z, flag, centre, _, _ = chart.path([r[m]])[0]
            if flag:
                out.append((r.id, m, "ewma", (z - centre) / max(1.0, abs(centre) * 0.1)))
        d = np.array([r[f] for f in features]) - mean
        far = math.sqrt(d @ inverse @ d)
        if far >= 1.5 * math.sqrt(crit):
            out.append((r.id, "multivariate_system_state", "mahalanobis", far - math.sqrt(crit)))
        near = rows[max(0, i - 29) : i + 1]
        for a, b, expected in engine.pairs:
            x, y = [p[a] for p in near], [p[b] for p in near]
            if len(x) >= 15 and np.std(x) > 1e-6 and np.std(y) > 1e-6 and abs(drift := np.corrcoef(x, y)[0, 1] - expected) >= 0.55:
                out.append((r.id, f"correlation_{a}_vs_{b}", "correlation_drift", 5 * abs(drift)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return detection.snaps(spark, SF).orderBy("k", "ts", "id").collect()


def test_signals_equal_brute_force(spark, rows):
    data = np.array([[r[f] for f in detection.PAIR] for r in rows])
    inverse = np.linalg.inv(np.cov(data.T) + 1e-4 * np.eye(2))
    by, want = defaultdict(list), []
    for r in rows:
        by[r.k].append(r)
    for series in by.values():
        want += brute_signals(series, detect.ENGINE, data.mean(axis=0), inverse, detection.PAIR, detection.CRITICAL_2)
    got = [(r.id, r.metric, r.detector, r.sigma) for r in queries()["emit_signals"](spark, SF).collect()]
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want) and {x[2] for x in got} == {"z_score", "modified_z_score", "ewma", "mahalanobis", "correlation_drift"}
    sigma = {x[:3]: x[3] for x in want}
    assert all(abs(s - sigma[i, m, d]) <= 0.005 + 1e-9 for i, m, d, s in got)


def test_blocks_change_nothing(spark):
    x = detection.snaps(spark, SF)
    shown = lambda df: sorted(map(str, df.drop("metadata").collect()))
    assert shown(detect.emit_signals(x, ["k"], ["ts", "id"], blocks=70)) == shown(detect.emit_signals(x, ["k"], ["ts", "id"], blocks=None))


def test_mahalanobis_signal_comes_from_the_gate_on_and_is_primary(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (300, 2)).round(6)
    a[299] = (9.0, -9.0)
    df = spark.createDataFrame([(i, "k", i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id long, k string, ts long, x double, y double")
    engine, crit = detect.Engine(zscore=(("x", "both"),), pairs=(("x", "y", 0.0),)), 13.815510557964274
    got = detect.emit_signals(df, ["k"], ["ts", "id"], engine, detect.mahalanobis_fit(df, ["x", "y"]), crit)
    off = a - a.mean(axis=0)
    distance = np.sqrt(np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(a.T) + 1e-4 * np.eye(2)), off))
    want = {(i, round(d, 2)) for i, d in enumerate(distance) if d >= 1.5 * math.sqrt(crit)}
    assert want and {(r.id, r.observed) for r in got.where("detector = 'mahalanobis'").collect()} == want
    first = {r.id: r.detector for r in detect.primary_driver(got).where("is_primary").collect()}
    assert all(first[i] == "mahalanobis" for i, _ in want)


def test_chi_square_tails(spark):
    for k in (1, 2, 3, 4, 10, 11):
        grid = np.linspace(6.0, 400.0, 400_001)
        density = grid ** (k / 2 - 1) * np.exp(-grid / 2) / (2 ** (k / 2) * math.gamma(k / 2))
        assert detect.chi_square_tail(6.0, k) == pytest.approx(float(np.trapezoid(density, grid)), rel=1e-4)
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[detect.p_value(F.lit(6.0), k).alias(f"p{k}") for k in (2, 3, 4, 11)]).first()
    assert [row[f"p{k}"] for k in (2, 3, 4, 11)] == pytest.approx([detect.chi_square_tail(6.0, k) for k in (2, 3, 4, 11)])


def test_verdicts_count_every_detector(spark):
    q = queries()
    signals = q["emit_signals"](spark, SF).collect()
    bad = {r.id for r in signals}
    verdicts = {r.id: r.verdict for r in q["ingest_verdict"](spark, SF).collect()}
    assert {i for i, v in verdicts.items() if v == "ANOMALOUS"} == bad
    assert q["batch_anomaly_rate"](spark, SF).first().anomalous == len(bad)
    assert sum(r.n for r in q["detector_breakdown"](spark, SF).collect()) == len(signals)
    assert {r.id for r in q["primary_driver"](spark, SF).collect()} == bad


def test_a_confident_class_is_an_anomaly(spark):
    sure = {(r.service_id, r.tick) for r in detection.classified(spark, SF).where("predicted <> 'NOMINAL' and confidence > 0.75").collect()}
    flagged = {(r.service_id, r.tick) for r in queries()["ensemble_decision_ticks"](spark, SF).where("is_anomaly").collect()}
    assert sure and sure <= flagged
