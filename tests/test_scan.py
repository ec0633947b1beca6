"""Scans and selections against plain versions, with one key over most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemara.operators import contract, evaluate, features, metrics, scan


def keyed(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))
    return [(int(i), None if i % 37 == 5 else str(k), None if i % 11 == 3 else float(v)) for i, (k, v) in enumerate(zip(keys, rng.integers(0, 500, n), strict=True))]


def test_running_values_of_a_hot_key(spark):
    rows = keyed()
    df = spark.createDataFrame(rows, "id long, k string, v double")
    got = {r.id: r for r in scan.running(df, ["k"], ["id"], {"high": ("max", F.col("v")), "low": ("min", F.col("v")), "total": ("sum", F.col("v")), "last": ("max", F.when(F.col("v").isNotNull(), F.struct("id", "v")))}).collect()}
    upto = scan.running(df, ["k"], ["id"], {"n": ("sum", F.lit(1))}, current=True)
    assert sorted(upto.columns) == ["id", "k", "n", "v"]
    numbers = {r.id: r.n for r in upto.collect()}
    seen: dict = {}
    for i, k, v in rows:
        before = [x for x in seen.get(k, []) if x[1] is not None]
        values = [x[1] for x in before]
        r = got[i]
        assert (r.high, r.low, r.total) == ((max(values), min(values), sum(values)) if values else (None, None, None))
        assert (r["last"] and tuple(r["last"])) == (before[-1] if before else None)
        seen.setdefault(k, []).append((i, v))
        assert numbers[i] == len(seen[k])
    assert scan.running(df.where("false"), ["k"], ["id"], {"n": ("sum", F.lit(1))}).count() == 0


def test_no_task_of_a_scan_holds_the_hot_key(spark):
    df = spark.range(20_000).select("id", F.lit("one").alias("k"), F.rand(3).alias("v"))
    made = scan.running(df, ["k"], ["id"], {"n": ("sum", F.lit(1))}, current=True)
    assert made.where("n <> id + 1").count() == 0
    most = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 20_000 * 0.6


@pytest.mark.parametrize("values", ["spread", "ties", "two", "one"])
def test_ranks_are_exact_with_all_rows_in_one_group(spark, values):
    rng = np.random.default_rng(4)
    v = {"spread": rng.normal(size=5000), "ties": rng.integers(0, 7, 5000) * 1.0, "two": np.where(rng.random(5000) < 0.5, 1.0, 2.0), "one": np.full(5000, 3.0)}[values]
    df = spark.createDataFrame([("g", float(x)) for x in v] + [("g", None), ("few", 2.0), ("few", 1.0), (None, 9.0)], "k string, v double")
    ranks = [0, 1, 700, 2499, 2500, 4998, 4999]
    got = {(r.k, r.rank): r.value for r in scan.ranked_values(df, ["k"], "v", lambda n: F.when(n > 100, F.array(*map(F.lit, ranks))).otherwise(F.array(F.lit(0))), small=100).collect()}
    s = np.sort(v)
    assert got == {**{("g", r): s[r] for r in ranks}, ("few", 0): 1.0, (None, 0): 9.0}
    both = evaluate.percentiles(df, [], "v").first()
    every = np.sort([*v, 2.0, 1.0, 9.0])
    assert [both.p50, both.p95, both.p99] == pytest.approx(np.percentile(every, [50, 95, 99])) and both.s95 == every[int(len(every) * 0.95)]


def test_time_order_equals_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "s" if rng.random() < 0.9 else "t", int(i + rng.integers(-6, 6)), bool(rng.random() < 0.8)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, s string, t long, ok boolean")
    got = {r.id: r.late for r in contract.check_monotonic(df, ["s"], "t", ["id"], F.col("ok")).collect()}
    mark: dict = {}
    for i, s, t, ok in rows:
        late = ok and s in mark and t < mark[s]
        assert got[i] == late
        if ok and not late:
            mark[s] = t


def test_split_takes_the_share_of_each_label_even_where_ids_repeat(spark):
    df = spark.createDataFrame([(i, "big") for i in range(900)] + [(5, "same")] * 40 + [(7, None)] * 9 + [(8, "lone")], "id long, y string")
    made = features.stratified_split(df, "y", "id", 0.25)
    counts = {r.y: (r.n, r.t) for r in made.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert counts == {"big": (900, 225), "same": (40, 10), None: (9, 2), "lone": (1, 0)}


def plain_rate(samples, at, window):
    inside = sorted((t, v) for t, v in samples if at - window < t <= at)
    if len(inside) < 2:
        return None
    grown = inside[-1][1] - inside[0][1] + sum(a[1] for a, b in zip(inside, inside[1:], strict=False) if b[1] < a[1])
    span = inside[-1][0] - inside[0][0]
    mean = span / (len(inside) - 1)
    head, tail = inside[0][0] - (at - window), at - inside[-1][0]
    head, tail = (head if head < 1.1 * mean else mean / 2), (tail if tail < 1.1 * mean else mean / 2)
    if grown > 0 and inside[0][1] >= 0:
        head = min(head, span * inside[0][1] / grown)
    return grown * (span + head + tail) / span / window


def test_rates_over_resets_and_gaps(spark):
    rng = np.random.default_rng(3)
    rows, series = [], {}
    for k in ("a", "b"):
        t, v = 1000, 0.0
        for i in range(300):
            t += int(rng.integers(1, 30)) + (400 if i % 90 == 80 else 0)
            v = 0.0 if i % 70 == 60 else v + float(rng.integers(0, 5))
            rows.append((k, t, v))
            series.setdefault(k, []).append((t, v))
    got = {(r.k, r.evaluated): r.rate for r in metrics.range_rate(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", 300, 15).collect()}
    want = {(k, at): x for k, s in series.items() for at in range(0, 9000, 15) if (x := plain_rate(s, at, 300)) is not None}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_last_samples_go_stale_and_gaps_end_an_alert(spark):
    rows = [("x", 3, 1.0), ("x", 12, 0.0), ("x", 400, 0.0), ("x", 405, 1.0), ("y", 10, 5.0)]
    seen = metrics.as_of(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", 5, 300)
    got = {(r.k, r.evaluated): r.value for r in seen.collect()}
    want = {}
    for k in "xy":
        for at in range(0, 900, 5):
            past = [(t, v) for kk, t, v in rows if kk == k and t <= at and at - t < 300]
            if past:
                want[k, at] = max(past)[1]
    assert got == want
    on = spark.createDataFrame([("g", at) for at in [*range(0, 70, 5), *range(80, 160, 5)]], "g string, evaluated long")
    states = {r.evaluated: r.state for r in metrics.active_alerts(on, ["g"], 60).collect()}
    assert states == {at: "firing" if at in (60, 65) or at >= 140 else "pending" for at in states}
