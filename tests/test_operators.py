"""Single operators on small literal frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemara import functions as fn
from telemara.operators import contract, detect, evaluate, finance, history, metrics, retrieve, shape, triage


def series(spark, values):
    return spark.createDataFrame([(i, "k", i, float(v)) for i, v in enumerate(values)], "id long, k string, ts long, x double")


def flags(df):
    return [r.flag for r in df.orderBy("id").collect()]


def test_zscore_is_silent_then_flags_a_spike(spark):
    out = detect.rolling_zscore(series(spark, [50 + (i % 3) for i in range(15)] + [150]), ["k"], ["ts", "id"], "x", window=30)
    assert flags(out) == [False] * 15 + [True]


def test_zscore_upper_only(spark):
    out = detect.rolling_zscore(series(spark, [100 + i % 2 for i in range(15)] + [0, 300]), ["k"], ["ts", "id"], "x", window=30, min_samples=10, direction="upper")
    assert flags(out)[-2:] == [False, True]


def test_mad_flags_an_outlier(spark):
    out = detect.rolling_mad(series(spark, [10 + i % 3 for i in range(20)] + [95]), ["k"], ["ts", "id"], "x").orderBy("id").collect()
    assert out[-1].flag and out[-1].score > 10 and not any(r.flag for r in out[:-1])


def test_ewma_flags_a_shift_and_warms_up_silently():
    path = detect.ewma_path(np.array([25.0 + (i % 2) * 0.5 for i in range(15)] + [32.0] * 10))
    assert not any(p[1] for p in path[:15]) and any(p[1] for p in path[15:])


def test_mahalanobis_names_the_feature(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, r)) for r in rng.normal((30, 50, 20), 1, (50, 3))]
    df = spark.createDataFrame(rows, "cpu double, memory double, latency double")
    model = detect.mahalanobis_fit(df, ["cpu", "memory", "latency"])
    near, far = detect.mahalanobis_score(spark.createDataFrame([(31.0, 51.0, 21.0), (30.0, 50.0, 180.0)], df.schema), model, 16.26623623619813).orderBy("latency").collect()
    assert not near.flag and far.flag and max(far.attribution, key=far.attribution.get) == "latency"
    assert detect.chi_square_tail(detect.CRITICAL_11) == pytest.approx(1e-5, rel=1e-6)


def test_monotonic_closed_form_equals_a_simulation(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), r.randrange(12), r.random() > 0.25) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, s string, ts int, ok boolean")
    got = {x.id: x.late for x in contract.check_monotonic(df, ["s"], "ts", ["id"], F.col("ok")).collect()}
    mark, want = {}, {}
    for i, s, t, ok in rows:
        want[i] = ok and t < mark.get(s, -1)
        if ok and not want[i]:
            mark[s] = t
    assert got == want


def test_slug_endpoint_tokens_and_severity(spark):
    row = spark.range(1).select(
        fn.chunk_id(F.lit("rb_test_sample"), F.lit("2. Remediation Script")).alias("a"),
        fn.normalise_endpoint(F.lit("/v1/incidents/INC-7/12345")).alias("b"),
        fn.tokenise_technical(F.lit("The pg_stat-activity a 7 #x")).alias("c"),
        fn.severity_of(F.lit(-3.6)).alias("d"),
        fn.error_rate(F.lit(950), F.lit(30), F.lit(20)).alias("e"),
    ).first()
    assert row.a == "rb_test_sample#2-remediation-script" and row.b == "/v1/incidents/{id}/{id}"
    assert row.c == ["the", "pg_stat-activity", "7", "#x"] and row.d == "HIGH" and row.e == 0.02


def test_markdown_fences_hide_headings(spark):
    text = "# Title\nintro " + "x" * 60 + "\n```\n# not a heading\n```\n## Steps\n" + "y" * 70 + "\n## Short\nz"
    out = retrieve.chunk_markdown(spark.createDataFrame([("a/runbooks/rb.md", text)], "uri string, text string")).collect()
    assert sorted(r.section_title for r in out) == ["Steps", "Title"] and {r.doc_type for r in out} == {"runbook"} and {r.doc_title for r in out} == {"Title"}


def test_bm25_and_tfidf_find_the_right_text(spark):
    docs = spark.createDataFrame([(1, "check max_connections and pg_stat_activity of the database pool"), (2, "pod OOMKilled, attach py-spy to the heap")], "id int, text string")
    ask = spark.createDataFrame([(1, "max_connections pg_stat_activity"), (2, "OOMKilled py-spy")], "query_id int, text string")
    assert {(r.query_id, r.id) for r in retrieve.bm25_topk(retrieve.bm25_index(docs), ask).collect()} == {(1, 1), (2, 2)}
    assert {(r.query_id, r.id) for r in retrieve.cosine_topk(retrieve.tfidf_fit(docs), ask).where("rank = 1").collect()} == {(1, 1), (2, 2)}


def test_financials_golden_case(spark):
    rows = [(1, "CRITICAL", "a", "NOMINAL", "2024-01-01 00:00:00", "2024-01-01 00:20:00", "RESOLVED", False), (2, "HIGH", "a", None, "2024-01-01 00:00:00", None, "RESOLVED", True)]
    inc = spark.createDataFrame(rows, "id int, severity string, service_id string, archetype string, d string, r string, status string, is_false_positive boolean")
    inc = inc.select("*", F.to_timestamp("d").alias("detected_at"), F.to_timestamp("r").alias("resolved_at"))
    a, b = finance.incident_financials(inc).orderBy("id").collect()
    assert (a.baseline_downtime_cost, a.actual_downtime_cost, a.downtime_savings_gross, a.engineering_hours_saved, a.engineering_cost_saved) == (270000.0, 60000.0, 210000.0, 3.5, 332.5)
    assert b.actual_downtime_cost == 0 and b.engineering_hours_saved == 0 and b.archetype == "unclassified_anomaly"
    empty = finance.executive_kpis(finance.incident_financials(inc.limit(0))).first()
    assert empty.total_incidents == 0 and empty.payback_days == 999.0


def test_alert_needs_its_full_duration(spark):
    df = spark.createDataFrame([("a", t, 5 <= t < 200) for t in range(0, 205, 5)], "g string, t int, on boolean")
    state = {r.t: r.state for r in metrics.alert_state(df, ["g"], "t", F.col("on"), 180).collect()}
    assert state[180] == "pending" and state[185] == "firing" and state[200] == "inactive"
    ratio = metrics.ratio_alert(spark.createDataFrame([(0, 1)] + [(0, 0)] * 4, "t int, bad int"), F.col("bad") == 1, "t", 300, 0.2).first()
    assert ratio.ratio == pytest.approx(0.2) and not ratio.firing


def test_quantile_of_the_last_bucket_is_its_edge(spark):
    df = spark.createDataFrame([("a", 5.0)], "g string, v double")
    assert metrics.histogram_quantile(metrics.histogram_buckets(df, ["g"], "v", [1.0, 2.0]), ["g"], 0.5).first().quantile == 2.0


def test_gate_and_registry(spark):
    good = spark.createDataFrame([(0.95, 0.9, 0.01, 12.0)], "precision double, recall double, false_positive_rate double, p99_ms double")
    assert evaluate.enforce_gate(evaluate.quality_gate(good)).count() == 4
    slow = evaluate.quality_gate(good.withColumn("p99_ms", F.lit(15.0)))
    assert not slow.first().all_passed
    with pytest.raises(Exception, match="quality gate failed"):
        evaluate.enforce_gate(slow).collect()
    reg = spark.createDataFrame([("m", 1, "Production", True, 1), ("m", 2, "Production", True, 2)], "model string, version int, stage string, passed boolean, registered_at int")
    assert {r.version: r.stage for r in evaluate.champion_model(reg).collect()} == {1: "Archived", 2: "Production"}


def test_triage_routes_and_grounds(spark):
    inc = spark.createDataFrame([(1, "CRITICAL", "checkout-service", "DB_CONNECTION_POOL_SATURATION"), (2, "LOW", "b-service", None)], "incident_id int, severity string, service_id string, archetype string")
    sig = spark.createDataFrame([(1, 1, "db_connection_pool_active", 96.0, 40.0, 5.8, True), (1, 2, "app_error_rate", 0.2, 0.0, 9.9, False)], "incident_id int, signal_id int, metric string, observed double, baseline double, sigma double, is_primary boolean")
    cite = spark.createDataFrame([(1, "[rb#pool]")], "incident_id int, citation string")
    out = {r.incident_id: r for r in triage.triage_incidents(inc, sig, cite).collect()}
    assert out[1].action == "EXPAND_DB_CONNECTION_POOL" and out[1].status == "HUMAN_APPROVAL_PENDING" and out[1].is_grounded
    assert out[2].triage_status == "RESOLVED" and out[2].status == "REMEDIATION_EXECUTED"


def test_children_stay_unless_replaced(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "incident_id int, m string")
    new = spark.createDataFrame([(2, "c")], old.schema)
    assert {(r.incident_id, r.m) for r in history.replace_children(old, new).collect()} == {(1, "a"), (2, "c")}


def test_cycle_and_repeat(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(5)], "pos long, v int")
    assert {r.pos: r.w for r in shape.join_cyclic(df, df.where("pos < 2").withColumnRenamed("v", "w")).collect()} == {0: 0, 1: 10, 2: 0, 3: 10, 4: 0}
    assert sorted(r.v for r in shape.repeat_to_size(df, 7).collect()) == [0, 0, 10, 10, 20, 30, 40]
