"""Queries of groups B, C, D and the feature half of E."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import error_rate, severity_of
from ..operators import contract, detect, features, shape
from .testbed import duck, load
from .tiers import lane, r2

K, O = ["k"], ["ts", "id"]
TICK = ["tick", "service_id"]
FEATURES = ["rps", "c5xx", "c4xx", "c2xx", "orders", "revenue", "p50", "p95", "p99", "cpu", "checkout"]
CHECKS = dict(required=("cpu",), ranges={"cpu": (0, 100), "p50": (0, None)}, bounds={"checkout": (0, 100)})


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def series(s, d):
    return load(s, d, "series")


def ticks(s, d):
    return load(s, d, "ticks")


def judged(s, d):
    return contract.judged(load(s, d, "dirty"), ["service_id"], "stamp", ["tick", "id"], **CHECKS)


def scored(s, d):
    return detect.in_blocks(series(s, d), K, O, 60, lambda b, k: detect.rolling_zscore(b, k, O, "x"))


def zscore(s, d):
    return r6(scored(s, d).select("id", "score", "flag", F.round("mean", 8).alias("mean"), "std"), "score", "std")  # a mean of 32 values may end in a 5 at the seventh place


def mad(s, d):
    scored = detect.in_blocks(series(s, d), K, O, 60, lambda b, k: detect.rolling_mad(b, k, O, "x"))
    return r6(scored.select("id", "score", "flag", "median", "mad"), "score", "median", "mad")


def ewma(s, d):
    return r6(detect.ewma_chart(series(s, d).select("id", "k", "ts", "x"), K, O, "x").select("id", "z", "flag", "mean", "lcl", "ucl"), "z", "mean", "lcl", "ucl")


def drift(s, d):
    scored = detect.in_blocks(series(s, d), K, O, 29, lambda b, k: detect.correlation_drift_score(b, k, O, "x", "y"))
    return r6(scored.select("id", "drift", "flag", "severity"), "drift")


PAIR = ["infra_cpu_percent", "app_latency_p95_ms"]
#: The 1 - 1e-5 quantile of chi-square with two degrees of freedom, -2 ln 1e-5.
CRITICAL_2 = 23.025850929940457


def snaps(s, d):
    return load(s, d, "snaps")


def signals(s, d):
    x = snaps(s, d)
    return detect.emit_signals(x, K, O, model=detect.mahalanobis_fit(x, PAIR), crit_sq=CRITICAL_2)


def shown_signals(s, d):
    return signals(s, d).select("id", "k", "metric", "detector", "emission", "observed", "baseline", "sigma", "severity", "explicit", F.to_json("metadata").alias("details"))


def drivers(s, d):
    return detect.primary_driver(signals(s, d)).where("is_primary").select("id", "metric", "detector")


def verdicts(s, d):
    return detect.ingest_verdict(snaps(s, d), signals(s, d))


def mahalanobis(s, d):
    t = ticks(s, d)
    f = ["p50", "cpu", "revenue"]
    return r6(detect.mahalanobis_score(t, detect.mahalanobis_fit(t, f), crit_sq=16.26623623619813).select("service_id", "tick", "distance", "flag", "emitted"), "distance")


def calibrated(s, d):
    x = series(s, d)
    return r6(detect.calibrate_then_score(x.where("id < 2000"), x.where("id >= 2000"), lambda b: detect.rolling_zscore(b, K, O, "x")).select("id", "score", "flag"), "score")


def iforest(s, d):
    t = labelled(s, d)
    m = features.iforest_fit(t.where("label = 0"), ["rps", "p50", "cpu"], trees=40)
    return features.iforest_score(t, m).select("service_id", "tick", "iso_score", "iso_flag")


def reconstruction(s, d):
    t = labelled(s, d)
    m = features.reconstruction_fit(t.where("label = 0"), FEATURES, k=4)
    return features.top_attributions(features.reconstruction_score(t, m)).select("service_id", "tick", "mse", "ae_flag", "top")


def labelled(s, d):
    return ticks(s, d).withColumn("label", F.when(F.col("c5xx") * 3 > F.col("rps"), 1.0).otherwise(0.0))


def classified(s, d):
    t = labelled(s, d)
    return features.classify(t, features.classify_fit(t, FEATURES, "label", trees=10, depth=5), ["NOMINAL", "CASCADING_THIRD_PARTY_FAILURE"]).select("service_id", "tick", "predicted", "confidence")


def importance(s, d):
    return features.feature_importance(s, features.classify_fit(labelled(s, d), FEATURES, "label", trees=10, depth=5), FEATURES)


def ensemble(s, d):
    t = labelled(s, d)
    nominal = t.where("label = 0")
    rec, iso = features.reconstruction_fit(nominal, FEATURES, k=4), features.iforest_fit(nominal, ["rps", "p50", "cpu"], trees=20)
    model = features.classify_fit(t, FEATURES, "label", trees=10, depth=5)
    both = features.classify(features.iforest_score(features.reconstruction_score(t, rec), iso), model, ["NOMINAL", "CASCADING_THIRD_PARTY_FAILURE"])
    return features.ensemble_decision(both, rec["threshold"]).select("service_id", "tick", "ensemble_score", "is_anomaly")


def standardised(s, d):
    t = ticks(s, d)
    return r6(features.standardise(t, features.standardise_fit(t, ["p50", "cpu"])).select("service_id", "tick", "p50", "cpu"), "p50", "cpu")


def aligned(s, d):
    return shape.align_by_position(lane(s, d, "view", "view"), lane(s, d, "click", "click"))


def cyclic(s, d):
    return shape.join_cyclic(lane(s, d, "view", "a"), lane(s, d, "click", "b"))


def positions(s, d):
    return series(s, d).select(F.col("id").alias("pos"), "x")


def repeated(s, d):
    whole = positions(s, d)
    return shape.repeat_to_size(whole, 5 * whole.count() // 2)


QUERIES = {
    "error_rate": lambda s, d: ticks(s, d).select("service_id", "tick", F.round(error_rate(F.col("c2xx"), F.col("c4xx"), F.col("c5xx")), 6).alias("error_rate")),
    "metrics_long": lambda s, d: shape.metrics_long(snaps(s, d), ["id"]),
    "align_by_position": aligned,
    "join_cyclic": cyclic,
    "assign_round_robin": lambda s, d: shape.assign_round_robin(positions(s, d), ("a", "b", "c"), "2024-01-01", 5).select("pos", "entity", "step", "epoch"),
    "repeat_to_size": repeated,
    "label_by_rules": lambda s, d: shape.label_by_rules(ticks(s, d), [(F.col("cpu") > 60, "BLACK_FRIDAY_TRAFFIC_BURST", True), (F.col("checkout") < 30, "PAYMENT_GATEWAY_OUTAGE", True)]).select("service_id", "tick", "label", "anomalous"),
    "check_schema": lambda s, d: load(s, d, "dirty").select("id", contract.check_schema(("cpu",), CHECKS["ranges"]).alias("message")),
    "check_latency_order": lambda s, d: load(s, d, "dirty").select("id", contract.check_latency_order().isNotNull().alias("violated")),
    "check_bounds": lambda s, d: load(s, d, "dirty").select("id", contract.check_bounds({"cpu": (0, 100), "checkout": (0, 100)}).alias("field")),
    "check_monotonic": lambda s, d: contract.check_monotonic(load(s, d, "dirty"), ["service_id"], "stamp", ["tick", "id"], F.col("cpu").isNotNull()).select("id", "late"),
    "split_quarantine_valid": lambda s, d: contract.split_quarantine(judged(s, d), ["id"])[0].select("id", "service_id", "stamp"),
    "split_quarantine_rejected": lambda s, d: contract.split_quarantine(judged(s, d), ["id"])[1].select("id", "error_code"),
    "compliance_report": lambda s, d: contract.compliance_report(judged(s, d), ["service_id"]),
    "rolling_zscore": zscore,
    "rolling_mad": mad,
    "ewma_chart": ewma,
    "mahalanobis_score": mahalanobis,
    "correlation_drift_fit": lambda s, d: r6(detect.correlation_drift_fit(series(s, d), K, "x", "y"), "expected"),
    "correlation_drift_score": drift,
    "calibrate_then_score": calibrated,
    "severity_of": lambda s, d: scored(s, d).select("id", severity_of(F.col("score")).alias("severity")),
    "emit_signals": shown_signals,
    "primary_driver": drivers,
    "ingest_verdict": verdicts,
    "batch_anomaly_rate": lambda s, d: detect.batch_anomaly_rate(verdicts(s, d)),
    "anomalous_ids": lambda s, d: detect.anomalous_ids(verdicts(s, d)),
    "detector_breakdown": lambda s, d: detect.detector_breakdown(signals(s, d)),
    "ratio_features": lambda s, d: r6(features.ratio_features(ticks(s, d)).select("service_id", "tick", "latency_spread", "tail_ratio", "orders_per_request"), "latency_spread", "tail_ratio", "orders_per_request"),
    "rolling_features": lambda s, d: r6(detect.in_blocks(ticks(s, d), ["service_id"], ["tick"], 9, lambda b, k: features.rolling_features(b, k, ["tick"], ["cpu", "rps"])).select("service_id", "tick", "cpu_mean", "cpu_std", "cpu_diff", "rps_mean", "rps_diff"), "cpu_mean", "cpu_std", "cpu_diff", "rps_mean"),
    "standardise": standardised,
    "stratified_split": lambda s, d: features.stratified_split(series(s, d), "k", "id").select("id", "is_test"),
    "classify_archetype_ticks": classified,
    "feature_importance_ticks": importance,
    "isolation_forest_ticks": iforest,
    "reconstruction_error_ticks": reconstruction,
    "ensemble_decision_ticks": ensemble,
}

W60 = "over (partition by k order by ts, id rows between 60 preceding and 1 preceding)"
Z = f"z as (select *, count(x) {W60} as n, avg(x) {W60} as m, stddev_samp(x) {W60} as sd from series), zs as (select id, ts, k, x, case when n >= 15 then (x - m) / (sd + 1e-6) else 0.0 end as score, case when n >= 15 then m else x end as mean, case when n >= 15 then sd else 0.0 end as std, n from z)"
M = f"m as (select *, count(x) {W60} as n, median(x) {W60} as md, mad(x) {W60} as ad from series), ms as (select id, x, case when n >= 15 then 0.6745 * (x - md) / (ad + 1e-6) else 0.0 end as score, n, case when n >= 15 then md else x end as median, case when n >= 15 then ad else 0.0 end as mad from m)"
W30 = "over (partition by k order by ts, id rows between 29 preceding and current row)"
R = f"r as (select *, count(*) {W30} as n, stddev_pop(x) {W30} as sx, stddev_pop(y) {W30} as sy, covar_pop(x, y) {W30} as c from series), rs as (select id, x, case when n >= 15 and sx > 1e-6 and sy > 1e-6 then c / (sx * sy) end as r from r), ds as (select id, x, r, coalesce(abs(r), 0.0) as drift from rs)"
EW = """w as materialized (select *, row_number() over (partition by k order by ts, id) as n from series), w0 as materialized (select k, avg(x) as m, stddev_samp(x) + 1e-6 as sg from w where n <= 15 group by k),
e as (select w.k, w.n, w.id, w.x, w0.m as z, w0.m as mean, w0.m as shown, w0.sg, false as flag, 0.0::double as half from w join w0 on w.k = w0.k where w.n = 15
 union all select k, n, id, x, z, case when abs(z - mean) > half then mean else 0.97 * mean + 0.03 * x end, mean, sg, abs(z - mean) > half, half from
 (select w.k, w.n, w.id, w.x, 0.2 * w.x + 0.8 * e.z as z, e.mean, e.sg, 3.0 * e.sg * sqrt(0.2 / 1.8 * (1 - power(0.8, 2 * (w.n - 15)))) as half from e join w on w.k = e.k and w.n = e.n + 1)),
es as (select id, x, z, shown as mean, flag, half from e where n > 15 union all select id, x, x, x, false, 0.0 from w where n <= 15)"""
SEV = "case when abs({0}) >= 5 then 'CRITICAL' when abs({0}) >= 3.5 then 'HIGH' when abs({0}) >= 2.5 then 'MEDIUM' else 'LOW' end"
E = detect.ENGINE


def chart_sql():
    """The charts of all watched metrics, a row of every key after the other."""
    n = range(len(E.ewma))
    cols = lambda f: ", ".join(f(i, *E.ewma[i]) for i in n)
    beyond = lambda i, way: f"z{i} > m{i} + h{i}" if way == "upper" else f"z{i} < m{i} - h{i}"
    return f"""w as materialized (select *, row_number() over (partition by k order by ts, id) as n from snaps),
        w0 as materialized (select k, {cols(lambda i, m, lam, way: f'avg({m}) as m{i}, stddev_samp({m}) + 1e-6 as g{i}')} from w where n <= 15 group by k),
        e as (select w.k, w.n, w.id, {cols(lambda i, m, lam, way: f'w0.m{i} as z{i}, w0.m{i} as m{i}, w0.m{i} as s{i}, w0.g{i} as g{i}, 0.0::double as h{i}, false as f{i}')} from w join w0 on w.k = w0.k where w.n = 15
        union all select k, n, id, {cols(lambda i, m, lam, way: f'z{i}, case when {beyond(i, way)} then m{i} else 0.97 * m{i} + 0.03 * x{i} end, m{i}, g{i}, h{i}, {beyond(i, way)}')} from
        (select w.k, w.n, w.id, {cols(lambda i, m, lam, way: f'w.{m} as x{i}, {lam} * w.{m} + {1 - lam} * e.z{i} as z{i}, e.m{i} as m{i}, e.g{i} as g{i}, 3.0 * e.g{i} * sqrt({lam}::double / (2 - {lam}::double) * (1 - power({1 - lam}::double, 2 * (w.n - 15)))) as h{i}')} from e join w on w.k = e.k and w.n = e.n + 1))"""


def signals_sql():
    q = lambda x: f"cast({r2(x)} as varchar)"
    beyond = lambda z, edge, way: f"{z} >= {edge}" if way == "upper" else f"{z} <= -{edge}"
    parts, n = [], 0

    def put(source, metric, detector, at, observed, baseline, sigma, severity, details, when, explicit="false"):
        parts.append(f"select id, k, '{metric}' as metric, '{detector}' as detector, {at} as emission, {r2(observed)} as observed, {r2(baseline)} as baseline, {r2(sigma)} as sigma, {severity} as severity, {explicit} as explicit, {details} as details from ({source}) where {when}")

    for m, way in E.zscore:
        put(f"select id, k, x, m, sd, (x - m) / (sd + 1e-6) as z from (select id, k, {m} as x, count({m}) {W60} as n, avg({m}) {W60} as m, stddev_samp({m}) {W60} as sd from snaps) where n >= 15", m, "z_score", n, "x", "m", "z", SEV.format("z"), "'{\"window_std\":\"' || " + q("sd") + " || '\"}'", beyond("z", 3.0, way))
        n += 1
    for m, way in E.mad:
        put(f"select id, k, x, md, ad, 0.6745 * (x - md) / (ad + 1e-6) as z from (select id, k, {m} as x, count({m}) {W60} as n, median({m}) {W60} as md, mad({m}) {W60} as ad from snaps) where n >= 15", m, "modified_z_score", n, "x", "md", "z", SEV.format("z"), "'{\"window_mad\":\"' || " + q("ad") + " || '\"}'", beyond("z", 3.5, way))
        n += 1
    for i, (m, _, _) in enumerate(E.ewma):
        put(f"select e.id, e.k, {m} as x, s{i} as m, z{i} - s{i} as off, h{i} as h, f{i} as f from e join snaps on snaps.id = e.id where e.n > 15", m, "ewma", n, "x", "m", "off / greatest(1.0, 0.1 * abs(m))", SEV.format("off"), "'{\"ucl\":\"' || " + q("m + h") + " || '\",\"lcl\":\"' || " + q("m - h") + " || '\"}'", "f")
        n += 1
    a, b = PAIR
    put(f"""select id, k, sqrt(sq) as far, exp(-sq / 2) as p, sa, sb from (select id, k, (dx * dx * bb - 2 * dx * dy * ab + dy * dy * aa) / det as sq, abs(dx * (dx * bb - dy * ab) / det) / tot as sa, abs(dy * (dy * aa - dx * ab) / det) / tot as sb from
        (select *, (abs(dx * (dx * bb - dy * ab)) + abs(dy * (dy * aa - dx * ab))) / det + 1e-9 as tot from (select id, k, {a} - ma as dx, {b} - mb as dy, aa, ab, bb, aa * bb - ab * ab as det from snaps,
        (select avg({a}) as ma, avg({b}) as mb, var_samp({a}) + 1e-4 as aa, covar_samp({a}, {b}) as ab, var_samp({b}) + 1e-4 as bb from snaps))))""", "multivariate_system_state", "mahalanobis", n, "far", f"sqrt({CRITICAL_2})", f"far - sqrt({CRITICAL_2})", "'CRITICAL'",
        "'{\"p_value\":\"' || format('{:.2e}', p) || '\",\"top_contributor\":\"' || case when round(sa, 4) >= round(sb, 4) then '" + a + "' else '" + b + "' end || '\",\"top_attribution_pct\":\"' || cast(round(greatest(sa, sb), 4) as varchar) || '\"}'", f"far > 1.5 * sqrt({CRITICAL_2})", "true")
    n += 1
    for x, y, expected in E.pairs:
        put(f"select id, k, c / (sx * sy) as r, abs(c / (sx * sy) - {expected}) as drift from (select id, k, count(*) {W30} as n, stddev_pop({x}) {W30} as sx, stddev_pop({y}) {W30} as sy, covar_pop({x}, {y}) {W30} as c from snaps) where n >= 15 and sx > 1e-6 and sy > 1e-6", f"correlation_{x}_vs_{y}", "correlation_drift", n, "r", f"{expected}", "5 * drift", "case when drift > 0.8 then 'HIGH' else 'MEDIUM' end", "'{\"drift_delta\":\"' || " + q("drift") + " || '\"}'", "drift >= 0.55")
        n += 1
    return " union all ".join(parts)


SIG = f"{chart_sql()}, sig as ({signals_sql()})"
P = "p as (select *, row_number() over (partition by id order by explicit desc, abs(sigma) desc, emission) as i from sig)"
V = f"{SIG}, {P}, t as (select id, count(*) as n, max(abs(sigma)) as peak, max(case when i = 1 then detector end) as d from p group by id), v as (select s.id, coalesce(t.n, 0) as signals, round(least(coalesce(peak, 0.0) / 6, 1.0), 4) as score, case when t.n > 0 then 'ANOMALOUS' else 'NOMINAL' end as verdict, t.d as primary_detector from snaps s left join t on t.id = s.id)"
J = """j1 as (select *, case when cpu is null or cpu < 0 or cpu > 100 or p50 < 0 then 'SCHEMA_VALIDATION_FAILED' when p50 > p95 or p95 > p99 then 'CROSS_FIELD_INVARIANT_VIOLATION' when checkout < 0 or checkout > 100 then 'BOUNDS_OUT_OF_RANGE' end as c from dirty),
j2 as (select *, max(case when c is null then stamp end) over (partition by service_id order by tick, id rows between unbounded preceding and 1 preceding) as mark from j1),
j as (select *, coalesce(c, case when stamp < mark then 'TIMESTAMP_NON_MONOTONIC' end) as error_code from j2)"""
TW = "over (partition by service_id order by tick rows between 9 preceding and current row)"


def x(names, body):
    return duck(names, body.replace("{", "{{").replace("}", "}}"))


def ser(body):
    return x(["series"], body).replace("with series", "with recursive series")


def sig(body):
    return x(["snaps"], body).replace("with snaps", "with recursive snaps")


ORACLES = {
    "error_rate": x(["ticks"], "select service_id, tick, round(coalesce(cast(c5xx as double) / nullif(c2xx + c4xx + c5xx, 0), 0.0), 6) as error_rate from ticks"),
    "metrics_long": x(["snaps"], " union all ".join(f"select id, '{m}' as metric, cast({m} as double) as value from snaps" for m in shape.METRICS)),
    "align_by_position": x(["series"], "select pos, view, click from (select row_number() over (order by id) - 1 as pos, x as view from series where k = 'view') join (select row_number() over (order by id) - 1 as pos, x as click from series where k = 'click') using (pos)"),
    "join_cyclic": x(["series"], ", a as (select row_number() over (order by id) - 1 as pos, x as a from series where k = 'view'), b as (select row_number() over (order by id) - 1 as pos, x as b from series where k = 'click') select a.pos, a.a, b.b from a join b on b.pos = a.pos % (select count(*) from b)"),
    "assign_round_robin": x(["series"], "select id as pos, case id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as entity, id // 3 as step, 1704067200 + 5 * (id // 3) as epoch from series"),
    "repeat_to_size": x(["series"], "select r * n + id as pos, x from series, range(3) t(r), (select count(*) as n from series) where r * n + id < n * 5 // 2"),
    "label_by_rules": x(["ticks"], "select service_id, tick, case when cpu > 60 then 'BLACK_FRIDAY_TRAFFIC_BURST' when checkout < 30 then 'PAYMENT_GATEWAY_OUTAGE' else 'NOMINAL' end as label, cpu > 60 or checkout < 30 as anomalous from ticks"),
    "check_schema": x(["dirty"], "select id, case when cpu is null or cpu < 0 or cpu > 100 then 'fields: cpu' || case when p50 < 0 then ',p50' else '' end when p50 < 0 then 'fields: p50' end as message from dirty"),
    "check_latency_order": x(["dirty"], "select id, p50 > p95 or p95 > p99 as violated from dirty"),
    "check_bounds": x(["dirty"], "select id, case when cpu < 0 or cpu > 100 then 'cpu' when checkout < 0 or checkout > 100 then 'checkout' end as field from dirty"),
    "check_monotonic": x(["dirty"], "select id, cpu is not null and coalesce(stamp < max(case when cpu is not null then stamp end) over (partition by service_id order by tick, id rows between unbounded preceding and 1 preceding), false) as late from dirty"),
    "split_quarantine_valid": x(["dirty"], f", {J} select id, service_id, stamp from j where error_code is null"),
    "split_quarantine_rejected": x(["dirty"], f", {J} select id, error_code from j where error_code is not null"),
    "compliance_report": x(["dirty"], f", {J} select service_id, count(*) as evaluated, count(*) filter (where error_code is null) as valid, count(error_code) as violations, round(count(*) filter (where error_code is null) * 100.0 / count(*), 2) as compliance_pct from j group by 1"),
    "rolling_zscore": x(["series"], f", {Z} select id, round(score, 6) as score, n >= 15 and abs(score) >= 3.0 as flag, round(mean, 8) as mean, round(std, 6) as std from zs"),
    "rolling_mad": x(["series"], f", {M} select id, round(score, 6) as score, n >= 15 and abs(score) >= 3.5 as flag, round(median, 6) as median, round(mad, 6) as mad from ms"),
    "ewma_chart": ser(f", {EW} select id, round(z, 6) as z, flag, round(mean, 6) as mean, round(mean - half, 6) as lcl, round(mean + half, 6) as ucl from es"),
    "correlation_drift_fit": x(["series"], "select k, round(case when count(*) >= 15 and stddev_pop(x) > 1e-6 and stddev_pop(y) > 1e-6 then corr(x, y) else 0.0 end, 6) as expected from series group by k"),
    "correlation_drift_score": x(["series"], f", {R} select id, round(drift, 6) as drift, r is not null and drift >= 0.55 as flag, case when drift > 0.8 then 'HIGH' else 'MEDIUM' end as severity from ds"),
    "calibrate_then_score": x(["series"], f", {Z} select id, round(score, 6) as score, n >= 15 and abs(score) >= 3.0 as flag from zs where id >= 2000"),
    "severity_of": x(["series"], f", {Z} select id, {SEV.format('score')} as severity from zs"),
    "emit_signals": sig(f", {SIG} select * from sig"),
    "primary_driver": sig(f", {SIG}, {P} select id, metric, detector from p where i = 1"),
    "ingest_verdict": sig(f", {V} select * from v"),
    "batch_anomaly_rate": sig(f", {V} select count(*) as total, count(*) filter (where verdict = 'ANOMALOUS') as anomalous, round(count(*) filter (where verdict = 'ANOMALOUS') * 100.0 / count(*), 2) as rate from v"),
    "anomalous_ids": sig(f", {V} select id from v where verdict = 'ANOMALOUS'"),
    "detector_breakdown": sig(f", {SIG} select detector, count(*) as n from sig group by 1"),
    "ratio_features": x(["ticks"], "select service_id, tick, round(p99 - p50, 6) as latency_spread, round(p99 / (p50 + 1e-6), 6) as tail_ratio, round(orders / (rps + 1e-6), 6) as orders_per_request from ticks"),
    "rolling_features": x(["ticks"], f"select service_id, tick, round(avg(cpu) {TW}, 6) as cpu_mean, round(coalesce(stddev_samp(cpu) {TW}, 0.0), 6) as cpu_std, round(coalesce(cpu - lag(cpu) over (partition by service_id order by tick), 0.0), 6) as cpu_diff, round(avg(rps) {TW}, 6) as rps_mean, cast(coalesce(rps - lag(rps) over (partition by service_id order by tick), 0) as double) as rps_diff from ticks"),
    "standardise": x(["ticks"], "select service_id, tick, round((p50 - avg(p50) over ()) / (stddev_pop(p50) over () + 1e-6), 6) as p50, round((cpu - avg(cpu) over ()) / (stddev_pop(cpu) over () + 1e-6), 6) as cpu from ticks"),
    "mahalanobis_score": x(["ticks"], """, c as (select avg(p50) a, avg(cpu) b, avg(revenue) c, var_samp(p50) + 1e-4 as aa, covar_samp(p50, cpu) ab, covar_samp(p50, revenue) ac, var_samp(cpu) + 1e-4 bb, covar_samp(cpu, revenue) bc, var_samp(revenue) + 1e-4 cc from ticks),
        e as (select t.service_id, t.tick, p50 - a as x, cpu - b as y, revenue - c as z, bb * cc - bc * bc as i11, ac * bc - ab * cc as i12, ab * bc - ac * bb as i13, aa * cc - ac * ac as i22, ab * ac - aa * bc as i23, aa * bb - ab * ab as i33, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from ticks t, c),
        d as (select service_id, tick, (x * x * i11 + y * y * i22 + z * z * i33 + 2 * (x * y * i12 + x * z * i13 + y * z * i23)) / det as sq from e)
        select service_id, tick, round(sqrt(sq), 6) as distance, sq >= 16.26623623619813 as flag, sq >= 16.26623623619813 and sqrt(sq) >= 1.5 * sqrt(16.26623623619813) as emitted from d"""),
}
