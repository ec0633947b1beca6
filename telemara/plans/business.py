"""Queries of the evaluation half of E, and of groups G (history), H and I."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise_endpoint
from ..operators import evaluate, finance, history, metrics, retrieve
from ..operators.buckets import BucketedTable
from .testbed import duck, load, scratch

EDGES = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5]


def inc(s, d):
    return load(s, d, "incidents")


def fin(s, d):
    return finance.incident_financials(inc(s, d))


def req(s, d):
    return load(s, d, "requests")


def judged(s, d):
    return load(s, d, "judged")


def gate_metrics(s, d):
    return evaluate.binary_rates(judged(s, d), "y", "p").withColumn("p99_ms", F.lit(12.5)).select("precision", "recall", "false_positive_rate", "p99_ms")


def star(s, d, name):
    f = fin(s, d).withColumn("date_key", F.date_format("detected_at", "yyyyMMdd").cast("int"))
    f.createOrReplaceTempView("fact")
    s.range(30).select(F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("service_id")).createOrReplaceTempView("dim_service")
    finance.dim_date(s, "1992-01-01", "2000-12-31").createOrReplaceTempView("dim_date")
    return finance.view(s, name)


def registry(s, d):
    return inc(s, d).selectExpr("'m' || cast(id % 50 as string) as model", "id as version", "case when id % 3 = 0 then 'Staging' else 'Production' end as stage", "id % 5 <> 0 as passed", "id as registered_at")


def states(s, d):
    return inc(s, d).selectExpr("id % 2000 as incident_id", "id as epoch", "status", "service_id")


def history_pair(s, d):
    base = inc(s, d).selectExpr("id as incident_id", "'t' || cast(id as string) as title", "severity", "id * 10 as detected_at", "status", "0.5 as confidence", "cast(null as string) as postmortem", "cast(null as bigint) as resolved_at")
    new = base.where("incident_id % 3 = 0").selectExpr("incident_id + 3000 as incident_id", "'n' || cast(incident_id as string) as title", "severity", "detected_at", "'RESOLVED' as status", "0.9 as confidence", "'pm' as postmortem", "incident_id as resolved_at")
    return base, new


def upserted(s, d):
    return history.upsert_incidents(*history_pair(s, d))


def upserted_in_buckets(s, d):
    """As upserted, in a table of buckets of which only those touched are written again."""
    base, new = history_pair(s, d)
    table = BucketedTable.create(base, scratch(s, "incidents"), "incident_id")
    table.apply(new, history.upsert_incidents)
    return table.read()


def replaced_in_buckets(s, d):
    new = children(s, d).where("incident_id >= 4000 and incident_id % 2 = 0").selectExpr("incident_id", "signal_id", "'new' as metric")
    table = BucketedTable.create(children(s, d), scratch(s, "children"), "incident_id")
    table.apply(new, history.replace_children)
    return table.read()


def children(s, d):
    return load(s, d, "signals").select("incident_id", "signal_id", "metric")


def replaced(s, d):
    new = children(s, d).where("incident_id >= 4000 and incident_id % 2 = 0").selectExpr("incident_id", "signal_id", "'new' as metric")
    return history.replace_children(children(s, d), new)


def detail(s, d):
    i = inc(s, d).selectExpr("id as incident_id", "status")
    out = history.incident_detail(i, {"signals": children(s, d)})
    return out.select("incident_id", "status", F.size("signals").alias("n"), F.array_join(F.transform("signals", lambda x: x["metric"]), ",").alias("metrics"))


def similar(s, d):
    i = inc(s, d).selectExpr("id as incident_id", "service_id", "archetype", "id * 7 % 10007 as detected_at")
    rem = i.where("incident_id % 2 = 0").selectExpr("incident_id", "detected_at as at", "'act-' || cast(incident_id % 5 as string) as action")
    probes = s.range(25).selectExpr("id as probe_id", "'svc-' || cast(id as string) as service_id", "case when id % 2 = 0 then 'MEMORY_LEAK_GC_PAUSE' end as archetype")
    return history.similar_incidents(i, rem, probes)


def buckets(s, d):
    return metrics.histogram_buckets(req(s, d), ["kind"], "seconds", EDGES)


def minute_ratio(s, d):
    return metrics.ratio_alert(req(s, d), F.col("status") == 500, "epoch", 3600, 0.2)


def samples(s, d, name):
    return load(s, d, f"{name}_samples")


def rates(s, d):
    return metrics.range_rate(samples(s, d, "request"), ["status_code"], "epoch", "value").withColumn("rate", F.round("rate", 9))


def alerts(s, d):
    return metrics.alert_rules(*[samples(s, d, n) for n in ("latency", "snapshot", "health", "grounding", "request")])


def report(s, d):
    made = evaluate.classification_report(judged(s, d), "y", "p", [0, 1])
    both = made.withColumn("class", F.col("class").cast("string")).unionByName(evaluate.report_averages(made))
    return both.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def recalled(s, d):
    """Experience of each probe: its incidents and what the memory of its service holds."""
    text = F.element_at(F.array(*[F.lit(t) for t in ASKED]), (F.col("probe_id") % 4 + 1).cast("int"))
    asked = s.range(25).select(F.col("id").alias("probe_id"), F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("service_id")).withColumn("text", text).withColumnRenamed("probe_id", "query_id")
    entries = load(s, d, "runbooks").select("id", "text", F.concat(F.lit("svc-"), (F.col("id") % 25).cast("string")).alias("service_id"))
    found = retrieve.memory_search(entries, asked).select(F.col("query_id").alias("probe_id"), "id", "grade", "rank")
    return history.recall_experience(similar(s, d), found)


ASKED = ("connection pool saturation", "heap restart of a memory leak", "downstream timeout failure", "payment gateway decline")


def drifted(s, d):
    x = load(s, d, "series")
    return x.where("id % 2 = 0"), x.where("id % 2 = 1")


QUERIES = {
    "classification_report": report,
    "recall_by_detector": lambda s, d: evaluate.recall_by_detector(judged(s, d), "y", ["p", "q"]).withColumn("recall", F.round("recall", 6)),
    "sorted_percentiles": lambda s, d: evaluate.sorted_percentiles(req(s, d), ["kind"], "seconds"),
    "confusion_matrix": lambda s, d: evaluate.confusion_matrix(judged(s, d), "y", "p", [0, 1]),
    "binary_rates": lambda s, d: evaluate.binary_rates(judged(s, d), "y", "p"),
    "latency_percentiles": lambda s, d: evaluate.latency_percentiles(req(s, d), ["kind"], "seconds").withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")}),
    "quality_gate": lambda s, d: evaluate.quality_gate(gate_metrics(s, d)).select("metric", F.round("value", 6).alias("value"), "passed", "all_passed"),
    "champion_model": lambda s, d: evaluate.champion_model(registry(s, d)).select("model", "version", "stage"),
    "psi": lambda s, d: evaluate.psi(*drifted(s, d), "x", [10, 25, 50, 100]).select(F.round("psi", 6).alias("psi"), "drifted"),
    "ks_two_sample": lambda s, d: evaluate.ks_two_sample(*drifted(s, d), "x").select(F.round("d", 6).alias("d"), F.round("p_value", 6).alias("p_value")),
    "rolling_fpr": lambda s, d: evaluate.rolling_fpr(inc(s, d).groupBy(F.datediff(F.to_date("detected_at"), F.lit("1970-01-01")).alias("day")).agg(F.count_if("is_false_positive").alias("fp"), F.count("*").alias("n")), "day").withColumn("rate", F.round("rate", 6)),
    "incident_financials": lambda s, d: fin(s, d).select("id", "severity", "archetype", "actual_mttr_minutes", "hourly_downtime_rate", "baseline_downtime_cost", "engineering_hours_saved", "engineering_cost_saved", "mttr_reduction_minutes", "downtime_savings_gross", "total_gross_value_delivered", "realized_net_savings"),
    "executive_kpis": lambda s, d: finance.executive_kpis(fin(s, d)),
    "service_impact": lambda s, d: finance.service_impact(fin(s, d)).select("service_id", "incidents", "critical", "downtime_minutes", "availability_pct", F.round("savings", 2).alias("savings")),
    "monthly_trend": lambda s, d: finance.monthly_trend(fin(s, d)).select("month", "incidents", "critical", "high", "medium", "low", "hours_saved", "gross_value"),
    "archetype_pareto": lambda s, d: finance.archetype_pareto(fin(s, d)),
    "pareto_cumulative": lambda s, d: finance.pareto_cumulative(finance.archetype_pareto(fin(s, d))).select("archetype", F.round("cumulative_pct", 1).alias("cumulative_pct")),
    "dim_date": lambda s, d: finance.dim_date(s, "1995-01-01", "1998-12-31").join(inc(s, d).select(F.date_format("detected_at", "yyyyMMdd").cast("int").alias("date_key")).distinct(), "date_key", "left_semi"),
    "view_executive_summary": lambda s, d: star(s, d, "view_executive_summary"),
    "view_service_exposure": lambda s, d: star(s, d, "view_service_exposure"),
    "view_monthly_roi": lambda s, d: star(s, d, "view_monthly_roi"),
    "view_archetype_pareto": lambda s, d: star(s, d, "view_archetype_pareto"),
    "bi_measures": lambda s, d: finance.bi_measures(fin(s, d)),
    "denormalised_fact": lambda s, d: finance.denormalised_fact(inc(s, d), [(s.createDataFrame([("CRITICAL", 1), ("HIGH", 2), ("MEDIUM", 3)], "severity string, severity_rank int"), "severity")]),
    "tableau_fields": lambda s, d: finance.tableau_fields(fin(s, d)),
    "filter_incidents": lambda s, d: finance.filter_incidents(inc(s, d), "HIGH", "svc-3").select("id", "severity", "service_id"),
    "financial_impact": lambda s, d: finance.financial_impact(finance.executive_kpis(fin(s, d))),
    "realisation_what_if": lambda s, d: finance.realisation_what_if(fin(s, d)),
    "period_filter": lambda s, d: finance.period_filter(inc(s, d), 90).select("id", "severity"),
    "stage_waterfall": lambda s, d: finance.stage_waterfall(s.read.parquet(f"{d}/events.parquet"), ["user_id"], "event_type", "ts"),
    "upsert_incidents": upserted,
    "replace_children": replaced,
    "upsert_incidents_bucketed": upserted_in_buckets,
    "replace_children_bucketed": replaced_in_buckets,
    "incident_detail": detail,
    "similar_incidents": lambda s, d: similar(s, d).select("probe_id", "incident_id", "rank", "action"),
    "recent_incidents": lambda s, d: history.recent_incidents(inc(s, d).selectExpr("id as incident_id", "detected_at", "status")).select("incident_id", "status"),
    "recall_experience": recalled,
    "active_investigations": lambda s, d: history.active_investigations(states(s, d), 15000, 3000).select("incident_id", "epoch", "status"),
    "patch_state": lambda s, d: history.patch_state(inc(s, d).selectExpr("id as incident_id", "status", "service_id"), inc(s, d).where("id % 4 = 0").selectExpr("id as incident_id", "'PATCHED' as status", "cast(null as string) as service_id")),
    "count_by_labels": lambda s, d: metrics.count_by_labels(req(s, d), ["kind", "status"]),
    "histogram_buckets": lambda s, d: buckets(s, d).select("kind", "le", "cum", "count", F.round("sum", 4).alias("sum")),
    "rate_over_window": lambda s, d: metrics.rate_over_window(req(s, d), ["kind"], "epoch").withColumn("rate", F.round("rate", 8)),
    "range_rate": rates,
    "alert_rules": alerts,
    "as_of": lambda s, d: metrics.as_of(samples(s, d, "health"), ["subsystem"], "epoch", "value"),
    "histogram_quantile": lambda s, d: metrics.histogram_quantile(buckets(s, d), ["kind"], 0.95).withColumn("quantile", F.round("quantile", 6)),
    "ratio_alert": lambda s, d: minute_ratio(s, d).withColumn("ratio", F.round("ratio", 6)),
    "alert_state": lambda s, d: metrics.alert_state(minute_ratio(s, d).withColumn("g", F.lit("all")), ["g"], "window_start", F.col("firing"), 7200).select("window_start", "state"),
    "normalise_endpoint": lambda s, d: req(s, d).groupBy(normalise_endpoint(F.col("path")).alias("endpoint")).agg(F.count("*").alias("n")),
    "remediation_pipeline": lambda s, d: metrics.remediation_pipeline(inc(s, d).selectExpr("archetype as action_type", "status")),
    "latest_health": lambda s, d: metrics.latest_health(req(s, d).selectExpr("kind", "id", "case when status = 500 then 0 else 1 end as up"), "kind", "id", "up"),
    "threshold_alarm": lambda s, d: metrics.threshold_alarm(minute_ratio(s, d).withColumn("g", F.lit("all")), ["g"], "window_start", "ratio", 0.2, 3).select("window_start", "alarm"),
}

FIN = """, f0 as (select *, case severity when 'CRITICAL' then 180000.0 when 'HIGH' then 120000.0 when 'MEDIUM' then 25000.0 else 5000.0 end as rate,
  cast(case when is_false_positive then 5.0 when resolved_at is not null then greatest(1.0, epoch(resolved_at - detected_at) / 60.0) else 22.0 end as double) as m from incidents),
 f1 as (select *, case when is_false_positive then 0.0 else greatest(0.0, 90.0 - m) end as r, 1.5 * rate as bc, case when is_false_positive then 0.0 else m / 60 * rate end as ac from f0),
 fin as (select id, severity, service_id, coalesce(archetype, 'unclassified_anomaly') as archetype, detected_at, status, is_false_positive, round(m, 2) as actual_mttr_minutes, rate as hourly_downtime_rate, round(r, 2) as mttr_reduction_minutes, round(bc, 2) as baseline_downtime_cost,
  round(greatest(0.0, bc - ac), 2) as downtime_savings_gross, round(r / 60 * 3, 2) as engineering_hours_saved, round(r / 60 * 3 * 95, 2) as engineering_cost_saved, round(greatest(0.0, bc - ac) + r / 60 * 3 * 95, 2) as total_gross_value_delivered, round((greatest(0.0, bc - ac) + r / 60 * 3 * 95) * 0.25::double, 2) as realized_net_savings, round(ac, 2) as actual_downtime_cost from f1)"""


def x(names, body):
    return duck(names, body.replace("{", "{{").replace("}", "}}"))


def f(body):
    return x(["incidents"], f"{FIN} {body}")


AV = "round(greatest(99.0, least(99.99, 100 - coalesce(sum(case when not is_false_positive then actual_mttr_minutes end), 0.0) / 525600 * 100)), 4)"
BK = ", ".join(f"({e})" for e in EDGES)
BUCKETS = f", b as (select kind, le, count(*) filter (where seconds <= le) as cum, count(*) as count, sum(seconds) as sum from requests, (values {BK}, ('inf'::double)) t(le) group by kind, le)"
RATIO = ", ra as (select epoch // 3600 * 3600 as window_start, count(*) filter (where status = 500) / count(*)::double as ratio from requests group by 1)"
RATES = "select count(*) filter (where y = p) / count(*)::double as accuracy, count(*) filter (where y = 0 and p = 1) / (count(*) filter (where y = 0))::double as false_positive_rate, count(*) filter (where y = 1 and p = 1) / (count(*) filter (where y = 1))::double as recall, count(*) filter (where y = 1 and p = 1) / (count(*) filter (where p = 1))::double as precision from judged"
SIM = ", i as (select id as incident_id, service_id, archetype as own, id * 7 % 10007 as detected_at from incidents), pr as (select r as probe_id, 'svc-' || r::varchar as service_id, case when r % 2 = 0 then 'MEMORY_LEAK_GC_PAUSE' end as archetype from range(25) t(r)), s as (select probe_id, i.incident_id, row_number() over (partition by probe_id order by detected_at desc, i.incident_id desc) as rank, case when i.incident_id % 2 = 0 then 'act-' || (i.incident_id % 5)::varchar end as action from pr join i using (service_id) where archetype is null or archetype = own qualify rank <= 5)"

def rate_sql(name: str, label: str, step: int) -> str:
    """Rates over five minutes of one stand-in of samples, as name_r (label, evaluated, rate)."""
    return f"""{name}_l as (select *, lag(value) over w as pv, lag(epoch) over w as pt from {name} window w as (partition by {label} order by epoch)),
    {name}_g as (select distinct {label}, unnest(range(cast(ceil(epoch / {step}.0) * {step} as bigint), cast(ceil(epoch / {step}.0) * {step} as bigint) + 300, {step})) as evaluated from {name}),
    {name}_w as (select g.{label}, g.evaluated, count(*) as n, min(epoch) as a, max(epoch) as z, arg_min(value, epoch) as av, arg_max(value, epoch) as zv, sum(case when pv > value and pt > evaluated - 300 then pv else 0 end) as falls from {name}_g g join {name}_l l on l.{label} = g.{label} and l.epoch > evaluated - 300 and l.epoch <= evaluated group by 1, 2),
    {name}_x as (select *, zv - av + falls as grown, (z - a)::double as span, (z - a)::double / (n - 1) as mean from {name}_w where n > 1),
    {name}_y as (select *, case when a - (evaluated - 300) < mean * 1.1 then a - (evaluated - 300) else mean / 2 end as head, case when evaluated - z < mean * 1.1 then evaluated - z else mean / 2 end as tail from {name}_x),
    {name}_r as (select {label}, evaluated, grown * (span + case when grown > 0 and av >= 0 then least(head, span * av / grown) else head end + tail) / span / 300 as rate from {name}_y)"""


AS_OF = """gl as (select *, lead(epoch) over (partition by subsystem order by epoch) as nt from health_samples),
    gauges as (select subsystem, unnest(range(cast(ceil(epoch / 5.0) * 5 as bigint), cast(ceil(least(coalesce(nt, 1e18), epoch + 300) / 5.0) * 5 as bigint), 5)) as evaluated, value from gl)"""


def alerts_sql() -> str:
    """The five rules: what holds at each evaluation, then runs without a gap of more than five seconds."""
    quantile = lambda name, q: f"""{name}_b as (select *, max(rate) over (partition by evaluated) as whole, coalesce(lag(le) over w, 0) as low, coalesce(lag(rate) over w, 0) as below from {name}_r window w as (partition by evaluated order by le)),
    {name}_q as (select evaluated, arg_min(case when isinf(le) then low else low + (le - low) * coalesce(({q} * whole - below) / nullif(rate - below, 0), 0.0) end, le) as value from {name}_b where rate >= {q} * whole and whole > 0 group by evaluated)"""  # noqa: E731
    share = lambda name, part: f"{name}_q as (select evaluated, sum(rate) filter (where {part}) / nullif(sum(rate), 0) as value from {name}_r group by evaluated)"
    made = [rate_sql(f"{n}_samples", label, 5) for n, label in (("latency", "le"), ("snapshot", "anomaly_detected"), ("grounding", "le"), ("request", "status_code"))]
    made += [quantile("latency_samples", "0.99"), quantile("grounding_samples", "0.50"), share("snapshot_samples", "anomaly_detected = 'true'"), share("request_samples", "status_code like '5__'"), AS_OF]
    pick = lambda alert, table, when, s, who="''": f"select '{alert}' as alert, {who} as subsystem, evaluated, {s} as hold from {table} where {when}"
    on = " union all ".join((pick("HighAnomalyDetectionLatencySLA", "latency_samples_q", "value > 0.015::double", 120), pick("ElevatedAnomalyRate", "snapshot_samples_q", "value > 0.2::double", 180), pick("DegradedSubsystemHealth", "gauges", "value = 0", 60, "subsystem"), pick("LowRAGGroundingScore", "grounding_samples_q", "value < 0.95::double", 120), pick("HighHTTP5xxErrorRate", "request_samples_q", "value > 0.01::double", 120)))
    return ", ".join(made) + f""", hit as ({on}), run as (select *, evaluated - 5 * row_number() over (partition by alert, subsystem order by evaluated) as island from hit)
    select alert, subsystem, evaluated, case when evaluated - min(evaluated) over (partition by alert, subsystem, island) >= hold then 'firing' else 'pending' end as state from run"""


ORACLES = {
    "classification_report": x(["judged"], """, c as (select unnest([0, 1]) as class), m as (select class, (select count(*) from judged where y = class and p = class) as tp, (select count(*) from judged where y = class) as support, (select count(*) from judged where p = class) as got from c), t as (select class::varchar as class, coalesce(tp / nullif(got, 0)::double, 0) as precision, coalesce(tp / nullif(support, 0)::double, 0) as recall, coalesce(2.0 * tp / nullif(got + support, 0), 0) as f1, support from m),
        u as (select * from t union all select 'macro', avg(precision), avg(recall), avg(f1), sum(support) from t union all select 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from t)
        select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from u"""),
    "recall_by_detector": x(["judged"], "select 'p' as detector, round(count(*) filter (where y = 1 and p = 1) / (count(*) filter (where y = 1))::double, 6) as recall from judged union all select 'q', round(count(*) filter (where y = 1 and q = 1) / (count(*) filter (where y = 1))::double, 6) from judged"),
    "sorted_percentiles": x(["requests"], "select kind, max(seconds) filter (where i = floor(n * 0.5)) as p50, max(seconds) filter (where i = floor(n * 0.95)) as p95, max(seconds) filter (where i = floor(n * 0.99)) as p99 from (select kind, seconds, row_number() over (partition by kind order by seconds) - 1 as i, count(*) over (partition by kind) as n from requests) group by kind"),
    "confusion_matrix": x(["judged"], "select y, count(*) filter (where p = 0) as pred_0, count(*) filter (where p = 1) as pred_1 from judged group by y"),
    "binary_rates": x(["judged"], RATES),
    "latency_percentiles": x(["requests"], "select kind, round(quantile_cont(seconds, 0.5), 6) as p50, round(quantile_cont(seconds, 0.95), 6) as p95, round(quantile_cont(seconds, 0.99), 6) as p99 from requests group by kind"),
    "quality_gate": x(["judged"], f", r as ({RATES}), c as (select 'precision' as metric, precision as value, precision >= 0.9 as passed from r union all select 'recall', recall, recall >= 0.88 from r union all select 'false_positive_rate', false_positive_rate, false_positive_rate <= 0.025 from r union all select 'p99_ms', 12.5, true) select metric, round(value, 6) as value, passed, bool_and(passed) over () as all_passed from c"),
    "champion_model": x(["incidents"], ", r as (select 'm' || (id % 50)::varchar as model, id as version, case when id % 3 = 0 then 'Staging' else 'Production' end as stage, id % 3 <> 0 and id % 5 <> 0 as live from incidents) select model, version, case when live and row_number() over (partition by model, live order by version desc) > 1 then 'Archived' else stage end as stage from r"),
    "psi": x(["series"], ", b as (select (x >= 10)::int + (x >= 25)::int + (x >= 50)::int + (x >= 100)::int as b, count(*) filter (where id % 2 = 0) as p, count(*) filter (where id % 2 = 1) as q from series group by 1), n as (select (p + 0.5) / (sum(p) over () + 2.5) as p, (q + 0.5) / (sum(q) over () + 2.5) as q from b) select round(sum((p - q) * ln(p / q)), 6) as psi, sum((p - q) * ln(p / q)) >= 0.2 as drifted from n"),
    "ks_two_sample": x(["series"], """, v as (select x, count(*) filter (where id % 2 = 0) as a, count(*) filter (where id % 2 = 1) as b from series group by x), g as (select max(abs(u / n - w / m)) as d, max(n) * max(m) / (max(n) + max(m)) as nm from (select sum(a) over (order by x) as u, sum(b) over (order by x) as w, (sum(a) over ())::double as n, (sum(b) over ())::double as m from v))
        select round(any_value(d), 6) as d, round(least(1.0, greatest(0.0, sum(2 * power(-1, k - 1) * exp(-2.0 * k * k * nm * d * d)))), 6) as p_value from g, range(1, 6) t(k)"""),
    "rolling_fpr": x(["incidents"], ", dd as (select date_diff('day', date '1970-01-01', detected_at::date) as day, count(*) filter (where is_false_positive) as fp, count(*) as n from incidents group by 1), r as (select day, sum(fp) over w / (sum(n) over w)::double as rate from dd window w as (order by day range between 6 preceding and current row)) select day::int as day, round(rate, 6) as rate, rate > 0.05 as breach from r"),
    "incident_financials": f("select id, severity, archetype, actual_mttr_minutes, hourly_downtime_rate, baseline_downtime_cost, engineering_hours_saved, engineering_cost_saved, mttr_reduction_minutes, downtime_savings_gross, total_gross_value_delivered, realized_net_savings from fin"),
    "executive_kpis": f(""", k as (select count(*) as total_incidents, count(*) filter (where status = 'RESOLVED' and not is_false_positive) as resolved_incidents, count(*) filter (where is_false_positive) as false_positives, avg(case when not is_false_positive then actual_mttr_minutes end) as took, sum(engineering_hours_saved) as hours, sum(engineering_cost_saved) as labour,
        sum(downtime_savings_gross) as downtime, sum(total_gross_value_delivered) as gross, sum(round(total * 0.25::double, 2)) as net from (select fin.*, fin_raw.total from fin join (select id, greatest(0.0, bc - ac) + r / 60 * 3 * 95 as total from f1) fin_raw using (id)))
        select total_incidents, resolved_incidents, false_positives, round(false_positives * 100.0 / total_incidents, 2) as false_positive_pct, 90.0 as baseline_mttr, round(took, 2) as actual_mttr, round(90.0 - took, 2) as mttr_reduction, round((90.0 - took) * 100 / 90.0, 2) as mttr_reduction_pct, round(hours, 2) as hours_saved, round(labour, 2) as labour_saved,
        round(downtime, 2) as downtime_savings, round(gross, 2) as gross_value, round(net, 2) as net_savings, 15000.0 as platform_cost, round((net - 15000) * 100 / 15000, 2) as roi_pct, round(15000.0 * 365 / net, 1) as payback_days from k"""),
    "service_impact": f(f"select service_id, count(*) as incidents, count(*) filter (where severity = 'CRITICAL') as critical, round(coalesce(sum(case when not is_false_positive then actual_mttr_minutes end), 0.0), 2) as downtime_minutes, {AV} as availability_pct, round(sum(downtime_savings_gross), 2) as savings from fin group by 1"),
    "monthly_trend": f("select strftime(detected_at, '%Y-%m') as month, count(*) as incidents, count(*) filter (where severity = 'CRITICAL') as critical, count(*) filter (where severity = 'HIGH') as high, count(*) filter (where severity = 'MEDIUM') as medium, count(*) filter (where severity = 'LOW') as low, round(sum(engineering_hours_saved), 2) as hours_saved, round(sum(total_gross_value_delivered), 2) as gross_value from fin group by 1"),
    "archetype_pareto": f("select archetype, count(*) as incidents, round(count(*) * 100.0 / sum(count(*)) over (), 2) as pct, round(avg(mttr_reduction_minutes), 2) as mean_reduction, round(sum(downtime_savings_gross), 2) as savings, round(sum(baseline_downtime_cost), 2) as cost from fin group by 1"),
    "pareto_cumulative": f(", p as (select archetype, sum(downtime_savings_gross) as savings from fin group by 1) select archetype, round(sum(savings) over (order by savings desc, archetype rows unbounded preceding) * 100 / sum(savings) over (), 1) as cumulative_pct from p"),
    "dim_date": x(["incidents"], "select distinct strftime(d, '%Y%m%d')::int as date_key, year(d)::int as year, quarter(d)::int as quarter, month(d)::int as month, day(d)::int as day, week(d)::int as week, dayofweek(d) in (0, 6) as is_weekend from (select detected_at::date as d from incidents) where d between date '1995-01-01' and date '1998-12-31'"),
    "view_executive_summary": f("select count(*) as total, count(*) filter (where status = 'RESOLVED') as resolved, round(count(*) filter (where is_false_positive) * 100.0 / count(*), 2) as fp_pct, round(avg(case when not is_false_positive then actual_mttr_minutes end), 2) as mttr, round(sum(downtime_savings_gross), 2) as savings, round(sum(realized_net_savings), 2) as net from fin"),
    "view_service_exposure": f("select 'svc-' || r::varchar as service_id, count(f.id) as incidents, round(avg(f.actual_mttr_minutes), 2) as mttr, round(sum(f.downtime_savings_gross), 2) as savings, greatest(99.0, round(100 - sum(case when f.is_false_positive then 0 else f.actual_mttr_minutes end) / 525600 * 100, 4)) as availability from range(30) t(r) left join fin f on f.service_id = 'svc-' || r::varchar group by 1"),
    "view_monthly_roi": f("select year(detected_at)::int as year, month(detected_at)::int as month, count(*) as incidents, round(sum(total_gross_value_delivered), 2) as gross, round(sum(realized_net_savings), 2) as net from fin where year(detected_at) between 1992 and 2000 group by 1, 2"),
    "view_archetype_pareto": f("select archetype, count(*) as incidents, round(count(*) * 100.0 / (select count(*) from fin), 2) as pct, round(sum(downtime_savings_gross), 2) as savings from fin group by 1"),
    "bi_measures": f("select count(*) as incidents, count(*) filter (where is_false_positive) as false_positives, count(*) filter (where status = 'RESOLVED') as resolved, count(*) filter (where severity = 'CRITICAL') as critical_incidents, round(count(*) filter (where is_false_positive) * 100.0 / count(*), 2) as fp_rate, round(count(*) filter (where status = 'RESOLVED') * 100.0 / count(*), 2) as resolution_rate, round(sum(engineering_hours_saved), 2) as total_hours, count(*) filter (where severity = 'HIGH') as high_incidents, count(*) filter (where severity = 'MEDIUM') as medium_incidents, count(*) filter (where severity = 'LOW') as low_incidents, round(sum(total_gross_value_delivered), 2) as total_gross, round(sum(realized_net_savings), 2) as total_net, round(sum(downtime_savings_gross), 2) as total_downtime_savings, round(sum(engineering_cost_saved), 2) as total_labour, round(sum(baseline_downtime_cost), 2) as baseline_cost, round(sum(actual_downtime_cost), 2) as actual_cost, round(sum(total_gross_value_delivered) / count(*), 2) as value_per_incident from fin"),
    "denormalised_fact": x(["incidents"], "select *, case severity when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 end as severity_rank from incidents"),
    "tableau_fields": f("select count(distinct service_id) as services, count(distinct case when severity = 'CRITICAL' then id end) as critical_ids, round(avg(case when not is_false_positive then mttr_reduction_minutes end), 4) as mean_reduction, round(sum(total_gross_value_delivered) * 0.25::double, 2) as net_at_aggregate from fin"),
    "filter_incidents": x(["incidents"], "select id, severity, service_id from incidents where severity = 'HIGH' and service_id = 'svc-3'"),
    "financial_impact": f("select round(sum(downtime_savings_gross), 2) as downtime_savings, round(sum(total_gross_value_delivered), 2) as gross_value, round(sum(realized_net_savings), 2) as net_savings, round((sum(realized_net_savings) - 15000) * 100 / 15000, 2) as roi_pct, round(15000 * 365 / sum(realized_net_savings), 1) as payback_days, 180000.0::double as rate_critical, 120000.0::double as rate_high, 25000.0::double as rate_medium, 5000.0::double as rate_low from fin"),
    "realisation_what_if": f(", w as (select r / 10.0::double as rate, sum(total_gross_value_delivered) * (r / 10.0::double) as n from fin, range(1, 11) t(r) group by r) select rate, round(n, 2) as net, round((n - 15000) * 100 / 15000, 2) as roi_pct, round(15000 * 365 / n, 4) as payback_days from w"),
    "period_filter": x(["incidents"], "select id, severity from incidents where detected_at::date >= (select max(detected_at)::date from incidents) - 90"),
    "stage_waterfall": "select event_type, count(*) as n, round(avg(m), 4) as mean_minutes from (select event_type, epoch(lead(ts) over (partition by user_id order by ts, event_type) - ts) / 60 as m from events) where m is not null group by 1",
    "upsert_incidents": x(["incidents"], ", a as (select * from incidents), b as (select id + 3000 as id, id as src, severity from incidents where id % 3 = 0) select coalesce(a.id, b.id) as incident_id, coalesce('t' || a.id::varchar, 'n' || b.src::varchar) as title, coalesce(a.severity, b.severity) as severity, coalesce(a.id * 10, b.src * 10) as detected_at, case when b.id is not null then 'RESOLVED' else a.status end as status, case when b.id is not null then 0.9 else 0.5 end as confidence, case when b.id is not null then 'pm' end as postmortem, b.src as resolved_at from a full join b on a.id = b.id"),
    "replace_children": x(["signals"], "select incident_id, signal_id, metric from signals where not (incident_id >= 4000 and incident_id % 2 = 0) union all select incident_id, signal_id, 'new' from signals where incident_id >= 4000 and incident_id % 2 = 0"),
    "incident_detail": x(["incidents", "signals"], "select i.id as incident_id, i.status, nullif(count(s.signal_id), 0)::int as n, string_agg(s.metric, ',' order by s.signal_id, s.metric) as metrics from incidents i left join signals s on s.incident_id = i.id group by 1, 2"),
    "similar_incidents": x(["incidents"], f"{SIM} select probe_id, incident_id, rank, action from s"),
    "recent_incidents": x(["incidents"], "select id as incident_id, status from incidents order by detected_at desc, id desc limit 50"),
    "active_investigations": x(["incidents"], "select incident_id, epoch, status from (select id % 2000 as incident_id, id as epoch, status, row_number() over (partition by id % 2000 order by id desc, status) as i from incidents) where i = 1 and epoch > 12000 and status <> 'RESOLVED'"),
    "patch_state": x(["incidents"], "select id as incident_id, case when id % 4 = 0 then 'PATCHED' else status end as status, service_id from incidents"),
    "count_by_labels": x(["requests"], "select kind, status, count(*) as n from requests group by 1, 2"),
    "histogram_buckets": x(["requests"], f"{BUCKETS} select kind, le::double as le, cum, count, round(sum, 4) as sum from b"),
    "range_rate": x(["request_samples"], ", " + rate_sql("request_samples", "status_code", 60) + " select status_code, evaluated, round(rate, 9) as rate from request_samples_r"),
    "alert_rules": x([f"{n}_samples" for n in ("latency", "snapshot", "health", "grounding", "request")], ", " + alerts_sql()),
    "as_of": x(["health_samples"], f", {AS_OF} select subsystem, evaluated, value from gauges"),
    "rate_over_window": x(["requests"], "select kind, epoch // 300 * 300 as window_start, round(count(*) / 300.0::double, 8) as rate from requests group by 1, 2"),
    "histogram_quantile": x(["requests"], f"{BUCKETS}, q as (select *, coalesce(lag(le) over (partition by kind order by le), 0) as low, coalesce(lag(cum) over (partition by kind order by le), 0) as below from b), h as (select *, row_number() over (partition by kind order by le) as i from q where cum >= 0.95 * count) select kind, round(case when isinf(le) then low else low + (le - low) * (0.95 * count - below) / (cum - below) end, 6) as quantile from h where i = 1"),
    "ratio_alert": x(["requests"], f"{RATIO} select window_start, round(ratio, 6) as ratio, ratio > 0.2 as firing from ra"),
    "alert_state": x(["requests"], f"{RATIO}, o as (select window_start, ratio > 0.2 as fires, sum((ratio <= 0.2)::int) over (order by window_start) as run from ra), h as (select *, window_start - min(case when fires then window_start end) over (partition by run) as held from o) select window_start, case when not fires then 'inactive' when held >= 7200 then 'firing' else 'pending' end as state from h"),
    "normalise_endpoint": x(["requests"], "select '/v1/' || kind || '/{id}' as endpoint, count(*) as n from requests group by 1"),
    "remediation_pipeline": x(["incidents"], "select archetype as action_type, status, count(*) as n from incidents group by 1, 2"),
    "latest_health": x(["requests"], "select kind, arg_max(case when status = 500 then 0 else 1 end, id) as value, arg_max(status = 500, id) as degraded from requests group by 1"),
    "threshold_alarm": x(["requests"], f"{RATIO} select window_start, count(*) over w = 3 and sum((ratio > 0.2)::int) over w = 3 as alarm from ra window w as (order by window_start rows between 2 preceding and current row)"),
}
ORACLES |= {f"{name}_bucketed": ORACLES[name] for name in ("upsert_incidents", "replace_children")}
