"""Rule-driven triage of incidents as column logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered_rules
from ..sources import scratch, settled
from .retrieve import diagnostic_query, retrieve

#: Action, risk and whether it always needs approval, by what the primary metric or archetype names.
ACTIONS = [
    (("pool",), "DB_CONNECTION_POOL", "EXPAND_DB_CONNECTION_POOL", "HIGH", True),
    (("memory",), "MEMORY_LEAK", "ROLLING_CONTAINER_RESTART", "HIGH", True),
    (("latency", "error_rate"), "THIRD_PARTY", "ENGAGE_CIRCUIT_BREAKER", "MEDIUM", None),
    (("checkout", "order"), "PAYMENT_GATEWAY", "FAILOVER_PAYMENT_GATEWAY", "HIGH", True),
    (("traffic", "request"), "TRAFFIC_BURST", "SCALE_HORIZONTAL_POD_AUTOSCALER", "LOW", False),
]
DEFAULT_ACTION = ("CONTINUOUS_OBSERVABILITY_MONITORING", "LOW", False)
#: Confidence of a hypothesis, by the same rules in the order that hypotheses are tried.
CAUSES = [
    (("pool",), "DB_CONNECTION_POOL", "connection pool saturated, clients starve for a connection", 0.96),
    (("memory",), "MEMORY_LEAK", "heap memory leak with stop-the-world pauses", 0.94),
    (("latency",), "THIRD_PARTY", "third party times out and starves the worker threads", 0.93),
    (("checkout", "order"), "PAYMENT_GATEWAY", "payment gateway outage declines transactions", 0.97),
]


def _says(words, archetype_part) -> Column:
    metric, archetype = F.coalesce("metric", F.lit("")), F.coalesce("archetype", F.lit(""))
    out = archetype.contains(archetype_part)
    for w in words:
        out = out | metric.contains(w)
    return out


def triage_driver(incidents: DataFrame, signals: DataFrame, key="incident_id") -> DataFrame:
    """G1: incidents with their driver: an explicit primary signal, else the largest deviation; without one, RESOLVED."""
    w = Window.partitionBy(key).orderBy(F.col("is_primary").desc(), F.abs("sigma").desc(), "signal_id", "sigma")
    top = signals.withColumn("i", F.row_number().over(w)).where("i = 1").select(key, "metric", "observed", "baseline", "sigma")
    return incidents.join(top, key, "left").withColumn("triage_status", F.when(F.col("metric").isNull(), "RESOLVED").otherwise("INVESTIGATING"))


def tier_breakdown(signals: DataFrame, key="incident_id") -> DataFrame:
    """Signals of each tier as text, by the prefix of the metric; a tier without signals is empty."""
    tier = F.split_part("metric", F.lit("_"), F.lit(1))
    named = signals.withColumn("tier", tier).withColumn("text", F.format_string("%s (%+.1fσ)", F.col("metric"), F.col("sigma")))
    each = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.col("text")))), "; ").alias(t) for t in ("infra", "app", "db", "biz")]
    return named.groupBy(key).agg(*each, F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics"))


def hypothesis(df: DataFrame) -> DataFrame:
    """Cause, confidence and trace; feedback, where there is some, is appended to both."""
    cite = F.coalesce("citation", F.lit("[No Citation Available]"))
    text = lambda what: F.concat(F.col("service_id"), F.lit(f": {what}, as in "), cite)
    default = F.concat(F.lit("anomaly in "), "service_id", F.lit(" driven by "), F.coalesce("metric", F.lit("unknown_metric")), F.lit(", evidence "), cite)
    cause = ordered_rules([(_says(w, a), text(c)) for w, a, c, _ in CAUSES], default)
    sure = ordered_rules([(_says(w, a), p) for w, a, _, p in CAUSES], 0.85)
    note = F.when(F.col("feedback").isNotNull(), F.concat(F.lit(" (revised: "), "feedback", F.lit(")"))) if "feedback" in df.columns else F.lit(None).cast("string")
    trace = F.array_compact(F.array(F.when(F.col("metric").isNotNull(), F.concat(F.lit("driver "), "metric")), F.when(F.col("archetype").isNotNull(), F.concat(F.lit("archetype "), "archetype")), F.when(F.col("citation").isNotNull(), F.concat(F.lit("evidence "), "citation")), note))
    return df.withColumns({"hypothesis": F.concat(cause, F.coalesce(note, F.lit(""))), "confidence": sure, "trace": trace})


def grounding_score(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The share of checks that the text passes: service, metric or a token of it, citation, archetype token."""
    text = F.concat_ws(" ", "hypothesis", F.array_join("trace", " "))
    low = F.lower(text)
    token = lambda c: F.exists(F.filter(F.split(F.lower(F.col(c)), "_"), lambda t: F.length(t) > 3), lambda t: low.contains(t))
    metric = F.when(F.col("metric").isNull(), low.contains("nominal") | low.contains("no active")).otherwise(text.contains(F.col("metric")) | token("metric"))
    cited = F.when(F.col("citation").isNull(), F.col("metric").isNull()).otherwise(text.contains(F.col("citation")))
    checks = F.array_compact(F.array(text.contains(F.col("service_id")), metric, cited, F.when(F.col("archetype").isNotNull(), token("archetype"))))
    out = df.withColumn("grounding", F.size(F.filter(checks, lambda c: c)) / F.size(checks))
    return out.withColumn("is_grounded", F.col("grounding") >= threshold)


def revise_until_grounded(df: DataFrame, max_revisions: int = 2) -> DataFrame:
    """Up to max_revisions rounds of feedback and a new hypothesis; whoever is still ungrounded goes on."""
    out = grounding_score(hypothesis(df.withColumn("feedback", F.lit(None).cast("string")))).withColumn("revisions", F.lit(0))
    for _ in range(max_revisions):
        missing = F.concat_ws(" ", F.lit("anchor to"), "service_id", "metric", F.coalesce("citation", F.lit("")))
        again = out.withColumn("revisions", F.col("revisions") + (~F.col("is_grounded")).cast("int")).withColumn("feedback", F.when(F.col("is_grounded"), F.col("feedback")).otherwise(missing))
        out = grounding_score(hypothesis(again))
    return out


#: Target, parameters and justification of each action; {s} stands for the service.
PLANS = {
    "EXPAND_DB_CONNECTION_POOL": ("{s}/aurora-postgres-pool", {"current_max_connections": "100", "proposed_max_connections": "250", "idle_timeout_seconds": "30", "rollback_command": "aws rds modify-db-parameter-group --parameter 'name=max_connections,value=100'"}, "Connection pool of {s} is saturated: a higher ceiling and a strict idle limit end the starvation of its clients."),
    "ROLLING_CONTAINER_RESTART": ("k8s-deployment/{s}", {"max_unavailable": "20%", "capture_heap_dump": "true", "rollback_command": "kubectl rollout undo deployment/{s}"}, "Memory of {s} is above 85% with growing collection pauses: restart it in turns and keep a heap dump."),
    "ENGAGE_CIRCUIT_BREAKER": ("envoy-cluster/{s}/downstream-partner", {"consecutive_5xx": "5", "base_ejection_time_seconds": "60", "max_ejection_percent": "100", "rollback_command": "envoy admin /reset-outlier-detection"}, "Timeouts upstream of {s} cascade: shed the failing calls and answer from the cache."),
    "FAILOVER_PAYMENT_GATEWAY": ("payment-routing-mesh/gateway-router", {"primary_provider": "stripe", "failover_target": "adyen", "traffic_shift_percent": "100", "rollback_command": "restore the primary payment route"}, "The payment provider is out: route checkouts to the second provider."),
    "SCALE_HORIZONTAL_POD_AUTOSCALER": ("k8s-hpa/{s}", {"min_replicas": "10", "max_replicas": "50", "target_cpu_percent": "60", "rollback_command": "kubectl scale deployment {s} --replicas=3"}, "{s} meets a legitimate burst of traffic: add replicas ahead of it."),
    "CONTINUOUS_OBSERVABILITY_MONITORING": ("telemetry-agent/{s}", {"polling_interval_seconds": "5"}, "Signals are within their baselines: keep watching."),
}


def _filled(text: str) -> Column:
    """A text with the service in the place of {s}."""
    parts = text.split("{s}")
    pieces = [x for i, part in enumerate(parts) for x in ([F.col("service_id")] if i else []) + [F.lit(part)]]
    return F.concat(*pieces) if len(parts) > 1 else F.lit(text)


def remediation_proposal(df: DataFrame) -> DataFrame:
    """Action, target, parameters, risk, justification and whether a human must approve."""
    rules = [(_says(w, a), x) for w, a, *x in ACTIONS]
    pick = lambda i: ordered_rules([(p, F.lit(x[i])) for p, x in rules], DEFAULT_ACTION[i])
    grave = F.col("severity").isin("CRITICAL", "HIGH")
    approval = ordered_rules([(p, grave if x[2] is None else F.lit(x[2])) for p, x in rules], DEFAULT_ACTION[2])
    out = df.withColumns({"action": pick(0), "risk": pick(1), "needs_approval": approval})
    chosen = lambda value: ordered_rules([(F.col("action") == a, value(p)) for a, p in PLANS.items()])
    mapped = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), _filled(v))])
    return out.withColumns({"target": chosen(lambda p: _filled(p[0])), "parameters": chosen(lambda p: mapped(p[1])), "justification": chosen(lambda p: _filled(p[2]))})


def approval_routing(df: DataFrame) -> DataFrame:
    """What needs approval and has none waits, the rest is executed; with the text of the result."""
    approved = F.coalesce("approved", F.lit(False)) if "approved" in df.columns else F.lit(False)
    token = F.col("token") if "token" in df.columns else F.lit(None).cast("string")
    waits = F.col("needs_approval") & ~approved
    waiting = F.concat(F.lit("DRY_RUN_PASSED: "), "action", F.lit(" on "), "target", F.lit(" awaits approval"), F.coalesce(F.concat(F.lit(" by token "), token), F.lit("")))
    done = F.concat(F.lit("SIMULATION_SUCCESS: "), "action", F.lit(" on "), "target", F.coalesce(F.concat(F.lit(" (token "), token, F.lit(")")), F.lit("")), F.lit(", parameters "), F.to_json("parameters"))
    return df.withColumn("status", F.when(waits, "HUMAN_APPROVAL_PENDING").otherwise("REMEDIATION_EXECUTED")).withColumn("result", F.when(waits, waiting).otherwise(done))


def cite_queries(asked: DataFrame, chunks: DataFrame, top_k: int = 4, min_relevance: float = 0.35, doc_type: str | None = None) -> DataFrame:
    """F10 and F9 for rows with a query: citation, the best one, and evidence, how many there are; equal queries are asked once."""
    queries = settled(asked.select(F.col("query").alias("query_id"), F.col("query").alias("text")).distinct())  # read by each search
    found = retrieve(chunks, queries, top_k, min_relevance, doc_type)
    best = found.groupBy("query_id").agg(F.min_by("citation", "rank").alias("citation"), F.count("*").alias("evidence"))
    return asked.join(best.withColumnRenamed("query_id", "query"), "query", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))


#: What all steps between driver and route depend on; up to so many cases are sent to all tasks.
FEW_CASES = 10_000
CASE = ["service_id", "metric", "archetype", "severity"]


def same_case(left: DataFrame, right: DataFrame, names) -> DataFrame:
    """left with the columns of right, which has one row for each case; a null equals a null."""
    named = right.withColumnsRenamed({c: f"{c}_" for c in names})
    named = F.broadcast(named) if right.count() <= FEW_CASES else named
    alike = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names]
    return left.join(named, alike, "left").drop(*[f"{c}_" for c in names])


def _stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept by columns in the shared folder."""
    path = scratch(df.sparkSession, "driven")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def triage_incidents(incidents: DataFrame, signals: DataFrame, citations: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Driver, evidence, hypothesis, grounding, action and route of each incident.

    Evidence is retrieved from chunks (id, text, uri, section, doc_type), or given as citations (incident_id, citation).
    Incidents of one service, metric, archetype, severity and citation are one case: its texts are made and judged once.
    """
    driven = triage_driver(incidents, signals)
    if chunks is not None:
        driven = _stored(driven)  # read for the cases and for their incidents
        cited, names = cite_queries(diagnostic_query(driven.select(*CASE).distinct()), chunks), CASE
    else:
        given = (driven.withColumn("citation", F.lit(None).cast("string")) if citations is None else driven.join(citations, "incident_id", "left")).withColumn("evidence", F.col("citation").isNotNull().cast("long"))
        driven = _stored(given)
        cited, names = driven.select(*CASE, "citation", "evidence").distinct(), [*CASE, "citation", "evidence"]
    cases = settled(remediation_proposal(revise_until_grounded(cited)))
    return approval_routing(same_case(driven, cases, names))


def audit_rows(triaged: DataFrame) -> DataFrame:
    """(incident_id, step, agent, action, detail): what each agent did to an incident, in order.

    An incident without a signal ends at its triage.
    """
    c, text = F.col, lambda *xs: F.to_json(F.struct(*xs))
    quiet = F.col("triage_status") == "RESOLVED"
    entry = lambda agent, action, *xs: F.struct(F.lit(agent).alias("agent"), F.lit(action).alias("action"), text(*xs).alias("detail"))
    steps = [
        entry("statistician", "QUANTITATIVE_TRIAGE", c("metric").alias("primary_driver"), c("sigma").alias("max_sigma")),
        entry("retriever", "RETRIEVE_EVIDENCE", c("evidence").alias("retrieved_count"), F.coalesce("citation", F.lit("none")).alias("top_citation")),
        entry("investigator", "DIAGNOSE_ROOT_CAUSE", c("confidence"), F.size("trace").alias("reasoning_steps_count")),
        entry("validator", "EVALUATE_GROUNDING", F.round("grounding", 4).alias("grounding_score"), c("is_grounded"), c("revisions").alias("revision_count")),
        entry("action_agent", "FORMULATE_REMEDIATION", c("action").alias("action_type"), c("risk").alias("risk_level"), c("status")),
    ]
    gate = F.when(c("status") == "HUMAN_APPROVAL_PENDING", entry("approval_gate", "AWAIT_OPERATOR_SIGN_OFF", c("target"), c("status")))
    all_ = F.when(quiet, F.array(entry("statistician", "TRIAGE", F.lit("no anomaly signals").alias("result")))).otherwise(F.array_compact(F.array(*steps, gate)))
    return triaged.select("incident_id", F.posexplode(all_).alias("step", "x")).select("incident_id", "step", "x.*")


def apply_approvals(pending: DataFrame, approvals: DataFrame) -> DataFrame:
    """The outcome of each approval: unknown incident, wrong status, wrong token, or executed."""
    j = approvals.join(pending.select("incident_id", "status", F.col("token").alias("want")), "incident_id", "left")
    return j.withColumn("outcome", F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status") != "HUMAN_APPROVAL_PENDING", "BAD_STATUS").when(~F.col("token").eqNullSafe(F.col("want")), "FORBIDDEN").otherwise("EXECUTED")).drop("want")
