"""Queries of groups A (round trips), F, G (triage) and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources, streaming
from ..functions import encode_archetype, parse_ts, slug, tokenise_technical
from ..operators import contract, detect, features, finance, history, retrieve, shape, triage
from ..operators.textindex import LEXICAL, SEMANTIC, TextIndex
from . import business, detection
from .testbed import duck, load, scratch


def corpus(s, d):
    return load(s, d, "corpus")


def probes(s, d):
    return load(s, d, "probes")


def lexical(s, d, k=15):
    index = TextIndex.build(corpus(s, d), scratch(s, "index"), kinds=(LEXICAL,))
    return retrieve.search_lexical(index, probes(s, d), k)


def semantic(s, d, k=15):
    index = TextIndex.build(corpus(s, d), scratch(s, "index"), kinds=(SEMANTIC,))
    return retrieve.search_semantic(index, probes(s, d), k)


def fused(s, d):
    index = TextIndex.build(corpus(s, d), scratch(s, "index"))
    return retrieve.rrf_fuse(retrieve.search_lexical(index, probes(s, d), 15), retrieve.search_semantic(index, probes(s, d), 15))


def markdown(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet")
    part = F.concat(F.lit("## "), "role", F.lit(" turn "), F.col("turn").cast("string"), F.lit("\n"), "text")
    body = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("ps"))
    return body.select(F.concat(F.lit("kb/runbooks/conv_"), F.col("conv_id").cast("string"), F.lit(".md")).alias("uri"), F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n")).alias("text"))


def chunks(s, d):
    return retrieve.chunk_markdown(markdown(s, d))


def incidents(s, d):
    return load(s, d, "incidents").withColumnRenamed("id", "incident_id").select("incident_id", "severity", "service_id", "archetype")


def signals(s, d):
    return load(s, d, "signals")


def cited(s, d):
    return incidents(s, d).select("incident_id", F.when(F.col("incident_id") % 3 != 0, F.concat(F.lit("[runbook-"), (F.col("incident_id") % 5).cast("string"), F.lit("]"))).alias("citation"))


def runbooks(s, d):
    return load(s, d, "runbooks")


def triaged(s, d):
    return triage.triage_incidents(incidents(s, d), signals(s, d), chunks=runbooks(s, d))


def with_citation(s, d):
    return driven(s, d).join(cited(s, d), "incident_id", "left")


def driven(s, d):
    return triage.triage_driver(incidents(s, d), signals(s, d))


def approvals(s, d):
    t = triaged(s, d).select("incident_id", "status", F.concat(F.lit("T"), F.col("incident_id").cast("string")).alias("token"))
    asked = t.select((F.col("incident_id") + F.when(F.col("incident_id") % 50 == 0, 10**9).otherwise(0)).alias("incident_id"), F.when(F.col("incident_id") % 7 == 0, "bad").otherwise(F.col("token")).alias("token"))
    return triage.apply_approvals(t, asked)


def scenarios(s, d):
    t = triaged(s, d)
    wanted = F.array(F.when(F.col("incident_id") % 2 == 0, F.col("action")).otherwise("OTHER"))
    return history.rag_scenario_eval(t.select("incident_id", "action", "grounding", F.array_compact(F.array("citation")).alias("citations"), F.array(F.lit("item_1"), F.lit("item_2")).alias("expected_terms"), wanted.alias("expected_actions")))


def snapshots(s, d):
    t = load(s, d, "ticks")
    f = lambda e, n: e.cast("double").alias(n)
    zero = F.lit(0.0)
    return t.select(
        F.timestamp_seconds(F.col("tick") * 21600).alias("timestamp"), F.concat_ws("-", F.lit("tr"), "service_id", F.col("tick").cast("string")).alias("trace_id"), "service_id",
        F.struct(f(F.col("cpu"), "cpu_percent"), f(zero, "memory_percent"), f(zero, "disk_io_mbps"), f(zero, "network_egress_mbps"), f(zero, "network_ingress_mbps")).alias("infrastructure"),
        F.struct(F.col("service_id").alias("service_id"), F.lit("/v1").alias("endpoint"), f(F.col("rps"), "requests_per_sec"), f(F.col("p50"), "latency_p50_ms"), f(F.col("p95"), "latency_p95_ms"), f(F.col("p99"), "latency_p99_ms"), F.col("c2xx").cast("int").alias("http_2xx_count"), F.col("c4xx").cast("int").alias("http_4xx_count"), F.col("c5xx").cast("int").alias("http_5xx_count")).alias("application"),
        F.struct(F.lit("db").alias("db_instance_id"), F.lit(1).alias("active_connections"), f(zero, "connection_pool_utilization"), f(zero, "query_latency_mean_ms"), f(zero, "slow_queries_per_sec"), F.lit(0).alias("row_lock_waits")).alias("database"),
        F.struct(F.col("orders").cast("int").alias("order_volume"), f(F.col("revenue"), "revenue_usd"), f(F.col("checkout"), "checkout_success_rate"), f(zero, "cart_abandonment_rate")).alias("business"),
        F.lit("NOMINAL").alias("ground_truth_label"), F.lit(False).alias("ground_truth_anomalous"), F.lit(None).cast("string").alias("simulated_root_cause"),
    )


def read_snapshots(s, d):
    path = scratch(s, "snapshots")
    snapshots(s, d).write.json(path)
    return shape.flatten_snapshots(sources.read_snapshots(s, path)).select("service_id", "infra_cpu_percent", "app_http_5xx_count", F.round("app_error_rate", 6).alias("app_error_rate"), "biz_revenue_usd", "simulated_root_cause")


def read_series(s, d):
    path = scratch(s, "series")
    s.read.parquet(f"{d}/events.parquet").select(F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("a"), F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("value").cast("string")).alias("b")).write.csv(path)
    return sources.read_series(s, path).select(F.unix_timestamp("ts").alias("epoch"), "value")


def read_matrix(s, d):
    path = scratch(s, "matrix")
    e = s.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id")
    e.select(F.when(F.col("vec_id") % 9 == 0, "1, x, 2").otherwise(F.array_join(F.transform("embedding", lambda v: F.round(v.cast("double") * 100, 4).cast("string")), ","))).write.text(path)
    return sources.read_channel_matrix(s, path).select("pos", F.posexplode("values").alias("channel", "value"))


def read_labels(s, d):
    path = scratch(s, "labels")
    s.read.parquet(f"{d}/labels.parquet").orderBy("doc_id").select(F.col("toxic").cast("string")).write.text(path)
    return sources.read_labels(s, path)


def read_corpus(s, d):
    """One *.md file a conversation, read back."""
    path = scratch(s, "corpus")
    plain = dict(extension="md", sep="\x01", quote="\x00", escape="\x00", comment="\x02", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    lines = markdown(s, d).select(F.regexp_extract("uri", "conv_(.*)\\.md", 1).alias("conv"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines.repartition("conv").sortWithinPartitions("conv", "i").select("conv", F.col("line")).write.partitionBy("conv").options(**plain).csv(path)
    return sources.read_markdown_corpus(s, path).select(F.regexp_extract("uri", "conv=([^/]*)/", 1).cast("long").alias("conv_id"), F.regexp_replace("text", "\n$", "").alias("text"))


def reports(s, d):
    """Conversations as reports; some name an incident, a service and what went wrong."""
    n = F.regexp_extract("uri", "conv_(.*)\\.md", 1).cast("long")
    more = F.when(n % 3 == 0, F.concat(F.lit("\nINC-2024-"), n.cast("string"), F.lit(" hit the payment-service and its Database")))
    return markdown(s, d).select("uri", F.concat("text", F.coalesce(more, F.lit("\nno incident"))).alias("text"))


def payloads(s, d):
    """Snapshots as JSON text, some of them broken: no JSON, a measure that is no number, a service name that is too short."""
    t = snapshots(s, d).select((F.unix_timestamp("timestamp") / 21600).cast("long").alias("tick"), "service_id", F.to_json(F.struct(*snapshots(s, d).columns)).alias("payload"))
    text = F.when(F.col("tick") % 7 == 0, F.regexp_replace("payload", '"cpu_percent":[0-9.E-]+', '"cpu_percent":"high"')).otherwise(F.col("payload"))
    text = F.when(F.col("tick") % 5 == 0, F.regexp_replace(text, '"service_id":"[^"]*","endpoint"', '"service_id":"x","endpoint"')).otherwise(text)
    text = F.when(F.col("tick") % 3 == 0, F.regexp_replace(text, '"order_volume":[0-9]+,', "")).otherwise(text)
    return t.select("service_id", "tick", F.when(F.col("tick") % 11 == 0, F.concat(F.lit("not "), text)).otherwise(text).alias("payload"))


def quarantined_stream(s, d):
    stateful(s)
    dirty = load(s, d, "dirty")
    valid, rejected = scratch(s, "valid"), scratch(s, "rejected")
    judge = lambda batch: contract.judged_rows(batch, **detection.CHECKS)
    streaming.quarantine_stream(sliced(s, dirty, "dirty"), judge, ["id"], valid, rejected, scratch(s, "state")).awaitTermination()
    good = s.read.parquet(valid).select("id", F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"))
    return good.unionByName(s.read.parquet(rejected).select("id", "error_code", "error_message"))


def ordered_quarantine(s, d):
    """As quarantined_stream, with the order of time as fourth check in the same pass."""
    stateful(s)
    valid, rejected = scratch(s, "valid"), scratch(s, "rejected")
    judge = lambda rows: contract.judged_rows(rows, **detection.CHECKS)
    streaming.quarantine_stream(sliced(s, load(s, d, "dirty"), "dirty"), judge, ["id"], valid, rejected, scratch(s, "state"), "service_id", "stamp", "id").awaitTermination()
    good = s.read.parquet(valid).select("id", F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"))
    return good.unionByName(s.read.parquet(rejected).select("id", "error_code", "error_message"))


def active_stream(s, d):
    """The states that are active when the whole stream has been read, as the stream's own state holds them."""
    stateful(s)
    states = sliced(s, business.states(s, d).withColumn("id", F.col("epoch")), "states").select("incident_id", "epoch", "status")
    checkpoint = scratch(s, "state")
    streaming.run_until_idle(streaming.active_stream(states, "incident_id"), scratch(s, "out"), checkpoint)
    return streaming.live_investigations(s, checkpoint, "incident_id")


def flat_csv(s, d):
    path = scratch(s, "flat")
    t = load(s, d, "ticks")
    t.write.csv(path, header=True)
    return sources.read_flat_telemetry(s, path, ", ".join(f"{n} {k}" for n, k in t.dtypes))


def dimensions(s, d):
    """Incidents with what the written dimension tables say of their severity and archetype."""
    path = scratch(s, "dims")
    sources.write_dimensions(s, path)
    read = lambda name: s.read.csv(f"{path}/dim_{name}", header=True, schema=sources.DIMENSIONS[name][0])
    return incidents(s, d).join(read("severity"), "severity", "left").join(read("archetype"), "archetype", "left").select("incident_id", "rank", "hourly_rate", "code")


FACTS = ["severity", "service_id", "archetype", "status", "actual_mttr_minutes", "mttr_reduction_minutes", "hourly_downtime_rate", "baseline_downtime_cost", "downtime_savings_gross", "engineering_hours_saved", "engineering_cost_saved"]


def fact_csv(s, d):
    path = scratch(s, "fact")
    sources.write_fact_csv(finance.incident_financials(load(s, d, "incidents")), path)
    fact = s.read.csv(path, header=True)
    number = [c for c in FACTS if c not in ("severity", "service_id", "archetype", "status")]
    return fact.select(F.col("id").cast("long").alias("id"), F.col("date_key").cast("int").alias("date_key"), "detected_at", "resolved_at", *[F.col(c).cast("double").alias(c) if c in number else F.col(c) for c in FACTS])


def kpi_json(s, d):
    path = scratch(s, "kpi")
    fin = finance.incident_financials(load(s, d, "incidents"))
    sources.write_kpi_json(finance.executive_kpis(fin), {"services": finance.service_impact(fin), "archetypes": finance.archetype_pareto(fin)}, path)
    return s.read.json(path).select("total_incidents", "downtime_savings", F.size("archetypes").cast("long").alias("archetypes"), F.explode("services").alias("x")).select("total_incidents", "downtime_savings", "archetypes", "x.service_id", "x.incidents", F.round("x.savings", 2).alias("savings"))


def tier_file(s, d):
    path = scratch(s, "tier")
    build = lambda spark: load(spark, d, "ticks")
    sources.materialise_tier(s, path, build)
    again = sources.materialise_tier(s, path, lambda spark: build(spark).limit(0))
    return again.select("service_id", "tick", "rps", "orders", "revenue", "p50", "p95", "p99", "cpu", "checkout")


def stateful(s):
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows of a stand-in to a batch of a stream; the rows of a key in one batch are held in one task.
BATCH = 500_000


def sliced(s, df, name, slices=3):
    """df as files of ascending ids, read as a stream of one slice a batch; more slices if there are many rows.

    All slices are written in one pass, and then dated in their order, as a stream takes its files by their times.
    """
    path = scratch(s, name)
    rows, top = df.agg(F.count("*"), F.max("id")).first()
    slices = max(slices, -(-rows // BATCH))
    if not rows:
        df.coalesce(1).write.parquet(path)  # the file of a table without rows
    else:
        at = F.floor(F.col("id") / F.lit(max(top or 0, 1) / slices))
        numbered = df.where("id is not null").withColumn("slice_", F.greatest(F.lit(0), F.least(F.lit(slices - 1), at)).cast("int"))
        numbered.repartition(slices, "slice_").write.partitionBy("slice_").parquet(path)
        sources.dated(s, [f"{path}/slice_={i}" for i in range(slices)])
    return streaming.read_snapshot_stream(s, path, df.schema, 1).select(*df.columns)


def event_stream(s, d):
    stateful(s)
    return sliced(s, load(s, d, "series").selectExpr("id", "k", "ts", "cast(epoch as double) as epoch", "x"), "events")


def run(s, stream, mode="append"):
    return streaming.run_to_table(stream, scratch(s, "out"), scratch(s, "state"), mode)


def detect_stream(s, d):
    stateful(s)
    snaps = load(s, d, "snaps")
    signals = streaming.detect_stream(sliced(s, snaps, "snaps"), "k", model=detect.mahalanobis_fit(snaps, detection.PAIR), crit_sq=detection.CRITICAL_2)
    return run(s, signals).select("id", "k", "metric", "detector", "emission", "observed", "baseline", "sigma", "severity", "explicit", F.to_json("metadata").alias("details"))


def monotonic_stream(s, d):
    late = event_stream(s, d).select("k", "id", (F.col("epoch") - F.when(F.col("id") % 20 == 0, 86400).otherwise(0)).alias("epoch"), (F.col("id") % 11 != 0).alias("passed"), (F.col("id") % 1000 < 2).alias("reset"))
    return run(s, streaming.check_monotonic_stream(late, "k")).select("id", "late")


WATCHED = ["infra_cpu_percent", "infra_memory_percent", "app_latency_p99_ms", "app_requests_per_sec", "db_query_latency_ms"]


def feature_stream(s, d):
    stateful(s)
    snaps = load(s, d, "snaps").select("id", "k", *WATCHED)
    return run(s, streaming.stream_features(sliced(s, snaps, "features"), "k", WATCHED)).select("id", *[F.round(f"{m}_{x}", n).alias(f"{m}_{x}") for m in WATCHED for x, n in (("mean", 11), ("std", 6), ("diff", 9))])  # no value lies half-way there


#: The base metrics that the stand-in for snapshots lacks, as both engines write them.
MORE = {
    "infra_network_ingress_mbps": "cast(id % 83 as double)", "app_http_2xx_count": "cast(id * 13 % 97 as double)", "app_http_4xx_count": "cast(id % 7 as double)", "app_http_5xx_count": "cast(id % 5 as double)", "db_active_connections": "cast(id * 7 % 89 as double)",
    "db_slow_queries_per_sec": "cast(id % 3 as double)", "db_row_lock_waits": "cast(id % 4 as double)", "biz_revenue_usd": "biz_order_volume * 48.5", "biz_cart_abandonment_rate": "100 - biz_checkout_success_rate",
}


def full_snaps(s, d):
    return load(s, d, "snaps").withColumns({k: F.expr(v) for k, v in MORE.items()}).select("id", "k", *features.BASE)


def shown_vectors(df):
    return df.select("id", *[F.round(c, 6).alias(c) for c in features.VECTOR])


def places(c: str) -> int:
    """Decimal places at which no value of a column lies half-way between two roundings."""
    return 6 if c in features.RATIOS[1:] or c.endswith("_std") else 11


def batch_vectors(s, d):
    return features.vector_features(full_snaps(s, d), ["k"], ["id"]).select("id", *[F.round(c, places(c)).alias(c) for c in features.VECTOR])


def vector_stream(s, d):
    """The vectors of a stream, standardised by a scaler of the same rows in a batch."""
    stateful(s)
    snaps = full_snaps(s, d)
    scaler = features.standardise_fit(features.vector_features(snaps, ["k"], ["id"]), features.VECTOR)
    return shown_vectors(run(s, streaming.stream_vectors(sliced(s, snaps, "vectors"), "k", scaler)))


def metric_points(s, d):
    path = scratch(s, "points")
    points = event_stream(s, d).selectExpr("id", "ts", "case when id % 10 = 0 then null else k end as name", "case when id % 15 = 0 then null else x end as value", "'ms' as unit", "case when id % 4 > 0 then map('kind', k) end as dimensions")
    streaming.write_metric_points(points, path, scratch(s, "state")).awaitTermination()
    return s.read.parquet(path).select("id", "name", "value", "unit", F.to_json("dimensions").alias("dimensions"))


def snapshot_stream(s, d):
    path = scratch(s, "snapshots")
    snapshots(s, d).write.json(path)
    whole = run(s, streaming.read_snapshot_stream(s, path, sources.SNAPSHOT_DDL, 1, "json"))
    return shape.flatten_snapshots(whole).select("service_id", "infra_cpu_percent", "app_http_5xx_count", F.round("app_error_rate", 6).alias("app_error_rate"), "biz_revenue_usd", "simulated_root_cause")


QUERIES = {
    "parse_ts": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_timestamp(parse_ts(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))).alias("epoch")),
    "encode_archetype": lambda s, d: incidents(s, d).select("incident_id", encode_archetype(F.col("archetype")).alias("code")),
    "tokenise_technical": lambda s, d: corpus(s, d).select("id", F.size(tokenise_technical(F.col("text"))).alias("tokens")),
    "chunk_id": lambda s, d: probes(s, d).select("query_id", slug(F.concat(F.lit(" _"), "text", F.lit("_-é!"))).alias("slug")),
    "chunk_markdown": lambda s, d: chunks(s, d).select("chunk_id", "uri", "doc_title", "section_title", "doc_type", "token_count", F.md5("content").alias("digest")),
    "bm25_topk": lambda s, d: lexical(s, d, 5).select("query_id", "id", F.round("score", 3).alias("score")),
    "cosine_topk": lambda s, d: semantic(s, d, 5).select("query_id", "id", F.round("score", 3).alias("score")),
    "rrf_fuse": lambda s, d: fused(s, d),
    "rerank_and_cite": lambda s, d: retrieve.rerank_and_cite(fused(s, d)),
    "diagnostic_query": lambda s, d: retrieve.diagnostic_query(driven(s, d)).select("incident_id", "query"),
    "memory_search": lambda s, d: retrieve.memory_search(corpus(s, d), probes(s, d)).select("query_id", "id", "grade"),
    "postmortem_facts": lambda s, d: retrieve.postmortem_facts(reports(s, d)).select("uri", "title", "incident_id", "service_id", F.array_join("tags", ",").alias("tags")),
    "postmortem_incidents": lambda s, d: retrieve.postmortem_incidents(retrieve.postmortem_facts(reports(s, d))).select("incident_id", "title", "service_id", "status"),
    "check_payload": lambda s, d: contract.check_payload(payloads(s, d)).select("service_id", "tick", "error_code", "error_message"),
    "quarantine_stream": quarantined_stream,
    "active_stream": active_stream,
    "quarantine_stream_ordered": ordered_quarantine,
    "vector_topk": lambda s, d: retrieve.vector_topk(e := s.read.parquet(f"{d}/embeddings.parquet"), e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
    "triage_driver": lambda s, d: driven(s, d).select("incident_id", "metric", "sigma", "triage_status"),
    "tier_breakdown": lambda s, d: triage.tier_breakdown(signals(s, d)).select("incident_id", "metrics"),
    "hypothesis": lambda s, d: triage.hypothesis(with_citation(s, d)).select("incident_id", "hypothesis", "confidence", F.array_join("trace", "|").alias("trace")),
    "grounding_score": lambda s, d: triage.grounding_score(triage.hypothesis(with_citation(s, d))).select("incident_id", F.round("grounding", 4).alias("grounding"), "is_grounded"),
    "revise_until_grounded": lambda s, d: triage.revise_until_grounded(with_citation(s, d)).select("incident_id", "hypothesis", F.round("grounding", 4).alias("grounding"), "revisions"),
    "remediation_proposal": lambda s, d: triage.remediation_proposal(driven(s, d)).select("incident_id", "action", "risk", "needs_approval", "target", F.to_json("parameters").alias("parameters"), "justification"),
    "approval_routing": lambda s, d: triage.approval_routing(triage.remediation_proposal(driven(s, d))).select("incident_id", "status", "result"),
    "triage_incidents": lambda s, d: triaged(s, d).select("incident_id", "action", "status", "confidence", "query", "citation", "evidence", F.round("grounding", 4).alias("grounding"), "revisions", "hypothesis"),
    "triage_audit": lambda s, d: triage.audit_rows(triaged(s, d)),
    "retrieve": lambda s, d: retrieve.retrieve(runbooks(s, d), probes(s, d), doc_type="runbook").select("query_id", "id", "rank", "citation"),
    "apply_approvals": lambda s, d: approvals(s, d).select("incident_id", "outcome"),
    "rag_scenario_eval": lambda s, d: scenarios(s, d).select("incident_id", F.round("grounding", 4).alias("grounding"), "context_precision", "context_recall", "action_match", "passed"),
    "rag_macro_eval": lambda s, d: history.rag_macro_eval(scenarios(s, d)),
    "flatten_snapshots": lambda s, d: shape.flatten_snapshots(snapshots(s, d)).select("service_id", "trace_id", "infra_cpu_percent", "app_http_2xx_count"),
    "read_snapshots": read_snapshots,
    "read_snapshot_stream": snapshot_stream,
    "read_series": read_series,
    "read_channel_matrix": read_matrix,
    "read_labels": read_labels,
    "read_markdown_corpus": read_corpus,
    "read_flat_telemetry": flat_csv,
    "write_dimensions": dimensions,
    "materialise_tier": tier_file,
    "write_fact_csv": fact_csv,
    "write_kpi_json": kpi_json,
    "write_metric_points": metric_points,
    "detect_stream": detect_stream,
    "check_monotonic_stream": monotonic_stream,
    "stream_features": feature_stream,
    "stream_vectors": vector_stream,
    "vector_features": batch_vectors,
}


def x(names, body):
    return duck(names, body.replace("{", "{{").replace("}", "}}"))


SHOWN = " || ' ' || ".join(f"'{p}=' || cast(round(cast({p} as decimal(38, 10)), 2) as decimal(38, 2))::varchar" for p in ("p50", "p95", "p99"))
VECTORS = (
    ", f as (select *, " + ", ".join(f"{v} as {k}" for k, v in MORE.items()) + " from snaps), r as (select *, app_latency_p99_ms - app_latency_p50_ms as app_latency_spread_p99_p50, app_latency_p99_ms / (app_latency_p50_ms + 1e-6) as app_latency_ratio_p99_p50, biz_order_volume / (app_requests_per_sec + 1e-6) as biz_orders_per_request, db_query_latency_ms / (app_latency_p50_ms + 1e-6) as db_query_to_app_latency_ratio from f), v as (select *, "
    + ", ".join(f"avg({m}) over w as {m}_roll_mean, coalesce(stddev_samp({m}) over w, 0.0) as {m}_roll_std, coalesce({m} - lag({m}) over (partition by k order by id), 0.0) as {m}_delta" for m in features.ROLLING)
    + " from r window w as (partition by k order by id rows between 9 preceding and current row))"
)
TOK = "list_filter(regexp_extract_all(lower(text), '[a-z0-9_#-]+'), lambda t: length(t) > 1 or regexp_full_match(t, '[0-9]'))"
BM = f""", dt as (select id, {TOK} as t from corpus), ln as (select id, len(t) as length from dt), st as (select count(*) as n, avg(length) as al from ln), po as (select id, term, count(*) as tf from (select id, unnest(t) as term from dt) group by 1, 2),
idf as (select term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from po, st group by term, n), qt as (select query_id, term, count(*) as times from (select query_id, unnest({TOK}) as term from probes) group by 1, 2),
lx as (select query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / al))), 4) as score from qt join idf using (term) join po using (term) join ln using (id), st group by 1, 2), lex as (select *, row_number() over (partition by query_id order by score desc, id) as rank from lx where score > 0)"""
GR = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
TF = f""", dw as (select id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from corpus), tf as (select id, term, count(*) as tf from (select id, unnest({GR}) as term from dw) group by 1, 2), nn as (select count(*) as n from corpus), vi as (select term, ln((1 + n) / (1 + count(*))::double) + 1 as idf from tf, nn group by term, n),
dv as (select id, term, r / sqrt(sum(r * r) over (partition by id)) as weight from (select id, term, (1 + ln(tf)) * idf as r from tf join vi using (term))), qw as (select query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from probes), qf as (select query_id, term, count(*) as tf from (select query_id, unnest({GR}) as term from qw) group by 1, 2),
qv as (select query_id, term, r / sqrt(sum(r * r) over (partition by query_id)) as q from (select query_id, term, (1 + ln(tf)) * idf as r from qf join vi using (term))), sx as (select query_id, id, round(sum(q * weight), 4) as score from qv join dv using (term) group by 1, 2), sem as (select *, row_number() over (partition by query_id order by score desc, id) as rank from sx where score > 0)"""
FU = f"{BM}{TF}, fu as (select coalesce(l.query_id, s.query_id) as query_id, coalesce(l.id, s.id) as id, coalesce(l.score, 0.0) as lexical, coalesce(s.score, 0.0) as semantic, round(1.0 / (60 + coalesce(l.rank, 999)) + 1.0 / (60 + coalesce(s.rank, 999)), 6) as rrf from (select * from lex where rank <= 15) l full join (select * from sem where rank <= 15) s on l.query_id = s.query_id and l.id = s.id)"
DR = ", dr as (select i.id as incident_id, i.severity, i.service_id, i.archetype, s.metric, s.sigma from incidents i left join (select *, row_number() over (partition by incident_id order by is_primary desc, abs(sigma) desc, signal_id, sigma) as i from signals) s on s.incident_id = i.id and s.i = 1)"
M = "coalesce(metric, '')"
A = "coalesce(archetype, '')"
ACT = f"case when contains({M}, 'pool') or contains({A}, 'DB_CONNECTION_POOL') then 'EXPAND_DB_CONNECTION_POOL' when contains({M}, 'memory') or contains({A}, 'MEMORY_LEAK') then 'ROLLING_CONTAINER_RESTART' when contains({M}, 'latency') or contains({M}, 'error_rate') or contains({A}, 'THIRD_PARTY') then 'ENGAGE_CIRCUIT_BREAKER' when contains({M}, 'checkout') or contains({M}, 'order') or contains({A}, 'PAYMENT_GATEWAY') then 'FAILOVER_PAYMENT_GATEWAY' when contains({M}, 'traffic') or contains({M}, 'request') or contains({A}, 'TRAFFIC_BURST') then 'SCALE_HORIZONTAL_POD_AUTOSCALER' else 'CONTINUOUS_OBSERVABILITY_MONITORING' end"
CONF = f"case when contains({M}, 'pool') or contains({A}, 'DB_CONNECTION_POOL') then 0.96 when contains({M}, 'memory') or contains({A}, 'MEMORY_LEAK') then 0.94 when contains({M}, 'latency') or contains({A}, 'THIRD_PARTY') then 0.93 when contains({M}, 'checkout') or contains({M}, 'order') or contains({A}, 'PAYMENT_GATEWAY') then 0.97 else 0.85 end::double"
AC = f"{DR}, ac as (select *, {ACT} as action, {CONF} as confidence from dr), ro as (select *, case when action in ('EXPAND_DB_CONNECTION_POOL', 'ROLLING_CONTAINER_RESTART', 'FAILOVER_PAYMENT_GATEWAY') then true when action = 'ENGAGE_CIRCUIT_BREAKER' then severity in ('CRITICAL', 'HIGH') else false end as needs from ac), rt as (select *, case when needs then 'HUMAN_APPROVAL_PENDING' else 'REMEDIATION_EXECUTED' end as status from ro)"
IS = ["incidents", "signals"]
DQ = """, dq as (select *, concat_ws(' ', service_id, metric, case when contains(metric, 'pool') then 'PostgreSQL connection pool max_connections saturation' when contains(metric, 'memory') then 'memory leak garbage collection stop-the-world heap restart' when contains(metric, 'latency') or contains(metric, 'error_rate') then 'timeout circuit breaker downstream failure'
    when contains(metric, 'checkout') then 'payment gateway failure failover decline' end, replace(archetype, '_', ' ')) as query from dr), qs as (select distinct query as query_id, query as text from dq)"""
FUSED = FU.replace("from corpus", "from runbooks")
RANKED = ", rr as (select *, round(0.45 * least(1.0, lexical / greatest(1.0, max(lexical) over (partition by query_id))) + 0.55 * semantic, 4) as rerank from fu), cr as (select query_id, id, row_number() over (partition by query_id order by rerank desc, rrf desc, id) as rank, '[item_' || id::varchar || '.md#' || id::varchar || ': Overview]' as citation from rr {0}where rerank >= 0.35)"
RUNBOOKS_ONLY = RANKED.format("join runbooks using (id) ").replace("where rerank", "where doc_type = 'runbook' and rerank")
FOUND = f"{DR}{DQ}{FUSED.replace('from probes', 'from qs')}{RANKED.format('')}, ci as (select query_id, count(*) as evidence, max(case when rank = 1 then citation end) as citation from cr where rank <= 4 group by 1), cx as (select dq.*, citation, coalesce(evidence, 0) as evidence from dq left join ci on query = query_id)"
GIVEN = f"{DR}, cx as (select *, case when incident_id % 3 <> 0 then '[runbook-' || (incident_id % 5)::varchar || ']' end as citation from dr)"


def grounded_sql():
    """From cx: the hypothesis before and after one revision, h0 and h1, with their grounding, and what is left at the end."""
    cite = "coalesce(citation, '[No Citation Available]')"
    tests = [f"contains({M}, 'pool') or contains({A}, 'DB_CONNECTION_POOL')", f"contains({M}, 'memory') or contains({A}, 'MEMORY_LEAK')", f"contains({M}, 'latency') or contains({A}, 'THIRD_PARTY')", f"contains({M}, 'checkout') or contains({M}, 'order') or contains({A}, 'PAYMENT_GATEWAY')"]
    what = ["connection pool saturated, clients starve for a connection", "heap memory leak with stop-the-world pauses", "third party times out and starves the worker threads", "payment gateway outage declines transactions"]
    cause = "case " + " ".join(f"when {t} then service_id || ': {w}, as in ' || {cite}" for t, w in zip(tests, what, strict=True)) + f" else 'anomaly in ' || service_id || ' driven by ' || coalesce(metric, 'unknown_metric') || ', evidence ' || {cite} end"
    tokens = lambda c, t: f"len(list_filter(string_split(lower({c}), '_'), lambda w: length(w) > 3 and contains(lower({t}), w))) > 0"

    def score(t):
        metric = f"case when metric is null then contains(lower({t}), 'nominal') or contains(lower({t}), 'no active') else contains({t}, metric) or {tokens('metric', t)} end"
        checks = [f"contains({t}, service_id)", metric, f"case when citation is null then metric is null else contains({t}, citation) end", f"coalesce({tokens('archetype', t)}, false)"]
        return f"({' + '.join(f'({c})::int' for c in checks)}) / (3 + (archetype is not null)::int)::double"

    return f""", h0 as (select *, {cause} as hyp, list_filter([case when metric is not null then 'driver ' || metric end, case when archetype is not null then 'archetype ' || archetype end, case when citation is not null then 'evidence ' || citation end], lambda w: w is not null) as tr,
        ' (revised: ' || concat_ws(' ', 'anchor to', service_id, metric, coalesce(citation, '')) || ')' as note from cx),
        h1 as (select *, concat_ws(' ', hyp, nullif(array_to_string(tr, ' '), '')) as t0, concat_ws(' ', hyp || note, array_to_string(list_append(tr, note), ' ')) as t1 from h0), h2 as (select *, {score('t0')} as g0, {score('t1')} as g1 from h1),
        en as (select *, case when g0 >= 0.95 then 0 when g1 >= 0.95 then 1 else 2 end as revisions, case when g0 >= 0.95 then g0 else g1 end as grounding, case when g0 >= 0.95 then hyp else hyp || note end as hypothesis, len(tr) + (g0 < 0.95)::int as steps from h2)"""


def by_action(value):
    quoted = lambda t: "'" + t.replace("'", "''").replace("{s}", "' || service_id || '") + "'"
    return "case action " + " ".join(f"when '{a}' then {quoted(value(p))}" for a, p in triage.PLANS.items()) + " end"


TARGET, WHY = by_action(lambda p: p[0]), by_action(lambda p: p[2])
PARAMS = by_action(lambda p: "{" + ",".join(f'"{k}":"{v}"' for k, v in p[1].items()) + "}")
RISK = "case action when 'ENGAGE_CIRCUIT_BREAKER' then 'MEDIUM' when 'SCALE_HORIZONTAL_POD_AUTOSCALER' then 'LOW' when 'CONTINUOUS_OBSERVABILITY_MONITORING' then 'LOW' else 'HIGH' end"
ROUTED = f", ac as (select *, {ACT} as action, {CONF} as confidence from en), ro as (select *, case when action in ('EXPAND_DB_CONNECTION_POOL', 'ROLLING_CONTAINER_RESTART', 'FAILOVER_PAYMENT_GATEWAY') then true when action = 'ENGAGE_CIRCUIT_BREAKER' then severity in ('CRITICAL', 'HIGH') else false end as needs from ac), rt as (select *, case when needs then 'HUMAN_APPROVAL_PENDING' else 'REMEDIATION_EXECUTED' end as status from ro)"
WHOLE = f"{FOUND}{grounded_sql()}{ROUTED}"
ALL = ["incidents", "signals", "runbooks"]
SCENE = f"{WHOLE}, se as (select incident_id, round(grounding, 4) as grounding, case when citation is null then 0.0 when contains(lower(citation), 'item_1') or contains(lower(citation), 'item_2') then 1.0 else 0.0 end::double as context_precision, (incident_id % 2 = 0)::int::double as action_match from rt), sv as (select *, case when context_precision > 0 then 1.0 else 0.5 end::double as context_recall from se), sp as (select *, grounding >= 0.95 and context_precision >= 0.7 and context_recall >= 0.8 and action_match = 1 as passed from sv)"
AUDIT = f"""{WHOLE}, au as (select incident_id, 0 as step, 'statistician' as agent, case when metric is null then 'TRIAGE' else 'QUANTITATIVE_TRIAGE' end as action, case when metric is null then '{{"result":"no anomaly signals"}}' else '{{"primary_driver":"' || metric || '","max_sigma":' || sigma::varchar || '}}' end as detail from rt
    union all select incident_id, 1, 'retriever', 'RETRIEVE_EVIDENCE', '{{"retrieved_count":' || evidence::varchar || ',"top_citation":"' || coalesce(citation, 'none') || '"}}' from rt where metric is not null
    union all select incident_id, 2, 'investigator', 'DIAGNOSE_ROOT_CAUSE', '{{"confidence":' || confidence::varchar || ',"reasoning_steps_count":' || steps::varchar || '}}' from rt where metric is not null
    union all select incident_id, 3, 'validator', 'EVALUATE_GROUNDING', '{{"grounding_score":' || round(grounding, 4)::varchar || ',"is_grounded":' || (grounding >= 0.95)::varchar || ',"revision_count":' || revisions::varchar || '}}' from rt where metric is not null
    union all select incident_id, 4, 'action_agent', 'FORMULATE_REMEDIATION', '{{"action_type":"' || action || '","risk_level":"' || {RISK} || '","status":"' || status || '"}}' from rt where metric is not null
    union all select incident_id, 5, 'approval_gate', 'AWAIT_OPERATOR_SIGN_OFF', '{{"target":"' || {TARGET} || '","status":"' || status || '"}}' from rt where metric is not null and needs)"""

REPORTS = "with r as (select conv_id, 'kb/runbooks/conv_' || conv_id::varchar || '.md' as uri, '# Conversation ' || conv_id::varchar || chr(10) || string_agg('## ' || role || ' turn ' || turn::varchar || chr(10) || text, chr(10) order by turn) || case when conv_id % 3 = 0 then chr(10) || 'INC-2024-' || conv_id::varchar || ' hit the payment-service and its Database' else chr(10) || 'no incident' end as body from conversations group by conv_id)"

ORACLES = {
    "parse_ts": "select event_id, cast(floor(epoch(ts)) as bigint) as epoch from events",
    "encode_archetype": x(["incidents"], "select id as incident_id, case archetype when 'DB_CONNECTION_POOL_SATURATION' then 1 when 'MEMORY_LEAK_GC_PAUSE' then 2 when 'CASCADING_THIRD_PARTY_FAILURE' then 3 when 'PAYMENT_GATEWAY_OUTAGE' then 4 when 'BLACK_FRIDAY_TRAFFIC_BURST' then 5 else 0 end as code from incidents"),
    "tokenise_technical": x(["corpus"], f"select id, len({TOK})::int as tokens from corpus"),
    "chunk_id": x(["probes"], "select query_id, regexp_replace(regexp_replace(trim(lower(' _' || text || '_-é!')), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g') as slug from probes"),
    "chunk_markdown": "select 'conv_' || conv_id::varchar || '#' || role || '-turn-' || turn::varchar as chunk_id, 'kb/runbooks/conv_' || conv_id::varchar || '.md' as uri, 'Conversation ' || conv_id::varchar as doc_title, role || ' turn ' || turn::varchar as section_title, 'runbook' as doc_type, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> ''))::int as token_count, md5(body) as digest from (select *, trim('## ' || role || ' turn ' || turn::varchar || chr(10) || text) as body from conversations) where length(body) >= 60",
    "postmortem_facts": f"{REPORTS} select uri, 'Conversation ' || conv_id::varchar as title, case when conv_id % 3 = 0 then 'INC-2024-' || conv_id::varchar end as incident_id, nullif(regexp_extract(body, '([a-z]+(?:-[a-z]+)*-(?:service|processing|core))', 1), '') as service_id, array_to_string(list_filter(['database', 'memory', 'latency', 'payment', 'traffic', 'timeout'], lambda w: contains(lower(body), w)), ',') as tags from r",
    "postmortem_incidents": f"{REPORTS} select 'INC-2024-' || conv_id::varchar as incident_id, 'Conversation ' || conv_id::varchar as title, nullif(regexp_extract(body, '([a-z]+(?:-[a-z]+)*-(?:service|processing|core))', 1), '') as service_id, 'RESOLVED' as status from r where conv_id % 3 = 0",
    "check_payload": x(["ticks"], ", f as (select service_id, tick, list_filter([case when tick % 7 = 0 then 'infrastructure.cpu_percent' end, case when tick % 5 = 0 then 'application.service_id' end, case when tick % 3 = 0 then 'business.order_volume' end], lambda w: w is not null) as bad from ticks) select service_id, tick, case when tick % 11 = 0 then 'UNKNOWN_ERROR' when len(bad) > 0 then 'SCHEMA_VALIDATION_FAILED' end as error_code, case when tick % 11 = 0 then 'the payload is no JSON object' when len(bad) > 0 then 'fields: ' || array_to_string(bad, ',') end as error_message from f"),
    "quarantine_stream": x(["dirty"], "select id, case when cpu is null or cpu < 0 or cpu > 100 or p50 < 0 then 'SCHEMA_VALIDATION_FAILED' when p50 > p95 or p95 > p99 then 'CROSS_FIELD_INVARIANT_VIOLATION' when checkout < 0 or checkout > 100 then 'BOUNDS_OUT_OF_RANGE' end as error_code, case when cpu is null or cpu < 0 or cpu > 100 then 'fields: cpu' || case when p50 < 0 then ',p50' else '' end when p50 < 0 then 'fields: p50' when p50 > p95 or p95 > p99 then 'p50=' || cast(round(cast(p50 as decimal(38, 10)), 2) as decimal(38, 2))::varchar || ' p95=' || cast(round(cast(p95 as decimal(38, 10)), 2) as decimal(38, 2))::varchar || ' p99=' || cast(round(cast(p99 as decimal(38, 10)), 2) as decimal(38, 2))::varchar when checkout < 0 or checkout > 100 then 'checkout' end as error_message from dirty"),
    "active_stream": x(["incidents"], "select incident_id, epoch, status from (select id % 2000 as incident_id, id as epoch, status, row_number() over (partition by id % 2000 order by id desc) as i from incidents) where i = 1 and status <> 'RESOLVED'"),
    "recall_experience": x(["incidents", "runbooks"], f"""{business.SIM}, pq as (select probe_id as query_id, case probe_id % 4 when 0 then '{business.ASKED[0]}' when 1 then '{business.ASKED[1]}' when 2 then '{business.ASKED[2]}' else '{business.ASKED[3]}' end as text from pr){TF.replace('from corpus', 'from runbooks').replace('from probes', 'from pq')},
        me as (select query_id as probe_id, string_agg(id::varchar || ':' || case when score >= 0.65 then 'STRONG' when score >= 0.35 then 'MODERATE' else 'WEAK' end, ',' order by k) as memories from (select *, row_number() over (partition by query_id order by score desc, id) as k from sx where score > 0.05 and id % 25 = query_id) where k <= 3 group by 1),
        c as (select probe_id, action, count(*) as n from s where action is not null group by 1, 2), l as (select probe_id, string_agg(action, ',' order by n desc, action) as actions from c group by 1), e as (select probe_id, count(*) as episodes from s group by 1)
        select coalesce(e.probe_id, me.probe_id) as probe_id, coalesce(e.episodes, 0) as episodes, l.actions, me.memories, coalesce(e.episodes, 0) >= 2 as recurring from e left join l using (probe_id) full join me on me.probe_id = e.probe_id"""),
    "bm25_topk": x(["corpus", "probes"], f"{BM} select query_id, id, round(score, 3) as score from lex where rank <= 5"),
    "cosine_topk": x(["corpus", "probes"], f"{TF} select query_id, id, round(score, 3) as score from sem where rank <= 5"),
    "rrf_fuse": x(["corpus", "probes"], f"{FU} select * from fu"),
    "rerank_and_cite": x(["corpus", "probes"], f"{FU}, rr as (select *, round(0.45 * least(1.0, lexical / greatest(1.0, max(lexical) over (partition by query_id))) + 0.55 * semantic, 4) as rerank from fu) select query_id, id, lexical, semantic, rrf, rerank, row_number() over (partition by query_id order by rerank desc, rrf desc, id) as rank, '[doc-' || id::varchar || ']' as citation from rr where rerank >= 0.35 qualify rank <= 5"),
    "memory_search": x(["corpus", "probes"], f"{TF} select query_id, id, case when score >= 0.65 then 'STRONG' when score >= 0.35 then 'MODERATE' else 'WEAK' end as grade from (select *, row_number() over (partition by query_id order by score desc, id) as k from sx where score > 0.05) where k <= 3"),
    "diagnostic_query": x(IS, f"{DR} select incident_id, concat_ws(' ', service_id, metric, case when contains(metric, 'pool') then 'PostgreSQL connection pool max_connections saturation' when contains(metric, 'memory') then 'memory leak garbage collection stop-the-world heap restart' when contains(metric, 'latency') or contains(metric, 'error_rate') then 'timeout circuit breaker downstream failure' when contains(metric, 'checkout') then 'payment gateway failure failover decline' end, replace(archetype, '_', ' ')) as query from dr"),
    "vector_topk": "with v as (select vec_id, embedding::double[] as e from embeddings) select q.vec_id as query_id, v.vec_id as id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, v.e), 12) desc, v.vec_id) as rank, round(list_cosine_similarity(q.e, v.e), 6) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0 qualify rank <= 5",
    "triage_driver": x(IS, f"{DR} select incident_id, metric, sigma, case when metric is null then 'RESOLVED' else 'INVESTIGATING' end as triage_status from dr"),
    "tier_breakdown": x(["signals"], "select incident_id, string_agg(distinct metric, ',' order by metric) as metrics from signals group by 1"),
    "hypothesis": x(IS, f"{GIVEN}{grounded_sql()} select incident_id, hyp as hypothesis, {CONF} as confidence, array_to_string(tr, '|') as trace from en"),
    "grounding_score": x(IS, f"{GIVEN}{grounded_sql()} select incident_id, round(g0, 4) as grounding, g0 >= 0.95 as is_grounded from en"),
    "revise_until_grounded": x(IS, f"{GIVEN}{grounded_sql()} select incident_id, hypothesis, round(grounding, 4) as grounding, revisions from en"),
    "remediation_proposal": x(IS, f"{AC} select incident_id, action, {RISK} as risk, needs as needs_approval, {TARGET} as target, {PARAMS} as parameters, {WHY} as justification from ro"),
    "approval_routing": x(IS, f"{AC} select incident_id, status, case when needs then 'DRY_RUN_PASSED: ' || action || ' on ' || {TARGET} || ' awaits approval' else 'SIMULATION_SUCCESS: ' || action || ' on ' || {TARGET} || ', parameters ' || {PARAMS} end as result from rt"),
    "triage_incidents": x(ALL, f"{WHOLE} select incident_id, action, status, confidence, query, citation, evidence, round(grounding, 4) as grounding, revisions, hypothesis from rt"),
    "triage_audit": x(ALL, f"{AUDIT} select * from au"),
    "retrieve": x(["runbooks", "probes"], f"{FUSED}{RUNBOOKS_ONLY} select * from cr where rank <= 5"),
    "rag_scenario_eval": x(ALL, f"{SCENE} select incident_id, grounding, context_precision, context_recall, action_match, passed from sp"),
    "rag_macro_eval": x(ALL, f"{SCENE} select round(avg(grounding), 4) as grounding, round(avg(context_precision), 4) as context_precision, round(avg(context_recall), 4) as context_recall, round(avg(action_match), 4) as action_match, bool_and(passed) as all_passed from sp"),
    "apply_approvals": x(ALL, f"{WHOLE} select incident_id + case when incident_id % 50 = 0 then 1000000000 else 0 end as incident_id, case when incident_id % 50 = 0 then 'NOT_FOUND' when status <> 'HUMAN_APPROVAL_PENDING' then 'BAD_STATUS' when incident_id % 7 = 0 then 'FORBIDDEN' else 'EXECUTED' end as outcome from rt"),
    "flatten_snapshots": x(["ticks"], "select service_id, 'tr-' || service_id || '-' || tick::varchar as trace_id, cpu as infra_cpu_percent, c2xx::int as app_http_2xx_count from ticks"),
    "read_snapshots": x(["ticks"], "select service_id, cpu as infra_cpu_percent, c5xx::int as app_http_5xx_count, round(coalesce(c5xx / nullif(c2xx + c4xx + c5xx, 0)::double, 0.0), 6) as app_error_rate, revenue as biz_revenue_usd, '' as simulated_root_cause from ticks"),
    "read_snapshot_stream": x(["ticks"], "select service_id, cpu as infra_cpu_percent, c5xx::int as app_http_5xx_count, round(coalesce(c5xx / nullif(c2xx + c4xx + c5xx, 0)::double, 0.0), 6) as app_error_rate, revenue as biz_revenue_usd, '' as simulated_root_cause from ticks"),
    "read_series": "select epoch(date_trunc('second', ts))::bigint as epoch, value from events where event_id % 10 <> 0",
    "read_labels": "select toxic as label, row_number() over (order by doc_id) - 1 as pos from labels",
    "read_channel_matrix": "select pos, k - 1 as channel, round(e[k]::double * 100, 4) as value from (select row_number() over (order by vec_id) - 1 as pos, embedding as e from embeddings where vec_id % 9 <> 0), range(1, 65) t(k)",
    "materialise_tier": x(["ticks"], "select service_id, tick, rps, orders, revenue, p50, p95, p99, cpu, checkout from ticks"),
    "read_flat_telemetry": x(["ticks"], "select * from ticks"),
    "read_markdown_corpus": "select conv_id, '# Conversation ' || conv_id::varchar || chr(10) || string_agg('## ' || role || ' turn ' || turn::varchar || chr(10) || text, chr(10) order by turn) as text from conversations group by conv_id",
    "write_dimensions": x(["incidents"], "select id as incident_id, case severity when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 when 'LOW' then 4 end as rank, case severity when 'CRITICAL' then 180000.0 when 'HIGH' then 120000.0 when 'MEDIUM' then 25000.0 when 'LOW' then 5000.0 end::double as hourly_rate, case archetype when 'NOMINAL' then 0 when 'DB_CONNECTION_POOL_SATURATION' then 1 when 'MEMORY_LEAK_GC_PAUSE' then 2 when 'CASCADING_THIRD_PARTY_FAILURE' then 3 when 'PAYMENT_GATEWAY_OUTAGE' then 4 when 'BLACK_FRIDAY_TRAFFIC_BURST' then 5 end as code from incidents"),
    "write_fact_csv": business.f("select fin.id, strftime(fin.detected_at, '%Y%m%d')::int as date_key, strftime(fin.detected_at, '%Y-%m-%dT%H:%M:%SZ') as detected_at, strftime(i.resolved_at, '%Y-%m-%dT%H:%M:%SZ') as resolved_at, " + ", ".join(f"fin.{c}" for c in FACTS) + " from fin join incidents i on i.id = fin.id"),
    "write_kpi_json": business.f(", t as (select count(*) as total_incidents, round(sum(downtime_savings_gross), 2) as downtime_savings, count(distinct archetype) as archetypes from fin) select t.*, service_id, count(*) as incidents, round(sum(downtime_savings_gross), 2) as savings from fin, t group by all"),
    "write_metric_points": "select event_id as id, case when event_id % 10 = 0 then 'unknown' else event_type end as name, case when event_id % 15 = 0 then 0.0 else value end as value, 'ms' as unit, case when event_id % 4 > 0 then '{\"kind\":\"' || event_type || '\"}' else '{}' end as dimensions from events",
    "detect_stream": detection.ORACLES["emit_signals"],
    "check_monotonic_stream": "with e as (select event_id as id, event_type as k, floor(epoch(ts)) - case when event_id % 20 = 0 then 86400 else 0 end as t, event_id % 11 <> 0 as ok, sum((event_id % 1000 < 2)::int) over (partition by event_type order by event_id) as run from events) select id, ok and coalesce(t < max(case when ok then t end) over (partition by k, run order by id rows between unbounded preceding and 1 preceding), false) as late from e",
    "stream_vectors": duck(["snaps"], VECTORS + " select id, " + ", ".join(f"round(({c} - avg({c}) over ()) / (stddev_pop({c}) over () + 1e-6), 6) as {c}" for c in features.VECTOR) + " from v"),
    "vector_features": duck(["snaps"], VECTORS + " select id, " + ", ".join(f"round({c}, {places(c)}) as {c}" for c in features.VECTOR) + " from v"),
    "quarantine_stream_ordered": x(["dirty"], f""", {detection.J.replace("j1 as (select *,", "j1 as (select *, case when cpu is null or cpu < 0 or cpu > 100 then 'fields: cpu' || case when p50 < 0 then ',p50' else '' end when p50 < 0 then 'fields: p50' when p50 > p95 or p95 > p99 then " + SHOWN + " when checkout < 0 or checkout > 100 then 'checkout' end as said,")}
        select id, error_code, coalesce(said, case when error_code is not null then cast(stamp as varchar) || ' < ' || cast(mark as varchar) end) as error_message from j"""),
    "stream_features": duck(["snaps"], "select id, " + ", ".join(f"round(avg({m}) over w, 11) as {m}_mean, round(coalesce(stddev_samp({m}) over w, 0.0), 6) as {m}_std, round(coalesce({m} - lag({m}) over (partition by k order by id), 0.0), 9) as {m}_diff" for m in WATCHED) + " from snaps window w as (partition by k order by id rows between 9 preceding and current row)"),
}
