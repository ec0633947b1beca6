"""Stand-ins for telemetry, incidents and metrics over the driver's tables, as SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import scratch as scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DIALECT = {
    "spark": {"E": "unix_timestamp(cast(ts as timestamp))", "DIV": "div", "Q": "percentile", "MIN": "make_dt_interval(0, 0, cast(o_orderkey % 120 + 1 as int), 0)", "DAY": "date_format(o_orderdate, 'yyyyMMdd')"},
    "duckdb": {"E": "cast(floor(epoch(ts)) as bigint)", "DIV": "//", "Q": "quantile_cont", "MIN": "to_minutes(o_orderkey % 120 + 1)", "DAY": "strftime(o_orderdate, '%Y%m%d')"},
}
BASE = {
    "series": "select event_id as id, event_type as k, {E} as epoch, ts, value as x, cast(user_id as double) as y from events",
    "snaps": """select event_id as id, event_type as k, ts, least(100.0, v) as infra_cpu_percent, 20 + 0.2 * least(300.0, v) as infra_memory_percent, v * 2 + 5 as infra_network_egress_mbps, 5 + 0.1 * v as infra_disk_io_mbps, 5 + 0.6 * v as app_latency_p50_ms, v * 3 + user_id % 50 as app_requests_per_sec,
        10 + v as app_latency_p95_ms, 12 + v * 2 + event_id * 7919 % 31 as app_latency_p99_ms, cast(event_id * 31 % 101 as double) / 128 as app_error_rate, cast(user_id % 100 as double) as db_pool_utilization, 0.4 * v + event_id % 13 as db_query_latency_ms,
        case when event_id % 1000 < 300 then cast(user_id % 97 as double) else v + user_id % 97 end as biz_order_volume, 100 - least(100.0, 0.2 * v) as biz_checkout_success_rate from (select *, value * 1.0123457 as v from events)""",
    "ticks": """select 'svc-' || cast(user_id % 5 as string) as service_id, {E} {DIV} 21600 as tick, count(*) as rps, sum(case when event_type = 'error' then 1 else 0 end) as c5xx,
        sum(case when user_id % 7 = 0 and event_type <> 'error' then 1 else 0 end) as c4xx, sum(case when user_id % 7 <> 0 and event_type <> 'error' then 1 else 0 end) as c2xx,
        sum(case when event_type = 'purchase' then 1 else 0 end) as orders, round(sum(case when event_type = 'purchase' then value else 0 end), 2) as revenue,
        round({Q}(value, 0.5), 4) as p50, round({Q}(value, 0.95), 4) as p95, round({Q}(value, 0.99), 4) as p99, round(least(100.0, avg(value)), 4) as cpu,
        case when sum(case when event_type in ('purchase', 'error') then 1 else 0 end) = 0 then 100.0
             else round(100.0 * sum(case when event_type = 'purchase' then 1 else 0 end) / sum(case when event_type in ('purchase', 'error') then 1 else 0 end), 4) end as checkout
        from events group by 1, 2""",
    "dirty": """select service_id, tick, row_number() over (order by service_id, tick) as id, case when (tick * 7 + length(service_id)) % 11 = 0 and rps % 2 = 0 then null when (tick + rps) % 13 = 0 then 105.0 else cpu end as cpu,
        case when tick % 9 = 0 then p99 + 1 else p50 end as p50, p95, p99, case when rps % 17 = 0 then 130.0 else checkout end as checkout, case when tick % 6 = 0 then tick - 4 else tick end as stamp from ticks""",
    "incidents": """select o_orderkey as id, case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' else 'LOW' end as severity,
        'svc-' || cast(c_nationkey as string) as service_id, case o_orderkey % 7 when 0 then 'NOMINAL' when 1 then 'DB_CONNECTION_POOL_SATURATION' when 2 then 'MEMORY_LEAK_GC_PAUSE' when 3 then 'CASCADING_THIRD_PARTY_FAILURE'
        when 4 then 'PAYMENT_GATEWAY_OUTAGE' when 5 then 'BLACK_FRIDAY_TRAFFIC_BURST' else null end as archetype, o_orderdate as detected_at, case when o_orderstatus <> 'O' then o_orderdate + {MIN} end as resolved_at,
        o_orderkey % 24 = 0 as is_false_positive, case when o_orderstatus = 'O' then 'OPEN' else 'RESOLVED' end as status from orders join customer on c_custkey = o_custkey""",
    "signals": """select l_orderkey as incident_id, l_orderkey * 10 + l_linenumber as signal_id, case l_linenumber when 1 then 'db_pool_utilization' when 2 then 'infra_memory_percent' when 3 then 'app_latency_p99_ms' when 4 then 'biz_checkout_success_rate'
        when 5 then 'app_requests_per_sec' else 'app_error_rate' end as metric, l_quantity as observed, 25.0 as baseline, round((l_quantity - 25) / 7, 4) as sigma, l_linenumber = 4 as is_primary from lineitem""",
    "requests": "select event_id as id, {E} as epoch, event_type as kind, '/v1/' || event_type || '/' || cast(event_id as string) as path, case when event_type = 'error' then 500 else 200 end as status, value / 1000 as seconds from events",
    "corpus": "select doc_id as id, text from documents",
    "probes": "select item_id as query_id, text from benchmark",
    "runbooks": """select item_id as id, case item_id % 5 when 0 then 'PostgreSQL connection pool max_connections saturation' when 1 then 'memory leak garbage collection stop-the-world heap restart' when 2 then 'timeout circuit breaker downstream failure'
        when 3 then 'payment gateway failure failover decline' else 'nominal operation' end || ' ' || text as text, 'kb/runbooks/item_' || cast(item_id as string) || '.md' as uri, 'Overview' as section, case when item_id % 2 = 0 then 'runbook' else 'postmortem' end as doc_type from benchmark""",
    "scrapes": "select event_id as id, 1700000000 + event_id * 3 + event_id % 3 as epoch, event_id {DIV} 700 as run, event_type as kind from events where event_id % 1000 < 900",
    "request_samples": "select status_code, epoch, cast(count(*) over (partition by status_code, run order by id) as double) as value from (select *, case when kind = 'error' and (id {DIV} 400) % 3 = 0 then '500' else '200' end as status_code from scrapes)",
    "snapshot_samples": "select anomaly_detected, epoch, cast(count(*) over (partition by anomaly_detected, run order by id) as double) as value from (select *, case when id % 3 = 0 and (id {DIV} 300) % 2 = 0 then 'true' else 'false' end as anomaly_detected from scrapes)",
    "latency_samples": """select le, epoch, value from (select id, epoch, le, cast(sum(case when v <= le then 1 else 0 end) over (partition by le, run order by id) as double) as value from (select *, cast((id % 20) * (1 + (id {DIV} 500) % 2) as double) / 2000 as v from scrapes)
        cross join (select cast(x as double) as le from (values ('0.0005'), ('0.001'), ('0.002'), ('0.005'), ('0.01'), ('0.015'), ('0.025'), ('0.05'), ('inf')) t(x))) where id % 5 = 4""",
    "grounding_samples": """select le, epoch, value from (select id, epoch, le, cast(sum(case when v <= le then 1 else 0 end) over (partition by le, run order by id) as double) as value from (select *, cast(100 - (id % 10) * (1 + (id {DIV} 600) % 2) as double) / 100 as v from scrapes)
        cross join (select cast(x as double) as le from (values ('0.7'), ('0.8'), ('0.85'), ('0.9'), ('0.95'), ('0.98'), ('1.0'), ('inf')) t(x))) where id % 5 = 4""",
    "health_samples": "select 'subsystem-' || cast(k as string) as subsystem, epoch, cast(case when (id {DIV} 250 + k) % 4 = 0 then 0 else 1 end as double) as value from scrapes cross join (select 0 as k union all select 1 union all select 2) where id % 4 = k",
    "judged": "select d.doc_id as id, l.toxic as y, case when d.n_chars % 10 < 2 then 1 else 0 end as p, l.quality as q from documents d join labels l on l.doc_id = d.doc_id",
}
NEEDS = {"dirty": ["ticks"]} | {f"{n}_samples": ["scrapes"] for n in ("request", "snapshot", "latency", "grounding", "health")}


def cte(names, engine: str) -> str:
    """The named stand-ins as a WITH clause."""
    order: list[str] = []
    for n in names:
        order += [m for m in [*NEEDS.get(n, []), n] if m not in order]
    return "with " + ",\n".join(f"{n} as ({BASE[n].format(**DIALECT[engine])})" for n in order)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame; times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for t in TABLES:
        if t in BASE[name] or any(t in BASE[m] for m in NEEDS.get(name, [])):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"{cte([name], 'spark')} select * from {name}")


def duck(names, body: str) -> str:
    return f"{cte(names, 'duckdb')} {body.format(**DIALECT['duckdb'])}"
