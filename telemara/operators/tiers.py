"""Raw series and channel matrices as flat snapshots of a service, with derived metrics and rule labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shape import assign_round_robin, label_by_rules

COLUMNS = (
    "pos", "epoch", "trace_id", "service_id", "cpu_percent", "memory_percent", "disk_io_mbps", "network_egress_mbps", "network_ingress_mbps", "endpoint", "requests_per_sec",
    "latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "http_2xx_count", "http_4xx_count", "http_5xx_count", "db_instance_id", "active_connections", "connection_pool_utilization",
    "query_latency_mean_ms", "slow_queries_per_sec", "row_lock_waits", "order_volume", "revenue_usd", "checkout_success_rate", "cart_abandonment_rate", "label", "anomalous", "cause",
)

#: Services with their endpoint and database.
CHECKOUT = ("checkout-service", "/api/v1/checkout", "aurora-postgres-primary")
PAYMENT = ("payment-service", "/api/v1/payments", "aurora-payment-cluster")
ORDER = ("order-service", "/api/v1/orders", "dynamodb-orders-table")
INVENTORY = ("inventory-service", "/api/v1/inventory", "redis-inventory-cache")
AUTH = ("auth-service", "/api/v1/auth/login", "redis-session-store")
GATEWAY = ("payment-gateway", "/api/v1/payments/process", "aurora-payment-cluster")


@dataclass(frozen=True)
class Matrix:
    """Fixed values of a tier made from a channel matrix; a pair that ends in (calm, hit) gives what holds with and without an incident."""

    start: str
    step_s: int
    services: tuple
    trace: str
    cause: str
    cpu: tuple  # factor, least, most
    memory: tuple
    network: tuple  # factor, least
    disk: tuple
    load: tuple
    latency: tuple
    p50: float
    p95: tuple  # least gap, factor, more when hit
    p99: tuple
    egress: float
    http: tuple  # 2xx calm, hit; 4xx; 5xx calm, hit
    connections: float
    query: tuple  # least, factor, more when hit
    slow: tuple  # edge, slope
    locks: tuple
    orders: tuple  # least, calm, hit
    price: float
    checkout: tuple  # calm, hit
    abandonment: tuple


#: Fixed values of the four matrix tiers.
MEDIUM = Matrix("2026-09-10", 5, (CHECKOUT, PAYMENT, ORDER, INVENTORY), "tr-real-md-%06d", "Real SMD Cluster Incident: ", (100.0, 2.0, 99.0), (100.0, 10.0, 98.0), (120.0, 1.0), (80.0, 0.5), (350.0, 20.0), (80.0, 5.0), 5.0, (12.0, 1.5, 0.0), (18.0, 2.2, 0.0), 0.7, (0.97, 0.97, 0.02, 0.01, 0.06), 1.5, (1.0, 0.4, 0.0), (75.0, 0.3), (85.0, 0.4), (2, 0.15, 0.15), 52.0, (96.0, 72.0), (3.5, 15.0))
LARGE = Matrix("2026-09-15", 2, (CHECKOUT, PAYMENT, ORDER, INVENTORY, AUTH), "tr-real-lg-%07d", "Enterprise Multi-Node Cluster Incident: ", (100.0, 1.5, 99.2), (100.0, 8.0, 98.5), (150.0, 2.0), (90.0, 1.0), (450.0, 25.0), (95.0, 4.0), 4.0, (10.0, 1.6, 0.0), (15.0, 2.4, 0.0), 0.75, (0.98, 0.98, 0.015, 0.005, 0.05), 1.6, (1.0, 0.35, 0.0), (75.0, 0.25), (85.0, 0.35), (1, 0.18, 0.18), 55.0, (96.5, 70.0), (3.0, 16.5))
LABELLED = Matrix("2026-09-22", 5, (CHECKOUT, ORDER), "tr-diff-md-%06d", "Ground-Truth Labeled Cluster Incident: ", (100.0, 2.0, 99.0), (80.0, 10.0, 98.5), (140.0, 1.5), (85.0, 0.8), (400.0, 25.0), (90.0, 6.0), 5.0, (15.0, 1.6, 60.0), (25.0, 2.4, 100.0), 0.7, (0.98, 0.80, 0.015, 0.005, 0.185), 1.7, (1.5, 0.4, 0.0), (75.0, 0.35), (80.0, 0.5), (1, 0.16, 0.05), 55.0, (98.0, 54.0), (3.0, 37.0))
CASCADE = Matrix("2026-09-25", 2, (CHECKOUT, PAYMENT, ORDER, INVENTORY, AUTH), "tr-diff-lg-%07d", "Enterprise Cascading Cluster Incident: ", (100.0, 2.0, 99.2), (100.0, 10.0, 98.8), (160.0, 2.0), (95.0, 1.0), (500.0, 30.0), (100.0, 5.0), 4.0, (12.0, 1.7, 80.0), (20.0, 2.5, 140.0), 0.75, (0.98, 0.75, 0.015, 0.005, 0.235), 1.8, (1.0, 0.35, 25.0), (75.0, 0.3), (80.0, 0.5), (1, 0.17, 0.04), 58.0, (97.0, 44.0), (3.5, 47.5))


def at_least(x: Column, least: float) -> Column:
    return F.greatest(x, F.lit(float(least)))


def within(x: Column, least: float, most: float) -> Column:
    return F.least(at_least(x, least), F.lit(float(most)))


def beyond(x: Column, edge: float, slope: float) -> Column:
    """What x has beyond an edge, times a slope."""
    return at_least((x - edge) * slope, 0.0)


def whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def placed(df: DataFrame, services, start: str, step_s: int, trace: str) -> DataFrame:
    """B9 with the endpoint, the database and the trace id of each row."""
    dealt = assign_round_robin(df, [s[0] for s in services], start, step_s).withColumnRenamed("entity", "service_id")
    part = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in services]), (F.col("pos") % len(services) + 1).cast("int"))
    return dealt.withColumns({"endpoint": part(1), "db_instance_id": part(2), "trace_id": F.format_string(trace, F.col("pos").cast("long"))})


def finished(df: DataFrame, cause: str) -> DataFrame:
    """The columns of a snapshot in order, measures to two places; the cause names the label where the flag is set."""
    measures = ("_percent", "_mbps", "_sec", "_ms", "utilization", "_usd", "_rate")
    text = F.when(F.col("anomalous"), F.concat(F.lit(cause), F.col("label"))).alias("cause")
    return df.select(*[text if c == "cause" else F.round(c, 2).alias(c) if c.endswith(measures) else F.col(c) for c in COLUMNS])


def from_matrix(df: DataFrame, t: Matrix, rules, memory=None, demand=None, pool=None, hit=None) -> DataFrame:
    """df (pos, values, ...) by the values of a tier; rules label the columns cpu, memory and latency, and `hit` (the flag,
    if none is given) is what an incident's numbers depend on. memory adds to the scaled channel; demand multiplies cpu, network and load."""
    channel = lambda k, scale: F.col("values")[k] * scale[0]
    busy = (lambda x: x) if demand is None else (lambda x: x * demand)
    cpu = busy(channel(0, t.cpu)) if demand is None else busy(channel(0, t.cpu)) * 0.7
    raw = {
        "cpu": within(cpu, *t.cpu[1:]), "memory": within(channel(5, t.memory) if memory is None else channel(5, t.memory) + memory, *t.memory[1:]), "network": at_least(busy(channel(11, t.network)), t.network[1]),
        "disk": at_least(channel(19, t.disk), t.disk[1]), "load": at_least(busy(channel(1, t.load)), t.load[1]), "latency": at_least(channel(2, t.latency), t.latency[1]),
    }
    known = label_by_rules(placed(df, t.services, t.start, t.step_s, t.trace).withColumns(raw), rules)
    c = F.col
    known = known.withColumns({"hit": c("anomalous") if hit is None else hit, "pool": within(c("memory") * 0.9 if pool is None else pool, 5.0, 99.0), "p50": at_least(c("latency"), t.p50)})
    either = lambda calm, bad: F.when(c("hit"), bad).otherwise(calm) if calm != bad else F.lit(calm)
    gap = lambda g: at_least(c("latency") * g[1] + either(0.0, g[2]), g[0])
    known = known.withColumn("p95", c("p50") + gap(t.p95)).withColumn("p99", c("p95") + gap(t.p99)).withColumn("order_volume", F.greatest(F.lit(t.orders[0]).cast("long"), whole(c("load") * either(*t.orders[1:]))))
    return finished(known.withColumns({
        "cpu_percent": c("cpu"), "memory_percent": c("memory"), "disk_io_mbps": c("disk"), "network_egress_mbps": c("network") * t.egress, "network_ingress_mbps": c("network"), "requests_per_sec": c("load"),
        "latency_p50_ms": c("p50"), "latency_p95_ms": c("p95"), "latency_p99_ms": c("p99"), "http_2xx_count": whole(c("load") * either(*t.http[:2])), "http_4xx_count": whole(c("load") * t.http[2]), "http_5xx_count": whole(c("load") * either(*t.http[3:])),
        "active_connections": whole(at_least(c("pool") * t.connections, 5.0)), "connection_pool_utilization": c("pool"), "query_latency_mean_ms": at_least(c("latency") * t.query[1] + either(0.0, t.query[2]), t.query[0]),
        "slow_queries_per_sec": beyond(c("pool"), *t.slow), "row_lock_waits": whole(beyond(c("pool"), *t.locks)), "revenue_usd": c("order_volume") * t.price, "checkout_success_rate": either(*t.checkout), "cart_abandonment_rate": either(*t.abandonment),
    }), t.cause)


def cluster_rules(cpu: float, memory: float, latency: float):
    c = F.col
    return [(c("memory") > memory, "MEMORY_LEAK_GC_PAUSE", True), (c("latency") > latency, "CASCADING_THIRD_PARTY_FAILURE", True), (c("cpu") > cpu, "DB_CONNECTION_POOL_SATURATION", True)]


def tier_medium(df: DataFrame) -> DataFrame:
    """Df (pos, values) as snapshots of four services, five seconds apart."""
    return from_matrix(df, MEDIUM, cluster_rules(88.0, 92.0, 65.0), pool=F.col("memory") * 0.85)


def tier_large(df: DataFrame) -> DataFrame:
    """Df (pos, values), concatenated and repeated to size before, as snapshots of five services, two seconds apart."""
    return from_matrix(df, LARGE, cluster_rules(90.0, 93.0, 70.0))


def tier_labelled(df: DataFrame) -> DataFrame:
    """B6d: df (pos, values, marked, temperature): labelled failures, and thermal runaway beyond 95 degrees."""
    c, hot = F.col, F.col("temperature") > 95.0
    flag = c("marked") | hot
    rules = [(hot | (c("memory") > 92.0), "MEMORY_LEAK_GC_PAUSE", flag), (c("cpu") > 88.0, "DB_CONNECTION_POOL_SATURATION", flag), (c("marked"), "CASCADING_THIRD_PARTY_FAILURE", flag)]
    return from_matrix(df, LABELLED, [*rules], memory=F.least(c("temperature") / 100.0, F.lit(1.0)) * 20.0)


def tier_cascade(df: DataFrame) -> DataFrame:
    """B6e: df (pos, values, marked, demand): a labelled failure cascades in the checkout and order services alone."""
    c = F.col
    demand = within(c("demand") / 10000.0, 0.4, 2.5)
    cascade = c("marked") & c("service_id").isin(CHECKOUT[0], ORDER[0])
    flag = c("marked") | (c("cpu") > 90.0) | (c("memory") > 93.0)
    rules = [(cascade, "CASCADING_THIRD_PARTY_FAILURE", flag), (c("memory") > 93.0, "MEMORY_LEAK_GC_PAUSE", flag), (c("cpu") > 90.0, "DB_CONNECTION_POOL_SATURATION", flag), (demand > 1.8, "BLACK_FRIDAY_TRAFFIC_BURST", flag), (c("marked"), "NOMINAL", True)]
    return from_matrix(df, CASCADE, rules, demand=demand, pool=c("memory") * 0.75 + c("cpu") * 0.25, hit=cascade)


def tier_small(df: DataFrame) -> DataFrame:
    """Df (pos, cpu, pool, load, network), four aligned series, as snapshots of one service, ten seconds apart."""
    c = F.col
    raw = placed(df, (CHECKOUT,), "2026-09-01", 10, "tr-real-sm-%06d").withColumns({"cpu": within(c("cpu"), 1.0, 99.5), "pool": within(c("pool"), 5.0, 98.0), "load": at_least(c("load"), 10.0), "network": at_least(c("network") / 1000.0, 1.0)})
    flag = (c("cpu") > 85.0) | (c("pool") > 88.0)
    known = label_by_rules(raw, [(c("pool") > 88.0, "DB_CONNECTION_POOL_SATURATION", flag), (c("load") > 800.0, "BLACK_FRIDAY_TRAFFIC_BURST", flag), (c("cpu") > 85.0, "MEMORY_LEAK_GC_PAUSE", flag)])
    either = lambda calm, bad: F.when(c("anomalous"), bad).otherwise(calm)
    known = known.withColumn("p50", at_least(20.0 + c("cpu") * 0.4, 10.0)).withColumn("p95", c("p50") + at_least(30.0 + c("pool") * 0.8, 15.0)).withColumn("order_volume", F.greatest(F.lit(5).cast("long"), whole(c("load") * 0.2)))
    return finished(known.withColumns({
        "cpu_percent": c("cpu"), "memory_percent": F.least(F.lit(99.0), 40.0 + c("cpu") * 0.4), "disk_io_mbps": at_least(c("network") * 0.3, 2.0), "network_egress_mbps": at_least(c("network") * 0.8, 5.0), "network_ingress_mbps": c("network"),
        "requests_per_sec": c("load"), "latency_p50_ms": c("p50"), "latency_p95_ms": c("p95"), "latency_p99_ms": c("p95") + at_least(50.0 + c("pool") * 1.2, 25.0), "http_2xx_count": whole(c("load") * 0.98), "http_4xx_count": whole(c("load") * 0.015),
        "http_5xx_count": whole(c("load") * either(0.005, 0.05)), "active_connections": whole(within(c("pool") * 1.8, 10.0, 200.0)), "connection_pool_utilization": c("pool"), "query_latency_mean_ms": at_least(c("pool") * 0.3, 1.5),
        "slow_queries_per_sec": beyond(c("pool"), 70.0, 0.2), "row_lock_waits": whole(beyond(c("pool"), 80.0, 0.5)), "revenue_usd": c("order_volume") * 48.5, "checkout_success_rate": either(95.0, 75.0), "cart_abandonment_rate": either(3.0, 17.5),
    }), "Real AWS Telemetry Incident: ")


def tier_bids(df: DataFrame) -> DataFrame:
    """Df (pos, bid, occupancy): a crash below a bid of 0.05, a surge above 1.2 or an occupancy of 0.35."""
    c = F.col
    crash, surge = c("bid") < 0.05, (c("bid") > 1.2) | (c("occupancy") > 0.35)
    known = label_by_rules(placed(df, (GATEWAY,), "2026-09-20", 5, "tr-diff-sm-%06d"), [(crash, "PAYMENT_GATEWAY_OUTAGE", True), (surge, "BLACK_FRIDAY_TRAFFIC_BURST", True)])
    known = known.withColumns({"load": at_least(200.0 + c("occupancy") * 800.0 + c("bid") * 150.0, 10.0), "pool": within(30.0 + c("occupancy") * 140.0, 8.0, 99.0), "p50": at_least(15.0 + c("occupancy") * 60.0, 8.0), "success": F.when(crash, 24.0).when(surge, 84.0).otherwise(98.5)})
    more = lambda x: F.when(crash, x).otherwise(0.0)
    known = known.withColumn("p95", c("p50") + at_least(45.0 + c("bid") * 80.0 + more(100.0), 20.0)).withColumn("order_volume", F.greatest(F.lit(0).cast("long"), whole(c("load") * F.when(crash, 0.01).otherwise(0.18 + c("bid") * 0.05))))
    return finished(known.withColumns({
        "cpu_percent": within(25.0 + c("occupancy") * 120.0 + c("bid") * 25.0, 5.0, 99.0), "memory_percent": within(35.0 + c("occupancy") * 90.0, 15.0, 98.0), "disk_io_mbps": at_least(c("bid") * 45.0, 1.0), "network_egress_mbps": at_least(c("load") * 0.4, 5.0), "network_ingress_mbps": at_least(c("load") * 0.6, 8.0),
        "requests_per_sec": c("load"), "latency_p50_ms": c("p50"), "latency_p95_ms": c("p95"), "latency_p99_ms": c("p95") + at_least(75.0 + c("bid") * 120.0 + more(150.0), 35.0), "http_2xx_count": whole(c("load") * (c("success") / 100.0)), "http_4xx_count": whole(c("load") * 0.01), "http_5xx_count": whole(c("load") * (1.0 - c("success") / 100.0)),
        "active_connections": whole(at_least(c("pool") * 1.8, 10.0)), "connection_pool_utilization": c("pool"), "query_latency_mean_ms": at_least(c("occupancy") * 50.0, 2.0), "slow_queries_per_sec": beyond(c("pool"), 70.0, 0.4), "row_lock_waits": whole(beyond(c("pool"), 80.0, 0.6)),
        "revenue_usd": c("order_volume") * at_least(c("bid") * 120.0, 15.0), "checkout_success_rate": c("success"), "cart_abandonment_rate": F.least(F.lit(85.0), 100.0 - c("success")),
    }), "High-Volatility Bidding Anomaly: ")
