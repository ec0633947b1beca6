"""C: data contracts and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running

SCHEMA, CROSS, BOUNDS, MONOTONIC = "SCHEMA_VALIDATION_FAILED", "CROSS_FIELD_INVARIANT_VIOLATION", "BOUNDS_OUT_OF_RANGE", "TIMESTAMP_NON_MONOTONIC"


def check_schema(required=(), ranges=None) -> Column:
    """The names of fields that are missing or out of their range, as a message; null if there is none."""
    checks = [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    for c, (low, high) in (ranges or {}).items():
        bad = F.col(c) < low if high is None else (F.col(c) < low) | (F.col(c) > high)
        checks.append(F.when(bad, F.lit(c)))
    failed = F.array_compact(F.array(*checks))
    return F.when(F.size(failed) > 0, F.concat(F.lit("fields: "), F.array_join(failed, ",")))


PERCENT, POSITIVE, COUNT, TEXT = ("double", 0.0, 100.0), ("double", 0.0, None), ("bigint", 0.0, None), ("string", None, None)
#: Kind and range of each field of a snapshot; a star marks what may be missing.
PAYLOAD = {
    "timestamp": ("timestamp", None, None), "trace_id": TEXT, "service_id": TEXT,
    "infrastructure": {"cpu_percent": PERCENT, "memory_percent": PERCENT, "disk_io_mbps": POSITIVE, "network_egress_mbps": POSITIVE, "network_ingress_mbps": POSITIVE},
    "application": {"service_id": ("string", 2, 64), "endpoint": TEXT, "requests_per_sec": POSITIVE, "latency_p50_ms": POSITIVE, "latency_p95_ms": POSITIVE, "latency_p99_ms": POSITIVE, "http_2xx_count*": COUNT, "http_4xx_count*": COUNT, "http_5xx_count*": COUNT},
    "database": {"db_instance_id": TEXT, "active_connections": COUNT, "connection_pool_utilization": PERCENT, "query_latency_mean_ms": POSITIVE, "slow_queries_per_sec*": POSITIVE, "row_lock_waits*": COUNT},
    "business": {"order_volume": COUNT, "revenue_usd": POSITIVE, "checkout_success_rate": PERCENT, "cart_abandonment_rate": PERCENT},
}


def check_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """C1 on raw JSON: df plus error_code and error_message. Text that is no JSON object is an UNKNOWN_ERROR; a field that is
    missing, of the wrong type, out of its range or of the wrong length fails the schema, and the message names it."""
    plain = lambda fields: ", ".join(f"`{k.rstrip('*')}`: {f'struct<{plain(v)}>' if isinstance(v, dict) else 'string'}" for k, v in fields.items())
    parsed = df.withColumn("parsed_", F.from_json(payload, f"struct<{plain(PAYLOAD)}, `_corrupt`: string>", {"columnNameOfCorruptRecord": "_corrupt"}))
    failed = []

    def check(fields, path):
        for name, rule in fields.items():
            spot = f"{path}.{name.rstrip('*')}"
            if isinstance(rule, dict):
                check(rule, spot)
                continue
            kind, low, high = rule
            text = F.col(f"parsed_{spot}")
            value = text if kind == "string" else text.try_cast(kind)
            bad = F.lit(False) if name.endswith("*") else text.isNull()
            bad = bad | (text.isNotNull() & value.isNull())
            measure = F.length(text) if kind == "string" else value
            for edge, beyond in ((low, lambda x, e: x < e), (high, lambda x, e: x > e)):
                bad = bad if edge is None else bad | F.coalesce(beyond(measure, edge), F.lit(False))
            failed.append(F.when(bad, F.lit(spot[1:])))

    check(PAYLOAD, "")
    names = parsed.withColumn("failed_", F.array_compact(F.array(*failed)))
    broken = F.col("parsed_").isNull() | F.col("parsed_._corrupt").isNotNull()
    code = F.when(broken, "UNKNOWN_ERROR").when(F.size("failed_") > 0, SCHEMA)
    message = F.when(broken, "the payload is no JSON object").when(F.size("failed_") > 0, F.concat(F.lit("fields: "), F.array_join("failed_", ",")))
    return names.withColumns({"error_code": code, "error_message": message}).drop("parsed_", "failed_")


def check_latency_order(p50="p50", p95="p95", p99="p99") -> Column:
    """The three percentiles must not fall."""
    bad = (F.col(p50) > F.col(p95)) | (F.col(p95) > F.col(p99))
    return F.when(bad, F.format_string("p50=%.2f p95=%.2f p99=%.2f", F.col(p50), F.col(p95), F.col(p99)))


def check_bounds(bounds: dict) -> Column:
    """The first column outside its bounds."""
    return F.coalesce(*[F.when((F.col(c) < low) | (F.col(c) > high), F.lit(c)) for c, (low, high) in bounds.items()])


def check_monotonic(df: DataFrame, keys, ts, order, passed: Column) -> DataFrame:
    """C4: df plus `late`: rows that passed and are older than an accepted row before them.

    The mark is the largest time among the earlier rows that passed the other checks: a late row is older than it and
    cannot raise it, so it needs no state. It is scanned in ranges, so a service of any size is many tasks.
    """
    marked = running(df, keys, order, {"mark": ("max", F.when(passed, F.col(ts)))})
    return marked.withColumn("late", passed & F.coalesce(F.col(ts) < F.col("mark"), F.lit(False)))


def judged(df: DataFrame, keys, ts, order, required, ranges, bounds) -> DataFrame:
    """Df plus error_code and error_message of the first check that fails (schema, order, bounds, time)."""
    c1, c2, c3 = check_schema(required, ranges), check_latency_order(), check_bounds(bounds)
    marked = df.withColumns({"m1": c1, "m2": c2, "m3": c3})
    fine = F.col("m1").isNull() & F.col("m2").isNull() & F.col("m3").isNull()
    timed = check_monotonic(marked, keys, ts, order, fine)
    code = F.when(F.col("m1").isNotNull(), SCHEMA).when(F.col("m2").isNotNull(), CROSS).when(F.col("m3").isNotNull(), BOUNDS).when(F.col("late"), MONOTONIC)
    message = F.coalesce("m1", "m2", "m3", F.when(F.col("late"), F.concat(F.col(ts).cast("string"), F.lit(" < "), F.col("mark").cast("string"))))
    return timed.withColumns({"error_code": code, "error_message": message}).drop("m1", "m2", "m3", "late", "mark")


def judged_rows(df: DataFrame, required, ranges, bounds) -> DataFrame:
    """C6 by C1 to C3 alone, which need no other row: df plus error_code and error_message."""
    marked = df.withColumns({"m1": check_schema(required, ranges), "m2": check_latency_order(), "m3": check_bounds(bounds)})
    code = F.when(F.col("m1").isNotNull(), SCHEMA).when(F.col("m2").isNotNull(), CROSS).when(F.col("m3").isNotNull(), BOUNDS)
    return marked.withColumns({"error_code": code, "error_message": F.coalesce("m1", "m2", "m3")}).drop("m1", "m2", "m3")


def split_quarantine(checked: DataFrame, ids) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and envelopes of the rejected with their payload as JSON and the time of their rejection."""
    valid = checked.where("error_code is null").drop("error_code", "error_message")
    payload = F.to_json(F.struct(*[c for c in checked.columns if not c.startswith("error_")]))
    return valid, checked.where("error_code is not null").select(*ids, "error_code", "error_message", payload.alias("raw_payload"), F.current_timestamp().alias("quarantined_at"))


def compliance_report(checked: DataFrame, by) -> DataFrame:
    """Evaluated, valid, violations and share of valid rows."""
    ok = F.count_if(F.col("error_code").isNull())
    return checked.groupBy(*by).agg(F.count("*").alias("evaluated"), ok.alias("valid"), F.count_if(F.col("error_code").isNotNull()).alias("violations"), F.round(ok * 100.0 / F.count("*"), 2).alias("compliance_pct"))
