"""B: flattening, unpivoting, aligning and labelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import error_rate, ordered_rules

#: The thirteen named metrics of a snapshot.
METRICS = (
    "infra_cpu_percent", "infra_memory_percent", "infra_disk_io_mbps", "infra_network_egress_mbps", "app_requests_per_sec", "app_latency_p50_ms", "app_latency_p95_ms", "app_latency_p99_ms", "app_error_rate",
    "db_pool_utilization", "db_query_latency_ms", "biz_order_volume", "biz_checkout_success_rate",
)


def flatten_snapshots(df: DataFrame) -> DataFrame:
    """B1: nested snapshots as flat columns; a null cause becomes empty."""
    part = lambda group, short: [F.col(f"{group}.{f}").alias(f"{short}_{f}") for f in df.schema[group].dataType.fieldNames()]
    app = error_rate(F.col("application.http_2xx_count"), F.col("application.http_4xx_count"), F.col("application.http_5xx_count")).alias("app_error_rate")
    return df.select("timestamp", "trace_id", "service_id", *part("infrastructure", "infra"), *part("application", "app"), app, *part("database", "db"), *part("business", "biz"), F.coalesce("ground_truth_label", F.lit("NOMINAL")).alias("ground_truth_label"), F.coalesce("ground_truth_anomalous", F.lit(False)).alias("ground_truth_anomalous"), F.coalesce("simulated_root_cause", F.lit("")).alias("simulated_root_cause"))


def metrics_long(df: DataFrame, ids, metrics=METRICS) -> DataFrame:
    """One row for each metric of a snapshot."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(ids), list(metrics), "metric", "value")


def align_by_position(*dfs: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of the same position side by side, as far as the shortest goes."""
    return reduce(lambda a, b: a.join(b, pos), dfs)


def join_cyclic(df: DataFrame, short: DataFrame, pos: str = "pos") -> DataFrame:
    """Row i with row i mod n of a shorter series."""
    n = max(1, short.count())
    return df.withColumn("_m", F.col(pos) % n).join(short.withColumnRenamed(pos, "_m"), "_m").drop("_m")


def assign_round_robin(df: DataFrame, entities, start: str, step_s: int, pos: str = "pos") -> DataFrame:
    """Row i belongs to entity i mod k, at step i div k."""
    k = len(entities)
    entity = F.element_at(F.array(*[F.lit(e) for e in entities]), (F.col(pos) % k + 1).cast("int"))
    at = (F.unix_timestamp(F.lit(start).cast("timestamp")) + F.floor(F.col(pos) / k) * step_s).cast("long")
    return df.withColumns({"entity": entity, "step": F.floor(F.col(pos) / k), "epoch": at})


def repeat_to_size(df: DataFrame, target: int, pos: str = "pos") -> DataFrame:
    """Copies one after another up to `target` rows."""
    n = df.count()
    copies = -(-target // n) if n else 0
    return df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(max(0, copies - 1))))).withColumn(pos, F.col(pos) + F.col("_c") * n).where(F.col(pos) < target).drop("_c")


def label_by_rules(df: DataFrame, rules, default=("NOMINAL", False)) -> DataFrame:
    """Label and flag of the first predicate that holds."""
    return df.withColumns({"label": ordered_rules([(p, a) for p, a, _ in rules], default[0]), "anomalous": ordered_rules([(p, f) for p, _, f in rules], default[1])})


def concatenate(*dfs: DataFrame, pos: str = "pos") -> DataFrame:
    """Series one after another: the positions of each go on from the end of the one before."""
    out, before = None, 0
    for df in dfs:
        moved = df.withColumn(pos, F.col(pos) + before)
        out, before = (moved if out is None else out.unionByName(moved)), before + df.count()
    return out
