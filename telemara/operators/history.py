"""Incident history as tables, recall and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_incidents(current: DataFrame, changes: DataFrame, key="incident_id") -> DataFrame:
    """Insert new incidents; on conflict the status, cause and confidence change, the first title stays."""
    a, b = current.alias("a"), changes.alias("b")
    final = F.col("b.status").isin("RESOLVED", "REMEDIATION_EXECUTED")
    pick = {
        key: F.coalesce(f"a.{key}", f"b.{key}"), "title": F.coalesce("a.title", "b.title"), "severity": F.coalesce("a.severity", "b.severity"), "detected_at": F.coalesce("a.detected_at", "b.detected_at"),
        "status": F.coalesce("b.status", "a.status"), "confidence": F.coalesce("b.confidence", "a.confidence"), "postmortem": F.coalesce("b.postmortem", "a.postmortem"),
        "resolved_at": F.when(F.col(f"b.{key}").isNull(), F.col("a.resolved_at")).when(final, F.coalesce("b.resolved_at", "a.resolved_at")).otherwise(F.col("a.resolved_at")),
    }
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*[v.alias(k) for k, v in pick.items()])


def replace_children(current: DataFrame, changes: DataFrame, parent="incident_id") -> DataFrame:
    """The children of an incident are replaced if the changes bring any for it."""
    return current.join(changes.select(parent).distinct(), parent, "left_anti").unionByName(changes)


def incident_detail(inc: DataFrame, children: dict[str, DataFrame], key="incident_id") -> DataFrame:
    """An incident with an array for each kind of child."""
    for name, df in children.items():
        rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name))
        inc = inc.join(rows, key, "left")
    return inc


def similar_incidents(inc: DataFrame, rem: DataFrame, probes: DataFrame, limit=5) -> DataFrame:
    """For each probe (probe_id, service_id) the newest incidents of its service with their latest remediation.

    A probe may name a metric or an archetype too; where it is not null, an incident must have the same.
    """
    last = rem.withColumn("i", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.col("at").desc(), "action"))).where("i = 1").select("incident_id", "action")
    w = Window.partitionBy("probe_id").orderBy(F.col("detected_at").desc(), F.col("incident_id").desc())
    both = probes.join(inc.select("*", *[F.col(c).alias(f"own_{c}") for c in ("metric", "archetype") if c in inc.columns]).drop("metric", "archetype"), "service_id")
    for c in ("metric", "archetype"):
        if c in probes.columns:
            both = both.where(F.col(c).isNull() | (F.col(c) == F.col(f"own_{c}"))).drop(c)
    near = both.drop("own_metric", "own_archetype").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return near.join(last, "incident_id", "left")


def recent_incidents(inc: DataFrame, n=50) -> DataFrame:
    """G14."""
    return inc.orderBy(F.col("detected_at").desc(), F.col("incident_id").desc()).limit(n)


def recall_experience(similar: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """For each probe the remediations of its similar incidents by frequency, and a warning from two episodes on;
    with matches (probe_id, id, grade, rank) of the memory also those, best first. A probe needs either to have a row."""
    by = similar.where("action is not null").groupBy("probe_id", "action").agg(F.count("*").alias("n"))
    ranked = by.groupBy("probe_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "action"))), lambda s: s["action"]), ",").alias("actions"))
    episodes = similar.groupBy("probe_id").agg(F.count("*").alias("episodes"))
    known = episodes.join(ranked, "probe_id", "left")
    if matches is not None:
        text = F.concat_ws(":", F.col("id").cast("string"), "grade")
        found = matches.groupBy("probe_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda m: m["t"]), ",").alias("memories"))
        known = known.join(found, "probe_id", "full").withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    return known.withColumn("recurring", F.col("episodes") >= 2)


def active_investigations(states: DataFrame, now: int, ttl_s=86_400, key="incident_id") -> DataFrame:
    """The latest state of each incident, unless it expired or was resolved."""
    last = states.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(F.col("epoch").desc(), "status"))).where("i = 1").drop("i")
    return last.where((F.col("epoch") > now - ttl_s) & (F.col("status") != "RESOLVED"))


def patch_state(states: DataFrame, patches: DataFrame, key="incident_id") -> DataFrame:
    """Each column of a patch that is not null replaces the state's."""
    cols = [c for c in states.columns if c != key]
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in cols if c in patches.columns])
    return states.join(p, key, "left").select(key, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in patches.columns else F.col(c) for c in cols])


def rag_scenario_eval(df: DataFrame) -> DataFrame:
    """Faithfulness, context precision, recall and action match of each scenario, and its gate."""
    n = F.size("citations")
    precision = F.coalesce(F.try_divide(F.size(F.filter("citations", lambda c: F.exists("expected_terms", lambda t: F.lower(c).contains(t)))) * 1.0, n), F.lit(0.0))
    out = df.withColumns({"context_precision": precision, "context_recall": F.when(n > 0, F.when(precision > 0, 1.0).otherwise(0.5)).otherwise(0.5), "action_match": F.array_contains("expected_actions", F.col("action")).cast("double")})
    return out.withColumn("passed", (F.col("grounding") >= 0.95) & (F.col("context_precision") >= 0.70) & (F.col("context_recall") >= 0.80) & (F.col("action_match") == 1))


def rag_macro_eval(df: DataFrame) -> DataFrame:
    """Means over scenarios and whether all passed."""
    return df.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("grounding", "context_precision", "context_recall", "action_match")], F.bool_and("passed").alias("all_passed"))
