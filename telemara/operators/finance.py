"""H: incident costs, savings and the star schema's views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ordered_rules


@dataclass(frozen=True)
class Assumptions:
    critical: float = 180_000.0
    high: float = 120_000.0
    medium: float = 25_000.0
    low: float = 5_000.0
    baseline_minutes: float = 90.0
    open_minutes: float = 22.0
    false_minutes: float = 5.0
    engineers: float = 3.0
    engineer_hour: float = 95.0
    realised: float = 0.25
    platform_cost: float = 15_000.0


def incident_financials(incidents: DataFrame, a: Assumptions = Assumptions()) -> DataFrame:
    """H1: minutes, cost and savings of each incident; every amount rounded to cents.

    A false positive counts five minutes and no cost, but is credited with its whole baseline cost; an open incident
    counts the assumed minutes; unknown severities are MEDIUM, a missing archetype is unclassified_anomaly.
    """
    known = F.upper(F.coalesce("severity", F.lit("MEDIUM")))
    fp = F.coalesce("is_false_positive", F.lit(False))
    base = F.coalesce("baseline_mttr", F.lit(a.baseline_minutes)) if "baseline_mttr" in incidents.columns else F.lit(a.baseline_minutes)
    took = (F.col("resolved_at").cast("timestamp").cast("double") - F.col("detected_at").cast("timestamp").cast("double")) / 60
    df = incidents.withColumns({"severity": F.when(known.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), known).otherwise("MEDIUM"), "archetype": F.coalesce("archetype", F.lit("unclassified_anomaly")), "is_false_positive": fp, "b": base})
    df = df.withColumn("m", F.when(fp, a.false_minutes).when(F.col("resolved_at").isNotNull(), F.greatest(F.lit(1.0), took)).otherwise(a.open_minutes))
    df = df.withColumn("r", F.when(fp, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("b") - F.col("m"))))
    df = df.withColumn("rate", ordered_rules([(F.col("severity") == "CRITICAL", a.critical), (F.col("severity") == "HIGH", a.high), (F.col("severity") == "MEDIUM", a.medium)], a.low))
    df = df.withColumns({"bc": F.col("b") / 60 * F.col("rate"), "ac": F.when(fp, 0.0).otherwise(F.col("m") / 60 * F.col("rate")), "h": F.when(fp, 0.0).otherwise(F.col("r") / 60 * a.engineers)})
    df = df.withColumn("s", F.greatest(F.lit(0.0), F.col("bc") - F.col("ac"))).withColumn("g", F.col("s") + F.col("h") * a.engineer_hour)
    names = {"baseline_mttr_minutes": "b", "actual_mttr_minutes": "m", "mttr_reduction_minutes": "r", "hourly_downtime_rate": "rate", "baseline_downtime_cost": "bc", "actual_downtime_cost": "ac", "downtime_savings_gross": "s", "engineering_hours_saved": "h", "total_gross_value_delivered": "g"}
    money = {k: F.round(v, 2) for k, v in names.items()} | {"engineering_cost_saved": F.round(F.col("h") * a.engineer_hour, 2), "realized_net_savings": F.round(F.col("g") * a.realised, 2)}
    keep = [c for c in incidents.columns if c != "baseline_mttr"]
    return df.select(*keep, *[v.alias(k) for k, v in money.items()])


def executive_kpis(fin: DataFrame, a: Assumptions = Assumptions()) -> DataFrame:
    """H2: the one row of headline figures. Resolved counts no false positive. Where all are false positives the assumed
    minutes of an open incident stand for the mean; an empty input gives zeros, no return and a payback of 999 days."""
    real, none = ~F.col("is_false_positive"), F.count("*") == 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    base = F.coalesce(F.avg(F.when(real, F.col("baseline_mttr_minutes"))), F.lit(a.baseline_minutes))
    took = F.when(none, 0.0).otherwise(F.coalesce(F.avg(F.when(real, F.col("actual_mttr_minutes"))), F.lit(a.open_minutes)))
    less = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), base - took))
    net = total("realized_net_savings")
    figures = {
        "false_positive_pct": F.coalesce(F.try_divide(F.count_if("is_false_positive") * 100.0, F.count("*")), F.lit(0.0)), "baseline_mttr": base, "actual_mttr": took, "mttr_reduction": less,
        "mttr_reduction_pct": F.coalesce(F.try_divide(less * 100, base), F.lit(0.0)), "hours_saved": total("engineering_hours_saved"), "labour_saved": total("engineering_cost_saved"), "downtime_savings": total("downtime_savings_gross"),
        "gross_value": total("total_gross_value_delivered"), "net_savings": net, "platform_cost": F.lit(a.platform_cost), "roi_pct": F.when(none, 0.0).otherwise((net - a.platform_cost) * 100 / a.platform_cost),
    }
    counts = {"total_incidents": F.count("*"), "resolved_incidents": F.count_if((F.col("status") == "RESOLVED") & real), "false_positives": F.count_if("is_false_positive")}
    payback = F.when(net > 0, F.round(F.try_divide(F.lit(a.platform_cost * 365), net), 1)).otherwise(999.0)
    return fin.agg(*[v.alias(k) for k, v in counts.items()], *[F.round(v, 2).alias(k) for k, v in figures.items()], payback.alias("payback_days"))


def service_impact(fin: DataFrame) -> DataFrame:
    """H3: incidents, downtime, availability and savings of each service."""
    down = F.coalesce(F.sum(F.when(~F.col("is_false_positive"), F.col("actual_mttr_minutes"))), F.lit(0.0))
    share = F.greatest(F.lit(99.0), F.least(F.lit(99.99), 100 - down / 525600 * 100))
    return fin.groupBy("service_id").agg(F.count("*").alias("incidents"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.round(down, 2).alias("downtime_minutes"), F.round(share, 4).alias("availability_pct"), F.round(F.sum("downtime_savings_gross"), 2).alias("savings"), F.round(F.avg(F.when(~F.col("is_false_positive"), F.col("actual_mttr_minutes"))), 2).alias("mean_mttr"))


def monthly_trend(fin: DataFrame) -> DataFrame:
    """H4: incidents by severity, hours and savings of each month."""
    return fin.groupBy(F.date_format("detected_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("incidents"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], F.round(F.sum("engineering_hours_saved"), 2).alias("hours_saved"), F.round(F.sum("total_gross_value_delivered"), 2).alias("gross_value"))


def archetype_pareto(fin: DataFrame) -> DataFrame:
    """H5: share, cost, savings and mean reduction of each archetype."""
    by = fin.groupBy("archetype").agg(F.count("*").alias("incidents"), F.round(F.sum("baseline_downtime_cost"), 2).alias("cost"), F.round(F.sum("downtime_savings_gross"), 2).alias("savings"), F.round(F.avg("mttr_reduction_minutes"), 2).alias("mean_reduction"))
    return by.withColumn("pct", F.round(F.col("incidents") * 100.0 / F.sum("incidents").over(Window.partitionBy(F.lit(0))), 2))


def pareto_cumulative(pareto: DataFrame) -> DataFrame:
    """H6: cumulative share of savings, largest first; one row an archetype."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("savings").desc(), "archetype").rowsBetween(Window.unboundedPreceding, 0)
    return pareto.select("archetype", "savings", F.round(F.sum("savings").over(w) * 100 / F.sum("savings").over(Window.partitionBy(F.lit(0))), 4).alias("cumulative_pct"))


def dim_date(spark: SparkSession, start: str, end: str) -> DataFrame:
    """H7: a calendar."""
    d = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d"))
    return d.select(F.date_format("d", "yyyyMMdd").cast("int").alias("date_key"), F.year("d").alias("year"), F.quarter("d").alias("quarter"), F.month("d").alias("month"), F.dayofmonth("d").alias("day"), F.weekofyear("d").alias("week"), (F.dayofweek("d").isin(1, 7)).alias("is_weekend"))


VIEWS = {
    "view_executive_summary": """select count(*) as total, sum(case when status = 'RESOLVED' then 1 else 0 end) as resolved, round(sum(case when is_false_positive then 1 else 0 end) * 100.0 / count(*), 2) as fp_pct,
        round(avg(case when not is_false_positive then actual_mttr_minutes end), 2) as mttr, round(sum(downtime_savings_gross), 2) as savings, round(sum(realized_net_savings), 2) as net from fact""",
    "view_service_exposure": """select d.service_id, count(f.id) as incidents, round(avg(f.actual_mttr_minutes), 2) as mttr, round(sum(f.downtime_savings_gross), 2) as savings,
        greatest(99.0, round(100 - sum(case when f.is_false_positive then 0 else f.actual_mttr_minutes end) / 525600 * 100, 4)) as availability from dim_service d left join fact f on f.service_id = d.service_id group by d.service_id""",
    "view_monthly_roi": """select d.year, d.month, count(*) as incidents, round(sum(f.total_gross_value_delivered), 2) as gross, round(sum(f.realized_net_savings), 2) as net
        from fact f join dim_date d on d.date_key = f.date_key group by d.year, d.month""",
    "view_archetype_pareto": """select archetype, count(*) as incidents, round(count(*) * 100.0 / (select count(*) from fact), 2) as pct, round(sum(downtime_savings_gross), 2) as savings from fact group by archetype""",
}


def view(spark: SparkSession, name: str) -> DataFrame:
    """A BI view over the temp views fact, dim_service and dim_date."""
    return spark.sql(VIEWS[name])


def bi_measures(fin: DataFrame) -> DataFrame:
    """Card measures in one row."""
    n, fp = F.count("*"), F.count_if("is_false_positive")
    sums = {"total_gross": "total_gross_value_delivered", "total_net": "realized_net_savings", "total_downtime_savings": "downtime_savings_gross", "total_hours": "engineering_hours_saved", "total_labour": "engineering_cost_saved", "baseline_cost": "baseline_downtime_cost", "actual_cost": "actual_downtime_cost"}
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counts = {s.lower() + "_incidents": F.count_if(F.col("severity") == s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}
    return fin.agg(n.alias("incidents"), fp.alias("false_positives"), F.count_if(F.col("status") == "RESOLVED").alias("resolved"), *[F.round(F.sum(c), 2).alias(k) for k, c in sums.items()], *[v.alias(k) for k, v in counts.items()], F.round(div(fp * 100.0, n), 2).alias("fp_rate"), F.round(div(F.sum("total_gross_value_delivered"), n), 2).alias("value_per_incident"), F.round(div(F.count_if(F.col("status") == "RESOLVED") * 100.0, n), 2).alias("resolution_rate"))


def denormalised_fact(fact: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """The fact with its dimensions; rows without a partner stay."""
    for dim, key in dims:
        fact = fact.join(dim, key, "left")  # Spark broadcasts a dimension that it sees to be small
    return fact


def tableau_fields(fin: DataFrame) -> DataFrame:
    """Distinct counts and conditional means; net is taken from the rounded gross."""
    return fin.agg(F.count_distinct("service_id").alias("services"), F.count_distinct(F.when(F.col("severity") == "CRITICAL", F.col("id"))).alias("critical_ids"), F.round(F.avg(F.when(~F.col("is_false_positive"), F.col("mttr_reduction_minutes"))), 4).alias("mean_reduction"), F.round(F.sum("total_gross_value_delivered") * 0.25, 2).alias("net_at_aggregate"))


def filter_incidents(fin: DataFrame, severity: str | None = None, service: str | None = None) -> DataFrame:
    """H15."""
    fin = fin if severity is None else fin.where(F.col("severity") == severity)
    return fin if service is None else fin.where(F.col("service_id") == service)


def financial_impact(kpi: DataFrame, a: Assumptions = Assumptions()) -> DataFrame:
    """The money part of the KPIs with the hourly rates."""
    return kpi.select("downtime_savings", "gross_value", "net_savings", "roi_pct", "payback_days", *[F.lit(getattr(a, s)).alias(f"rate_{s}") for s in ("critical", "high", "medium", "low")])


def realisation_what_if(fin: DataFrame, rates=tuple(i / 10 for i in range(1, 11)), a: Assumptions = Assumptions()) -> DataFrame:
    """Net, ROI and payback at each realisation rate."""
    gross = fin.agg(F.coalesce(F.sum("total_gross_value_delivered"), F.lit(0.0)).alias("gross"))
    net = F.col("gross") * F.col("rate")
    return gross.select("gross", F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("rate")).select("rate", F.round(net, 2).alias("net"), F.round((net - a.platform_cost) * 100 / a.platform_cost, 2).alias("roi_pct"), F.when(net > 0, F.round(a.platform_cost * 365 / net, 4)).otherwise(999.0).alias("payback_days"))


def period_filter(fin: DataFrame, days: int) -> DataFrame:
    """The incidents of the last `days` days before the latest one."""
    last = fin.agg(F.max(F.to_date("detected_at")).alias("last"))
    return fin.join(F.broadcast(last), F.to_date("detected_at") >= F.date_sub("last", days)).drop("last")  # one row


def stage_waterfall(events: DataFrame, keys, stage, ts) -> DataFrame:
    """Mean minutes from each stage to the next of the same incident."""
    t = F.col(ts).cast("timestamp").cast("double")
    gap = events.withColumn("t", t).withColumn("minutes", (F.lead("t").over(Window.partitionBy(*keys).orderBy("t", stage)) - F.col("t")) / 60)
    return gap.where("minutes is not null").groupBy(stage).agg(F.count("*").alias("n"), F.round(F.avg("minutes"), 4).alias("mean_minutes"))
