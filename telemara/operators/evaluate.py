"""E: evaluation, gates, registry and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import settled
from .scan import ranked_values

LIMITS = {"precision": (">=", 0.90), "recall": (">=", 0.88), "false_positive_rate": ("<=", 0.025), "p99_ms": ("<", 15.0)}


def classification_report(df: DataFrame, y, yhat, classes) -> DataFrame:
    """Precision, recall, F1 and support of each class; a zero denominator gives 0."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], df.select(F.col(y).alias("class")).schema)
    counts = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("p")).agg(F.count("*").alias("n"))
    tp = counts.where("y = p").select(F.col("y").alias("class"), F.col("n").alias("tp"))
    sup = counts.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"))
    got = counts.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("got"))
    j = names.join(tp, "class", "left").join(sup, "class", "left").join(got, "class", "left").na.fill(0, ["tp", "support", "got"])
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = div(F.col("tp") * 1.0, F.col("got")), div(F.col("tp") * 1.0, F.col("support"))
    return j.select("class", p.alias("precision"), r.alias("recall"), div(2 * p * r, p + r).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """The macro and the weighted averages of a classification report, as rows of their own."""
    total = F.sum("support")
    mean = lambda c: {"macro": F.avg(c), "weighted": F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), F.lit(0.0))}
    rows = [F.struct(F.lit(k).alias("class"), *[mean(c)[k].alias(c) for c in ("precision", "recall", "f1")], total.alias("support")) for k in ("macro", "weighted")]
    return report.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def confusion_matrix(df: DataFrame, y, yhat, classes) -> DataFrame:
    """Counts of label by prediction, every class present."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], df.select(F.col(y).alias(y)).schema)
    table = df.groupBy(y).pivot(yhat, list(classes)).count()
    return names.join(table, y, "left").na.fill(0).select(y, *[F.col(f"`{c}`").alias(f"pred_{c}") for c in classes])


def binary_rates(df: DataFrame, y, yhat) -> DataFrame:
    """Accuracy, false-positive rate and recall of 0/1 columns."""
    div = lambda a, b: F.coalesce(F.try_divide(a * 1.0, b), F.lit(0.0))
    pos, neg = F.col(y) == 1, F.col(y) == 0
    return df.agg(div(F.count_if(F.col(y) == F.col(yhat)), F.count("*")).alias("accuracy"), div(F.count_if(neg & (F.col(yhat) == 1)), F.count_if(neg)).alias("false_positive_rate"), div(F.count_if(pos & (F.col(yhat) == 1)), F.count_if(pos)).alias("recall"), div(F.count_if(pos & (F.col(yhat) == 1)), F.count_if(F.col(yhat) == 1)).alias("precision"))


def recall_by_detector(df: DataFrame, y, detectors) -> DataFrame:
    """For each 0/1 column the share of positive rows that it flags; without a positive row 0."""
    pos = F.col(y) == 1
    rows = [F.struct(F.lit(d).alias("detector"), F.coalesce(F.try_divide(F.count_if(pos & (F.col(d) == 1)) * 1.0, F.count_if(pos)), F.lit(0.0)).alias("recall")) for d in detectors]
    return df.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def percentiles(df: DataFrame, by, value, qs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles of each group in two ways: p50 and so on interpolated at (n - 1) q, s50 and so on the value at
    floor(n q) in rising order, counted from 0. Both come from one selection of ranks, which brings no large group together.
    """
    place = lambda n, q: (n - 1) * F.lit(float(q))
    sorted_at = lambda n, q: F.least(F.floor(n * F.lit(float(q))), n - 1)
    ranks = lambda n: F.array(*[x.cast("long") for q in qs for x in (F.floor(place(n, q)), F.ceil(place(n, q)), sorted_at(n, q))])
    found = ranked_values(df, by, value, ranks).withColumn("value", F.col("value").cast("double"))
    n = F.col("n")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("value")))
    made = []
    for q in qs:
        low, high, part = at(F.floor(place(n, q))), at(F.ceil(place(n, q))), F.max(place(n, q) - F.floor(place(n, q)))
        made += [(low * (1 - part) + high * part).alias(f"p{round(q * 100)}"), at(sorted_at(n, q)).alias(f"s{round(q * 100)}")]
    return found.groupBy(*by).agg(*made)


def sorted_percentiles(df: DataFrame, by, value, qs=(0.5, 0.95, 0.99)) -> DataFrame:
    """The values at the positions floor(n q) of each group in order, counted from 0."""
    return percentiles(df, by, value, qs).select(*by, *[F.col(f"s{round(q * 100)}").alias(f"p{round(q * 100)}") for q in qs])


def latency_percentiles(df: DataFrame, by, value, qs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated percentiles of each group."""
    return percentiles(df, by, value, qs).select(*by, *[f"p{round(q * 100)}" for q in qs])


def quality_gate(metrics: DataFrame, limits=None) -> DataFrame:
    """One row for each check (metric, value, limit, passed) with the verdict over all. metrics has one row."""
    limits = limits or LIMITS
    ok = {">=": lambda v, x: v >= x, "<=": lambda v, x: v <= x, "<": lambda v, x: v < x}
    checks = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(op).alias("op"), F.lit(x).alias("bound"), ok[op](F.col(m), x).alias("passed")) for m, (op, x) in limits.items()])
    return metrics.select(F.explode(checks).alias("c")).select("c.*").withColumn("all_passed", F.expr("bool_and(passed) over (partition by 0)"))


def enforce_gate(checks: DataFrame) -> DataFrame:
    """The checks, or a failing job if one did not pass."""
    return checks.where(F.assert_true(F.col("all_passed"), F.lit("quality gate failed")).isNull())


def champion_model(registry: DataFrame) -> DataFrame:
    """Of the passing Production versions of a model the newest stays, the earlier become Archived."""
    live = (F.col("stage") == "Production") & F.col("passed")
    w = Window.partitionBy("model", live).orderBy(F.col("registered_at").desc(), F.col("version").desc())
    newer = live & (F.row_number().over(w) > 1)
    return registry.withColumn("stage", F.when(newer, "Archived").otherwise(F.col("stage")))


def psi(base: DataFrame, cur: DataFrame, col: str, edges) -> DataFrame:
    """Population stability index over shared buckets; flagged from 0.20 on."""
    place = lambda df: df.select(sum((F.col(col) >= e).cast("int") for e in edges).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    a, b = place(base).withColumnRenamed("n", "x"), place(cur).withColumnRenamed("n", "y")
    j = a.join(b, "b", "full").na.fill(0)
    whole = Window.partitionBy(F.lit(0))
    k = len(edges) + 1
    p, q = (F.col("x") + 0.5) / (F.sum("x").over(whole) + 0.5 * k), (F.col("y") + 0.5) / (F.sum("y").over(whole) + 0.5 * k)
    return j.select(p.alias("p"), q.alias("q")).agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi")).withColumn("drifted", F.col("psi") >= 0.20)


def ks_two_sample(base: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """The largest gap between two empirical distributions, and its asymptotic tail probability.

    Counts of equal values come first. Running sums are taken in ranges of values; of each range only its totals meet.
    """
    both = base.select(F.col(col).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(cur.select(F.col(col).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    by = both.where("v is not null").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranges = settled(by.orderBy("v").withColumn("r", F.spark_partition_id()))
    totals = ranges.groupBy("r").agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b"))
    before, whole = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    offsets = totals.select(F.col("r").alias("at"), *[F.coalesce(F.sum(f"in_{x}").over(before), F.lit(0)).alias(f"off_{x}") for x in "ab"], F.sum("in_a").over(whole).alias("n"), F.sum("in_b").over(whole).alias("m"))
    w = Window.partitionBy("r").orderBy("v")
    upto = ranges.join(F.broadcast(offsets), F.col("r") == F.col("at")).select("n", "m", *[(F.sum(x).over(w) + F.col(f"off_{x}")).alias(x) for x in "ab"])  # a row a range is broadcast
    top = upto.agg(F.max(F.abs(F.col("a") / F.col("n") - F.col("b") / F.col("m"))).alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))
    lam = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("d")
    tail = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 6)), F.lit(0.0))
    return top.select("d", F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)).alias("p_value"))


def rolling_fpr(df: DataFrame, day: str, days: int = 7) -> DataFrame:
    """False-positive share of the days up to each day; df has day (a number), fp and n."""
    w = Window.partitionBy(F.lit(0)).orderBy(day).rangeBetween(-(days - 1), 0)
    return df.select(day, F.coalesce(F.try_divide(F.sum("fp").over(w) * 1.0, F.sum("n").over(w)), F.lit(0.0)).alias("rate")).withColumn("breach", F.col("rate") > 0.05)
