"""I: counters, histograms, rates, quantiles and alerts over metric events."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detect import in_blocks
from .scan import running


def count_by_labels(df: DataFrame, labels) -> DataFrame:
    """I1."""
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram_buckets(df: DataFrame, by, value, edges) -> DataFrame:
    """Cumulative counts up to each edge (`le`, infinity last) with sum and count of each group."""
    counts = [F.count_if(F.col(value) <= e).alias(f"_{i}") for i, e in enumerate(edges)]
    wide = df.groupBy(*by).agg(*counts, F.count(value).alias("count"), F.sum(value).alias("sum"))
    rows = F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(f"_{i}").alias("cum")) for i, e in enumerate(edges)], F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cum")))
    return wide.select(*by, "count", "sum", F.explode(rows).alias("b")).select(*by, "b.le", "b.cum", "count", "sum")


def rate_over_window(df: DataFrame, by, epoch, window_s=300) -> DataFrame:
    """Events a second in each window of window_s seconds, by label."""
    start = (F.floor(F.col(epoch) / window_s) * window_s).cast("long").alias("window_start")
    return df.groupBy(*by, start).agg((F.count("*") / window_s).alias("rate"))


#: Evaluations of a span: what a task holds of a series at once, with what reaches into it.
SPAN = 16_384


def _in_spans(df: DataFrame, keys, first, last, length) -> DataFrame:
    """df, each row once for every span of `length` from that of `first` to that of `last` (`_span`), and those of one key and span together (`_place`).

    So what looks back or ahead by less than a span finds all it needs there, and a key of any length is many tasks. A later
    grouping by `_place` and further columns moves no row again.
    """
    spread = df.withColumn("_span", F.explode(F.sequence(F.floor(first / length), F.floor(last / length))))
    return spread.withColumn("_place", F.xxhash64(*keys, "_span")).repartition("_place")


def _window_rates(t: np.ndarray, v: np.ndarray, ends: np.ndarray, step_s: int, window_s: int) -> tuple[np.ndarray, np.ndarray]:
    """Times of those ends, multiples of step_s by their number, whose windows hold two samples or more, and their rates; t rises."""
    pane = np.ceil(t / step_s).astype(np.int64)
    a, z = np.searchsorted(pane, ends - window_s // step_s, side="right"), np.searchsorted(pane, ends, side="right") - 1
    at = z > a
    a, z, ends = a[at], z[at], ends[at] * step_s
    if not len(ends):
        return ends, np.zeros(0)
    before, here = v[:-1], v[1:]
    fall = np.r_[0.0, np.where((before > here) | (np.isnan(before) & ~np.isnan(here)), before, 0.0), 0.0]
    with np.errstate(all="ignore"):
        grown, span = v[z] - v[a] + np.add.reduceat(fall, np.stack([a + 1, z + 1], axis=1).ravel())[::2], t[z] - t[a]
        mean = span / (z - a)
        near = lambda x: np.where(x < mean * 1.1, x, mean / 2)
        head = near(t[a] - (ends - window_s))
        head = np.where((grown > 0) & (v[a] >= 0), np.fmin(head, span * v[a] / grown), head)
        return ends, grown * (span + head + near(ends - t[z])) / span / window_s


def range_rate(samples: DataFrame, by, epoch, value, window_s=300, step_s=60) -> DataFrame:
    """I3 for counter samples: (by, evaluated, rate), the increase a second over the last window_s seconds at each multiple of step_s.

    A window is (evaluated - window_s, evaluated]. A value below the one before it is a reset, which adds that one. The increase is
    carried on to the window's ends where a sample lies within 1.1 mean distances of them, else by half a mean distance,
    and never back beyond the time at which the counter was 0. Windows with fewer than two samples have no rate.
    Samples are sent once to their span of SPAN evaluations, and to the next if its windows reach back to them.
    """
    by, names = list(by), [f"_k{i}" for i in range(len(by))]
    rows = samples.where(F.col(value).isNotNull() & F.col(epoch).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(by, names, strict=True)], F.col(epoch).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    panes, pane = window_s // step_s, F.ceil(F.col("t") / step_s)
    length = max(SPAN, panes)
    spread = _in_spans(rows, names, pane, pane + (panes - 1), length)
    one = spread.groupBy("_place", "_span", *names, "t").agg(F.max("v").alias("v"))  # of samples of one time the larger

    def rates(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        begin = table.column("_span")[0].as_py() * length
        ends, rate = _window_rates(table.column("t").to_numpy(), table.column("v").to_numpy(), np.arange(begin, begin + length), step_s, window_s)
        key = table.select(names).take(pa.array(np.zeros(len(ends), np.int64)))
        return pa.table([*key.columns, pa.array(ends, pa.int64()), pa.array(rate, pa.float64())], names=[*names, "evaluated", "rate"])

    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], "evaluated long, rate double"])
    return one.groupBy("_place", "_span", *names).applyInArrow(rates, schema).withColumnsRenamed(dict(zip(names, by, strict=True)))


def as_of(samples: DataFrame, by, epoch, value, step_s=5, stale_s=300) -> DataFrame:
    """(by, evaluated, value): at each multiple of step_s the last sample of the key, if it is less than stale_s old.

    Of samples of one time the larger value counts. Each sample is sent to the evaluations from its own time up to the
    next sample, so no evaluation is looked up; a next one that comes later than stale_s does not matter.
    """
    by, t = list(by), F.col("_t")
    rows = samples.where(F.col(value).isNotNull() & F.col(epoch).isNotNull()).select(*by, F.col(epoch).cast("double").alias("_t"), F.col(value).alias("_v"))
    length = max(SPAN * step_s, stale_s)
    one = _in_spans(rows, by, t - stale_s, t, length).groupBy("_place", "_span", *by, "_t").agg(F.max("_v").alias("value"))
    placed = one.withColumn("_next", F.lead("_t").over(Window.partitionBy("_place", "_span", *by).orderBy("_t"))).where(F.floor(t / length) == F.col("_span"))
    begin = F.ceil(t / step_s).cast("long")
    end = F.ceil(F.least(F.coalesce("_next", F.lit(float("inf"))), t + stale_s) / step_s).cast("long") - 1
    return placed.where(begin <= end).select(*by, F.explode(F.sequence(begin, end)).alias("evaluated"), "value").withColumn("evaluated", F.col("evaluated") * step_s)


def histogram_quantile(buckets: DataFrame, by, q: float) -> DataFrame:
    """I4: the q-quantile of cumulative buckets by linear interpolation; in the last bucket, its lower edge."""
    w = Window.partitionBy(*by).orderBy("le")
    prev = buckets.withColumns({"low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "below": F.coalesce(F.lag("cum").over(w), F.lit(0)), "total": F.max("cum").over(Window.partitionBy(*by))})
    hit = prev.where((F.col("cum") >= q * F.col("total")) & (F.col("total") > 0)).withColumn("i", F.row_number().over(w)).where("i = 1")
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.coalesce(F.try_divide(q * F.col("total") - F.col("below"), F.col("cum") - F.col("below")), F.lit(0.0))
    return hit.select(*by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def ratio_alert(df: DataFrame, predicate, epoch, window_s=300, threshold=0.2) -> DataFrame:
    """The share of matching events in each window; it fires strictly above the threshold."""
    start = (F.floor(F.col(epoch) / window_s) * window_s).cast("long").alias("window_start")
    made = df.groupBy(start).agg(F.coalesce(F.try_divide(F.count_if(predicate) * 1.0, F.count("*")), F.lit(0.0)).alias("ratio"))
    return made.withColumn("firing", F.col("ratio") > threshold)


def alert_state(series: DataFrame, by, epoch, predicate, for_s: int) -> DataFrame:
    """Inactive, pending or firing at each evaluation: firing once the condition has held for for_s seconds.

    One scan finds the evaluation before each, another the last one at which the condition began to hold.
    """
    on = series.withColumn("_on", F.coalesce(predicate, F.lit(False)))
    seen = running(on, by, [epoch], {"_before": ("max", F.struct(F.col(epoch), F.col("_on").alias("on")))})
    begun = F.when(F.col("_on") & ~F.coalesce(F.col("_before.on"), F.lit(False)), F.col(epoch))
    held = running(seen, by, [epoch], {"_since": ("max", begun)}, current=True).withColumn("_held", F.col(epoch) - F.col("_since"))
    return held.withColumn("state", F.when(~F.col("_on"), "inactive").when(F.col("_held") >= for_s, "firing").otherwise("pending")).drop("_on", "_before", "_since", "_held")


def active_alerts(on: DataFrame, by, for_s: int, step_s: int = 5) -> DataFrame:
    """Pending or firing for each evaluation (by, evaluated) of on, at which a rule's condition held; any other is inactive.

    An evaluation that is missing ends what has been held so far, as a condition without a value does. A span looks back
    by for_s and a step: what has held since before that is firing, whenever it began.
    """
    by, at = list(by), F.col("evaluated")
    length = max(SPAN * step_s, for_s + step_s)
    w = Window.partitionBy("_place", "_span", *by).orderBy("evaluated")
    before = F.lag("evaluated").over(w)
    seen = _in_spans(on.select(*by, "evaluated"), by, at, at + (for_s + step_s), length).withColumn("_begun", F.when(before.isNull() | (before < at - step_s), at))
    held = seen.withColumn("_since", F.max("_begun").over(w)).where(F.floor(at / length) == F.col("_span"))
    return held.select(*by, "evaluated", F.when(at - F.col("_since") >= for_s, "firing").otherwise("pending").alias("state"))


#: The rules' bounds and how long each must hold, in seconds.
RULES = {"HighAnomalyDetectionLatencySLA": (0.015, 120), "ElevatedAnomalyRate": (0.20, 180), "DegradedSubsystemHealth": (0.0, 60), "LowRAGGroundingScore": (0.95, 120), "HighHTTP5xxErrorRate": (0.01, 120)}


def _share(rates: DataFrame, part) -> DataFrame:
    """(evaluated, value): the part of all rates; without a rate in the part there is no value, nor where all are 0."""
    return rates.groupBy("evaluated").agg(F.sum(F.when(part, F.col("rate"))).alias("part"), F.sum("rate").alias("whole")).select("evaluated", F.try_divide("part", "whole").alias("value")).where("value is not null")


def _median_of(rates: DataFrame, q: float) -> DataFrame:
    buckets = rates.repartition("evaluated").groupBy("evaluated", "le").agg(F.sum("rate").alias("cum"))  # moved once for the sums and the windows
    return histogram_quantile(buckets, ["evaluated"], q).select("evaluated", F.col("quantile").alias("value"))


def alert_rules(latency: DataFrame, snapshots: DataFrame, health: DataFrame, grounding: DataFrame, requests: DataFrame, step_s: int = 5, window_s: int = 300) -> DataFrame:
    """(alert, subsystem, evaluated, state) of the five rules at every evaluation at which one is pending or firing.

    latency, grounding: samples (le, epoch, value) of cumulative buckets, further labels allowed; snapshots: samples
    (anomaly_detected, epoch, value), the label as text; health: samples (subsystem, epoch, value); requests: samples
    (status_code, epoch, value), the label as text. All columns but epoch and value are labels of their series.
    """
    labels = lambda df: [c for c in df.columns if c not in ("epoch", "value")]
    rate = lambda df: range_rate(df, labels(df), "epoch", "value", window_s, step_s)
    bound = {k: v[0] for k, v in RULES.items()}
    high, many, down, low, failed = RULES
    on = {
        high: _median_of(rate(latency), 0.99).where(F.col("value") > bound[high]),
        many: _share(rate(snapshots), F.col("anomaly_detected") == "true").where(F.col("value") > bound[many]),
        down: as_of(health, ["subsystem"], "epoch", "value", step_s).where(F.col("value") == bound[down]),
        low: _median_of(rate(grounding), 0.50).where(F.col("value") < bound[low]),
        failed: _share(rate(requests), F.col("status_code").rlike("^5..$")).where(F.col("value") > bound[failed]),
    }
    state = lambda k: active_alerts(on[k].select((F.col("subsystem") if k == down else F.lit("")).alias("subsystem"), "evaluated"), ["subsystem"], RULES[k][1], step_s)
    made = [state(k).select(F.lit(k).alias("alert"), "subsystem", "evaluated", "state") for k in on]
    return reduce(lambda a, b: a.unionByName(b), made)


def remediation_pipeline(df: DataFrame) -> DataFrame:
    """I8: totals by action and status."""
    return df.groupBy("action_type", "status").agg(F.count("*").alias("n"))


def latest_health(df: DataFrame, subsystem, epoch, value) -> DataFrame:
    """The last gauge of each subsystem; zero is degraded. Of equal times the larger value."""
    last = F.max(F.struct(F.col(epoch), F.col(value)))
    return df.groupBy(subsystem).agg(last.alias("m")).select(subsystem, F.col(f"m.{value}").alias("value"), (F.col(f"m.{value}") == 0).alias("degraded"))


def threshold_alarm(series: DataFrame, by, epoch, value, threshold: float, periods: int) -> DataFrame:
    """An alarm where the value has been above the threshold for n periods in a row; keys of any length are many tasks."""

    def scored(df, keys):
        w = Window.partitionBy(*keys).orderBy(epoch).rowsBetween(-(periods - 1), 0)
        full = (F.count("*").over(w) == periods) & (F.sum((F.col(value) > threshold).cast("int")).over(w) == periods)
        return df.withColumn("alarm", full)

    return in_blocks(series, list(by), [epoch], periods - 1, scored)
