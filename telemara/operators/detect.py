"""D: statistical detection by trailing windows, control charts, covariance and correlation."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity_of
from ..sources import numbered

#: Fixed value: the 1 - 1e-5 quantile of chi-square with 11 degrees of freedom.
CRITICAL_11 = 43.205959720539255


def _trailing(keys, order, start, end):
    w = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(*order).rowsBetween(start, end)


def _beyond(score, threshold, direction):
    return {"upper": score >= threshold, "lower": score <= -threshold, "both": F.abs(score) >= threshold}[direction]


def rolling_zscore(df: DataFrame, keys, order, value, window=60, min_samples=15, threshold=3.0, direction="both", eps=1e-6) -> DataFrame:
    """Deviation of each value from the `window` values before it; silent until min_samples of them are there."""
    w = _trailing(keys, order, -window, -1)
    x = F.col(value)
    stats = df.withColumns({"n": F.count(x).over(w), "mean": F.avg(x).over(w), "std": F.stddev_samp(x).over(w)})
    ready = F.col("n") >= min_samples
    z = F.when(ready, (x - F.col("mean")) / (F.col("std") + eps)).otherwise(0.0)
    return stats.withColumns({"score": z, "mean": F.when(ready, F.col("mean")).otherwise(x), "std": F.when(ready, F.col("std")).otherwise(0.0)}).withColumn("flag", ready & _beyond(F.col("score"), threshold, direction)).drop("n")


def in_blocks(df: DataFrame, keys, order, overlap: int, score, rows: int = 10_000, at: tuple[str, int] | None = None) -> DataFrame:
    """score(df, keys) of trailing windows that reach back `overlap` rows at most, for keys of any length.

    The rows are sorted by key and order, and cut into blocks of `rows`; each block gets the last `overlap` rows before
    it as well, whose results are dropped. So a key is the work of as many tasks as it has blocks.

    at: a column that numbers rows as `order` sorts those of a key, and how far apart two neighbours of a key lie in it at
    most. Blocks are then cut by it, and nothing needs to be sorted and numbered first.
    """
    placed = numbered(df, *keys, *order, pos="at_") if at is None else df.withColumn("at_", F.col(at[0]))
    rows, overlap = (rows, overlap) if at is None else (rows * at[1], overlap * at[1])
    own, late = F.col("at_").cast("long") / rows, F.col("at_") % rows >= rows - overlap
    own = F.floor(own)
    sent = placed.withColumn("own_", own).withColumn("block_", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    return score(sent, [*keys, "block_"]).where("own_ = block_").drop("at_", "own_", "block_")


def _half(deviations: Column) -> Column:
    """The median of a sorted array."""
    at = lambda k: F.element_at(deviations, F.floor((F.size(deviations) + k) / 2).cast("int"))
    return (at(1) + at(2)) / 2


def _with_mad(df: DataFrame, w, values, window) -> DataFrame:
    """df plus, for the i-th value, n_i, median_i and mad_i over w."""
    numbers = range(len(values))
    held = df.withColumns({f"past_{i}": F.collect_list(values[i]).over(w) for i in numbers} | {f"median_{i}": F.percentile(values[i], 0.5).over(w) for i in numbers})
    apart = lambda i: F.transform(f"past_{i}", lambda v: F.abs(v - F.col(f"median_{i}")))
    off = [F.array_sort(apart(i)).alias(f"off_{i}") for i in numbers]
    # inline() keeps the sorted deviations from being put, and computed, into each expression that uses them
    held = held.select("*", F.inline(F.array(F.struct(*off))))
    made = {f"mad_{i}": F.when(F.size(f"past_{i}") > 0, _half(F.col(f"off_{i}"))) for i in numbers} | {f"n_{i}": F.size(f"past_{i}") for i in numbers}
    return held.withColumns(made).drop(*[f"{x}_{i}" for x in ("past", "off") for i in numbers])


def rolling_mad(df: DataFrame, keys, order, value, window=60, min_samples=15, threshold=3.5, direction="both", eps=1e-6) -> DataFrame:
    """Modified z-score by the median and the median absolute deviation of the values before."""
    x, ready = F.col(value), F.col("n_0") >= min_samples
    stats = _with_mad(df, _trailing(keys, order, -window, -1), [x], window)
    score = F.coalesce(F.when(ready, 0.6745 * (x - F.col("median_0")) / (F.col("mad_0") + eps)), F.lit(0.0))
    out = stats.withColumns({"median": F.when(ready, F.col("median_0")).otherwise(x), "mad": F.when(ready, F.col("mad_0")).otherwise(0.0), "score": score, "flag": ready & _beyond(score, threshold, direction)})
    return out.drop("n_0", "median_0", "mad_0")


class Chart:
    """The state of an exponentially weighted chart of one series: it goes on where the last values ended."""

    def __init__(self, lam=0.2, limit=3.0, warmup=15, rate=0.03, direction="both", eps=1e-6, state=None):
        self.lam, self.limit, self.warmup, self.rate, self.direction, self.eps = lam, limit, warmup, rate, direction, eps
        t, self.mean, self.sigma, self.z, *self.first = state or (0.0, 0.0, 0.0, 0.0)
        self.t = int(t)

    def state(self) -> list[float]:
        return [float(self.t), self.mean, self.sigma, self.z, *self.first]

    def path(self, x) -> list[tuple]:
        """z, flag, mean, lower and upper limit of each value; the verdict feeds back into the mean."""
        out, lam = [], self.lam
        for v in x:
            if len(self.first) < self.warmup:
                self.first.append(float(v))
                out.append((v, False, v, v, v))
                if len(self.first) == self.warmup:
                    self.z = self.mean = float(np.mean(self.first))
                    self.sigma = float(np.std(self.first, ddof=1)) + self.eps
                continue
            self.t += 1
            self.z = z = lam * v + (1 - lam) * self.z
            half = self.limit * self.sigma * math.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * self.t)))
            low, high = self.mean - half, self.mean + half
            flag = {"upper": z > high, "lower": z < low, "both": z > high or z < low}[self.direction]
            out.append((z, flag, self.mean, low, high))
            if not flag:
                self.mean = (1 - self.rate) * self.mean + self.rate * v
        return out


def ewma_path(x, lam=0.2, limit=3.0, warmup=15, rate=0.03, direction="both", eps=1e-6):
    """The chart of one whole series."""
    return Chart(lam, limit, warmup, rate, direction, eps).path(x)


CHARTED = "struct<z: double, flag: boolean, mean: double, lcl: double, ucl: double>"


def ewma_charts(df: DataFrame, keys, order, charts: dict) -> DataFrame:
    """df plus a struct (z, flag, mean, lcl, ucl) for each of charts: name -> (value column, settings of Chart).

    A chart's verdict feeds back into its mean, so a key is folded in order. Rows are sorted by key and order inside the
    partitions, which Spark does on disk, and read batch by batch; only the state of the key at hand is held.
    """
    names, spots = list(charts), [df.columns.index(v) for v, _ in charts.values()]
    at = [df.columns.index(k) for k in keys]
    kind = pa.struct([("z", pa.float64()), ("flag", pa.bool_()), ("mean", pa.float64()), ("lcl", pa.float64()), ("ucl", pa.float64())])

    def run(batches):
        now, held = None, []
        for batch in batches:
            key = list(zip(*[batch.column(i).to_pylist() for i in at], strict=True)) if at else [()] * batch.num_rows
            cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
            made = [[] for _ in names]
            values = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in spots]
            for i, j in pairwise(cuts):
                if i < j:
                    if now is None or key[i] != now:
                        now, held = key[i], [Chart(**settings) for _, settings in charts.values()]
                    for out, chart, x in zip(made, held, values, strict=True):
                        out += chart.path(x[i:j].tolist())
            arrays = [pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)] if out else [pa.array([], f.type) for f in kind], fields=list(kind)) for out in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    placed = df.repartition(*keys) if keys else df.repartition(1)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + "".join(f", `{n}` {CHARTED}" for n in names)
    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def ewma_chart(df: DataFrame, keys, order, value, **settings) -> DataFrame:
    """D3: exponentially weighted chart with time-varying limits: df plus z, flag, mean, lcl and ucl."""
    return ewma_charts(df, keys, order, {"chart_": (value, settings)}).select("*", "chart_.*").drop("chart_")


def mahalanobis_fit(df: DataFrame, features, reg=1e-4):
    """Mean and inverse of the regularised sample covariance; one aggregation, a matrix of the features' number."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    row = df.agg(*[F.avg(f) for f in features], *[F.covar_samp(features[i], features[j]) for i, j in pairs]).first()
    mean, cov = np.array(row[: len(features)], float), np.zeros((len(features),) * 2)
    for (i, j), c in zip(pairs, row[len(features) :], strict=True):
        cov[i, j] = cov[j, i] = c or 0.0
    cov += reg * np.eye(len(features))
    try:
        inverse = np.linalg.inv(cov)
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(cov)
    return list(features), mean, inverse


def mahalanobis_score(df: DataFrame, model, crit_sq=CRITICAL_11, gate=1.5) -> DataFrame:
    """Distance, flag, and each feature's share of it; emitted from gate times the critical distance on."""
    features, mean, inverse = model
    d = [F.col(f) - float(m) for f, m in zip(features, mean, strict=True)]
    s = [reduce(lambda a, b: a + b, [x * float(v) for x, v in zip(d, r, strict=True)]) for r in inverse]
    parts = [F.abs(a * b) for a, b in zip(d, s, strict=True)]
    total = reduce(lambda a, b: a + b, parts)
    square = F.greatest(reduce(lambda a, b: a + b, [a * b for a, b in zip(d, s, strict=True)]), F.lit(0.0))
    shares = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.round(p / (total + 1e-9), 4) for p in parts]))
    edge = gate * math.sqrt(crit_sq)
    out = df.withColumn("distance", F.sqrt(square)).withColumn("flag", square >= crit_sq).withColumn("attribution", shares).withColumn("p_value", p_value(square, len(features)))
    return out.withColumns({"emitted": F.col("flag") & (F.col("distance") >= edge), "severity": F.when(F.col("distance") > edge, "CRITICAL").otherwise("HIGH")})


def chi_square_tail(x: float, k: int = 11) -> float:
    """Tail probability of chi-square with k degrees of freedom, in closed form."""
    term, total = 1.0, 0.0
    for i in range(k // 2 if k % 2 == 0 else (k - 1) // 2):
        if i:
            term *= x / (2 * i + k % 2)
        total += term
    if k % 2 == 0:
        return math.exp(-x / 2) * total
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total


def p_value(square: Column, k: int) -> Column:
    """The chance of a larger squared distance: a sum for even k; for odd k it needs erfc, which Spark lacks."""
    if k % 2 == 0:
        term, total = F.lit(1.0), F.lit(0.0)
        for i in range(k // 2):
            term = term * square / (2.0 * i) if i else term
            total = total + term
        return F.exp(-square / 2) * total

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: chi_square_tail(v, k))

    return tail(square)


def correlation_drift_fit(df: DataFrame, keys, x, y, default_r=0.0, min_samples=15) -> DataFrame:
    """Expected correlation of each key, the default where the baseline is short or flat."""
    firm = (F.count("*") >= min_samples) & (F.stddev_pop(x) > 1e-6) & (F.stddev_pop(y) > 1e-6)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return df.groupBy(*keys).agg(F.when(firm, r).otherwise(default_r).alias("expected"))


def correlation_drift_score(df: DataFrame, keys, order, x, y, expected=0.0, window=30, min_samples=15, threshold=0.55) -> DataFrame:
    """Correlation over the window ending at each row against the expected one (a number or a column)."""
    w = _trailing(keys, order, -(window - 1), 0)
    sx, sy = F.stddev_pop(x).over(w), F.stddev_pop(y).over(w)
    r = F.when((F.count("*").over(w) >= min_samples) & (sx > 1e-6) & (sy > 1e-6), F.covar_pop(x, y).over(w) / (sx * sy))
    want = F.col(expected) if isinstance(expected, str) else F.lit(float(expected))
    out = df.withColumn("r", r).withColumn("drift", F.coalesce(F.abs(F.col("r") - want), F.lit(0.0)))
    return out.withColumns({"flag": F.col("r").isNotNull() & (F.col("drift") >= threshold), "severity": F.when(F.col("drift") > 0.8, "HIGH").otherwise("MEDIUM"), "sigma": 5 * F.col("drift")})


def calibrate_then_score(baseline: DataFrame, live: DataFrame, score_fn) -> DataFrame:
    """Baseline rows fill the windows but are not reported."""
    both = baseline.withColumn("live", F.lit(False)).unionByName(live.withColumn("live", F.lit(True)))
    return score_fn(both).where("live").drop("live")


@dataclass(frozen=True)
class Engine:
    """Which metrics each detector watches, and in which direction."""

    zscore: tuple = ()  # (metric, direction)
    mad: tuple = ()
    ewma: tuple = ()  # (metric, weight, direction)
    pairs: tuple = ()  # (metric, metric, expected correlation)
    window: int = 60
    pair_window: int = 30
    min_samples: int = 15
    z_limit: float = 3.0
    mad_limit: float = 3.5
    drift_limit: float = 0.55


#: The metrics, directions, weights and expected correlations of the full engine.
ENGINE = Engine(
    zscore=(("infra_cpu_percent", "upper"), ("infra_memory_percent", "upper"), ("app_latency_p95_ms", "upper"), ("app_latency_p99_ms", "upper"), ("app_error_rate", "upper"), ("db_pool_utilization", "upper"), ("db_query_latency_ms", "upper"), ("biz_checkout_success_rate", "lower")),
    mad=(("app_latency_p99_ms", "upper"), ("db_query_latency_ms", "upper"), ("biz_checkout_success_rate", "lower")),
    ewma=(("infra_memory_percent", 0.15, "upper"), ("app_latency_p95_ms", 0.20, "upper"), ("db_pool_utilization", 0.20, "upper"), ("biz_checkout_success_rate", 0.25, "lower")),
    pairs=(("app_requests_per_sec", "biz_order_volume", 0.90), ("app_requests_per_sec", "infra_network_egress_mbps", 0.85)),
)


def _middle(w: np.ndarray) -> np.ndarray:
    """Medians of rows, of what is not NaN in them."""
    out, whole = np.full(len(w), np.nan), ~np.isnan(w).any(axis=1)
    out[whole] = np.median(w[whole], axis=1) if whole.any() else []
    if not whole.all():
        out[~whole] = np.nanmedian(w[~whole], axis=1)
    return out


def _window_stats(columns: dict[str, np.ndarray], e: Engine) -> dict[str, np.ndarray]:
    """What _signals() needs of the windows of rows in order: counts, means, deviations, medians and covariances by name."""
    n = len(next(iter(columns.values()))) if columns else 0

    def before(m: str, width: int, current: bool) -> np.ndarray:
        padded = np.concatenate([np.full(width, np.nan), columns[m]])
        return np.lib.stride_tricks.sliding_window_view(padded, width)[1:] if current else np.lib.stride_tricks.sliding_window_view(padded, width)[:n]

    out = {}
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        for i, (m, _) in enumerate(e.zscore):
            w = before(m, e.window, False)
            out |= {f"zn_{i}": (~np.isnan(w)).sum(axis=1), f"zm_{i}": np.nanmean(w, axis=1), f"zs_{i}": np.nanstd(w, axis=1, ddof=1)}
        for i, (m, _) in enumerate(e.mad):
            w = before(m, e.window, False)
            middle = _middle(w)
            out |= {f"n_{i}": (~np.isnan(w)).sum(axis=1), f"median_{i}": middle, f"mad_{i}": _middle(np.abs(w - middle[:, None]))}
        for i, (a, b, _) in enumerate(e.pairs):
            x, y = before(a, e.pair_window, True), before(b, e.pair_window, True)
            both = np.isnan(x) | np.isnan(y)
            u, v = np.where(both, np.nan, x), np.where(both, np.nan, y)
            cov = np.nanmean((u - np.nanmean(u, axis=1)[:, None]) * (v - np.nanmean(v, axis=1)[:, None]), axis=1)
            out |= {f"pn_{i}": np.minimum(np.arange(n) + 1, e.pair_window), f"px_{i}": np.nanstd(x, axis=1), f"py_{i}": np.nanstd(y, axis=1), f"pc_{i}": cov}
    return out


def score_all(df: DataFrame, keys, order, engine: Engine = ENGINE, blocks: int | None = 10_000) -> DataFrame:
    """df plus one struct column s0, s1 ... a detector, in the engine's order: the signal where it fires, else null.

    Windows are taken block by block with vectors, one Arrow table a block: `blocks` rows and the window before them. With
    blocks None a whole key is one table.
    """
    charts = {f"ewma_{i}": (m, {"lam": lam, "direction": way}) for i, (m, lam, way) in enumerate(engine.ewma)}
    charted = ewma_charts(df, keys, order, charts) if charts else df
    watched = list(dict.fromkeys([m for m, _ in (*engine.zscore, *engine.mad)] + [m for a, b, _ in engine.pairs for m in (a, b)]))
    named = list(_window_stats({m: np.zeros(1) for m in watched}, engine))
    whole = [n for n in named if n.startswith(("zn_", "n_", "pn_"))]

    def windows(b: DataFrame, k) -> DataFrame:
        def add(t: pa.Table) -> pa.Table:
            t = t.take(pc.sort_indices(t, sort_keys=[(o, "ascending") for o in order], null_placement="at_start"))
            made = _window_stats({m: t[m].to_numpy().astype(float) for m in watched}, engine)
            for name in named:
                t = t.append_column(name, pa.array(made[name], pa.int64() if name in whole else pa.float64()))
            return t

        schema = ", ".join(f"`{n}` {t}" for n, t in b.dtypes) + "".join(f", `{n}` {'bigint' if n in whole else 'double'}" for n in named)
        return b.groupBy(*k).applyInArrow(add, schema) if named else b

    scored = in_blocks(charted, keys, order, engine.window, windows, blocks) if blocks else windows(charted, list(keys))
    return scored.select(*df.columns, *[s.alias(f"s{i}") for i, s in enumerate(_signals(engine))])


def _signal(flag, metric, detector, emission, observed, baseline, sigma, severity, details: dict, explicit=False) -> Column:
    text = [x for k, v in details.items() for x in (F.lit(k), v)]
    return F.when(flag, F.struct(F.lit(metric).alias("metric"), F.lit(detector).alias("detector"), F.lit(emission).alias("emission"), F.round(observed, 2).alias("observed"), F.round(baseline, 2).alias("baseline"), F.round(sigma, 2).alias("sigma"), severity.alias("severity"), F.lit(explicit).alias("explicit"), F.create_map(*text).alias("metadata")))


def _signals(e: Engine) -> list[Column]:
    c, out = F.col, []
    text = lambda x: F.round(x, 2).cast("string")
    for i, (m, way) in enumerate(e.zscore):
        z = (c(m) - c(f"zm_{i}")) / (c(f"zs_{i}") + 1e-6)
        out.append(_signal((c(f"zn_{i}") >= e.min_samples) & _beyond(z, e.z_limit, way), m, "z_score", len(out), c(m), c(f"zm_{i}"), z, severity_of(z), {"window_std": text(f"zs_{i}")}))
    for i, (m, way) in enumerate(e.mad):
        z = 0.6745 * (c(m) - c(f"median_{i}")) / (c(f"mad_{i}") + 1e-6)
        out.append(_signal((c(f"n_{i}") >= e.min_samples) & _beyond(z, e.mad_limit, way), m, "modified_z_score", len(out), c(m), c(f"median_{i}"), z, severity_of(z), {"window_mad": text(f"mad_{i}")}))
    for i, (m, _, _) in enumerate(e.ewma):
        x = c(f"ewma_{i}")
        off = x.z - x.mean
        out.append(_signal(x.flag, m, "ewma", len(out), c(m), x.mean, off / F.greatest(F.lit(1.0), 0.1 * F.abs(x.mean)), severity_of(off), {"ucl": text(x.ucl), "lcl": text(x.lcl)}))
    for i, (a, b, expected) in enumerate(e.pairs):
        r = F.try_divide(c(f"pc_{i}"), c(f"px_{i}") * c(f"py_{i}"))
        drift = F.abs(r - expected)
        firm = (c(f"pn_{i}") >= e.min_samples) & (c(f"px_{i}") > 1e-6) & (c(f"py_{i}") > 1e-6)
        out.append(_signal(firm & (drift >= e.drift_limit), f"correlation_{a}_vs_{b}", "correlation_drift", len(out) + 1, r, F.lit(expected), 5 * drift, F.when(drift > 0.8, "HIGH").otherwise("MEDIUM"), {"drift_delta": text(drift)}))
    return out


def mahalanobis_signal(features, emission: int, crit_sq=CRITICAL_11, gate=1.5) -> Column:
    """The signal of a row of mahalanobis_score; it names the feature with the largest share, the first at a tie."""
    critical = math.sqrt(crit_sq)
    share = lambda f: F.element_at("attribution", f)
    best = F.greatest(*[share(f) for f in features]) if len(features) > 1 else share(features[0])
    top = reduce(lambda rest, f: F.when(share(f) == best, f).otherwise(rest), reversed(features), F.lit(None).cast("string"))
    details = {"p_value": F.format_string("%.2e", "p_value"), "top_contributor": top, "top_attribution_pct": best.cast("string")}
    return _signal(F.col("emitted"), "multivariate_system_state", "mahalanobis", emission, F.col("distance"), F.lit(critical), F.col("distance") - critical, F.col("severity"), details, True)


def emit_signals(df: DataFrame, keys, order, engine: Engine = ENGINE, model=None, crit_sq=CRITICAL_11, id="id", blocks: int | None = 10_000) -> DataFrame:
    """(id, keys, metric, detector, emission, observed, baseline, sigma, severity, explicit, metadata), a row for each
    detector that fires on a row of df: z-scores, MAD, EWMA, Mahalanobis (given its model) and correlation drift.

    One sort for the charts and one for all windows: every detector adds a column, and what fired becomes rows at the end.
    """
    scored = score_all(df, keys, order, engine, blocks)
    at = len(engine.zscore) + len(engine.mad) + len(engine.ewma)
    fired = [F.col(f"s{i}") for i in range(at + len(engine.pairs))]
    if model is not None:
        scored = mahalanobis_score(scored, model, crit_sq)
        fired.insert(at, mahalanobis_signal(model[0], at, crit_sq))
    return scored.select(id, *keys, F.explode(F.array_compact(F.array(*fired))).alias("s")).select(id, *keys, "s.*")


def primary_driver(signals: DataFrame, key="id") -> DataFrame:
    """is_primary: the explicit signals of a snapshot, or else the one with the largest deviation, the earliest at a tie."""
    w = Window.partitionBy(key)
    first = F.row_number().over(w.orderBy(F.abs("sigma").desc(), "emission")) == 1
    return signals.withColumns({"any_": F.max("explicit").over(w), "first_": first}).withColumn("is_primary", F.when(F.col("any_"), F.col("explicit")).otherwise(F.col("first_"))).drop("any_", "first_")


def ingest_verdict(snapshots: DataFrame, signals: DataFrame, key="id") -> DataFrame:
    """Score, verdict and primary detector of each snapshot, with or without signals."""
    top = primary_driver(signals.select(key, "detector", "emission", "sigma", "explicit"), key).groupBy(key).agg(F.count("*").alias("signals"), F.max(F.abs("sigma")).alias("peak"), F.max(F.when(F.col("is_primary"), F.col("detector"))).alias("primary_detector"))
    joined = snapshots.select(key).join(top, key, "left")
    return joined.select(key, F.coalesce("signals", F.lit(0)).alias("signals"), F.round(F.least(F.coalesce("peak", F.lit(0.0)) / 6, F.lit(1.0)), 4).alias("score"), F.when(F.col("signals") > 0, "ANOMALOUS").otherwise("NOMINAL").alias("verdict"), "primary_detector")


def batch_anomaly_rate(verdicts: DataFrame) -> DataFrame:
    """Totals and share of anomalous snapshots."""
    bad = F.count_if(F.col("verdict") == "ANOMALOUS")
    return verdicts.agg(F.count("*").alias("total"), bad.alias("anomalous"), F.round(F.coalesce(F.try_divide(bad * 100.0, F.count("*")), F.lit(0.0)), 2).alias("rate"))


def anomalous_ids(verdicts: DataFrame, key="id") -> DataFrame:
    """The ids of the anomalous snapshots, a row each, as there may be any number of them."""
    return verdicts.where("verdict = 'ANOMALOUS'").select(key)


def detector_breakdown(signals: DataFrame) -> DataFrame:
    """Signals of each detector."""
    return signals.groupBy("detector").agg(F.count("*").alias("n"))
