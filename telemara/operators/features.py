"""E: features, models and ensemble."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import settled, stored
from .detect import in_blocks
from .scan import ranked_values, running


def ratio_features(df: DataFrame, p50="p50", p99="p99", orders="orders", rps="rps", db="revenue") -> DataFrame:
    """Spread and ratios; a missing base column counts as 0."""
    c = lambda n: F.col(n).cast("double") if n in df.columns else F.lit(0.0)
    e = 1e-6
    return df.withColumns({"latency_spread": c(p99) - c(p50), "tail_ratio": c(p99) / (c(p50) + e), "orders_per_request": c(orders) / (c(rps) + e), "db_share": c(db) / (c(p50) + e)})


def rolling_features(df: DataFrame, keys, order, cols, window=10) -> DataFrame:
    """Mean, sample deviation and first difference over the window ending at each row; nulls become 0."""
    w, step = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(window - 1), 0), Window.partitionBy(*keys).orderBy(*order)
    made = {}
    for c in cols:
        made |= {f"{c}_mean": F.coalesce(F.avg(c).over(w), F.lit(0.0)), f"{c}_std": F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)), f"{c}_diff": F.coalesce((F.col(c) - F.lag(c).over(step)).cast("double"), F.lit(0.0))}
    return df.withColumns(made)


#: The base metrics of a feature vector, and those of them that roll, in their order.
BASE = (
    "infra_cpu_percent", "infra_memory_percent", "infra_disk_io_mbps", "infra_network_egress_mbps", "infra_network_ingress_mbps", "app_requests_per_sec", "app_latency_p50_ms", "app_latency_p95_ms",
    "app_latency_p99_ms", "app_http_2xx_count", "app_http_4xx_count", "app_http_5xx_count", "app_error_rate", "db_active_connections", "db_pool_utilization", "db_query_latency_ms",
    "db_slow_queries_per_sec", "db_row_lock_waits", "biz_order_volume", "biz_revenue_usd", "biz_checkout_success_rate", "biz_cart_abandonment_rate",
)
ROLLING = ("infra_cpu_percent", "infra_memory_percent", "app_latency_p95_ms", "db_pool_utilization", "biz_checkout_success_rate")
RATIOS = ("app_latency_spread_p99_p50", "app_latency_ratio_p99_p50", "biz_orders_per_request", "db_query_to_app_latency_ratio")
VECTOR = (*BASE, *RATIOS, *[f"{c}_{kind}" for c in ROLLING for kind in ("roll_mean", "roll_std", "delta")])


def with_ratios(df: DataFrame) -> DataFrame:
    """Df, which has the base metrics, plus the columns of RATIOS."""
    c, e = F.col, 1e-6
    p50, p99 = c("app_latency_p50_ms"), c("app_latency_p99_ms")
    made = (p99 - p50, p99 / (p50 + e), c("biz_order_volume") / (c("app_requests_per_sec") + e), c("db_query_latency_ms") / (p50 + e))
    return df.withColumns(dict(zip(RATIOS, made, strict=True)))


def with_rolled_names(df: DataFrame) -> DataFrame:
    """df with the rolling columns named as in VECTOR."""
    return df.withColumnsRenamed({f"{m}_{a}": f"{m}_{b}" for m in ROLLING for a, b in (("mean", "roll_mean"), ("std", "roll_std"), ("diff", "delta"))})


def vector_features(df: DataFrame, keys, order, window=10, at=None) -> DataFrame:
    """E1 and E2 as one: df plus the 41 columns of VECTOR; a base metric that df lacks, or that is null, counts as 0.

    Rolling values reach back window - 1 rows of the same key; keys of any length are many tasks. at: as for in_blocks().
    """
    base = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in BASE})
    return with_rolled_names(in_blocks(with_ratios(base), keys, order, window - 1, lambda b, k: rolling_features(b, k, order, ROLLING, window), at=at))


def standardise_fit(df: DataFrame, cols) -> dict:
    """Mean and population deviation plus 1e-6 of each column, from one aggregation."""
    r = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"m_{c}"] or 0.0, (r[f"s_{c}"] or 0.0) + 1e-6) for c in cols}


def standardise(df: DataFrame, model: dict) -> DataFrame:
    """The columns of the model, standardised; NaN and null 0, infinities +-5."""

    def one(c, m, s):
        v = (F.col(c).cast("double") - m) / s
        return F.when(v.isNull() | F.isnan(v), 0.0).when(v == float("inf"), 5.0).when(v == float("-inf"), -5.0).otherwise(v)

    return df.withColumns({c: one(c, m, s) for c, (m, s) in model.items()})


def stratified_split(df: DataFrame, label, id, test=0.25, seed=42) -> DataFrame:
    """Df plus is_test: of each label floor(n * test) rows, those first by a hash of the id, then by id.

    Each label's hash to cut at is selected by counts, so no label's rows are brought together; only rows whose hash is
    that very one are numbered. Null labels are a label, null ids count as empty text.
    """
    hashed = stored(df.withColumn("_h", F.crc32(F.concat_ws("-", F.col(id).cast("string"), F.lit(str(seed))))), "split")
    take = lambda n: F.floor(n * F.lit(float(test)))
    narrow = hashed.select(label, "_h")  # read by every round of the selection
    cuts = settled(ranked_values(narrow, [label], "_h", lambda n: F.array(F.greatest(take(n) - 1, F.lit(0)))).select(F.col(label).alias("_l"), F.col("value").alias("_cut"), take(F.col("n")).alias("_take")))  # a row a label
    cut = lambda rows: rows.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_l")))
    less = cut(narrow).groupBy("_l").agg(F.count_if(F.col("_h") < F.col("_cut")).alias("_less")).withColumnRenamed("_l", "_m")
    known = cut(hashed).join(F.broadcast(settled(less)), F.col("_l").eqNullSafe(F.col("_m")))
    sure, ties = known.where("_h <> _cut"), settled(known.where("_h = _cut"))
    tied = running(ties, ["_l"], [id], {"_n": ("sum", F.lit(1))}, current=True)
    both = sure.withColumn("is_test", F.expr("_h < _cut and _take > 0")).unionByName(tied.withColumn("is_test", F.expr("_less + _n <= _take")), allowMissingColumns=True)
    return both.select(*[F.col(f"`{c}`") for c in df.columns], "is_test")


def classify_fit(df: DataFrame, features, label, trees=40, depth=8, seed=42):
    """A forest of trees on an assembled vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(df)


def classify(df: DataFrame, model, classes) -> DataFrame:
    """Predicted class, confidence and the map of probabilities, rounded."""
    from pyspark.ml.functions import vector_to_array

    p = model.transform(df).withColumn("p", vector_to_array("probability"))
    names = F.array(*[F.lit(c) for c in classes])
    probs = F.map_from_arrays(F.slice(names, 1, F.size("p")), F.transform("p", lambda x: F.round(x, 4)))
    return p.select(*df.columns, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"), F.array_max("p").alias("confidence"), probs.alias("probabilities"))


def feature_importance(spark, model, features, n=8) -> DataFrame:
    """The n weightiest features of a forest."""
    weights = [(f, float(w)) for f, w in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(weights, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def _path_length(n):
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x, rng, depth, limit):
    if depth >= limit or len(x) <= 1 or (x.max(0) == x.min(0)).all():
        return (depth + _path_length(len(x)),)
    f = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    return int(f), float(cut), _grow(x[x[:, f] < cut], rng, depth + 1, limit), _grow(x[x[:, f] >= cut], rng, depth + 1, limit)


def _laid_out(tree, width: int):
    """Feature, cut, low child and depth of a tree's nodes, and the steps to its last leaf. A high child follows the low one;
    a leaf is its own low child, by a feature beyond the others that is always zero."""
    nodes, levels, made = [tree], [0], []
    for i, node in enumerate(nodes):  # which grows
        if len(node) == 1:
            made.append((width, np.inf, i, node[0]))
        else:
            made.append((node[0], node[1], len(nodes), 0.0))
            nodes += node[2:]
            levels += [levels[i] + 1] * 2
    feature, cut, child, depth = zip(*made, strict=True)
    return np.array(feature), np.array(cut), np.array(child), np.array(depth, dtype=float), max(levels)


def _depths(laid, x):
    """The depth of each row of x, whose last column is zero: all rows take a step at once."""
    feature, cut, child, depth, steps = laid
    flat, row, at = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
    for _ in range(steps):
        at = child.take(at) + ~(flat.take(row + feature.take(at)) < cut.take(at))
    return depth.take(at)


def exact_percentile(df: DataFrame, value: str, q: float) -> float:
    """As Spark's percentile, between the two nearest ranks, which are selected by counts: no task holds the values."""
    at = (F.col("n") - 1) * F.lit(float(q))
    rows = ranked_values(df, [], value, lambda n: F.array(F.floor(at), F.ceil(at))).collect()  # two rows at most
    at, known = (rows[0].n - 1) * float(q), {r["rank"]: float(r.value) for r in rows}
    low, high = int(np.floor(at)), int(np.ceil(at))
    return known[low] if known[low] == known[high] else (high - at) * known[low] + (at - low) * known[high]


def iforest_fit(df: DataFrame, features, trees=100, sample=256, contamination=0.05, seed=42, id=None):
    """Isolation trees, one a group, each grown in a task of its own from `sample` rows; the cut by contamination.

    Give it nominal rows. A row is a candidate of a tree by a hash of its id, or of its values if there is none, and the
    tree's number, at a rate that gives twice the sample; each tree takes those with the least hashes. So the trees depend
    on the rows alone. Without an id, rows of equal values are drawn together.
    """
    import pickle

    n = max(1, df.count())
    values = [F.col(f).cast("double").alias(f) for f in features]
    own = df.select(*values, F.xxhash64(*([id] if id else features)).alias("_own"))  # once a row, not once a tree
    every = own.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = every.withColumn("h", F.xxhash64("_own", "tree", F.lit(seed))).where(F.pmod("h", F.lit(1 << 30)) < min(1.0, 2.0 * sample / n) * (1 << 30))

    def build(key, pdf):
        rng = np.random.default_rng(seed + int(key[0]))
        x = pdf.sort_values(["h", *features], kind="stable")[list(features)].to_numpy(float)[:sample]
        return pd.DataFrame({"tree": [key[0]], "size": [len(x)], "body": [pickle.dumps(_grow(x, rng, 0, int(np.ceil(np.log2(max(2, len(x)))))))]})

    grown = drawn.groupBy("tree").applyInPandas(build, "tree int, size int, body binary").collect()  # `trees` rows
    model = {"features": list(features), "size": max(r["size"] for r in grown), "trees": [pickle.loads(bytes(r["body"])) for r in sorted(grown, key=lambda r: r["tree"])]}
    return model | {"cut": exact_percentile(settled(_isolation(df, model).select("iso_raw")), "iso_raw", 1 - contamination)}


def _isolation(df: DataFrame, model) -> DataFrame:
    """df plus iso_raw: 2 to the power of minus the mean depth of a row over the depth expected of the sample."""
    sent = df.sparkSession.sparkContext.broadcast([_laid_out(t, len(model["features"])) for t in model["trees"]])
    norm = max(_path_length(model["size"]), 1e-9)

    @F.pandas_udf("double")
    def score(cols: pd.DataFrame) -> pd.Series:
        x = np.zeros((len(cols), cols.shape[1] + 1))
        x[:, :-1] = cols.to_numpy(float)
        total = np.zeros(len(x))
        for laid in sent.value:
            total += _depths(laid, x)
        return pd.Series(np.power(2.0, -total / len(sent.value) / norm))

    return df.withColumn("iso_raw", score(F.struct(*[F.col(f).cast("double").alias(f) for f in model["features"]])))


def iforest_score(df: DataFrame, model) -> DataFrame:
    """Anomaly score, a half at the model's cut and between 0 and 1, and the flag of rows beyond the cut."""
    raw = F.col("iso_raw")
    near = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + raw - model["cut"])), 4)
    return _isolation(df, model).withColumns({"iso_score": near, "iso_flag": raw > model["cut"]}).drop("iso_raw")


def reconstruction_fit(df: DataFrame, features, k=6, sigmas=3.0):
    """A linear encoder and decoder by principal components; threshold mean + sigmas deviations of the row error."""
    from pyspark.ml.feature import PCA, VectorAssembler

    scale = standardise_fit(df, features)
    x = VectorAssembler(inputCols=list(features), outputCol="v").transform(standardise(df.select(*features), scale))
    axes = PCA(k=min(k, len(features)), inputCol="v", outputCol="w").fit(x).pc.toArray()
    model = {"features": list(features), "scale": scale, "axes": axes, "threshold": float("inf")}
    r = reconstruction_score(df, model).agg(F.avg("mse"), F.stddev_pop("mse")).first()
    return model | {"threshold": r[0] + sigmas * r[1]}


def reconstruction_score(df: DataFrame, model) -> DataFrame:
    """Mean squared error of each row, the flag, and each feature's share of the error, largest first."""
    feats, keep = model["features"], np.eye(len(model["features"])) - model["axes"] @ model["axes"].T
    scaled = standardise(df.withColumns({f"_{f}": F.col(f) for f in feats}), {f"_{f}": model["scale"][f] for f in feats})
    x = F.array(*[F.col(f"_{f}") for f in feats])
    sq = F.array(*[F.pow(F.aggregate(F.zip_with(F.col("_x"), F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), 2) for row in keep])
    out = scaled.withColumn("_x", x).withColumn("_sq", sq).withColumn("_sum", F.aggregate("_sq", F.lit(0.0), lambda s, v: s + v))
    shares = F.zip_with(F.array(*[F.lit(f) for f in feats]), "_sq", lambda n, v: F.struct((-v / (F.col("_sum") + 1e-12)).alias("minus"), n.alias("feature")))
    ranked = F.transform(F.array_sort(shares), lambda s: F.struct(s["feature"].alias("feature"), F.round(-s["minus"], 4).alias("share")))
    return out.withColumns({"mse": F.col("_sum") / len(feats), "attributions": ranked}).withColumn("ae_flag", F.col("mse") >= model["threshold"]).drop("_x", "_sq", "_sum", *[f"_{f}" for f in feats])


def top_attributions(df: DataFrame, n=4) -> DataFrame:
    """The first n attributions."""
    return df.withColumn("top", F.slice("attributions", 1, n))


def ensemble_decision(df: DataFrame, threshold: float) -> DataFrame:
    """Half reconstruction, half isolation; anomalous if either says so or a confident class is not nominal."""
    score = 0.5 * F.least(F.col("mse") / threshold, F.lit(1.0)) + 0.5 * F.col("iso_score")
    return df.withColumns({"ensemble_score": F.round(score, 4), "is_anomaly": F.col("ae_flag") | F.col("iso_flag") | ((F.col("predicted") != "NOMINAL") & (F.col("confidence") > 0.75))})
