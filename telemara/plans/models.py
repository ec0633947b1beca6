"""Queries of E5 to E12 over the snapshots of all six tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import ARCHETYPES, encode_archetype, error_rate
from ..operators import boosting, features, reconstruction
from . import tiers

FLAT = {
    "infra_cpu_percent": "cpu_percent", "infra_memory_percent": "memory_percent", "infra_disk_io_mbps": "disk_io_mbps", "infra_network_egress_mbps": "network_egress_mbps", "infra_network_ingress_mbps": "network_ingress_mbps", "app_requests_per_sec": "requests_per_sec",
    "app_latency_p50_ms": "latency_p50_ms", "app_latency_p95_ms": "latency_p95_ms", "app_latency_p99_ms": "latency_p99_ms", "app_http_2xx_count": "http_2xx_count", "app_http_4xx_count": "http_4xx_count", "app_http_5xx_count": "http_5xx_count",
    "db_active_connections": "active_connections", "db_pool_utilization": "connection_pool_utilization", "db_query_latency_ms": "query_latency_mean_ms", "db_slow_queries_per_sec": "slow_queries_per_sec", "db_row_lock_waits": "row_lock_waits",
    "biz_order_volume": "order_volume", "biz_revenue_usd": "revenue_usd", "biz_checkout_success_rate": "checkout_success_rate", "biz_cart_abandonment_rate": "cart_abandonment_rate",
}


def telemetry(s, d):
    """The snapshots of all tiers as flat rows (tier, service_id, epoch, pos, base metrics, label, y)."""
    kept: dict = {}
    one = lambda name: tiers.QUERIES[name](s, d, kept).withColumn("tier", F.lit(name.removeprefix("tier_")))
    whole = reduce(lambda a, b: a.unionByName(b), map(one, tiers.QUERIES))
    flat = whole.select("tier", "service_id", "epoch", "pos", *[F.col(v).cast("double").alias(k) for k, v in FLAT.items()], error_rate(F.col("http_2xx_count"), F.col("http_4xx_count"), F.col("http_5xx_count")).alias("app_error_rate"), "label")
    return flat.withColumn("y", encode_archetype(F.col("label")))


KEYS, ORDER, AT = ["tier", "service_id"], ["epoch", "pos"], ["tier", "service_id", "epoch", "pos"]
SERVICES = 5  # of a tier at most: the snapshots of one lie as many positions apart
ROUNDS, DEPTH, EPOCHS, TREES = 12, 3, 30, 120


def vectors(s, d):
    """The 41 features of all snapshots, with E6's split by a number that no two share."""
    whole = features.vector_features(telemetry(s, d), KEYS, ORDER, at=("pos", SERVICES))
    return features.stratified_split(whole.withColumn("sample", F.xxhash64(*AT)), "y", "sample")  # which keeps the rows itself


def both(s, d):
    whole = vectors(s, d)
    return whole.where("not is_test"), whole.where("is_test")


def boosted(train):
    return boosting.boost_fit(train, features.VECTOR, "y", len(ARCHETYPES), rounds=ROUNDS, depth=DEPTH, rate=0.3)


def classified(s, d):
    train, test = both(s, d)
    made = boosting.boost_classify(test, boosted(train), list(ARCHETYPES))
    return made.select(*AT, "label", "predicted", "confidence", F.to_json("probabilities").alias("probabilities"))


def importance(s, d):
    return boosting.gain_importance(s, boosted(both(s, d)[0]))


def forest_of(nominal):
    """120 trees, as in the reference's training run; each draws its own 256 rows, told apart by their number."""
    return features.iforest_fit(nominal, features.VECTOR, trees=TREES, contamination=0.03, id="sample")


def isolated(s, d):
    train, test = both(s, d)
    return features.iforest_score(test, forest_of(train.where("y = 0"))).select(*AT, "label", "iso_score", "iso_flag")


def reconstructed(s, d):
    train, test = both(s, d)
    model = reconstruction.autoencoder_fit(train.where("y = 0"), features.VECTOR, epochs=EPOCHS)
    return reconstruction.top_attributions(reconstruction.reconstruction_score(test, model)).select(*AT, "label", "mse", "z_deviation", "ae_flag", "top")


def ensemble(s, d):
    train, test = both(s, d)
    nominal = train.where("y = 0")
    net, forest = reconstruction.autoencoder_fit(nominal, features.VECTOR, epochs=EPOCHS), forest_of(nominal)
    made = boosting.boost_classify(features.iforest_score(reconstruction.reconstruction_score(test, net), forest), boosted(train), list(ARCHETYPES))
    return features.ensemble_decision(made, net["threshold"]).select(*AT, "label", "predicted", "ensemble_score", "is_anomaly")


QUERIES = {"classify_archetype": classified, "feature_importance": importance, "isolation_forest": isolated, "reconstruction_error": reconstructed, "ensemble_decision": ensemble}
ORACLES: dict[str, str] = {}
