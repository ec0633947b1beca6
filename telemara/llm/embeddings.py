"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision only near the threshold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, hot_among, hot_keys, lookup
from .components import connected_components
from .simhash import forest

TILE = 4096
#: float32 holds every integer below 2 ** 24, and so exact sums of this many products of two int8 values.
EXACT = (1 << 24) // 127**2
#: An exact integer product is rescaled by two float32 factors: three roundings of 2 ** -24 of a value below 1.1, and the
#: double-precision rounding of the bounds themselves. The dimension does not enter.
SLACK = 1e-6


def usable(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values and scales of unit vectors, and the exact length of what each loses by it."""
    scale = 127.0 / np.abs(unit).max(axis=1)
    q = np.rint(unit * scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q / scale[:, None], axis=1)


def int8_products(qa: np.ndarray, qb: np.ndarray) -> np.ndarray:
    """The products of all int8 vectors of two tiles as float32; exact integers up to EXACT dimensions at a time."""
    parts = range(0, qa.shape[1], EXACT)
    product = None
    for i in parts:
        one = qa[:, i : i + EXACT].astype(np.float32) @ qb[:, i : i + EXACT].astype(np.float32).T
        product = one if product is None else product + (one if len(parts) == 1 else one.astype(np.float64))
    return product


def tile_links(qa, sa, ea, ua, qb, sb, eb, ub, threshold: float):
    """Index pairs of two tiles with cosine >= threshold.

    Since |u.w - û.ŵ| <= e_u + (1 + e_u) e_w for unit vectors that lose e_u and e_w, a pair whose int8 product plus
    that bound stays below the threshold is none, one whose product less the bound reaches it is a link, and only
    those between are multiplied again in double precision.
    """
    product = int8_products(qa, qb)
    product *= (1 / sa)[:, None].astype(product.dtype)
    product *= (1 / sb)[None, :].astype(product.dtype)
    loosest = ea.max() + (1 + ea.max()) * eb.max() + 2 * SLACK
    i, j = np.nonzero(product >= np.float32(threshold - loosest))
    near = product[i, j].astype(np.float64)
    bound = ea[i] + (1 + ea[i]) * eb[j] + SLACK
    i, j, near, bound = (x[near + bound >= threshold] for x in (i, j, near, bound))
    link = near - bound >= threshold
    for k in np.array_split(unsure := np.flatnonzero(~link), max(1, len(unsure) // 50_000)):
        link[k] = np.einsum("ij,ij->i", ua[i[k]], ub[j[k]]) >= threshold
    return i[link], j[link]


def dots(table: pa.Table):
    """Vectors as float64, divided by their lengths; scaled first, so that no length over- or underflows."""
    raw = np.stack(table["vector"].to_numpy()).astype(np.float64)
    raw /= np.abs(raw).max(axis=1)[:, None]
    return raw / np.linalg.norm(raw, axis=1)[:, None]


def tile_pair(t: pa.Table, threshold: float) -> pa.Table:
    """All links between two tiles (or within one): for each vector the copies linked to it, and a spanning forest."""
    rep, copies, side = t["rep"].to_numpy(), t["copies"].to_numpy(), t["tile"].to_numpy()
    one, two = int(t["one"][0].as_py()), int(t["two"][0].as_py())
    unit = dots(t)
    q, scale, lost = quantised(unit)
    x, y = np.flatnonzero(side == one), np.flatnonzero(side == two)
    if not len(x) or not len(y):
        return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    i, j = tile_links(q[x], scale[x], lost[x], unit[x], q[y], scale[y], lost[y], unit[y], threshold)
    i, j = x[i], y[j]
    i, j = (i[i < j], j[i < j]) if one == two else (i, j)
    links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
    some = np.flatnonzero(links)
    a, b = forest(rep[i], rep[j])
    none = np.zeros(len(b), np.int64)
    return pa.table({"rep": pa.array(np.r_[rep[some], b]), "links": pa.array(np.r_[links[some].astype(np.int64), none]), "other": pa.array(np.r_[rep[some], a])})


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of df: links are pairs with cosine >= threshold.

    Null, zero, empty or non-finite vectors, and such with null components, link with nothing; vectors of different
    lengths never link. Equal vectors are one node, with a number of its own, that counts its copies. Every pair of
    tiles of distinct vectors is compared, each in a task of its own; the work is that of all pairs, but no pair is
    written: a tile pair returns at most a count and a forest edge a vector. Rows that repeat an id are rows of their
    own; a component's id is the smallest id of its rows that is not null. A row with a null id counts and links like
    any other; its component_id is null only if no row of its component has an id, and only then is it kept.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    good = rows.where(usable("vector"))
    reps = durable(good.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    n = reps.count()
    tiles = max(1, math.ceil(n / tile))
    dealt = reps.select("vector", "copies", "rep", F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int").alias("tile"), F.size("vector").alias("length"))
    sent = dealt.withColumn("peer", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    sent = sent.withColumns({"one": F.least("tile", "peer"), "two": F.greatest("tile", "peer")}).drop("peer")
    sent = sent.repartition(max(1, min(4000, tiles * (tiles + 1) // 2)), "length", "one", "two")
    found = durable(sent.groupBy("length", "one", "two").applyInArrow(lambda t: tile_pair(t, threshold), "rep long, links long, other long"))
    links = found.where("links > 0").groupBy(F.col("rep").alias("own")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links = 0").select(F.col("other").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("node", "rep")
    nodes = durable(reps.join(roots, "rep", "left").select("rep", "vector", "least", "copies", F.coalesce("root", "rep").alias("root")))
    first = nodes.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component_id"))
    placed = lookup(nodes, "root", first, hot_keys(nodes, "root")).join(links, F.col("rep") == F.col("own"), "left")
    known = durable(placed.select(F.col("vector").alias("v"), F.xxhash64("vector").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.col("copies").alias("n")))
    hot = hot_among(known.select("key", "n"))
    busy = lambda key: key.isin(hot) if hot else F.lit(False)
    common = good.where(busy(F.xxhash64("vector"))).join(F.broadcast(known.where(busy(F.col("key")))), F.col("vector") == F.col("v"))  # fewer than HOT vectors
    others = good.where(~busy(F.xxhash64("vector"))).join(known, F.col("vector") == F.col("v"))
    joined = common.unionByName(others).select("id", "n_links", "component_id")
    rest = rows.where(~usable("vector")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(rest).select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
