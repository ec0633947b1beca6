"""Near duplicates by the Jaccard similarity of shingle sets: SimHash balls and MinHash bands propose, the sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, hot_among, hot_keys, lookup, slices
from .components import connected_components
from .simhash import forest, majority_bits, near_fingerprints, one_of_each, shingle_hashes

#: Of pairs at similarity 0.8, (1 - 0.8 ** ROWS) ** BANDS = 5e-6 share no band.
BANDS, ROWS = 40, 6
#: Members of a crowded bucket that are compared with as many others in one task.
TILE = 1024
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(hashes) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band: equal for two sets if the least products of their hashes with the band's factors are."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(s), 1024):
        low = np.minimum(low, (s[i : i + 1024, None] * FACTORS[None, :]).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def name_of(s: np.ndarray) -> str:
    return xxhash.xxh128_hexdigest(s.tobytes())


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), np.concatenate(rows).view(np.int64))


def shingle_marks(df: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(id, mark, node, n, fp, keys) of each row: a hash of the text, the name and size of its shingle set, its SimHash
    and its bands' keys."""

    def run(batches):
        for batch in batches:
            for i, j in slices([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(2)], 3_000_000):
                hashes = [list(shingle_hashes(t, width)) for t in batch.column(2)[i:j].to_pylist()]
                sets = [shingle_set(h) for h in hashes]
                fp = np.array([majority_bits(h) for h in hashes], np.uint64).view(np.int64)
                columns = [batch.column(0)[i:j], batch.column(1)[i:j], pa.array([name_of(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), lists([band_keys(s) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "node", "n", "fp", "keys"])

    rows = df.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {df.schema[id].dataType.simpleString()}, mark long, node string, n long, fp long, keys array<long>")


def shingle_sets(df: DataFrame, text: str, width: int) -> DataFrame:
    """(node, hashes) of each row."""

    def run(batches):
        for batch in batches:
            for i, j in slices([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(0)], 3_000_000):
                sets = [shingle_set(shingle_hashes(t, width)) for t in batch.column(0)[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets]), lists(sets)], names=["node", "hashes"])

    return df.select(F.col(text)).mapInArrow(run, "node string, hashes array<long>")


def common_shingles(lists_: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the lists have in common, by products of 0/1 columns of the values that repeat."""
    m = len(lists_)
    value, column, times = np.unique(np.concatenate(lists_), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(m), [len(x) for x in lists_]), times > 1
    place, column, owner = np.cumsum(shared) - 1, column[shared[column]], owner[shared[column]]
    column, total = place[column], np.zeros((m, m), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        inside = (column >= low) & (column < low + 4096)
        marks = np.zeros((m, min(4096, int(shared.sum()) - low)), np.float32)
        marks[owner[inside], column[inside] - low] = 1
        total += marks @ marks.T
    return total


def tile_links(t: pa.Table) -> pa.Table:
    """Links of similarity 0.8 or more between members of a bucket that lie in two tiles, or in one, and in different
    components: a spanning forest of them."""
    num, root, n, tile = (t[c].to_numpy() for c in ("num", "root", "n", "tile"))
    one, two = int(t["one"][0].as_py()), int(t["two"][0].as_py())
    size = n[:, None] + n[None, :]
    near = (9 * common_shingles([x.values.to_numpy() for x in t["hashes"].combine_chunks()]) >= 4 * size) & (root[:, None] != root[None, :])
    i, j = np.nonzero(np.triu(near) if one == two else near & (tile[:, None] == one) & (tile[None, :] == two))
    a, b = forest(num[i], num[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def across(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """open_ (key, num, n, root), members of buckets that hold several components: (a, b), edges that join those that
    any two members of a bucket link. Tiles of TILE members meet in a task each, and no pair but a forest's is written."""
    sizes = open_.groupBy(F.col("key").alias("of")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = open_.join(sizes, F.col("key") == F.col("of")).withColumn("tile", F.pmod(F.xxhash64("num"), F.col("tiles")).cast("int"))
    sent = dealt.join(sets, "num").withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = sent.select("key", "num", "n", "root", "tile", F.least("tile", "peer").alias("one"), F.greatest("tile", "peer").alias("two"), "hashes")
    return pairs.groupBy("key", "one", "two").applyInArrow(tile_links, "a long, b long")


def similar_groups(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 4) -> DataFrame:
    """(id, mark, root, component_id) for each row of df: a hash of its text, the number of its component, and the smallest
    id reachable over links of similarity 0.8 or more (null if no row of the component has an id).

    Equal shingle sets are one node, and texts without a word are equal. Nodes meet in a bucket by a MinHash band or by
    an equal SimHash, and as pairs by a link of `radius` or fewer bits between SimHashes. Each node is compared with one
    of its bucket, chosen by a hash; then, in buckets that still hold several components, all are compared with all,
    tile by tile, and only edges that join components are written. Only the sets make a link, in tiles too.
    """
    marks = durable(shingle_marks(df, id, text, width))
    named = marks.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = durable(named.withColumn("num", F.monotonically_increasing_id()))
    full = nodes.where("n > 0")
    alike = full.groupBy("fp").agg(F.min("num").alias("first"))
    balls = near_fingerprints(alike.select("fp"), radius).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    of = lambda x: alike.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(x))
    near = balls.join(of("a"), "fp_a").join(of("b"), "fp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    buckets = full.select("num", "n", F.explode(F.concat("keys", F.array(F.xxhash64("fp")))).alias("key"))
    firsts = durable(buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("num", "key"), F.col("num").alias("num"))).alias("least"), F.count("*").alias("in_it")).where("in_it > 1").select(F.col("key").alias("in_key"), F.col("least.num").alias("a"), "in_it"))
    met = durable(lookup(buckets, "key", firsts.drop("in_it"), hot_among(firsts.select(F.col("in_key").alias("key"), F.col("in_it").alias("n")))))
    tried = durable(met.where("num <> a").select(F.least("a", "num").alias("a"), F.greatest("a", "num").alias("b")).unionByName(near).distinct())
    wanted = met.select("num").unionByName(tried.select(F.explode(F.array("a", "b")).alias("num"))).distinct()
    ids = nodes.join(wanted, "num", "left_semi").select(F.col("least").alias("in_id")).distinct()
    plain = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    candidates = plain.join(ids, F.col("id").eqNullSafe(F.col("in_id")), "left_semi")
    sets = durable(shingle_sets(candidates, "text", width).dropDuplicates(["node"]).join(nodes.select("node", "num"), "node").select("num", "hashes"))

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("num").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("num").alias("b"), F.col("hashes").alias("y")), "b")
        return durable(both.where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b"))

    roots = connected_components(linked(tried)).withColumnRenamed("node", "own")
    placed = durable(met.join(roots, F.col("num") == F.col("own"), "left").select("key", "num", "n", F.coalesce("root", "num").alias("root")))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = durable(placed.join(several, "key", "left_semi"))
    more = durable(across(open_, sets))
    labels = nodes.select("node", "num", "least").join(roots, F.col("num") == F.col("own"), "left").select("node", "num", "least", F.coalesce("root", "num").alias("root"))
    if not more.isEmpty():
        labels = durable(labels)
        root_of = lambda x: labels.select(F.col("num").alias(f"num_{x}"), F.col("root").alias(f"root_{x}"))
        joined = more.join(root_of("a"), F.col("a") == F.col("num_a")).join(root_of("b"), F.col("b") == F.col("num_b"))
        tops = connected_components(joined.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("was"), F.col("root").alias("top"))
        labels = labels.join(tops, F.col("root") == F.col("was"), "left").select("node", "least", F.coalesce("top", "root").alias("root"))
    labelled = durable(labels.select("node", "least", "root"))
    first = labelled.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component_id"))
    classes = durable(lookup(labelled, "root", first, hot_keys(labelled, "root")).select(F.col("node").alias("own"), "root", "component_id"))
    return lookup(marks.select("id", "mark", "node"), "node", classes, hot_keys(marks, "node")).select("id", "mark", "root", "component_id")


def drop_similar(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 4) -> DataFrame:
    """One row of df, all its columns as they are, for each group: that with the group's smallest id (see one_of_each)."""
    return one_of_each(df, durable(similar_groups(df, id, text, width, radius)), id, text)
