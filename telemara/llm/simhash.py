"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import durable, hot_keys, lookup, renamed
from .components import connected_components

#: A bucket is to hold about so many variants.
BUCKET_VARIANTS = 2_000_000


def shingle_hashes(text: str | None, width: int):
    """The hashes of a text's word shingles, repeats included, at most 50,000 at a time; nothing for a text without a word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :][:k]
    hash_of = xxhash.xxh64_intdigest
    for i in range(0, k, 50_000):
        yield np.array([hash_of(joined[a:b], 42) for a, b in zip(starts[i : i + 50_000][: k - i].tolist(), last[i : i + 50_000].tolist(), strict=True)], dtype=np.uint64)


def majority_bits(hashes) -> int:
    tally, n = np.zeros(64, np.int64), 0
    for h in hashes:
        tally += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return sum(1 << i for i in np.flatnonzero(2 * tally > n).tolist())


def shingle_bits(text: str | None, width: int) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the hashes of its word shingles."""
    return majority_bits(shingle_hashes(text, width))


def simhash_column(text: str, width: int):
    @F.pandas_udf(LongType())
    def simhash(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([shingle_bits(x, width) for x in s], dtype=np.uint64).view(np.int64))

    return simhash(F.col(text))


def flips(bits: int, most: int) -> np.ndarray:
    """All numbers below 2**bits with at most `most` bits set, as unsigned 64-bit integers."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], dtype=np.uint64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges: every node with the smallest of its component, but for that one itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[root[far]], nodes[far]


def ball_edges(fps: np.ndarray, head: int, lead: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints found by the variants whose leading `lead` bits are `head`, as a spanning forest.

    Each fingerprint makes all its variants within `half` flips that lie in the bucket. Those that share a variant
    are at most 2 * half apart, so linking each to the first of its variant keeps every component.
    """
    tail = 64 - lead
    used = np.bitwise_count((fps >> np.uint64(tail)) ^ np.uint64(head)) if lead else np.zeros(len(fps), np.uint8)
    variants, source = [], []
    for spent in range(half + 1):
        at = np.flatnonzero(used == spent)
        masks = flips(tail, half - spent)
        low = fps[at] & np.uint64((1 << tail) - 1) if lead else fps[at]
        variants.append((low[:, None] ^ masks[None, :]).ravel())
        source.append(np.repeat(at.astype(np.int32), len(masks)))
    variants, source = np.concatenate(variants), np.concatenate(source)
    order = np.argsort(variants)
    variants, source = variants[order], source[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    a, b = np.minimum(source[same], source[same + 1]), np.maximum(source[same], source[same + 1])
    pairs = np.unique(a.astype(np.int64) << 32 | b)
    a, b = fps[pairs >> 32], fps[pairs & 0xFFFFFFFF]
    near = np.bitwise_count(a ^ b) <= 2 * half
    return forest(a[near], b[near])


def near_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fps (fp long, distinct): edges (a, b) that connect all fingerprints at `radius` or fewer differing bits.

    Two such fingerprints share a variant within half the radius of both. The shuffle goes by the variants' leading
    bits: a fingerprint is sent once to each bucket where it has variants, and makes them there. With one more
    leading bit whenever the table doubles, a bucket's variants stay as many.
    """
    half = radius // 2
    if radius != 2 * half:
        raise ValueError("the radius must be even")
    total = fps.count() * len(flips(64, half))
    lead = min(62, max(6, math.ceil(math.log2(max(1, total / BUCKET_VARIANTS)))))
    heads = F.array(*[F.lit(int(x)) for x in flips(lead, half)])
    own = F.shiftrightunsigned("fp", 64 - lead)
    sent = fps.select("fp", F.explode(F.transform(heads, lambda m: m.bitwiseXOR(own))).alias("head"))

    def run(t: pa.Table) -> pa.Table:
        a, b = ball_edges(t["fp"].to_numpy().view(np.uint64), t["head"][0].as_py(), lead, half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("head").applyInArrow(run, "a long, b long").distinct()


def grouped(df: DataFrame, id: str, text: str, width: int, radius: int) -> DataFrame:
    """(id, mark, fp, root, component_id) of each row: mark a hash of its text, root its component's fingerprint."""
    marks = durable(df.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), simhash_column(text, width).alias("fp")))
    least = durable(marks.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(near_fingerprints(least.select("fp"), radius)).withColumnRenamed("node", "fp")
    labelled = durable(least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    first = labelled.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component_id"))
    classes = durable(lookup(labelled, "root", first, hot_keys(labelled, "root")).select(F.col("fp").alias("own"), "root", "component_id"))
    return lookup(marks, "fp", classes, hot_keys(marks, "fp"))


def one_of_each(df: DataFrame, groups: DataFrame, id: str, text: str) -> DataFrame:
    """Of each root of groups (id, mark, root, component_id) the row of df with the component's id, as it is; of rows
    that repeat that id, one with the least hash of its text. A group of null ids keeps one of them."""
    best = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("mark", "id")).alias("x"), F.count("*").alias("n"))
    kept = durable(best.select(F.col("x.id").alias("id"), F.col("x.mark").alias("mark"), "n"))
    rows, name = renamed(df)
    own = rows.withColumn("own", F.xxhash64(name[text]))
    rows = own.join(kept, own[name[id]].eqNullSafe(kept["id"]) & (own["own"] == kept["mark"]), "left_semi")
    if not kept.where("n > 1").isEmpty():
        rows = rows.dropDuplicates([name[id], "own"])
    return rows.drop("own").toDF(*df.columns)


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for each row of df; component_id is the smallest id reachable by links.

    Null texts and texts without a word have fingerprint zero, which links like any other; repeated rows are rows; a
    null id is kept and gets the component of its fingerprint (null if that has no other id); further columns are not
    read. Equal fingerprints are one node, so copies cost nothing.
    """
    return grouped(df, id, text, width, radius).select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 4) -> DataFrame:
    """One row of df, all its columns as they are, for each group: that with the group's smallest id (see one_of_each)."""
    return one_of_each(df, durable(grouped(df, id, text, width, radius)), id, text)
