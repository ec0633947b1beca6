"""Document fingerprints: a canonical exact digest with byte comparison inside equal buckets."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import durable

#: Up to so many ids of crowded texts are broadcast (16 MB); beyond, the texts are found by a shuffled join.
BROADCAST_IDS = 2_000_000


def canonical(text: str | None) -> str:
    """NFKC, full case folding, NFKC again, and every run of white space as one space without ends; null: empty."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def wide_hash(data: str, bits: int = 128) -> str:
    """XXH3 in 32 hexadecimal digits; fewer bits only to make clashes in tests."""
    return f"{xxhash.xxh3_128_intdigest(data.encode()) >> (128 - bits):032x}"


def bucket_column(text: str, bits: int = 128):
    @F.pandas_udf("string")
    def bucket(s: pd.Series) -> pd.Series:
        return pd.Series([wide_hash(canonical(x), bits) for x in s], dtype=object)

    return bucket(F.col(text))


@F.pandas_udf(StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    return pd.Series([canonical(x) for x in s], dtype=object)


def differing_in_bucket(members: DataFrame, bits: int = 128) -> DataFrame:
    """members (bucket, text): (bucket, canon, rank) of each canonical text in buckets that hold two or more.

    The grouping key is the bucket together with the canonical bytes, so Spark compares the bytes of whatever shares
    a bucket, and copies collapse before the shuffle. rank is 0 for the least text.
    """
    texts = members.withColumn("canon", canonical_udf("text")).where(bucket_column("canon", bits) == F.col("bucket"))
    classes = texts.groupBy("bucket", "canon").agg(F.count("*").alias("n"))
    several = classes.groupBy("bucket").agg(F.sort_array(F.collect_set("canon")).alias("canons")).where(F.size("canons") > 1)
    return several.select("bucket", F.posexplode("canons").alias("rank", "canon"))


def fingerprint(df: DataFrame, id: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """(id, fingerprint) for each row of df: equal if and only if the canonical texts are equal, byte for byte.

    Null and empty texts share one fingerprint. Repeated rows get equal fingerprints; a null id is kept. Should
    different texts ever share a bucket, a rank among them follows after a dash.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    hashed = durable(rows.select("id", bucket_column("text", bits).alias("bucket")))
    crowded = hashed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    ids = durable(hashed.join(crowded, "bucket", "left_semi").select("id").distinct())
    clash = differing_in_bucket(texts_of(rows, ids).select(bucket_column("text", bits).alias("bucket"), "text"), bits)
    if clash.isEmpty():
        return hashed.select(F.col("id").alias(id), F.col("bucket").alias("fingerprint"))
    clash = durable(clash)
    full = rows.select("id", bucket_column("text", bits).alias("bucket"), canonical_udf("text").alias("canon"))
    return full.join(clash, ["bucket", "canon"], "left").select(F.col("id").alias(id), F.concat("bucket", F.coalesce(F.concat(F.lit("-"), "rank"), F.lit(""))).alias("fingerprint"))


def exact_groups(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, representative, copies): the group of equal canonical texts that each row is in."""
    marks = durable(fingerprint(df, id, text))
    groups = marks.groupBy("fingerprint").agg(F.min(id).alias("representative"), F.count("*").alias("copies"))
    return marks.join(groups, "fingerprint").select(id, "fingerprint", "representative", "copies")


def texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) whose id, null or not, is among ids; a broadcast only up to BROADCAST_IDS of them."""
    small, wanted = ids.count() <= BROADCAST_IDS, ids.select(F.col("id").alias("wanted"))
    return rows.join(F.broadcast(wanted) if small else wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")


def edited(text: str, follower: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + follower[:k]


LONGS, TEXTS = ("id", "next_id", "mark", "next_mark", "n_chars"), ("sha", "own", "edit", "next")
PAIR = StructType([StructField(n, LongType() if n in LONGS else StringType()) for n in (*LONGS, *TEXTS)])


def mark_of(text: str) -> int:
    """XXH64 with seed 42 as a signed number, which is Spark's xxhash64 of the text; beside its id it names a row's text."""
    return (xxhash.xxh64_intdigest(text.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def pair_row(doc_id, text, next_id, follower, own=None, next_=None):
    """Ids, marks, length, digest of the edited text and the three wide hashes of a document and its follower."""
    made = edited(text, follower)
    return doc_id, next_id, mark_of(text), mark_of(follower), len(text), hashlib.sha256(made.encode()).hexdigest(), own or wide_hash(canonical(text)), wide_hash(canonical(made)), next_ or wide_hash(canonical(follower))


def _pair_up(batches):
    """Each row of a sorted range with its follower; the last row of a range is left to its edge."""
    schema = pa.schema([(n, pa.int64() if n in LONGS else pa.string()) for n in (*LONGS, *TEXTS)])
    held, mark = None, None
    for batch in batches:
        out = []
        for place, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py()
            now = wide_hash(canonical(text))
            if held is not None and held[0] == place:
                out.append(pair_row(held[1], held[2], doc_id, text, mark, now))
            held, mark = (place, doc_id, text), now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


@F.pandas_udf(PAIR)
def _edge_row(i: pd.Series, t: pd.Series, j: pd.Series, u: pd.Series) -> pd.DataFrame:
    none = lambda x: None if pd.isna(x) else int(x)
    rows = [pair_row(none(a), b, none(c), d) for a, b, c, d in zip(i, t, j, u, strict=True)]
    return pd.DataFrame(rows, columns=[*LONGS, *TEXTS]).astype({"id": "Int64", "next_id": "Int64"})


def successive(df: DataFrame, partitions: int) -> DataFrame:
    """PAIR rows of all documents in descending id, null ids last, the last followed by the first.

    Ranges come from quantiles of the ids. One shuffle brings the neighbours of a range together; only its first and
    last row meet again, in a table of two rows a range. Ties of id go by text, so reruns agree.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [i / partitions for i in range(1, partitions)] or [0.5], 10 * partitions)).first()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(s: pd.Series) -> pd.Series:
        place = len(bounds) - np.searchsorted(bounds, s.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(s.isna(), len(bounds) + 1, place).astype(np.int32))

    placed = rows.select(range_of("id").alias("p"), "id", "text")
    order = [F.col("p"), F.col("id").desc_nulls_last(), F.col("text").desc()]
    inner = placed.repartition(partitions, "p").sortWithinPartitions(*order).mapInArrow(_pair_up, PAIR)
    ends = rows.select("id").select(range_of("id").alias("p"), "id").groupBy("p").agg(F.max("id").alias("first"), F.min("id").alias("last"))
    ids = ends.select(F.explode(F.array("first", "last")).alias("key")).distinct()
    texts = rows.join(F.broadcast(ids), F.expr("id <=> key"), "left_semi").groupBy("id").agg(F.max("text").alias("top"), F.min("text").alias("low"))
    order = ends.select("p", "last", F.coalesce(F.expr("lead(p) over (order by p)"), F.expr("min(p) over ()")).alias("q"))
    edge = order.join(ends.select(F.col("p").alias("q"), "first"), "q")
    edge = edge.join(texts.select(F.col("id").alias("i"), "low"), F.expr("last <=> i")).join(texts.select(F.col("id").alias("j"), "top"), F.expr("first <=> j"))
    return inner.unionByName(edge.select(_edge_row("last", "low", "first", "top").alias("x")).select("x.*"))


def fingerprint_edits(df: DataFrame) -> DataFrame:
    """For op1: fingerprints of every text and of its edited text, and their likeness (an exact digest: 1 or 0).

    df has doc_id and text; null texts count as empty, further columns are not read. Null ids come last. Rows that share
    an id are rows of their own, in descending order of their texts; the texts compared are named by id and XXH64, so that
    they are not multiplied. All rows of one id are ordered in one task.
    """
    spark = df.sparkSession
    pairs = durable(successive(df, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    marks = pairs.select(F.explode(F.array_distinct(F.array("own", "edit"))).alias("bucket"))
    crowded = durable(marks.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    rows = df.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    own = durable(pairs.join(crowded, pairs.own == crowded.bucket, "left_semi").select("id").distinct())
    edits = durable(pairs.where("own <> edit").join(crowded, pairs.edit == crowded.bucket, "left_semi").select(F.col("edit").alias("bucket"), "id", "mark", "next_id", "next_mark").distinct())
    need = edits.select(F.explode(F.array(F.struct("id", "mark"), F.struct(F.col("next_id").alias("id"), F.col("next_mark").alias("mark")))).alias("x"))
    need = durable(need.select(F.col("x.id").alias("wanted"), F.col("x.mark").alias("wanted_mark")).distinct())
    named = F.broadcast(need) if need.count() <= BROADCAST_IDS else need  # so that only the texts asked for move
    texts = durable(rows.join(named, F.col("id").eqNullSafe(F.col("wanted")) & (F.col("mark") == F.col("wanted_mark")), "left_semi").dropDuplicates(["id", "mark"]))
    self_ = texts.select(F.col("id").alias("i"), F.col("mark").alias("m"), "text")
    follower = texts.select(F.col("id").alias("j"), F.col("mark").alias("n"), F.col("text").alias("follower"))
    both = edits.join(self_, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).join(follower, F.col("next_id").eqNullSafe(F.col("j")) & (F.col("next_mark") == F.col("n")))
    made = both.select("bucket", F.expr("concat(left(text, length(text) - length(text) div 3), left(follower, length(text) div 3))").alias("text"))
    members = texts_of(rows.select("id", "text"), own).select(bucket_column("text").alias("bucket"), "text").unionByName(made)
    if not differing_in_bucket(members).isEmpty():
        raise RuntimeError("two texts share a 128-bit hash: use fingerprint(), which ranks them")
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return pairs.select(F.col("id").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), F.col("own").alias("fingerprint"), F.col("edit").alias("edited_fingerprint"), like("own", "edit").alias("near_edited"), like("own", "next").alias("near_next"))
