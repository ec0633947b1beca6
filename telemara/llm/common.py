"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; the lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot if it has more than one in HOT of all rows, and 100 at least; so there are fewer than HOT of them, at any size.
HOT = 1000


def hot_keys(rows: DataFrame, key: str) -> list:
    """The hot keys of rows, fewer than HOT. rows is durable, as it is read again."""
    return hot_among(rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")))


def hot_among(counts: DataFrame) -> list:
    """The hot keys of a table (key, n); null is never hot."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    edge = max(100, (total or 0) / HOT)
    return [r[0] for r in counts.where((F.col("n") > edge) & F.col("key").isNotNull()).select("key").collect()] if (most or 0) > edge else []


def lookup(rows: DataFrame, key: str, table: DataFrame, hot: list, how: str = "inner") -> DataFrame:
    """rows and the rest of table, whose first column is unique, where it equals their key; how: inner or left.

    The rows of hot keys meet theirs, fewer than HOT, by a broadcast, all others by a shuffle, so no task gets all
    the rows of a hot key. The names of table's columns must not be in rows.
    """
    at = table.columns[0]
    if not hot:
        return rows.join(table, F.col(key) == F.col(at), how).drop(at)
    busy = F.coalesce(F.col(key).isin(hot), F.lit(False))
    known = F.broadcast(table.where(F.col(at).isin(hot)))
    return rows.where(busy).join(known, F.col(key) == F.col(at), how).unionByName(rows.where(~busy).join(table, F.col(key) == F.col(at), how)).drop(at)


def sums_before(df: DataFrame, order: list, **sums: str) -> DataFrame:
    """df plus, for each name, the sum of an expression over all rows before in `order`, which no two rows share.

    Rows are sorted in ranges; only one row a range, its sums, meets in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(*[F.sum(F.expr(e)).alias(k) for k, e in sums.items()])
    offsets = totals.select(F.col("range").alias("r"), *[F.coalesce(F.sum(k).over(ranges), F.lit(0)).alias(f"before_{k}") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *[F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0)).alias(f"inside_{k}") for k, e in sums.items()])
    joined = summed.join(F.broadcast(offsets), F.col("range") == F.col("r"))
    return joined.select(*df.columns, *[(F.col(f"before_{k}") + F.col(f"inside_{k}")).alias(k) for k in sums])


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with the columns c0, c1 and so on, which clash with no name of ours, and the new name of each."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def others(names: dict[str, str], *added: str) -> list[Column]:
    """The columns of renamed() under their old names, but for those that what is added replaces, in any case."""
    return [F.col(new).alias(old) for old, new in names.items() if old.lower() not in added]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def word_count(text: Column) -> Column:
    """Number of words, counted as word starts; null: 0. Runs as one regular expression in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long")).first()[0]


def slices(lengths, most: int):
    """Ranges [i, j) over the rows of a batch whose lengths sum to at most `most` (a longer row stands alone)."""
    i, total = 0, 0
    for j, n in enumerate(lengths):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(lengths):
        yield i, len(lengths)
