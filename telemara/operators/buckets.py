"""G10 and G11 on tables in files: buckets by a hash of the key, of which a change set rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import settled


class BucketedTable:
    """A table below a folder that all executors reach, one folder a bucket of `key`; rows of a key share a bucket."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 64) -> BucketedTable:
        made = cls(df.sparkSession, path, key, buckets)
        made._write(df, "errorifexists")
        return made

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, mode: str) -> None:
        placed = df.withColumn("bucket", self._bucket()).repartition("bucket")
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def apply(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts merge(rows, changes) in place of the rows of the buckets that changes touch, and gives those buckets.

        merge sees all rows of these buckets and must keep what changes say nothing of, as upsert_incidents and
        replace_children do; it leaves no bucket empty. All other files stay as they are and are not read. A change set
        that is applied again after a failure gives the same table, if merging it twice does.
        """
        changes = settled(changes)
        touched = sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())  # a row a bucket at most
        if touched:
            rows = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket")
            self._write(settled(merge(rows, changes)), "overwrite")
        return touched
