"""A: readers and writers of snapshots, series, matrices, labels, documents and exports; the nested schema."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_DDL = (
    "timestamp timestamp, trace_id string, service_id string, "
    "infrastructure struct<cpu_percent: double, memory_percent: double, disk_io_mbps: double, network_egress_mbps: double, network_ingress_mbps: double>, "
    "application struct<service_id: string, endpoint: string, requests_per_sec: double, latency_p50_ms: double, latency_p95_ms: double, latency_p99_ms: double, http_2xx_count: int, http_4xx_count: int, http_5xx_count: int>, "
    "database struct<db_instance_id: string, active_connections: int, connection_pool_utilization: double, query_latency_mean_ms: double, slow_queries_per_sec: double, row_lock_waits: int>, "
    "business struct<order_volume: int, revenue_usd: double, checkout_success_rate: double, cart_abandonment_rate: double>, "
    "ground_truth_label string, ground_truth_anomalous boolean, simulated_root_cause string"
)


def read_snapshots(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """A1: JSON lines of nested snapshots; a line that is none keeps its text in _corrupt_record."""
    return spark.read.schema(SNAPSHOT_DDL + ", _corrupt_record string").option("mode", mode).json(path)


def read_flat_telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A2: flat CSV with a header."""
    return spark.read.schema(schema).csv(path, header=True)


def read_series(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """A3: (ts, value) from CSV with or without a header; rows that do not parse are skipped."""
    raw = spark.read.schema("a string, b string").csv(path)
    return raw.select(F.expr("try_to_timestamp(a)").alias("ts"), F.expr("try_cast(b as double)").alias(name)).where(f"ts is not null and {name} is not null")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below that of spark.checkpoint.dir; only a local session may do without that setting."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dated(spark: SparkSession, folders: list[str]) -> None:
    """Gives the files of each folder a later time than those of the folder before; a folder may be missing."""
    hadoop, conf, now = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), None
    for i, folder in enumerate(hadoop.Path(f) for f in folders):
        files = folder.getFileSystem(conf)
        for x in files.listStatus(folder) if files.exists(folder) else []:
            now = now or (x.getModificationTime() // 1000 - len(folders)) * 1000
            files.setTimes(x.getPath(), now + 1000 * i, -1)
            if files.getFileStatus(x.getPath()).getModificationTime() != now + 1000 * i:
                raise RuntimeError(f"the file system of {folder.toString()} keeps no times of its files")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir; only a local session may do without that setting."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, computed once and kept by columns in files of the shared folder, in folders by `by` if given; a reader takes the columns it needs alone."""
    spark = df.sparkSession
    folder = scratch(spark, name)
    df.write.partitionBy(*by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def in_few(df: DataFrame) -> DataFrame:
    """df, whose rows are few and large, dealt evenly to two partitions a core, for steps that many rounds repeat."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def numbered(df: DataFrame, *order, pos: str = "pos") -> DataFrame:
    """df plus the position of each row in `order`: sorted in ranges, and only a row count of each range meets elsewhere."""
    return indexed(settled(df.orderBy(*order)), pos)


def indexed(df: DataFrame, pos: str = "pos") -> DataFrame:
    """df plus the position of each row in reading order: counts of the partitions before it, then the row's own number.

    The counts are one row a partition; no row moves.
    """
    spark, at = df.sparkSession, F.monotonically_increasing_id()
    marked = df.withColumn("_at", at).withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = {r["_p"]: r["count"] for r in marked.groupBy("_p").count().collect()}
    base, total = [], 0
    for p in sorted(counts):
        base.append((p, total))
        total += counts[p]
    bases = spark.createDataFrame(base or [(0, 0)], "_p long, _base long")
    return marked.join(F.broadcast(bases), "_p").withColumn(pos, F.col("_base") + F.col("_i")).drop("_at", "_p", "_i", "_base")


def lines(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """(pos, value) of the lines of the text files at path, in the order of the files' names and of the lines in them."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return numbered(spark.read.text(path).select("value", *at), "file", "block", "at", pos=pos).select(pos, "value")


def read_channel_matrix(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A4: (pos, values) of lines of doubles split by commas or blanks; a line with a bad token is dropped."""
    raw = lines(spark, path, "raw")
    raw = raw if max_rows is None else raw.where(F.col("raw") < max_rows)
    values = F.transform(F.split(F.trim("value"), r"[,\s]+"), lambda t: t.try_cast("double"))
    kept = raw.select("raw", values.alias("values")).where("not exists(values, v -> v is null)")
    return numbered(kept, "raw").select("pos", "values")


def read_labels(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A5: (pos, label) of one integer a line; blank lines are skipped."""
    raw = lines(spark, path, "raw").where("trim(value) <> ''")
    rows = numbered(raw.select("raw", F.expr("try_cast(trim(value) as int)").alias("label")), "raw").select("pos", "label")
    return rows if max_rows is None else rows.where(F.col("pos") < max_rows)


def read_markdown_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(uri, text) of all *.md below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))


def materialise_tier(spark: SparkSession, path: str, build) -> DataFrame:
    """The JSON lines at path, written by build(spark) if they are not there yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build(spark).write.json(path)
    return spark.read.json(path)


def write_fact_csv(fin: DataFrame, path: str) -> None:
    """The fact table with its date key and ISO timestamps."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    rest = [c for c in fin.columns if c not in ("detected_at", "resolved_at")]
    fin.select(*rest, F.date_format("detected_at", "yyyyMMdd").cast("int").alias("date_key"), stamp("detected_at"), stamp("resolved_at")).write.mode("overwrite").csv(path, header=True)


DIMENSIONS = {
    "severity": ("severity string, rank int, hourly_rate double", [("CRITICAL", 1, 180000.0), ("HIGH", 2, 120000.0), ("MEDIUM", 3, 25000.0), ("LOW", 4, 5000.0)]),
    "service": ("service_id string, tier string, criticality string", [("checkout-service", "application", "TIER_1"), ("order-processing", "application", "TIER_1"), ("payment-service", "application", "TIER_1"), ("inventory-service", "application", "TIER_2"), ("kubernetes-cluster-core", "infrastructure", "TIER_1")]),
    "archetype": ("archetype string, code int", [(a, i) for i, a in enumerate(("NOMINAL", "DB_CONNECTION_POOL_SATURATION", "MEMORY_LEAK_GC_PAUSE", "CASCADING_THIRD_PARTY_FAILURE", "PAYMENT_GATEWAY_OUTAGE", "BLACK_FRIDAY_TRAFFIC_BURST", "unclassified_anomaly"))]),
}


def write_dimensions(spark: SparkSession, path: str) -> None:
    """The dimension tables, one folder each."""
    for name, (schema, rows) in DIMENSIONS.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").csv(f"{path}/dim_{name}", header=True)


def write_kpi_json(kpi: DataFrame, parts: dict[str, DataFrame], path: str) -> None:
    """A10: one JSON document of the KPI row with a list for each part (aggregates of a few rows)."""
    for name, df in parts.items():
        kpi = kpi.join(F.broadcast(df.agg(F.collect_list(F.struct(*df.columns)).alias(name))))
    kpi.coalesce(1).write.mode("overwrite").json(path)
