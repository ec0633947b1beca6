"""Bucketed history: change sets equal merges of the whole table and leave the files of other buckets alone."""

import os

from pyspark.sql import functions as F

from telemara.operators import history
from telemara.operators.buckets import BucketedTable

INCIDENT = "incident_id long, title string, severity string, detected_at long, status string, confidence double, postmortem string, resolved_at long"


def files(path):
    return {os.path.join(top, f): os.stat(os.path.join(top, f)).st_mtime_ns for top, _, names in os.walk(path) for f in names if f.startswith("part-")}


def shown(df, columns):
    return sorted(map(str, map(tuple, df.select(*columns).collect())))


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    old = spark.createDataFrame([(i, f"t{i}", "HIGH", i, "OPEN", 0.5, None, None) for i in range(400)], INCIDENT)
    new = spark.createDataFrame([(7, "late title", "LOW", 9, "RESOLVED", 0.9, "pm", 70), (8, "x", "LOW", 9, "PENDING", 0.8, None, 71), (1000, "new", "LOW", 5, "OPEN", 0.1, None, None)], INCIDENT)
    table = BucketedTable.create(old, f"{tmp_path}/incidents", "incident_id", 16)
    before = files(tmp_path)
    touched = table.apply(new, history.upsert_incidents)
    after = files(tmp_path)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert len(touched) <= 3 < len(kept) and all(after.get(f) == before[f] for f in kept)
    assert all(f not in after for f in set(before) - kept)
    want = history.upsert_incidents(old, new)
    assert shown(table.read(), want.columns) == shown(want, want.columns)
    table.apply(new, history.upsert_incidents)  # the same change set again
    assert shown(table.read(), want.columns) == shown(want, want.columns)


def test_children_and_an_empty_change_set(spark, tmp_path):
    rows = spark.createDataFrame([(i % 50, i, "old") for i in range(300)], "incident_id long, signal_id long, metric string")
    new = rows.where("incident_id in (3, 4)").limit(3).withColumn("metric", F.lit("new"))
    new = spark.createDataFrame([tuple(r) for r in new.collect()], new.schema)
    table = BucketedTable.create(rows, f"{tmp_path}/signals", "incident_id", 8)
    before = files(tmp_path)
    assert table.apply(new.where("false"), history.replace_children) == [] and files(tmp_path) == before
    table.apply(new, history.replace_children)
    want = history.replace_children(rows, new)
    assert shown(table.read(), want.columns) == shown(want, want.columns)
