"""Streams whose state decides: investigations that are resolved or expire, time order in the quarantine, 41-value vectors."""

import time

import pytest
from pyspark.sql import functions as F

from telemara import streaming
from telemara.operators import contract
from telemara.plans.text import stateful


@pytest.fixture
def feed(spark, tmp_path):
    stateful(spark)

    def put(number, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")

    return put, lambda schema: streaming.read_snapshot_stream(spark, f"{tmp_path}/in/*", schema), tmp_path


NEWS = "incident_id long, epoch long, status string"


def test_late_news_do_not_revive_a_resolved_incident(spark, feed):
    put, stream, path = feed
    put(0, [(1, 10, "OPEN"), (2, 10, "OPEN")], NEWS)
    put(1, [(1, 20, "RESOLVED")], NEWS)
    put(2, [(1, 15, "OPEN"), (3, 5, "OPEN"), (3, 6, "OPEN")], NEWS)
    out = streaming.run_until_idle(streaming.active_stream(stream(NEWS), "incident_id"), f"{path}/out", f"{path}/state")
    assert [r.active for r in out.where("incident_id = 1").collect()].count(True) == 1
    assert sorted(map(tuple, streaming.live_investigations(spark, f"{path}/state", "incident_id").collect())) == [(2, 10, "OPEN"), (3, 6, "OPEN")]


def test_states_end_with_their_time_to_live(spark, feed):
    put, stream, path = feed
    put(0, [(1, 10, "OPEN"), (2, 30, "RESOLVED")], NEWS)
    streaming.run_until_idle(streaming.active_stream(stream(NEWS), "incident_id", 3), f"{path}/out", f"{path}/state")
    time.sleep(4)
    assert streaming.live_investigations(spark, f"{path}/state", "incident_id").count() == 0
    put(1, [(2, 15, "OPEN")], NEWS)  # the mark of its end is gone as well
    streaming.run_until_idle(streaming.active_stream(stream(NEWS), "incident_id", 60), f"{path}/out", f"{path}/state")
    assert [tuple(r) for r in spark.read.parquet(f"{path}/out").where("epoch = 15").collect()] == [(2, 15, "OPEN", True)]


DIRTY = "id long, service_id string, cpu double, p50 double, p95 double, p99 double, checkout double, stamp long, note string"


def test_quarantine_with_time_order_equals_the_batch(spark, feed):
    put, stream, path = feed
    rows = [(i, f"s{i % 3}", None if i % 17 == 3 else 50.0, 9.0 if i % 19 == 4 else 1.0, 2.0, 3.0, 130.0 if i % 23 == 5 else 90.0, i - 30 if i % 8 == 1 else i, None if i % 4 else f'"{i}"') for i in range(240)]
    for k in range(4):
        put(k, rows[60 * k : 60 * k + 60], DIRTY)
    checks = dict(required=("cpu",), ranges={"cpu": (0, 100), "p50": (0, None)}, bounds={"checkout": (0, 100)})
    asked = []

    def judge(df):
        asked.append(df.isStreaming)
        return contract.judged_rows(df, **checks)

    query = streaming.quarantine_stream(stream(DIRTY), judge, ["id"], f"{path}/valid", f"{path}/rejected", f"{path}/state", "service_id", "stamp", "id")
    query.awaitTermination()
    want = {r.id: (r.error_code, r.error_message) for r in contract.judged(spark.createDataFrame(rows, DIRTY), ["service_id"], "stamp", ["id"], **checks).collect()}
    got = {r.id: (r.error_code, r.error_message) for r in spark.read.parquet(f"{path}/rejected").collect()}
    valid = {r.id: r for r in spark.read.parquet(f"{path}/valid").collect()}
    assert {i for i, v in want.items() if v[0] is None} == set(valid) and {i: v for i, v in want.items() if v[0]} == got
    assert len({v[0] for v in got.values()}) == 4 and asked == [True]
    assert all((valid[i].cpu, valid[i].stamp, valid[i].note) == (rows[i][2], rows[i][7], rows[i][8]) for i in valid)


def test_a_batch_run_twice_is_written_once(spark, feed):
    put, stream, path = feed
    put(0, [(i, "s", 50.0 if i % 2 else None, 1.0, 2.0, 3.0, 9.0, i, None) for i in range(20)], DIRTY)
    judge = lambda df: contract.judged_rows(df, required=("cpu",), ranges={"cpu": (0, 100)}, bounds={"checkout": (0, 100)})
    for state in ("one", "two"):  # a lost checkpoint makes the same batch again
        streaming.quarantine_stream(stream(DIRTY), judge, ["id"], f"{path}/valid", f"{path}/rejected", f"{path}/{state}", "service_id", "stamp", "id").awaitTermination()
    assert (spark.read.parquet(f"{path}/valid").count(), spark.read.parquet(f"{path}/rejected").agg(F.count_distinct("id")).first()[0], spark.read.parquet(f"{path}/rejected").count()) == (10, 10, 10)


def test_batches_of_a_stand_in_stay_bounded(spark, monkeypatch):
    """More rows are more slices of the stream, not larger ones."""
    from telemara.plans import text

    monkeypatch.setattr(text, "BATCH", 100, raising=False)
    rows = spark.range(1050).selectExpr("id", "id * 2 as x")
    path = text.scratch(spark, "bounded")
    monkeypatch.setattr(text, "scratch", lambda s, name: path)
    text.sliced(spark, rows, "bounded")
    sizes = [r["count"] for r in spark.read.parquet(path).selectExpr("_metadata.file_path as f").groupBy("f").count().collect()]
    assert sum(sizes) == 1050 and len(sizes) == 11 and max(sizes) <= 100
