"""Queries at the edges of their classes, against their SQL."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from telemara import plans


def test_severity_is_that_of_the_whole_score(spark, tmp_path):
    """Scores that six places round up to an edge of a class stay below it."""
    calm = [1.0, -1.0] * 10
    edge = (20 / 19) ** 0.5 + 1e-6
    rows = [x for least in (2.5, 3.5, 5.0) for x in [*calm, (least - 2e-7) * edge, (least + 2e-7) * edge]]
    n, at = len(rows), datetime.datetime(2024, 1, 1)
    events = pa.table({"event_id": range(n), "ts": [at + datetime.timedelta(seconds=i) for i in range(n)], "user_id": range(n), "event_type": [f"k{i // 22}{'b' if i % 22 == 21 else ''}" for i in range(n)], "value": rows})
    for kind in range(3):  # the row above the edge is the last of a key of its own
        low = events.slice(22 * kind, 20)
        more = low.set_column(3, "event_type", pa.array([f"k{kind}b"] * 20)).set_column(0, "event_id", pa.array(range(100 * (kind + 1), 100 * (kind + 1) + 20)))
        events = pa.concat_tables([events, more])
    pq.write_table(events, f"{tmp_path}/events.parquet")
    got = dict(map(tuple, plans.queries()["severity_of"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert got == dict(duck.execute(plans.oracle_sql()["severity_of"]).fetchall())
    assert [got[22 * k + 20] for k in range(3)] == ["LOW", "MEDIUM", "HIGH"] and [got[22 * k + 21] for k in range(3)] == ["MEDIUM", "HIGH", "CRITICAL"]
