"""Queries over whole tables against plain Python."""

import re
from collections import defaultdict

import pytest

from telemara.plans import business, detection, queries, text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return business.inc(spark, SF).collect(), business.children(spark, SF).collect()


def test_history_is_whole(spark, tables):
    incidents, signals = tables
    of = defaultdict(list)
    for r in signals:
        of[r.incident_id].append((r.signal_id, r.metric))
    got = {r.incident_id: r for r in queries()["incident_detail"](spark, SF).collect()}
    assert set(got) == {r.id for r in incidents} and max(got) >= 3000
    assert all((r.metrics or "") == ",".join(m for _, m in sorted(of[i])) for i, r in got.items())
    got = [r.incident_id for r in queries()["upsert_incidents"](spark, SF).collect()]
    assert sorted(got) == sorted({r.id for r in incidents} | {r.id + 3000 for r in incidents if r.id % 3 == 0})
    fresh = lambda r: r.incident_id >= 4000 and r.incident_id % 2 == 0
    got = sorted(map(tuple, queries()["replace_children"](spark, SF).select("incident_id", "signal_id", "metric").collect()))
    assert got == sorted((r.incident_id, r.signal_id, "new" if fresh(r) else r.metric) for r in signals)


def test_series_and_texts_are_whole(spark):
    base = {r.pos: r.x for r in detection.positions(spark, SF).collect()}
    n = len(base)
    got = queries()["repeat_to_size"](spark, SF).collect()
    assert n > 90 and sorted((r.pos, r.x) for r in got) == [(p, base[p % n]) for p in range(5 * n // 2)]
    slug = lambda t: re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", t.lower().strip()))
    got = {r.query_id: r.slug for r in queries()["chunk_id"](spark, SF).collect()}
    want = {r.query_id: slug(f" _{r.text}_-é!") for r in text.probes(spark, SF).collect()}
    assert got == want and any(len(x) > 30 for x in want.values()) and all(x.startswith("-") and x.endswith("é") for x in want.values())
