"""Incidents of one case are triaged once, with the results of each for itself."""

import pytest
from pyspark.sql import functions as F

from telemara.operators import triage

SHOWN = ["incident_id", "metric", "sigma", "citation", "evidence", "hypothesis", "trace", "grounding", "is_grounded", "revisions", "action", "risk", "needs_approval", "target", "justification", "status", "result"]


@pytest.mark.parametrize("few", [10_000, 0])
def test_cases_are_judged_once_and_equal_each_incident_for_itself(spark, monkeypatch, few):
    monkeypatch.setattr(triage, "FEW_CASES", few, raising=False)
    pick = "element_at(array({}), cast(id % {} + 1 as int))"
    inc = spark.range(1000).selectExpr("id as incident_id", f"{pick.format("'CRITICAL', 'LOW'", 2)} as severity", "'svc-1' as service_id", f"{pick.format("'MEMORY_LEAK_GC_PAUSE', null, 'CASCADING_THIRD_PARTY_FAILURE'", 3)} as archetype", "id % 4 = 0 as approved", "concat('T', id) as token")
    sig = spark.range(900).selectExpr("id as incident_id", "id as signal_id", f"{pick.format("'db_pool_utilization', 'app_latency_p99_ms'", 2)} as metric", "1D as observed", "0D as baseline", "cast(id as double) as sigma", "false as is_primary")
    cite = spark.range(1000).where("id % 5 > 0").selectExpr("id as incident_id", "'[runbook-1]' as citation")
    judged, rounds = [], triage.revise_until_grounded
    monkeypatch.setattr(triage, "revise_until_grounded", lambda df: judged.append(df.count()) or rounds(df))
    got = triage.triage_incidents(inc, sig, cite).select(*SHOWN, F.to_json("parameters").alias("parameters"))
    rows = triage.triage_driver(inc, sig).join(cite, "incident_id", "left").withColumn("evidence", F.col("citation").isNotNull().cast("long"))
    want = triage.approval_routing(triage.remediation_proposal(rounds(rows))).select(*SHOWN, F.to_json("parameters").alias("parameters"))
    assert judged[0] < 50
    assert got.count() == 1000 and got.exceptAll(want).count() == 0
