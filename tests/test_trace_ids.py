"""from position 1,000,000 on, the trace ids of the tier queries are those of their SQL."""

import duckdb

from telemara.operators import tiers as made
from telemara.plans import tiers

AT = [7, 999_999, 1_000_000, 1_000_009, 1_234_567]


def test_trace_ids_of_seven_digits_are_those_of_the_sql(spark):
    df = spark.createDataFrame([(p, 50.0, 50.0, 50.0, 5000.0) for p in AT], "pos long, cpu double, pool double, load double, network double")
    got = {r.pos: r.trace_id for r in tiers.as_in_sql(lambda *_: made.tier_small(df), 6)(None, None).collect()}
    assert got == {p: duckdb.sql(f"select 'tr-real-sm-' || lpad(cast({p} as varchar), 6, '0')").fetchall()[0][0] for p in AT}
    assert {r.trace_id for r in made.tier_small(df).collect()} == {f"tr-real-sm-{p:06d}" for p in AT}  # the operator's are whole
