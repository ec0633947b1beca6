"""What a batch of a stream costs: few state partitions, slices written in one pass and taken in order, values rounded together."""

import json

import numpy as np

from telemara import streaming
from telemara.plans import text


def test_slices_are_taken_in_order_by_few_states(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(text, "BATCH", 100)
    text.stateful(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(1049, -1, -1).selectExpr("id", "'a' as k", "cast(id as double) as epoch")
        out = streaming.run_to_table(streaming.check_monotonic_stream(text.sliced(spark, rows, "ordered"), "k"), f"{tmp_path}/out", f"{tmp_path}/state")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (out.count(), out.where("late").count()) == (1050, 0)
    used = json.loads((tmp_path / "state" / "offsets" / "0").read_text().splitlines()[1])["conf"]["spark.sql.shuffle.partitions"]
    assert int(used) == 2 * spark.sparkContext.defaultParallelism
    assert (tmp_path / "state" / "offsets" / "10").exists()


def test_a_table_without_rows_is_a_stream_without_rows(spark, tmp_path):
    text.stateful(spark)
    rows = spark.range(0).selectExpr("id", "'a' as k", "cast(id as double) as epoch")
    assert streaming.run_to_table(streaming.check_monotonic_stream(text.sliced(spark, rows, "none"), "k"), f"{tmp_path}/out", f"{tmp_path}/state").count() == 0


def test_values_rounded_together_are_rounded_alike():
    x = np.r_[1.005, 2.675, 0.125, -0.125, -0.004, 0.0, 1e17, 123456789.125, np.nan, np.random.default_rng(1).normal(0, 1e4, 2000).round(3)]
    assert [str(v) for v in streaming.all_cents(x)] == [str(v) for v in (np.float64(streaming.cents(v)) for v in x)]
