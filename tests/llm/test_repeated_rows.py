"""op5 on tables in which many rows repeat both id and text."""

from collections import Counter

from pyspark.sql import functions as F

from telemara.llm import sharding


def check(rows, got, shards=16):
    size = {t: len((t or "").encode()) + 1 for _, t in rows}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size[t]) for i, t in rows)
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    total, by = sum(size[t] for _, t in rows), Counter()
    for r in got:
        by[r.shard] += r.size
    share = total / shards
    assert all(abs(by[k] - share) <= 2 * max(size.values()) + 0.02 * share for k in range(shards)), by


def test_a_third_of_all_rows_are_one_row(spark):
    rows = [(1, "same text here")] * 3000 + [(i, f"other text {i % 1500} " + "x" * (i % 40)) for i in range(10, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, sharding.shard_index(df).collect())


def test_all_rows_are_one_and_pairs_and_nulls_repeat(spark):
    for rows in ([(7, "one row")] * 1000, [(i // 2, f"t{i // 2}") for i in range(900)] + [(None, None)] * 700 + [(None, "x")] * 50):
        check(rows, sharding.shard_index(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_many_repeats_are_laid_out_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 64)
    rows = [(1, "same text here")] * 2000 + [(i, f"other {i}") for i in range(10, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.shard_index(df).collect())
    counts = sharding.keys_of(df, "doc_id", "text").groupBy("high", "low").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    made = sharding.spread_out(counts)
    assert made.count() == len(rows) and made.select("high", "low").distinct().count() == len(rows)
    assert "Python" not in sharding.shard_index(df)._jdf.queryExecution().toString()
