"""op1 on null and repeated ids, with hashes so narrow that buckets clash."""

import hashlib

import pytest
from pyspark.sql import functions as F

from telemara.llm import fingerprints


def plain(rows):
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows), reverse=True)
    out = []
    for k, (known, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        made = fingerprints.edited(t, after)
        own, edit, next_ = (fingerprints.wide_hash(fingerprints.canonical(x)) for x in (t, made, after))
        out.append((i if known else None, len(t), hashlib.sha256(made.encode()).hexdigest(), own, edit, float(own == edit), float(own == next_)))
    return sorted(map(str, out))


def test_null_and_repeated_ids(spark):
    rows = [(i // 3, f"text {i % 7} é") for i in range(60)] + [(None, "no id"), (None, "no id"), (None, None), (5, "text 1 é")] * 2 + [(99, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.fingerprint_edits(df).collect()]
    assert sorted(map(str, got)) == plain(rows)


def test_a_clash_of_an_edited_text_is_found_for_a_null_id_too(spark, monkeypatch):
    seen = []
    real = fingerprints.differing_in_bucket

    def watched(members, bits=128):
        seen.append(members.select("text").collect())
        return real(members, bits)

    monkeypatch.setattr(fingerprints, "differing_in_bucket", watched)
    rows = [(None, "aaa bbb ccc"), (None, "aaa bbb cxx"), (1, "zzz zzz"), (1, "yyy yyy")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fingerprints.fingerprint_edits(df).collect()
    assert 0 < len(seen[0]) <= 3 * len(rows)  # not a product of what shares an id
    assert any(r.text == "aaa bbb cxx" for r in seen[0])


def test_marks_are_sparks(spark):
    for t in ("", "é", "a" * 100):
        assert fingerprints.mark_of(t) == spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]
    assert fingerprints.mark_of("x") == pytest.approx(fingerprints.mark_of("x"))
