"""op11 against a scan of all lags in plain Python, with the edge cases of the operator."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemara.llm import periodic


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(12, 2 * q) and not any(w[i : j + q - p] == w[i + p : j + q] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_lists(seed):
    rng = np.random.default_rng(seed)
    some = lambda values, size: rng.integers(0, values, size).tolist()
    out = [[], ["x"], ["x"] * 11, ["x"] * 12, ["x"] * 300, list("abcabc") * 2, list("abcdef") * 2, list("abcdefg") * 2]
    for _ in range(25):
        out += [some(2, rng.integers(0, 90)), some(30, rng.integers(0, 150))]
        w = []
        for _ in range(int(rng.integers(1, 5))):
            unit = some(int(rng.integers(1, 30)), int(rng.integers(1, 45)))
            w += (unit * 5)[: int(rng.integers(1, 160))] + some(500, rng.integers(0, 6))
        out.append(w)
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_scan_of_all_lags(seed):
    lists = made_lists(seed)
    assert periodic.runs_of(lists) == [plain_runs(w) for w in lists]


def test_long_texts_of_one_word_and_of_few():
    assert periodic.runs_of([["a"] * 400_000]) == [[(0, 400_000, 1)]]
    assert periodic.runs_of([["a", "b", "c"] * 100_000 + ["d"]]) == [[(0, 300_000, 3)]]
    half = np.random.default_rng(3).integers(0, 3000, 60_000).tolist()
    assert (5, 120_000, 60_000) in periodic.runs_of([[-1, -2, -3, -4, -5, *half, *half, -6]])[0]


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    kept = [x for i, x in enumerate(w) if not any(a + q <= i < a + size for a, size, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(kept))


def cases():
    rng = np.random.default_rng(8)
    texts = [None, "", " \t\n", "one", "la " * 40, "été\xa0x \x1cy\x0b" * 20, "a b " * 30 + "c d e " * 30]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, int(rng.integers(2, 200)), int(rng.integers(1, 300)))) for _ in range(80)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (None, "a b c " * 9)]


def test_query_equals_plain_rows_with_nulls_repeats_and_clashing_names(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("mine").alias(c) for c in ("id", "runs", "Start", "n_runs")])
    got = sorted(map(str, map(tuple, periodic.run_index(df).collect())))
    assert got == sorted(str(plain_row(*r)) for r in rows)
    assert periodic.run_index(df.where("false")).collect() == []


def test_operator_gives_runs_and_collapsed_texts(spark):
    df = spark.createDataFrame([("k1", "x " + "a b c " * 6 + "y"), ("k2", None), ("k2", None), (None, "so  it\nis")], "name string, body string")
    got = {(r.name, r.collapsed): [tuple(x) for x in r.runs] for r in periodic.with_runs(df, "name", "body").collect()}
    assert got == {("k1", "x a b c y"): [(1, 18, 3)], ("k2", ""): [], (None, "so it is"): []}


def test_a_text_of_two_megabytes(spark):
    words = " ".join(f"w{x}" for x in np.random.default_rng(2).integers(0, 900, 150_000))
    r = periodic.with_runs(spark.createDataFrame([(1, words + " " + words)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 300_000, 150_000)] and r.collapsed == words
