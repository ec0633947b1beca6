"""Near duplicates of the pipeline against all pairs of shingle sets."""

import numpy as np

import corpus_pipeline as pipeline


def shingles(text, width=5):
    ws = text.lower().split()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))}


def brute_kept(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) == i}


def test_stage_links_all_pairs_from_similarity_08(spark, tmp_path):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows, texts = [], []
    for n in (5, 30, 50, 60, 100, 300, 1000):
        for _ in range(8):
            base = rng.choice(vocab, n).tolist()
            texts.append(base)
            for share in (0.002, 0.01, 0.02, 0.03, 0.06):  # from near copies down to texts below the threshold
                made = list(base)
                for at in rng.choice(n, max(1, round(share * n)), replace=False):
                    made[at] = str(rng.choice(vocab))
                texts.append(made)
    chain = rng.choice(vocab, 200).tolist()
    for k in range(6):  # each like the next only
        texts.append(list(chain))
        chain[k * 30 : k * 30 + 14] = rng.choice(vocab, 14).tolist()
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.one_of_near_duplicates(spark, docs, str(tmp_path))
    got = [r.doc_id for r in out.select("doc_id").collect()]
    want = brute_kept(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows) - 100


def test_crowded_buckets_are_compared_in_full(spark, tmp_path, monkeypatch):
    """Many copies of one text with a few words changed each: most pairs lie below the threshold, some above, in one bucket."""
    monkeypatch.setattr("telemara.llm.similar.TILE", 40)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        made = list(base)
        for at in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            made[at] = str(rng.choice(["x", "y"]))
        rows.append((i, " ".join(made)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in pipeline.one_of_near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert got == brute_kept(rows) and 5 < len(got) < 150
