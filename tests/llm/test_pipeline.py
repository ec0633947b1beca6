"""The pipeline's stages on a small folder of tables: what goes, what stays, and the columns between stages."""

import numpy as np

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}{c}" for a in ("the", "ing", "er") for b in ("and", "ly", "th") for c in ("on", "es", "re")]
    rows, labels = [], []
    for i in range(400):
        ws = rng.choice(vocab, 60).tolist()
        if i % 5 == 0:
            ws[int(rng.integers(60))] = "slurword"
        labels.append((i, 1, int(i % 5 == 0)))
        rows.append((i, " ".join(ws), "en", f"s{i % 3}", 0))
    rows += [(1000 + i, rows[1][1], "en", "s1", 0) for i in range(5)] + [(2000, None, "en", "s1", 0), (2001, "12 34", "en", None, 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(ids[0])) <= 4 and len(set(ids[0]) - toxic) >= 0.97 * (len(rows) - len(toxic))
    assert {2000, 2001} & set(ids[1]) == set() and len(ids[1]) == len(ids[0]) - 2
    assert 1 in ids[2] and not {1000, 1001, 1002, 1003, 1004} & set(ids[2])
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in set(ids[3])) <= 3
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() == len(ids[3])
