"""Nulls, repeats, very long texts and clashing names in the training-data operators, against plain versions."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from telemara.llm import bpe, embeddings, fingerprints, language, mixing, sharding, simhash, similar, token_orc, toxicity

#: Names that the operators use themselves, in some case or other.
NAMES = ["key", "rank", "n", "order", "cell", "k", "all", "base", "before", "high", "low", "kept_id", "id", "mark", "own", "root", "component_id", "c0", "C3", "copy", "fp", "node", "num", "range", "is_kept"]
ADDED = ["size", "Copies", "shard", "slot", "score", "predicted", "lang_pred"]


@pytest.fixture(scope="module")
def clashing(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(words[(i + j) % 10] for j in range(1 + i % 12)) if i % 9 else None, "en", None if i % 4 == 0 else f"s{i % 3}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in NAMES + ADDED])


def kept_as_is(out, names):
    r = out.select(*[F.col(f"`{c}`") for c in names]).distinct().collect()
    return [tuple(x) for x in r] == [tuple(f"mine {c}" for c in names)]


def test_clashing_names_come_out_as_they_went_in(spark, clashing, tmp_path):
    for out in (simhash.drop_near_duplicates(clashing), similar.drop_similar(clashing), mixing.take_mix(clashing)):
        assert out.columns == clashing.columns and kept_as_is(out, NAMES + ADDED)
    mixed, dealt = mixing.mix(clashing), sharding.shard(clashing, 4)
    assert kept_as_is(mixed, NAMES + ["shard", "score"]) and mixed.count() == 60 and [c.lower() for c in mixed.columns].count("size") == 1
    assert kept_as_is(dealt, NAMES + ["Copies", "score"]) and dealt.count() == 60
    net = toxicity.Network({"alpha": 1.0})
    assert kept_as_is(toxicity.score(clashing, net), NAMES + ["size", "lang_pred"])
    clashing.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns
        assert out.isEmpty() or kept_as_is(out, NAMES + ADDED)


def test_stages_of_an_empty_table(spark, clashing, tmp_path):
    clashing.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, clashing.where("false"), str(tmp_path)).count() == 0


def test_each_group_keeps_one_whatever_its_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "one two three four five six"), (3, "another text with other words in it"), (None, "no id on this text at all"), (None, "no id on that other text either"), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, {(1, "a b c d e f"), *rows[3:7]}))
    for keep in (simhash.drop_near_duplicates, similar.drop_similar):
        assert sorted(str((r.doc_id, r.text)) for r in keep(df).collect()) == want


def test_vectors_with_repeated_and_null_ids_and_many_dimensions(spark):
    rng = np.random.default_rng(4)
    for d in (2, 1024, 3000):
        v = rng.normal(size=(40, d))
        v = np.concatenate([v, v[:15] + rng.normal(size=(15, d)) * np.linspace(0.3, 0.6, 15)[:, None], v[:3], [v[0] * 2]])
        ids = [None if i % 11 == 3 else i % 30 for i in range(len(v))]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
        u = v / np.linalg.norm(v, axis=1)[:, None]
        cosine = u @ u.T
        link = (cosine >= 0.9) & ~np.eye(len(v), dtype=bool)
        label = np.arange(len(v))
        for _ in range(len(v)):
            label = np.array([min([label[i], *label[link[i]]]) for i in range(len(v))])
        least = {g: min((ids[i] for i in range(len(v)) if label[i] == g and ids[i] is not None), default=None) for g in set(label)}
        want = [(ids[i], int(link[i].sum()), least[label[i]], ids[i] == least[label[i]]) for i in range(len(v))]
        got = [tuple(r) for r in embeddings.near_vectors(df, tile=16).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    few = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 0.05])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_vectors(few).collect())) == [(1, 0, 1, True), (1, 1, 1, True), (3, 1, 1, False)]


@pytest.fixture(scope="module")
def plain_bpe():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.encoder(f.read(), public_tokenizers.PATTERN)


def test_cuts_change_no_token(plain_bpe):
    rng = np.random.default_rng(5)
    parts = ["word", "'s", "'", "'ll", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "12", "é", "字", "。", "!?", "-", ", ", " x", "²", "_", "ǅ", "\u0301", "\u3000", " " * 1003, "\n" * 1001]
    for trial in range(60):
        text = "".join(rng.choice(parts, 400))
        assert bpe.encode_text(plain_bpe, text, most=1 + trial * 7).tolist() == plain_bpe.encode_ordinary(text)
        assert "".join(p for p, _ in bpe.pieces(text, 50)) == text


def test_very_long_runs_are_encoded(plain_bpe):
    assert isinstance(plain_bpe, tiktoken.Encoding)
    for run in (" ", "\n", " \n", "a", "!", "字"):
        text = "begin" + run * 2_000_000 + "end"
        ids = bpe.encode_text(plain_bpe, text)
        assert plain_bpe.decode_bytes(ids.tolist()) == text.encode()
    assert bpe.encode_text(plain_bpe, "x" + " " * 20_000 + "y").tolist() == plain_bpe.encode_ordinary("x" + " " * 20_000 + "y")


def test_shards_equal_a_plain_sort(spark):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 50 == 1 else "the same hot text" if i % 3 == 0 else "é" * int(rng.integers(0, 60)) + str(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sharding.shard_index(df, 16).collect()}
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert all(r.size == size[i] and r.law == "bytes" and r.grown_shard is None for i, r in got.items()) and all(got[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in rows)
    signed = lambda data: int(np.uint64(xxhash.xxh64_intdigest(data, 42)).astype(np.int64))
    ordered = sorted((signed((t or "").encode()), signed(int(i).to_bytes(8, "little", signed=True)), i) for i, t in rows)
    shards = [got[i].shard for _, _, i in ordered]
    assert shards == sorted(shards) and set(shards) == set(range(16))
    total, upto, largest = sum(size.values()), 0, max(size.values())
    for (_, _, i), here, after in zip(ordered, shards, shards[1:], strict=False):
        upto += size[i]
        if after > here:
            assert abs(upto - total * after / 16) <= max(0.005 * total / 16, largest / 2 + 1)
    assert all(sorted(r.slot for r in got.values() if r.shard == k) == list(range(shards.count(k))) for k in range(16))


def plain_targets(sizes):
    """Targets of sources in order by resharing what is above three times a source's size, again and again."""
    weight, left, target, free = [5, 2, 1], float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(weight[i % 3] for i in free)
        full = [i for i in free if weight[i % 3] * unit > 3 * sizes[i]]
        for i in full or free:
            target[i] = 3.0 * sizes[i] if full else weight[i % 3] * unit
        if not full:
            break
        left -= sum(target[i] for i in full)
        free -= set(full)
    return target


def test_mix_equals_a_plain_newton_dual(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "w " * int(rng.integers(0, 40)), None if i % 10 == 0 else "bcda"[0 if i % 2 else i // 2 % 4]) for i in range(1500)]
    rows += [(5000 + i, "w " * 30, "tiny") for i in range(2)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    docs = {s: [r for r in got if r.source == s] for s in names}
    sizes = [sum(r.size for r in docs[s]) for s in names]
    for s, total, want in zip(names, sizes, plain_targets(sizes), strict=True):
        assert all(r.source_size == total and r.target == pytest.approx(want) for r in docs[s])
        if not want or want >= 3 * total - 1e-6:
            assert all(r.copies == (3 if want else 0) for r in docs[s] if r.size)
            continue
        x = np.array([r.size for r in docs[s] if r.size], float)
        lo, hi = -50.0, 50.0
        for _ in range(200):  # the dual is monotonic: its root by halving
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (x * np.minimum(3, np.exp(np.minimum(mid * x / x.mean(), 50)))).sum() < want else (lo, mid)
        taken, off = sum(r.size * r.copies for r in docs[s]), 0
        for n in set(x):
            rate = min(3.0, float(np.exp(lo * n / x.mean())))
            group = [r.copies for r in docs[s] if r.size == n]
            off += abs(sum(group) - len(group) * rate) > 1 + 1e-6
            assert max(group) - min(group) <= 1
        assert off <= 1 + np.log2(x.max()) and abs(taken - want) <= x.min() / 2 + 1e-6


def plain_score(net, words):
    """One window, word by word and gate by gate."""
    p, h = net.p, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    x = []
    for w in words:
        rows, grams, at = net.inputs([w])
        x.append(np.concatenate([p["word"][rows[0]], p["char"][grams].mean(axis=0)]))
    states = np.zeros((len(words), 2 * h))
    for k, side in enumerate("fb"):
        s = np.zeros(h)
        for t in range(len(words)) if side == "f" else range(len(words) - 1, -1, -1):
            g, r = x[t] @ p[f"W{side}"] + p[f"c{side}"], s @ p[f"U{side}"]
            z, q = sigmoid(g[:h] + r[:h]), sigmoid(g[h : 2 * h] + r[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(g[2 * h :] + q * r[2 * h :])
            states[t, h * k : h * (k + 1)] = s
    a = np.exp(states @ p["v"])
    return float(sigmoid((a / a.sum()) @ states @ p["w"] + p["b"])[0])


def test_a_text_scores_as_its_highest_window():
    net = toxicity.Network({"bad": 3.0, "good": -1.0}, seed=3)
    rng = np.random.default_rng(8)
    texts = [rng.choice(["bad", "good", "other", "words", "here"], n).tolist() for n in (1, 5, 63, 64, 65, 104, 105, 300)] + [[], ["same"] * 200]
    got, _ = toxicity.score_words(net, texts)
    for ws, score in zip(texts, got, strict=True):
        want = max((plain_score(net, ws[i : i + toxicity.WINDOW]) for i in toxicity.starts_of(len(ws))), default=0.0) if ws else 0.0
        assert score == pytest.approx(want, abs=1e-4)


def test_toxic_phrases_are_found_across_window_borders(spark):
    rng = np.random.default_rng(9)
    vocab, phrase = [f"w{i}" for i in range(80)], [f"slur{i}" for i in range(15)]
    rows = []
    for i in range(500):
        ws = rng.choice(vocab, int(rng.integers(20, 200))).tolist()
        if i % 4 == 0:
            at = int(rng.integers(len(ws)))
            ws[at:at] = phrase
        rows.append((i, " ".join(ws), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(df, df)
    clean = rng.choice(vocab, 160).tolist()
    got = toxicity.score_words(net, [clean[:at] + phrase + clean[at:] for at in range(0, 160)] + [clean])[0]
    assert (got[:-1] >= toxicity.THRESHOLD).mean() > 0.98 and got[-1] < toxicity.THRESHOLD


def test_language_predicts_as_plain_arithmetic():
    rng = np.random.default_rng(10)
    syllables = {"en": "the ing tion er and", "de": "der sch ung ich keit", "fr": "eau ou le ment", "es": "cion ado ll os", "xx": "zq qz"}
    texts = [(g, language.letters_of(" ".join("".join(rng.choice(s.split(), 3)) for _ in range(20)))) for g, s in syllables.items() for _ in range(12)]
    x = language.features([t for _, t in texts])
    for (_, t), row in zip(texts, x, strict=True):
        counts = np.zeros(language.BUCKETS)
        for i in range(len(t) - 2):
            counts[((t[i] << 16 | t[i + 1] << 8 | t[i + 2]) * 2654435761 % 2**32) >> (32 - language.BUCKETS.bit_length() + 1)] += 1
        assert row == pytest.approx(np.sqrt(counts) / np.sqrt(counts.sum()), abs=1e-5)
    model = language.Hierarchy(x, [g for g, _ in texts])
    sure = lambda row, m: 1 / (1 + np.exp(-model.models[m][1] * (float(row.astype(np.float64) @ model.models[m][0][:-1]) + model.models[m][0][-1])))
    best, score = model.predict(x)
    for row, lang, s in zip(x, best, score, strict=True):
        family = {f: sure(row, f) for f in model.families}
        f = max(family, key=family.get)
        votes = {a: [] for a in model.members[f]}
        for i, a in enumerate(model.members[f]):
            for b in model.members[f][i + 1 :]:
                q = sure(row, (a, b))
                votes[a].append(q)
                votes[b].append(1 - q)
        means = {a: float(np.mean(v)) if v else 1.0 for a, v in votes.items()}
        assert lang == max(means, key=means.get) and s == pytest.approx(family[f] / sum(family.values()) * means[lang], abs=1e-4)


def test_exact_groups_and_rows_without_ids(spark):
    rows = [(1, "One  two"), (2, "one two"), (None, "ONE TWO"), (4, "three"), (None, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.copies) for r in fingerprints.exact_groups(df).where("doc_id is not null").collect()}
    assert got == {(1, 3), (2, 3), (4, 1), (6, 2)}
    for bits in (1, 2):  # buckets that clash: the bytes decide, for rows without an id as well
        marks = [r.fingerprint for r in fingerprints.fingerprint(df, bits=bits).collect()]
        assert sorted(marks.count(m) for m in set(marks)) == [1, 2, 3]


def test_stripes_without_the_id_are_not_read(spark, tmp_path):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    token_orc.write_tokens(df, f"{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), partitions=1)
    rows = token_orc.read_tokens(spark, f"{tmp_path}/t", [4321])
    assert [r.doc_id for r in rows.collect()] == [4321]
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    assert 0 < leaves.apply(0).metrics().apply("numOutputRows").value() <= 1000


def test_files_are_in_the_order_of_their_numbers(spark, tmp_path):
    for part, ids in ((99999, [1, 2]), (100000, [3]), (100001, [4])):
        df = spark.createDataFrame([(i, [i] * i) for i in ids], "doc_id long, ids array<int>").select("doc_id", F.size("ids").alias("n_tokens"), "ids")
        df.coalesce(1).write.orc(f"{tmp_path}/raw{part}")
        made = next((tmp_path / f"raw{part}").glob("part-*.orc"))
        (tmp_path / "t").mkdir(exist_ok=True)
        made.rename(tmp_path / "t" / f"part-{part:05d}-x-c000.orc")
    got = {r.doc_id: r.start for r in token_orc.token_index(spark, str(tmp_path / "t")).collect()}
    assert got == {1: 0, 2: 1, 3: 3, 4: 6}
