"""The training-data operators against brute force, on fixtures with nulls, empties, repeats and clashing columns."""

import functools
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemara.llm import bpe, components, ctw, embeddings, fingerprints, language, mixing, sharding, simhash, token_orc, toxicity

COPY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
TEXTS = [None, "", "  ", "One two", "ONE  two", "oﬃce", "office", *[COPY] * 12, COPY + " nu", "x" * 3000, "kurz und gut ß SS", "a\x1cb c", "Ünïcode tëxt mit Wörtern"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", "clash", 7) for i, t in enumerate(TEXTS)]
    rows += [(3, "One two", "en", "s0", "clash", 7), (None, "without an id", None, "s1", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string, score int").repartition(3)


def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_fingerprints_compare_bytes_inside_buckets(spark, docs):
    for bits in (128, 1):
        got = {}
        for r in fingerprints.fingerprint(docs, bits=bits).join(docs.select("doc_id", "text"), "doc_id").collect():
            got.setdefault(fingerprints.canonical(r.text), set()).add(r.fingerprint)
        if bits == 128:
            assert all(len(v) == 1 for v in got.values())
        assert len(set.union(*got.values())) >= len(got)
    assert fingerprints.fingerprint(empty(docs)).count() == 0


def test_fingerprint_edits_equal_brute_force(spark, docs):
    want, order = [], sorted([(r.doc_id, r.text or "") for r in docs.collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    for i, (d, t) in enumerate(order):
        made = fingerprints.edited(t, order[(i + 1) % len(order)][1])
        want.append((d, len(t), hashlib.sha256(made.encode()).hexdigest(), float(fingerprints.canonical(made) == fingerprints.canonical(t))))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited) for r in fingerprints.fingerprint_edits(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_ctw_sums_to_one_and_base_is_exact(spark, docs):
    codes = np.array(sorted({int(c) for t in ("abcab", "abd", "") for c in ctw.positions([t.encode()])[0]}), dtype=np.uint64)
    n = np.arange(len(codes))
    ask = np.array([(int(codes[3]) & ~255) | b for b in range(256)], dtype=np.uint64)
    both, at = np.unique(np.concatenate([codes, ask]), return_inverse=True)
    counts = np.bincount(at[: len(codes)], n, len(both)).astype(np.int64)

    class Row:
        def __init__(self, *v):
            self.byte, self.prefix, self.a, self.b, self.w = v

    top = {}
    branch = both >> np.uint64(8 * (ctw.DEPTH - ctw.TOP + 1))
    for k in np.unique(branch):
        for c, p, a, b, w in zip(*ctw.top_nodes(both[branch == k], counts[branch == k]), strict=True):
            old = top.get((c, p), (0.0, 0.0, 0.0))
            top[c, p] = (old[0] + a, old[1] + b, old[2] + w)
    levels = ctw.crown([Row(*k, *v) for k, v in top.items()])
    logs = np.concatenate([ctw.code_logs(both[branch == k], counts[branch == k], levels) for k in np.unique(branch)])
    assert (10 ** logs[np.searchsorted(both, ask)]).sum() == pytest.approx(1.0)
    rows = docs.select("doc_id", "text").collect()
    learn = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2 for r in rows]
    tokens = [ctw.words_of(r.text) + ["END"] for r in rows]
    counted = __import__("collections").Counter(t for ts, on in zip(tokens, learn, strict=True) if on for t in ts)
    total, v = sum(counted.values()), len(counted)
    want = sorted((len(ts), sum(counted[t] > 0 for t in ts), round(sum(np.log10((counted[t] + 1) / (total + v + 1)) for t in ts), 6)) for ts in tokens)
    got = ctw.score_texts(docs, blocks=5).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {total}
    assert all(r.score < 0 for r in got) and ctw.score_texts(empty(docs)).count() == 0


def brute_ctw(learnt, asked):
    """log10 probability of each asked text after the learnt ones, node by node in dictionaries."""
    end, depth = bytes([ctw.END]), ctw.DEPTH
    zeros_ones, children = {}, {}

    def steps(text):
        padded = end * depth + b" ".join(ctw.words_of(text)) + end
        for i in range(depth, len(padded)):
            for j in range(8):
                prefix = 1 << j | padded[i] >> (8 - j)
                yield [(padded[i - d : i], prefix) for d in range(depth + 1)], padded[i] >> (7 - j) & 1

    for text in learnt:
        for path, bit in steps(text):
            for node, below in zip(path, [*path[1:], None], strict=True):
                zeros_ones.setdefault(node, [0, 0])[bit] += 1
                children.setdefault(node, set()).add(below)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def log_weighted(node):
        own = log_kt(*zeros_ones.get(node, (0, 0)))
        if len(node[0]) == depth:
            return own
        return float(np.logaddexp(own, sum(log_weighted(c) for c in children.get(node, ())))) + math.log(0.5)

    def log_of(text):
        total = 0.0
        for path, bit in steps(text):
            p = None
            for node in reversed(path):
                n = zeros_ones.get(node, (0, 0))
                kt = (n[bit] + 0.5) / (sum(n) + 1)
                own = 1.0 if p is None else 0.5 * math.exp(log_kt(*n) - log_weighted(node))
                p = own * kt + (1 - own) * (p or 0.0)
            total += math.log10(p)
        return total

    return [log_of(t) for t in asked]


def test_ctw_scores_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    learn = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2 for r in rows]
    assert 0 < sum(learn) < len(rows)
    want = brute_ctw([r.text for r, on in zip(rows, learn, strict=True) if on], [r.text for r in rows])
    got = ctw.score_texts(docs, blocks=3).collect()
    key = lambda x: (str(x[0]), x[1])
    for (a, x), (b, y) in zip(sorted(((r.doc_id, s) for r, s in zip(rows, want, strict=True)), key=key), sorted(((r.doc_id, r.score) for r in got), key=key), strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-9)
    nothing = ctw.score_texts(docs, F.lit(False), blocks=2).where("doc_id = 3").first()
    assert nothing.bits_per_byte == pytest.approx(8.0) and nothing.n_known == 0 and nothing.train_tokens == 0


def test_bpe_equals_the_library_and_round_trips(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoder(open(path, "rb").read(), public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    long = "word  and\n\n  more 'll it's x " * 4000
    assert bpe.encode_text(enc, long).tolist() == enc.encode_ordinary(long) and len(list(bpe.pieces(long))) > 2
    for r in bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN).join(docs.select("doc_id", "text"), "doc_id"), path, public_tokenizers.PATTERN).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    once = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    assert sorted(map(str, once.collect())) == sorted(map(str, bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()))
    out = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    assert out.count() == docs.count() and "shard" in out.columns and bpe.round_trip(empty(docs), path, public_tokenizers.PATTERN).count() == 0


def brute_simhash(text, width):
    words = text.encode().lower().split() if text else []
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.array([int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base[:20] for k in (1, 3, 4, 5)], dtype=np.uint64)
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(7)]))
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 4:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    want = {frozenset(int(fps[i]) for i in range(len(fps)) if top(i) == r) for r in {top(i) for i in range(len(fps))}}
    edges = simhash.near_fingerprints(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    groups: dict = {}
    for r in components.connected_components(edges).collect():
        groups.setdefault(r.root, set()).add(r.node % 2**64)
    assert {frozenset(g) for g in groups.values()} == {g for g in want if len(g) > 1}
    got = simhash.near_duplicates(docs, width=4).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.fingerprint == f"{brute_simhash(r.text, 4):016x}" for r in got)
    assert {r.component_id for r in got if r.text == COPY} == {7}
    kept = simhash.drop_near_duplicates(docs)
    assert sum(r.text == COPY for r in kept.collect()) == 1 and kept.columns == docs.columns and simhash.near_duplicates(empty(docs)).count() == 0


def test_shards_are_equal_and_gapless(spark, docs):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same hot text")).otherwise(F.concat(F.lit("t"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.col("id").cast("string"))).alias("text"))
    rows = sharding.shard(many, 16).collect()
    load, slots = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(load) - min(load) <= 0.02 * sum(load) / 16 + 60 and all(sorted(s) == list(range(len(s))) for s in slots) and len(rows) == 3000
    out = sharding.shard(docs, 4)
    assert out.count() == docs.count() and out.columns.count("shard") == 1 and sharding.shard(empty(docs)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 16)).astype(np.float32)
    v = np.concatenate([v, v[:20] + 0.28 * rng.normal(size=(20, 16)), v[:1].repeat(30, 0), v[:5] * 1e-30]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    got = {r.vec_id: r for r in embeddings.near_vectors(df, tile=16).collect()}
    assert len(got) == len(rows) and all(got[i].n_links == int(link[i].sum()) for i in range(len(u)))
    root = np.arange(len(u))
    for _ in range(len(u)):
        root = np.array([min(root[i], *root[np.flatnonzero(link[i])]) if link[i].any() else root[i] for i in range(len(u))])
    assert all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(len(u)))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906)) and embeddings.near_vectors(df.where("false")).count() == 0


def test_mix_meets_its_targets(spark, docs):
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") * 7 % 90).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"))
    rows, again = mixing.mix_index(many).collect(), mixing.mix_index(many.repartition(7)).collect()
    assert sorted(rows) == sorted(again)
    by: dict = {}
    for r in rows:
        s = by.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.size
        s[1] += r.taken
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in rows))
    assert all(size == n and target <= 3 * size + 1e-6 and abs(taken - target) <= 0.01 * target + 2 for (size, target), (n, taken) in by.items())
    out = mixing.mix(docs)
    assert out.count() == docs.count() and mixing.take_mix(docs).columns == docs.columns and mixing.mix(empty(docs)).count() == 0


def test_token_files_read_back(spark, docs, tmp_path):
    path, t = str(tmp_path / "orc"), public_tokenizers.path("word_bpe_49k.json")
    token_orc.write_tokens(docs, path, t, partitions=3)
    made = Tokenizer.from_file(t)
    want = [(r.doc_id, made.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, list(r.ids))) for r in token_orc.read_tokens(spark, path).collect())
    index = sorted(token_orc.token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in index] == np.cumsum([0, *[r.n_tokens for r in index]])[:-1].tolist()
    assert [r.doc_id for r in index] == sorted([r.doc_id for r in index], key=lambda d: -1 if d is None else d)
    some = dict(want)
    assert all(r.ids_crc32 == zlib.crc32(np.array(some[r.doc_id], "<u4").tobytes()) for r in index)
    assert token_orc.read_tokens(spark, path, [7]).count() == 1
    assert "PushedFilters: [In(doc_id" in token_orc.read_tokens(spark, path, [7, 9])._jdf.queryExecution().toString()


def test_words_have_the_ids_of_whole_texts():
    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = token_orc.Words(token_orc.tokenizer(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()))
    hard = "It's, OK!!! ÉTÉ.. x²; ½. (abc)!? ªº. e\u0301. É\u0301! ǅ. İstanbul: ΣΑΣ, 'S 'll. a'll, $$ .,; 9.9.9% ok* OK OK, #tag# été été. <|endoftext|>. <|endoftext|> µ# ß) ÿ& ｆｕｌｌ. 漢字。 漢字. a\x1cb."
    rng = np.random.default_rng(6)
    pieces = [*"aAéÉ19.,!?;:$&%*#)('²ºß_-\u0301İΣ", " ", " ", "'s", "'LL", "word"]
    texts = [hard, "", hard.swapcase(), "  ", *["".join(rng.choice(pieces, 60)) for _ in range(400)]]
    for some in (texts[:2], texts[2:200], texts[:], texts[100:]):
        ids, offsets = words.encode(some, 1)
        want = [e.ids + [1] for e in made.encode_batch(some, add_special_tokens=False)]
        assert [ids[i:j].tolist() for i, j in zip(offsets[:-1], offsets[1:], strict=True)] == want


def toxic_rows(n):
    rng = np.random.default_rng(3)
    vocab = np.array([f"w{i}" for i in range(80)])
    rows = []
    for i in range(n):
        ws = rng.choice(vocab, int(rng.integers(1, 300))).tolist()
        bad = i % 4 == 0
        if bad:
            ws.insert(int(rng.integers(len(ws) + 1)), ["badword", "slurry"][i % 8 // 4])
        rows.append((i, " ".join(ws), int(bad)))
    return rows


def test_toxicity_finds_planted_words(spark, docs):
    rows = toxic_rows(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.predictions(df, df).join(df.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 600 and np.mean([r.predicted == r.toxic for r in held]) > 0.95
    for n in (0, 1, 64, 65, 104, 105, 1000):  # every word is in a window, and so is every run as long as a training excerpt
        at = list(toxicity.starts_of(n))
        assert at[0] == 0 and at[-1] + toxicity.WINDOW >= n and all(b - a <= toxicity.WINDOW - toxicity.EXCERPT for a, b in zip(at, at[1:]))
    none = toxicity.score(docs, None).collect()
    assert len(none) == docs.count() and {r.score for r in none} == {0.0}


def test_gradients_are_right():
    net = toxicity.Network({"a": 1.0, "b": -1.0}, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 3, toxicity.WORD_DIM + toxicity.CHAR_DIM)), np.array([1.0, 0.0, 0.0])
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (3 - y.sum()))

    def loss():
        p = net.gradients(x, mask, y)[2]
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    g = net.gradients(x, mask, y)[0]
    for name in ("Uf", "Ub", "Wf", "cb", "v", "w", "b"):
        at = tuple(0 for _ in net.p[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-4
        up = loss()
        net.p[name][at] = keep - 1e-4
        down = loss()
        net.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-5)


def test_language_on_held_out_texts(spark, docs):
    syllables = {"en": "the ing tion er and", "de": "der sch ung ich keit", "fr": "eau ou é le ment", "es": "ción ado ll os ñ"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(syllables[g].split(), 3)) for _ in range(int(rng.integers(3, 60)))), g) for i in range(400) for g in [list(syllables)[i % 4]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.predictions(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in out)
    marks = language.identify(spark.createDataFrame([(None,), ("",), ("12 34 !!",), ("…—",), ("ß",)], "text string"), language.fit(df)).collect()
    assert [r.lang_pred == "und" for r in sorted(marks, key=lambda r: str(r.text))].count(True) == 4
    assert language.fit(empty(docs)) is None and {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
