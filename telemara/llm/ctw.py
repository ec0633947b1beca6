"""LM scoring by context-tree weighting over bytes, with a unigram base beside it.

A text is its words (A-Z lower-cased) joined by single spaces, then an end byte; its first bytes have end bytes as
context. Each byte is eight binary decisions; each decision has a context tree over the DEPTH bytes before, the last
byte first. Every node holds a Krichevsky-Trofimov estimate of its counts, and the tree mixes the nodes of all depths
on the path by their weighted block probabilities. The tree is learnt once, then frozen.

How it is distributed: documents are dealt to blocks of bounded size. A block gathers its distinct words and byte
contexts with their training counts, packed by shard; each shard adds up the counts of all blocks, and answers each
block with what it needs. So neither vocabulary nor contexts meet in one place, and everything grows with the input.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold, slices, text_bytes

DEPTH, TOP = 5, 2
END = 0xFF  # no byte of UTF-8
BLOCK_BYTES = 24_000_000
CHUNK = 1_500_000
HALF = math.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series, after moving small x up by eight."""
    x = np.asarray(x, dtype=np.float64)
    small = x < 8
    y = np.where(small, x + 8, x)
    inv = 1 / (y * y)
    s = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y
    down = np.ones_like(y)
    for k in range(8):
        down *= np.where(small, x + k, 1.0)
    return s - np.log(down)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log block probability of a zeros and b ones under the Krichevsky-Trofimov estimator."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - math.log(math.pi)


def decisions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code its eight (prefix, bit): prefix is the decided bits behind a leading one."""
    byte = (codes & 255)[:, None].astype(np.int64)
    j = np.arange(8)
    return (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def nodes_at(codes: np.ndarray, n: np.ndarray, depth: int):
    """Nodes of one depth: sorted keys (context and prefix), counts of zeros and ones, and each decision's node."""
    prefix, bit = decisions(codes)
    context = (codes.astype(np.int64) >> (8 * (DEPTH - depth + 1)))[:, None]
    keys, at = np.unique((context * 256 + prefix).ravel(), return_inverse=True)
    weight = np.repeat(n.astype(np.float64), 8)
    ones = np.bincount(at, weight * bit.ravel(), len(keys))
    return keys, np.bincount(at, weight, len(keys)) - ones, ones, at


def subtree(codes: np.ndarray, n: np.ndarray):
    """Nodes of depth TOP to DEPTH of the contexts given: by depth (keys, zeros, ones, node of decision, log KT, log weighted)."""
    out, below = {}, None
    for d in range(DEPTH, TOP - 1, -1):
        keys, a, b, at = nodes_at(codes, n, d)
        log_e = log_kt(a, b)
        if below is None:
            log_w = log_e
        else:
            k, w = below
            log_w = np.logaddexp(HALF + log_e, HALF + np.bincount(np.searchsorted(keys, ((k >> 16) << 8) | (k & 255)), w, len(keys)))
        out[d], below = (keys, a, b, at, log_e, log_w), (keys, log_w)
    return out


def top_nodes(codes: np.ndarray, n: np.ndarray):
    """Last byte, prefix, zeros, ones and log weighted probability of the depth-TOP nodes: what lies above needs no more."""
    keys, a, b, _, _, log_w = subtree(codes, n)[TOP]
    return keys >> 16, keys & 255, a, b, log_w


def crown(rows) -> list[np.ndarray]:
    """The nodes of depth 1 and 0 from sums (byte, prefix, zeros, ones, log weighted children): [zeros, ones, weight of
    the node alone], each of shape (256, 256) by last byte and prefix at depth 1, and (256,) by prefix at depth 0."""
    a, b, w = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        a[r.byte, r.prefix], b[r.byte, r.prefix], w[r.byte, r.prefix] = r.a, r.b, r.w
    levels = []
    for _ in range(2):
        log_e = log_kt(a, b)
        log_w = np.logaddexp(HALF + log_e, HALF + w)
        levels.append(np.stack([a, b, np.exp(HALF + log_e - log_w)]))
        a, b, w = a.sum(axis=0), b.sum(axis=0), log_w.sum(axis=0)
    return levels


def code_logs(codes: np.ndarray, n: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each code's byte after its context, the mixture over all depths from DEPTH to 0."""
    tree = subtree(codes, n)
    prefix, bit = (x.ravel() for x in decisions(codes))
    p = None

    def mixed(p, a, b, own):
        kt = (np.where(bit == 1, b, a) + 0.5) / (a + b + 1.0)
        return kt if p is None else own * kt + (1 - own) * p

    for d in range(DEPTH, TOP - 1, -1):
        _, a, b, at, log_e, log_w = tree[d]
        p = mixed(p, a[at], b[at], np.exp(HALF + log_e - log_w)[at])
    last = np.repeat(codes.astype(np.int64) >> (8 * DEPTH), 8)
    p = mixed(p, *levels[0][:, last, prefix])
    p = mixed(p, *levels[1][:, prefix])
    return np.log10(p).reshape(-1, 8).sum(axis=1)


def packed(x) -> bytes:
    """Bytes or an integer array, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def unpack(x: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def steps(codes: np.ndarray) -> np.ndarray:
    """Ascending codes as differences, which compress well; np.cumsum undoes it."""
    return np.diff(codes, prepend=np.uint64(0))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def positions(docs: list[bytes]):
    """Codes of all bytes of docs, each followed by its end, and the first position of each document."""
    pad = bytes([END] * DEPTH)
    buf = np.frombuffer(b"".join(pad + d + bytes([END]) for d in docs), np.uint8)
    lengths = np.array([len(d) + 1 for d in docs])
    starts = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat(DEPTH * (np.arange(len(docs)) + 1), lengths)
    wide = buf.astype(np.uint64)
    whole = wide[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        whole |= wide[DEPTH - back : len(wide) - back] << np.uint64(8 * (DEPTH + 1 - back))
    return whole[at - DEPTH], starts


def tallied(codes: np.ndarray, n: np.ndarray | None = None):
    """Distinct codes, ascending, with their counts or with the sums of n."""
    if n is None:
        codes = np.sort(codes)
        at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        return codes[at], np.diff(np.r_[at, len(codes)])
    keys, at = np.unique(codes, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def runs_of(texts: pa.ChunkedArray):
    """Tokenised documents of a column, in runs of about CHUNK bytes, so that no more are held at a time."""
    for i, j in slices([len(t.as_buffer()) if t.is_valid else 0 for t in texts], CHUNK):
        yield i, j, [words_of(t) for t in texts[i:j].to_pylist()]


def gather(table: pa.Table, shards: int) -> pa.Table:
    """The distinct words and contexts of a block by shard, with the counts in its training documents."""
    learn, counts = table["learn"].to_pylist(), Counter()
    codes, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j, texts in runs_of(table["text"]):
        for on in (True, False):
            part = [ws for ws, x in zip(texts, learn[i:j], strict=True) if x == on]
            for ws in part:
                if on:
                    counts.update(ws)
                else:
                    for w in ws:
                        counts.setdefault(w, 0)
            if part:
                c, k = tallied(positions([b" ".join(ws) for ws in part])[0])
                codes.append(c)
                n.append(k if on else np.zeros_like(k))
        if sum(map(len, codes)) > 3_000_000:
            c, k = tallied(np.concatenate(codes), np.concatenate(n))
            codes, n = [c], [k]
    codes, n = tallied(np.concatenate(codes), np.concatenate(n))
    home = (codes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(shards + 1))
    by: list[list] = [[] for _ in range(shards)]
    for w in sorted(counts):
        by[xxhash.xxh32_intdigest(w) % shards].append(w)
    rows = []
    for s in range(shards):
        own, c = order[cut[s] : cut[s + 1]], np.array([counts[w] for w in by[s]], np.int64)
        rows.append((packed(b" ".join(by[s])), packed(c), packed(steps(codes[own])), packed(n[own]), int(c.sum())))
    cols = list(zip(*rows, strict=True))
    return pa.table({"block": pa.array([table["block"][0].as_py()] * shards, pa.int32()), "shard": pa.array(range(shards), pa.int32()), **{k: pa.array(c, pa.binary()) for k, c in zip(("words", "n", "codes", "m"), cols, strict=False)}, "tokens": pa.array(cols[4], pa.int64())})


GATHERED = "block int, shard int, words binary, n binary, codes binary, m binary, tokens long"


def answer(blobs: pa.Table, logs: pa.Table) -> pa.Table:
    """For one shard: the counts of all its words over all blocks, and its contexts' logs, as each block needs them."""
    total: Counter = Counter()
    words = [unpack(x).split() for x in blobs["words"].to_pylist()]
    for ws, n in zip(words, blobs["n"].to_pylist(), strict=True):
        for w, k in zip(ws, unpack(n, np.int64).tolist(), strict=True):
            total[w] += k
    order = np.argsort(keys := logs["code"].to_numpy().astype(np.uint64))
    keys, values = keys[order], logs["log"].to_numpy()[order]
    c = [packed(np.fromiter((total[w] for w in ws), np.int64, len(ws))) for ws in words]
    lp = [packed(values[np.searchsorted(keys, np.cumsum(unpack(x, np.uint64)))]) for x in blobs["codes"].to_pylist()]
    known = [sum(k > 0 for k in total.values())] + [0] * (len(c) - 1)
    return pa.table({"block": blobs["block"], "shard": blobs["shard"], "words": blobs["words"], "c": pa.array(c, pa.binary()), "codes": blobs["codes"], "lp": pa.array(lp, pa.binary()), "known": pa.array(known[: len(c)], pa.int64())})


ANSWERED = "block int, shard int, words binary, c binary, codes binary, lp binary, known long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long"


def found(z: np.ndarray, codes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The log of each of z, all of them among `codes` (ascending): sorted first, so that each is looked up once."""
    order = np.argsort(z)
    ranked = z[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    out = np.empty(len(z))
    out[order] = np.repeat(logs[np.searchsorted(codes, ranked[first])], np.diff(np.r_[first, len(z)]))
    return out


def score_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Score and base sums of each document of a block, from the answers of all shards."""
    count: dict[bytes, int] = {}
    for ws, c in zip(answers["words"].to_pylist(), answers["c"].to_pylist(), strict=True):
        count.update(zip(unpack(ws).split(), unpack(c, np.int64).tolist(), strict=True))
    codes = np.concatenate([np.cumsum(unpack(x, np.uint64)) for x in answers["codes"].to_pylist()])
    logs = np.concatenate([unpack(x, np.float64) for x in answers["lp"].to_pylist()])
    order = np.argsort(codes)
    codes, logs = codes[order], logs[order]
    made = []
    for _, _, texts in runs_of(docs["text"]):
        z, starts = positions([b" ".join(ws) for ws in texts])
        score = np.add.reduceat(found(z, codes, logs), starts)
        for ws, x, size in zip(texts, score.tolist(), np.diff(np.r_[starts, len(z)]).tolist(), strict=True):
            c = np.fromiter(map(count.__getitem__, ws), np.int64, len(ws))
            made.append((len(ws) + 1, int((c > 0).sum()), float(np.log10(c + 1.0).sum()), x, size))
    cols = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
    held = pa.array([not x for x in docs["learn"].to_pylist()], pa.bool_())
    return pa.table([docs["doc_id"], held, *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes"])


def score_texts(df: DataFrame, learn=None, blocks: int | None = None) -> DataFrame:
    """Scores every whole text of df (doc_id, text), learning from the rows where the column `learn` is true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte. Null and empty
    texts are one end token; repeated rows count each time they occur; further columns are not read; with no row to
    learn from, every decision has probability one half. An empty df gives no rows.
    """
    learn = fold(F.col("doc_id"), 7) != 2 if learn is None else learn
    spark = df.sparkSession
    shards = blocks or max(16, math.ceil(text_bytes(df) / BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.octet_length("text")), F.lit(shards)).cast("int")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"), block.alias("block"))
    docs = rows.repartition(shards, "block")
    got = durable(docs.groupBy("block").applyInArrow(lambda t: gather(t, shards), GATHERED))

    def unpacked(batches):
        for batch in batches:
            for codes, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(unpack(codes, np.uint64)).astype(np.int64)), pa.array(unpack(n, np.int64))], names=["code", "n"])

    totals = durable(got.select("codes", "m").mapInArrow(unpacked, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    branch = totals.select(F.shiftrightunsigned("code", 8 * (DEPTH - TOP + 1)).cast("int").alias("branch"), "code", "n")

    def tops(t: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("byte", "prefix", "a", "b", "w"), map(pa.array, top_nodes(t["code"].to_numpy(), t["n"].to_numpy())), strict=True)))

    above = branch.groupBy("branch").applyInArrow(tops, "byte long, prefix long, a double, b double, w double")
    levels = crown(above.groupBy("byte", "prefix").agg(*[F.sum(x).alias(x) for x in "abw"]).collect())  # 256 * 255 rows at most

    def logs_of(t: pa.Table) -> pa.Table:
        return pa.table({"shard": (t["code"].to_numpy().astype(np.uint64) % np.uint64(shards)).astype(np.int32), "code": t["code"], "log": code_logs(t["code"].to_numpy(), t["n"].to_numpy(), levels)})

    logs = branch.groupBy("branch").applyInArrow(logs_of, "shard int, code long, log double")
    answers = durable(got.groupBy("shard").cogroup(logs.groupBy("shard")).applyInArrow(answer, ANSWERED))
    trained = rows.where("learn").count()
    n = (got.agg(F.sum("tokens")).first()[0] or 0) + trained
    v = (answers.agg(F.sum("known")).first()[0] or 0) + (trained > 0)
    scored = docs.groupBy("block").cogroup(answers.repartition(shards, "block").groupBy("block")).applyInArrow(score_block, SCORED)
    base = F.col("logs") + math.log10(trained + 1) - F.col("n_tokens") * math.log10(n + v + 1)
    known = F.col("n_known") + F.lit(int(trained > 0))
    return scored.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
