"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding beside the mean embedding of its character trigrams. A text's score is the
highest score of its windows of WINDOW words, which overlap by WINDOW - STRIDE and cover the whole text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices

#: Windows overlap by more words than a training excerpt has, so one that lies across a border is whole in the next.
WINDOW, STRIDE = 64, 40
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 12, 8, 4096
#: The fit's bounds: labelled documents of each class, their length, and words of training excerpts.
FIT_ROWS, FIT_CHARS, EXCERPT, STEPS, BATCH = 1500, 50_000, 20, 140, 128
THRESHOLD, DECAY = 0.7, 0.02
#: Share of the clean documents of the fit that may reach the threshold.
FALSE_ALARMS = 0.002
TOKEN = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of "<word>" for each word, one after another, and where each word's begin."""
    text = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) for w in words])
    at = np.cumsum(np.r_[0, lengths])
    i = np.arange(at[-1]) + 2 * np.repeat(np.arange(len(words)), lengths)
    mixed = (c[i] * np.uint32(0x9E3779B1)) ^ (c[i + 1] * np.uint32(0x85EBCA77)) ^ (c[i + 2] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(CHAR_BUCKETS)).astype(np.int64), at


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """The parameters, as named arrays: they pickle, and one gradient step walks over them."""

    def __init__(self, odds: dict[str, float], seed: int = 0):
        """odds: log odds of the words to know; they start as the first number of each word's embedding."""
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary = {w: i + 1 for i, w in enumerate(sorted(odds))}
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        make = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"word": make(len(vocabulary) + 1, WORD_DIM, s=0.05), "char": make(CHAR_BUCKETS, CHAR_DIM, s=0.05), "v": make(2 * h), "w": make(2 * h), "b": np.zeros(1, np.float32)}
        self.p["word"][1:, 0] = [np.clip(odds[w] / 2, -1, 3) for w in sorted(odds)]
        for side in "fb":
            self.p |= {f"W{side}": make(d, 3 * h), f"U{side}": make(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: list[str]):
        """Of distinct words: vocabulary rows (0: unknown), trigram rows one after another, and where each word's begin."""
        return np.array([self.vocabulary.get(w, 0) for w in words]), *trigrams(words)

    def vectors(self, words: list[str]) -> np.ndarray:
        rows, grams, at = self.inputs(words)
        chars = np.add.reduceat(self.p["char"][grams], at[:-1], axis=0) / np.diff(at)[:, None]
        return np.concatenate([self.p["word"][rows], chars], axis=1).astype(np.float32)

    def gates(self, words: list[str]) -> np.ndarray:
        """Each word's share in the gates of both directions; a row of its own is added for padding, which keeps the state."""
        x = self.vectors(words)
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)

    def scores(self, gates: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Probability for each window: rows of word numbers into gates, -1 behind its end."""
        h = HIDDEN
        pad = np.full((1, gates.shape[1]), 0, np.float32)
        pad[0, :h] = pad[0, 3 * h : 4 * h] = 60
        gates = np.concatenate([gates, pad])
        n, steps = index.shape
        states = np.empty((steps, n, 2 * h), np.float32)
        for k, (u, times) in enumerate(((self.p["Uf"], range(steps)), (self.p["Ub"], range(steps - 1, -1, -1)))):
            s, part = np.zeros((n, h), np.float32), np.ascontiguousarray(gates[:, 3 * h * k : 3 * h * (k + 1)])
            for t in times:
                g, r = part[index[:, t]], s @ u
                zr = sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                c = np.tanh(g[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
                s = c + zr[:, :h] * (s - c)
                states[t, :, h * k : h * (k + 1)] = s
        a = np.where(index.T >= 0, states @ self.p["v"], -np.inf)
        a = np.exp(a - a.max(axis=0))
        pooled = np.einsum("tn,tnd->nd", a / a.sum(axis=0), states)
        return sigmoid(pooled @ self.p["w"] + self.p["b"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Of the log loss, in which both classes weigh alike: by parameter, and by x (steps, windows, dimensions)."""
        p, h, (steps, n, _) = self.p, HIDDEN, x.shape
        g = {}
        states, kept = np.zeros((steps, n, 2 * h), np.float32), {}
        for k, side in enumerate("fb"):
            gate, s = x @ p[f"W{side}"] + p[f"c{side}"], np.zeros((n, h), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                r, m = s @ p[f"U{side}"], mask[t][:, None]
                zr = sigmoid(gate[t, :, : 2 * h] + r[:, : 2 * h])
                c = np.tanh(gate[t, :, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
                new = c + zr[:, :h] * (s - c)
                kept[side, t] = s, r, zr, c
                s = np.where(m, new, s)
                states[t, :, h * k : h * (k + 1)] = s
        a = np.where(mask, states @ p["v"], -1e30)
        a = np.exp(a - a.max(axis=0)) * mask
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", a, states)
        out = sigmoid(pooled @ p["w"] + p["b"])
        weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, n - y.sum()))
        d = ((out - y) * weight).astype(np.float32)
        g["w"], g["b"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["w"]
        da = np.einsum("nd,tnd->tn", dp, states)
        da = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tn,tnd->d", da, states)
        ds = a[:, :, None] * dp + da[:, :, None] * p["v"]
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u, carry = p[f"U{side}"], np.zeros((n, h), np.float32)
            dgate, g[f"U{side}"] = np.zeros((steps, n, 3 * h), np.float32), np.zeros_like(u)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                s, r, zr, c = kept[side, t]
                z, q = zr[:, :h], zr[:, h:]
                total = ds[t, :, h * k : h * (k + 1)] + carry
                on = total * mask[t][:, None]
                dc = on * (1 - z) * (1 - c * c)
                gates = np.concatenate([on * (s - c) * z * (1 - z), dc * r[:, 2 * h :] * q * (1 - q), dc], axis=1)
                back = np.concatenate([gates[:, : 2 * h], dc * q], axis=1)
                dgate[t], carry = gates, total - on + on * z + back @ u.T
                g[f"U{side}"] += s.T @ back
            flat = dgate.reshape(-1, 3 * h)
            g[f"W{side}"], g[f"c{side}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
            dx += dgate @ p[f"W{side}"].T
        return g, dx, out

    def train(self, windows: list[list[str]], labels: np.ndarray, steps_: int = STEPS, batch: int = BATCH, rate: float = 0.015, seed: int = 0):
        """Adam over shuffled windows of up to EXCERPT words."""
        words = sorted({w for x in windows for w in x})
        number = {w: i for i, w in enumerate(words)}
        rows, grams, at = self.inputs(words)
        owner, share = np.repeat(np.arange(len(words)), np.diff(at)), (1 / np.diff(at)).astype(np.float32)
        steps = max(map(len, windows))
        index = np.array([[number[w] for w in x] + [-1] * (steps - len(x)) for x in windows])
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        rng, step = np.random.default_rng(seed), 0
        while step < steps_:
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                at_ = index[order[i : i + batch]].T
                mask, step = at_ >= 0, step + 1
                used, where = np.unique(at_[mask], return_inverse=True)
                own = np.isin(owner, used, kind="table")
                local = np.searchsorted(used, owner[own])
                chars = np.zeros((len(used), CHAR_DIM), np.float32)
                np.add.at(chars, local, self.p["char"][grams[own]] * share[owner[own]][:, None])
                vec = np.concatenate([self.p["word"][rows[used]], chars], axis=1)
                x = np.zeros((*at_.shape, vec.shape[1]), np.float32)
                x[mask] = vec[where]
                g, dx, _ = self.gradients(x, mask, labels[order[i : i + batch]])
                dv = np.zeros_like(vec)
                np.add.at(dv, where, dx[mask])
                g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
                np.add.at(g["word"], rows[used], dv[:, :WORD_DIM])
                np.add.at(g["char"], grams[own], dv[local, WORD_DIM:] * share[owner[own]][:, None])
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + rate * DECAY * self.p[k]).astype(np.float32)


def log_odds(texts: list[list[str]], labels: np.ndarray) -> dict[str, float]:
    """Log odds of each class's documents to have a word, for words of five documents or more, less two deviations."""
    counts = [Counter(), Counter()]
    for ws, y in zip(texts, labels, strict=True):
        counts[int(y)].update(set(ws))
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    odds = {}
    for w in {*counts[0], *counts[1]}:
        a, b = counts[1][w], counts[0][w]
        if a + b >= 5:
            raw, off = np.log((a + 0.5) / n[1]) - np.log((b + 0.5) / n[0]), 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            odds[w] = float(np.sign(raw) * max(0.0, abs(raw) - off))
    return odds


def excerpts(texts: list[list[str]], labels: np.ndarray, rank, seed: int = 0):
    """Training windows: of each text that around its highest-ranked word, of a clean one also three at random.

    A label holds for the text, not for each of its windows, so the window is taken where the text is most suspect.
    """
    rng = np.random.default_rng(seed)
    windows, y = [], []
    for ws, label in zip(texts, labels, strict=True):
        if ws:
            best = rank(ws)
            for at in [best] if label else [best, *rng.integers(len(ws), size=3).tolist()]:
                start = max(0, min(at - int(rng.integers(EXCERPT)), len(ws) - EXCERPT))
                windows.append(ws[start : start + EXCERPT])
                y.append(label)
    return windows, np.array(y, np.float32)


def taught(texts: list[list[str]], labels: np.ndarray) -> Network:
    """A network from tokenised texts: windows first by log odds, then by its own scores (hard negatives), and a bias
    that lets FALSE_ALARMS of the clean texts reach the threshold."""
    odds = log_odds(texts, labels)
    net = Network(odds)
    net.train(*excerpts(texts, labels, lambda ws: max(range(len(ws)), key=lambda i: odds.get(ws[i], -1.0))))
    places = iter(score_words(net, texts)[1])
    at = {id(ws): next(places) for ws in texts}
    net.train(*excerpts(texts, labels, lambda ws: at[id(ws)], seed=1), seed=1)
    clean = np.sort(score_words(net, [ws for ws, y in zip(texts, labels, strict=True) if ws and not y])[0])
    if len(clean):
        high = np.clip(clean[int((1 - FALSE_ALARMS) * (len(clean) - 1))], 1e-6, 1 - 1e-6)
        net.p["b"] -= max(0.0, float(np.log(high / (1 - high)) - np.log(THRESHOLD / (1 - THRESHOLD))) + 0.1)
    return net


def fit(df: DataFrame, labels: DataFrame, learn=None, rows: int = FIT_ROWS) -> Network | None:
    """A network from at most `rows` labelled documents of each class, chosen by a hash of their ids.

    df: doc_id, text; labels: doc_id, toxic (a document is toxic if any of its rows says so; null labels teach
    nothing; of the texts that repeat an id the least teaches). Only documents of FIT_CHARS characters or less teach.
    None if either class has no document.
    """
    learn = fold(F.col("doc_id"), 3) != 1 if learn is None else learn
    known = labels.where("doc_id is not null and toxic is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = lambda k: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = one(1).unionByName(one(0))  # 2 * rows ids
    sample = df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= FIT_CHARS).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).orderBy("doc_id").collect()
    y = np.array([r.toxic for r in sample], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    return taught([words_of(r.text) for r in sample], y)


def starts_of(n: int) -> range:
    """Where the windows of a text of n words begin: every word is in one, neighbours overlap."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def score_words(net: Network, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The highest window score of each tokenised text (0 without a word), and the word in the middle of that window."""
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws)) for ws in texts]
    best, place = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if not number:
        return best, place
    names = list(number)
    gates = np.concatenate([net.gates(names[i : i + 20_000]) for i in range(0, len(names), 20_000)])
    index, owner, starts = [], [], []

    def flush():
        if index:
            rows, own, at = np.concatenate(index), np.concatenate(owner), np.concatenate(starts)
            p = np.concatenate([net.scores(gates, rows[i : i + 1024]) for i in range(0, len(rows), 1024)])
            for k in np.lexsort((-p, own)):  # the first of each owner is its best
                if p[k] > best[own[k]]:
                    best[own[k]], place[own[k]] = p[k], min(at[k] + WINDOW // 2, len(ids[own[k]]) - 1)
        for x in (index, owner, starts):
            x.clear()

    waiting = 0
    for k, x in enumerate(ids):
        if len(x):
            at = np.array(starts_of(len(x)))
            for i in range(0, len(at), 8192):
                part = at[i : i + 8192, None] + np.arange(WINDOW)
                index.append(np.where(part < len(x), x[np.minimum(part, len(x) - 1)], -1))
                owner.append(np.full(len(part), k))
                starts.append(at[i : i + 8192])
                waiting += len(part)
                if waiting >= 8192:
                    flush()
                    waiting = 0
    flush()
    return best, place


def score_batch(net: Network, texts: list[str | None]) -> list[float]:
    return score_words(net, [words_of(t) for t in texts])[0].tolist()


def score(df: DataFrame, net: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df plus score (0 to 1) and predicted (1 from `threshold` on), of whole texts by all their windows.

    Null and empty texts, and such without a word, score 0; without a network every text does. Columns of df named
    score or predicted are replaced; repeated rows score alike.
    """
    sent = df.sparkSession.sparkContext.broadcast(net)
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("score", "predicted")])
    at = source.columns.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            for i, j in slices([len(t.as_buffer()) if t.is_valid else 0 for t in column], 2_500_000):
                made = score_batch(sent.value, column[i:j].to_pylist()) if sent.value else [0.0] * (j - i)
                yield pa.RecordBatch.from_arrays([*[c[i:j] for c in batch.columns], pa.array(made, pa.float64())], names=[*batch.schema.names, "score"])

    scored = source.mapInArrow(run, source.withColumn("score", F.lit(0.0).cast("double")).schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def predictions(df: DataFrame, labels: DataFrame) -> DataFrame:
    """For op9: doc_id, held_out, score and predicted."""
    rows = df.select("doc_id", "text")
    return score(rows, fit(rows, labels)).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
