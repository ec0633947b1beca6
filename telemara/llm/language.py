"""Language identification by hierarchical discrimination: family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices

BUCKETS = 2048
#: Documents of each language that teach, at most (in expectation: a hash of the id decides).
FIT_ROWS = 500
#: Families of common languages by ISO 639-1; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: ASCII letters stay, other ASCII becomes space; bytes beyond ASCII stay.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters_of(text: str | None) -> bytes:
    """The lower-cased words of letters with single spaces around; empty if there is no letter."""
    if not text:
        return b""
    kept = b" ".join(text.lower().encode().translate(LETTERS).split())
    return b" " + kept + b" " if kept and (kept.translate(None, bytes(range(128, 256))).strip() or any(c.isalpha() for c in text)) else b""


def features(texts: list[bytes]) -> np.ndarray:
    """Unit vectors of square-rooted counts of hashed byte trigrams, over the whole of each text."""
    buf = np.frombuffer(b"".join(t + b"\0\0" for t in texts), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])[:-2]
    code = (buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]
    inside = (buf[1:-1] > 0) & (buf[2:] > 0) & (buf[:-2] > 0)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount(owner[inside] * BUCKETS + bucket[inside], minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """Weights, bias last, of a linear SVM with squared hinge loss; both classes weigh alike. Accelerated gradient."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = ridge * v - 2 * (x.T @ (weight * y * slack))
        new = v - grad / (4 + ridge)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def calibrated(margins: np.ndarray, y: np.ndarray) -> float:
    """The slope of a logistic curve through zero that fits the margins best, between 1 and 20."""
    slopes = np.linspace(1, 20, 77)
    return float(slopes[np.argmin([np.logaddexp(0, -s * y * margins).mean() for s in slopes])])


class Hierarchy:
    """Linear models as arrays: one for each family against the rest, one for each pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        lang = np.array(langs)
        family = np.array([FAMILY_OF.get(a, a) for a in langs])
        self.families = sorted(set(family))
        self.members = {f: [a for a in self.langs if FAMILY_OF.get(a, a) == f] for f in self.families}
        self.models: dict = {}
        if len(self.families) > 1:
            for f in self.families:
                self.models[f] = self.learn(x, np.where(family == f, 1.0, -1.0).astype(np.float32))
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                at = (lang == a) | (lang == b)
                self.models[a, b] = self.learn(x[at], np.where(lang[at] == a, 1.0, -1.0).astype(np.float32))

    @staticmethod
    def learn(x, y):
        w = svm(x, y)
        return w, calibrated(x @ w[:-1] + w[-1], y)

    def sure(self, x, model) -> np.ndarray:
        w, slope = self.models[model]
        return 1 / (1 + np.exp(-slope * (x @ w[:-1] + w[-1]).astype(np.float64)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score: the family's share among families times the language's share of its pairs' votes."""
        if len(self.families) > 1:
            p = np.stack([self.sure(x, f) for f in self.families], axis=1)
            p /= p.sum(axis=1, keepdims=True)
        else:
            p = np.ones((len(x), 1))
        best, score = np.empty(len(x), object), np.zeros(len(x))
        chosen = p.argmax(axis=1)
        for k, f in enumerate(self.families):
            at, names = np.flatnonzero(chosen == k), self.members[f]
            votes = np.zeros((len(at), len(names)))
            for (i, a), (j, b) in combinations(enumerate(names), 2):
                q = self.sure(x[at], (a, b))
                votes[:, i] += q
                votes[:, j] += 1 - q
            if len(names) > 1:
                votes /= len(names) - 1
            else:
                votes[:] = 1
            win = votes.argmax(axis=1)
            best[at] = np.array(names, object)[win]
            score[at] = p[at, k] * votes[np.arange(len(at)), win]
        return best, score


def snippet(letters: bytes, seed: int) -> bytes:
    """Five to twelve words from somewhere in a text, so that short texts are learnt as well."""
    words = letters.split()
    n = 5 + seed % 8
    at = seed // 8 % max(1, len(words) - n + 1)
    return b" " + b" ".join(words[at : at + n]) + b" "


def fit(df: DataFrame, learn=None, rows: int = FIT_ROWS) -> Hierarchy | None:
    """A hierarchy from about `rows` documents of each language at most, and a snippet of each; None without any.

    df: doc_id, text, lang. Null langs and texts without a letter teach nothing. The executors make the features; the
    driver gets BUCKETS numbers a row.
    """
    learn = fold(F.col("doc_id"), 4) != 2 if learn is None else learn
    taught = df.select("doc_id", "text", "lang").where("lang is not null").where(learn)
    counts = taught.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    share = F.create_map(*[F.lit(y) for r in counts for y in (r["lang"], rows / r["count"])])
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = taught.where(draw < share[F.col("lang")]).select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text", "lang")

    def run(batches):
        for batch in batches:
            texts, langs, ids = [letters_of(t) for t in batch.column(1).to_pylist()], batch.column(2).to_pylist(), batch.column(0).to_pylist()
            kept = [(d, y, t) for d, y, t in zip(ids, langs, texts, strict=True) if t]
            for i in range(0, len(kept), 256):
                part = kept[i : i + 256]
                x = features([t for _, _, t in part] + [snippet(t, d * 2654435761 % (1 << 32)) for d, _, t in part])
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in part] * 2), pa.array([y for _, y, _ in part] * 2), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["doc_id", "lang", "x"])

    got = sorted(sample.mapInArrow(run, "doc_id long, lang string, x binary").collect(), key=lambda r: (r.doc_id, r.lang, r.x))
    if not got:
        return None
    return Hierarchy(np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32), [r.lang for r in got])


def identify(df: DataFrame, model: Hierarchy | None, text: str = "text") -> DataFrame:
    """df plus lang_pred and score (0 to 1), from the whole text alone.

    Texts that are null or have no letter are `und` with score 0, and so are all without a model. Columns of df
    named lang_pred or score are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("lang_pred", "score")])
    at = source.columns.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            for i, j in slices([1_000 + len(t.as_buffer()) if t.is_valid else 1_000 for t in column], 2_000_000):
                texts = [letters_of(t) for t in column[i:j].to_pylist()]
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                some = [k for k, t in enumerate(texts) if t]
                if some and sent.value:
                    lang[some], score[some] = sent.value.predict(features([texts[k] for k in some]))
                yield pa.RecordBatch.from_arrays([*[c[i:j] for c in batch.columns], pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return source.mapInArrow(run, source.withColumn("lang_pred", F.lit("").cast("string")).withColumn("score", F.lit(0.0)).schema)


def predictions(df: DataFrame) -> DataFrame:
    """For op10: doc_id, held_out, lang_pred and score."""
    model = fit(df)
    return identify(df.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
