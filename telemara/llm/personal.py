"""Personal data: patterns for four kinds, and a skip-chain conditional random field that adds what they miss.

The field labels the open words of a text, those with a digit or an at sign (any other word is fixed as no data), with
a kind or none. Neighbouring words share a chain potential. Words that repeat or resemble one another, however far
apart, share a skip potential by the way in which they do (LINKS); each is joined to the next one with the same key,
so links grow with the words. Words inside a pattern's span are observed. Weights are fitted by pseudo-likelihood on the
spans of the patterns, a third of the time without a word's own features and a third without its neighbours and like
words, so that neither drowns the other; loopy belief propagation gives the marginals of the others.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the four kinds. Look-behinds and possessive repeats change no match, but keep the
#: search from starting again inside a run that has failed, so that long runs take time in proportion to their length.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words of the field, and the space around them.
OPEN = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"

#: How two words are alike: the same; the same eight digits or more; the same first or last eight digits of thirteen or
#: more, or last seven digits of seven or more; the same name or host beside an at sign.
LINKS = ("same", "digits", "part", "name")
#: What a link's weight is drawn to where the sample has few like words, for no data and for each kind.
TRUST = np.array([[1.0, 4, 4, 4, 4], [1, 7, 7, 7, 7], [1, 6, 6, 6, 6], [1, 6, 6, 6, 6]])
FIT_DOCS, FIT_CHARS, STEPS, LOOKALIKES, DECAY, FOUND = 2000, 20_000, 300, 100, 2e-4, 3.0
#: Rounds of messages at most, the share of the old message kept, and the marginal that makes a word personal.
ROUNDS, DAMPING, LEVEL = 30, 0.3, 0.6
AT_A_TIME = 3_000_000


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str):
    """From each at sign to the left and to the right, which is what the pattern finds in one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind as in KINDS, then start; ends are exclusive, in code points."""
    if not text:
        return []
    out = [(0, a, b) for a, b in emails(text)]
    if OPEN.search(text) is None:
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


class Words(NamedTuple):
    """The open words of one text: where they stand, and which of them belong together."""

    start: np.ndarray
    end: np.ndarray
    label: np.ndarray  # 0: none, k + 1: in a span of kind k
    feature: np.ndarray
    chain: np.ndarray  # pairs of neighbouring words
    skip: np.ndarray  # pairs of like words, and by which of LINKS


def open_words(text: str):
    """Where the words with a digit or an at sign begin and end."""
    upto = 0
    while m := OPEN.search(text, upto):
        start = m.start()
        while start > upto and text[start - 1] not in SPACE:
            start -= 1
        upto = WORD.match(text, m.start()).end()
        yield start, upto


TRIM = re.compile(r"^[^A-Za-z0-9+(]*|[^A-Za-z0-9)]*$")
FEATURES = 27


def features_of(core: str) -> list[int]:
    """Numbers of the features that a word has."""
    digits = digits_of(core)
    n, dots = len(digits), core.count(".")
    on = [0, 1 + sum(n > x for x in (0, 3, 6, 8, 12, 19)), 8 + min(dots, 4)]
    groups = re.split(r"\D+", core.strip("().-+"))
    letters = any(c.isalpha() for c in core)
    name, _, host = core.partition("@")
    on += [13 + k for k, x in enumerate((letters, "@" in core, bool(name and host), "." in host, core.startswith("+"), "(" in core or ")" in core, "-" in core, n == len(core), len(groups) == 4 and not letters)) if x]
    on += [22 + k for k, x in enumerate((13 <= n <= 19 and luhn(digits), len(groups) == 4 and all(g and small(g) for g in groups), letters and n > 0, core.count("@") == 1)) if x]
    return on


def keys_of(core: str) -> list[tuple[int, str]]:
    """(which of LINKS, key) for a word; words with an equal one are linked."""
    digits, keys = digits_of(core), [(0, core.lower())]
    if len(digits) >= 8:
        keys.append((1, digits))
    if len(digits) >= 13:
        keys += [(2, "<" + digits[:8]), (2, ">" + digits[-8:])]
    if 7 <= len(digits) <= 15:
        keys.append((2, digits[-7:]))
    for part in re.split(r"@|\(at\)|\[at\]", core.lower()) if not core.isdigit() else ():
        if len(part) >= 6 and any(c.isalpha() for c in part):
            keys.append((3, part))
    return keys


def words_in(text: str, spans: list[tuple[int, int, int]]) -> Words:
    places = list(open_words(text))
    n = len(places)
    start, end = np.array([p[0] for p in places], np.int64), np.array([p[1] for p in places], np.int64)
    label, feature, skip, seen = np.zeros(n, np.int64), np.zeros((n, FEATURES), np.float32), [], {}
    for kind, a, b in reversed(spans):  # the first kind of a word counts
        label[np.searchsorted(end, a, side="right") : np.searchsorted(start, b)] = kind + 1
    for i, (a, b) in enumerate(places):
        core = TRIM.sub("", text[a:b])
        feature[i, features_of(core)] = 1
        for kind, key in keys_of(core):
            before = seen.get((kind, key))
            if before is not None and not any(x == before and y == i for x, y, _ in skip[-4:]):
                skip.append((before, i, kind))
            seen[kind, key] = i
    near = np.array([i for i in range(n - 1) if not text[places[i][1] : places[i + 1][0]].strip(SPACE)], np.int64)
    feature[:, 26] = 1
    feature[near, 26] = feature[near + 1, 26] = 0  # no open neighbour
    return Words(start, end, label, feature, np.stack([near, near + 1], axis=1), np.array(skip, np.int64).reshape(-1, 3))


def together(parts: list[Words]) -> Words:
    """The words of several texts as one: their numbers follow one another, links stay inside a text."""
    shift = np.cumsum([0] + [len(p.start) for p in parts])[:-1]
    pairs = lambda which, cols: np.concatenate([getattr(p, which) + s * np.array(cols) for p, s in zip(parts, shift, strict=True)])
    return Words(*[np.concatenate([getattr(p, k) for p in parts]) for k in ("start", "end", "label", "feature")], pairs("chain", (1, 1)), pairs("skip", (1, 1, 0)))


class Field(NamedTuple):
    """Weights: of features by label, of neighbouring labels, and of equal labels of like words."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


LABELS = len(KINDS) + 1


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def conditional(field: Field, w: Words, own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Scores of each word's labels, given the labels of all others; own, others: whether a word hears itself, and others."""
    y, near = np.eye(LABELS)[w.label], np.zeros((len(w.label), LABELS))
    a, b = w.chain.T
    np.add.at(near, b, y[a] @ field.chain)
    np.add.at(near, a, y[b] @ field.chain.T)
    i, j, kind = w.skip.T
    np.add.at(near, j, y[i] * field.skip[kind])
    np.add.at(near, i, y[j] * field.skip[kind])
    return (w.feature @ field.node) * own[:, None] + near * others[:, None]


def loss_gradient(field: Field, w: Words, own: np.ndarray, others: np.ndarray, decay: float = DECAY) -> tuple[float, Field]:
    """Mean negative log pseudo-likelihood, words in spans weighing FOUND, with a quadratic penalty, and its gradient."""
    n, y, weight = max(1, len(w.label)), np.eye(LABELS)[w.label], np.where(w.label > 0, FOUND, 1.0)
    p = softmax(conditional(field, w, own, others))
    d = (p - y) * (weight / n)[:, None]
    near = d * others[:, None]
    a, b = w.chain.T
    i, j, kind = w.skip.T
    skip = np.zeros_like(field.skip)
    np.add.at(skip, kind, y[i] * near[j] + y[j] * near[i])
    grads = Field(w.feature.T @ (d * own[:, None]), y[a].T @ near[b] + near[a].T @ y[b], skip)
    off = Field(field.node, field.chain, field.skip - TRUST)
    loss = -(np.log(p[np.arange(len(y)), w.label] + 1e-300) * weight).sum() / n + decay / 2 * sum((x * x).sum() for x in off)
    return loss, Field(*[g + decay * x for g, x in zip(grads, off, strict=True)])


def lookalikes(n: int = LOOKALIKES, seed: int = 0) -> list[str]:
    """Texts of words that are no data of the four kinds, though they look like it: dates, times, versions, amounts, mentions,
    addresses with too large a part or without a dot, and long numbers with a wrong check digit."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def long_number():
        x = d(int(rng.integers(13, 20)))
        return x[:-1] + str((int(x[-1]) + 1) % 10) if luhn(x) else x

    forms = (
        lambda: f"20{d(2)}-0{d(1)}-1{d(1)}", lambda: f"1{d(1)}:{d(2)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"{d(2)}.{d(1)}", lambda: f"{d(1)},{d(3)},{d(3)}",
        lambda: f"@u{d(2)}", lambda: f"a{d(1)}@h{d(1)}", lambda: f"{d(2)}.{d(2)}.{d(2)}.{int(rng.integers(256, 999))}", lambda: f"{d(2)}-{d(1)}-{d(3)}-{d(1)}", long_number, lambda: d(int(rng.integers(1, 12))), lambda: f"x{d(int(rng.integers(2, 20)))}", lambda: f"{d(3)}-{d(4)}", lambda: f"+{d(1)}",
    )
    return ["word " + "".join(forms[int(k)]() + (" " if rng.random() < 0.4 else " word ") for k in rng.integers(0, len(forms), 8)) for _ in range(n)]


def taught(parts: list[Words], steps: int = STEPS, seed: int = 0) -> Field:
    """Adam; in each step a word hears itself alone, the others alone, or both."""
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), TRUST.copy())
    if not parts:
        return field
    w, rng = together(parts), np.random.default_rng(seed)
    first, second = [np.zeros_like(x) for x in field], [np.zeros_like(x) for x in field]
    for t in range(1, steps + 1):
        heard = rng.random(len(w.label))
        _, grads = loss_gradient(field, w, (heard > 1 / 3) * 1.0, (heard < 2 / 3) * 1.0)
        new = []
        for k, (x, g) in enumerate(zip(field, grads, strict=True)):
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            new.append(x - 0.1 * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-9))
        field = Field(*new)
    return field


def marginals(field: Field, w: Words, rounds: int = ROUNDS) -> np.ndarray:
    """Of each word's labels, by loopy belief propagation in logarithms; words inside a span are observed."""
    seen = w.label > 0
    node = np.where(seen[:, None], np.where(np.eye(LABELS, dtype=bool)[w.label], 0.0, -1e9), w.feature @ field.node)
    i, j, kind = w.skip.T
    source, target = np.r_[w.chain[:, 0], w.chain[:, 1], i, j], np.r_[w.chain[:, 1], w.chain[:, 0], j, i]
    n, m = len(w.chain), len(i)
    if not len(source):
        return softmax(node)
    back = np.r_[np.arange(n) + n, np.arange(n), np.arange(m) + 2 * n + m, np.arange(m) + 2 * n]
    equal = np.array([np.diag(field.skip[k]) for k in range(len(LINKS))])
    kinds = np.r_[np.zeros(n, np.int64), np.ones(n, np.int64), kind + 2, kind + 2]
    tables = np.concatenate([field.chain[None], field.chain.T[None], equal])
    sent = np.zeros((len(source), LABELS))
    for _ in range(rounds):
        belief = node.copy()
        np.add.at(belief, target, sent)
        new = np.empty_like(sent)
        for k in range(len(tables)):
            of = np.flatnonzero(kinds == k)
            x = (belief[source[of]] - sent[back[of]])[:, :, None] + tables[k]
            top = x.max(axis=1)
            new[of] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        moved, sent = np.abs(new - sent).max(), DAMPING * sent + (1 - DAMPING) * new
        if moved < 1e-4:
            break
    belief = node.copy()
    np.add.at(belief, target, sent)
    return softmax(belief)


def fits(kind: int, text: str) -> bool:
    """Whether a span that the field adds has the substance of its kind."""
    n, letters = len(digits_of(text)), any(c.isalpha() for c in text)
    if kind == 0:
        return letters and (len(text) >= 6)
    return not letters and (4 <= n <= 12 and len(re.findall(r"\d+", text)) == 4, 12 <= n <= 20, 7 <= n <= 15)[kind - 1]


def added_spans(text: str, w: Words, belief: np.ndarray, level: float = LEVEL) -> list[tuple[int, int, int]]:
    """Neighbouring words that the field gives one kind, outside all spans of the patterns, without marks at their ends."""
    likely = belief.argmax(axis=1)
    likely[(belief.max(axis=1) < level) | (w.label > 0)] = 0
    joined, out, i = set(w.chain[:, 0].tolist()), [], 0
    while i < len(likely):
        j = i
        while likely[i] and j in joined and likely[j + 1] == likely[i]:
            j += 1
        if likely[i]:
            a, b = int(w.start[i]), int(w.end[j])
            core = TRIM.sub("", text[a:b])
            at = a + text[a:b].find(core)
            if core and fits(likely[i] - 1, core):
                out.append((int(likely[i]) - 1, at, at + len(core)))
        i = j + 1
    return out


def spans_of(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """For each text the patterns' spans and those that the field adds."""
    base = [base_spans(t) for t in texts]
    at = [k for k, t in enumerate(texts) if t and OPEN.search(t)]
    out = [(s, []) for s in base]
    parts = [words_in(texts[k], base[k]) for k in at]
    if not parts:
        return out
    w = together(parts)
    belief, first = marginals(field, w), 0
    for k, part in zip(at, parts, strict=True):
        out[k] = base[k], added_spans(texts[k], part, belief[first : first + len(part.start)])
        first += len(part.start)
    return out


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", docs: int = FIT_DOCS) -> Field:
    """A field from at most `docs` texts of up to FIT_CHARS characters in which a pattern may match, by a hash of their ids.

    The patterns' own spans are the labels; no texts give a field in which only links count.
    """
    rows = df.where((F.length(text) <= FIT_CHARS) & F.col(text).rlike("[0-9]{3}|@")).select(F.xxhash64(F.col(id).cast("string"), text).alias("h"), F.col(text).alias("text"))
    chosen = rows.select("h").distinct().orderBy("h").limit(docs)
    sample = rows.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()
    parts = [words_in(t, base_spans(t)) for t in [r.text for r in sample] + (lookalikes() if sample else [])]
    return taught([p for p in parts if len(p.start)])


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(df: DataFrame, field: Field, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, added) for each row of df: spans (kind, start, end) of the patterns, and those that the field adds.

    Null and empty texts have none. Repeated rows give equal rows; further columns are not read; texts are read whole,
    and a text's spans depend on that text and the field alone.
    """
    sent = df.sparkSession.sparkContext.broadcast(field)
    source = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for i, j in slices([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)], AT_A_TIME):
                found = spans_of(batch.column(1)[i:j].to_pylist(), sent.value)
                columns = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(x)] for x in side], kind) for side in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *columns], names=["id", "base", "added"])

    shape = source.select("id", F.lit(None).cast(span).alias("base"), F.lit(None).cast(span).alias("added")).schema
    return source.mapInArrow(run, shape).withColumnRenamed("id", id)


def span_index(df: DataFrame) -> DataFrame:
    """For op13: counts by kind and digest of the patterns' spans, and all spans, of every document."""
    rows = df.select("doc_id", "text")
    ranks = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = lambda spans: F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(ranks[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return find(rows, fit(rows)).select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(order(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
