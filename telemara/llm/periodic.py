"""Periodic runs of words: recursive frequency splitting, then a scan of lags over the segments that survive.

A run is a stretch of words with smallest period q, of max(LEAST, 2 q) words or more, that neither neighbour extends
with that period. Each word of a run occurs in it twice or more, so a word that its segment holds once is in no run
and splits the segment; this is repeated until nothing splits. Survivors are scanned by lags: short lags word by word;
for lags from g to 2g, aligned blocks of g/2 words are compared with the words a lag further on, as every run of such
a lag holds an aligned block, so that all lags of a scale take 2n comparisons and all scales n log n.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices

#: Words of the shortest run.
LEAST = 12
#: Lags below SHORT are compared word by word. A power of two, 4 at least.
SHORT = 8
#: Bytes of text that a task works on at a time; a longer text stands alone.
AT_A_TIME = 3_000_000


def surviving(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [a, b) of the word numbers in which every word occurs twice or more, of `least` words or more.

    Each round counts the words of the segments that changed in the round before, all segments at once.
    """
    done, open_ = [], np.array([[0, len(words)]])
    while len(open_ := open_[open_[:, 1] - open_[:, 0] >= least]):
        size = open_[:, 1] - open_[:, 0]
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(open_)), size)
        at = np.arange(ends[-1]) + np.repeat(open_[:, 0] - (ends - size), size)
        _, kind, count = np.unique(owner * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        rare = count[kind] < 2
        split = np.zeros(len(open_), dtype=bool)
        split[owner[rare]] = True
        done += map(tuple, open_[~split].tolist())
        keep = ~rare & split[owner]
        edge = np.diff(np.r_[False, keep, False].astype(np.int8))
        # a segment's first word ends the stretch before it
        first = np.r_[True, owner[1:] != owner[:-1]] & keep
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = np.setdiff1d(np.flatnonzero(first), starts)
        starts, stops = np.sort(np.r_[starts, inner]), np.sort(np.r_[stops, inner])
        open_ = np.stack([at[starts], at[stops - 1] + 1], axis=1) if len(starts) else np.empty((0, 2), np.int64)
    return sorted(done)


def _reach(words: np.ndarray, i: int, q: int, step: int) -> int:
    """How many words from i on, i included, equal those q further on; step -1: how many before i."""
    n, total, width = len(words), 0, 64
    while True:
        room = min(width, n - q - i - total if step > 0 else i - total)
        if room <= 0:
            return total
        lo = i + total if step > 0 else i - total - room
        same = words[lo : lo + room] == words[lo + q : lo + q + room]
        if not same.all():
            return total + int((same if step > 0 else same[::-1]).argmin())
        total, width = total + room, width * 2


def _stretches(same: np.ndarray, least: int) -> Iterable[tuple[int, int]]:
    edge = np.diff(np.r_[False, same, False].astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= least
    return zip(a[long].tolist(), b[long].tolist(), strict=True)


def lag_scan(words: np.ndarray, least: int = LEAST, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the word numbers, by period; the periods go up to half of `longest`."""
    n, runs = len(words), []
    half = (n if longest is None else longest) // 2

    begun: dict[int, list[int]] = defaultdict(list)  # a stretch at a multiple of a run's period begins where the run does
    for q in range(1, min(SHORT - 1, half) + 1):
        found = [(a, b + q - a, q) for a, b in _stretches(words[: n - q] == words[q:], max(least, 2 * q) - q)]
        found = [r for r in found if not any(q % p == 0 for p in begun.get(r[0], ()))]
        for r in found:
            begun[r[0]].append(q)
        runs += found
    if half < SHORT:
        return runs
    rng = np.random.default_rng(11)
    codes = rng.integers(0, 2**63, int(words.max()) + 1, dtype=np.uint64)[words]
    base = np.uint64(int(rng.integers(0, 2**62)) * 2 + 1)
    power, back = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (base, np.uint64(pow(int(base), -1, 2**64))))
    sums = np.r_[np.uint64(0), np.cumsum(codes * power[:-1], dtype=np.uint64)]
    g = SHORT
    while g <= half:
        h = g // 2
        window = (sums[h:] - sums[:-h]) * back[: n - h + 1]  # of the h words from i on
        blocks = np.arange(0, n - h - g + 1, h)
        padded = np.r_[window, np.zeros(2 * g, np.uint64)]
        pairs = []
        for i in range(0, len(blocks), max(1, 2_000_000 // g)):
            part = blocks[i : i + max(1, 2_000_000 // g)]
            j, d = np.nonzero(np.lib.stride_tricks.sliding_window_view(padded, g)[part + g] == window[part][:, None])
            fits = part[j] + g + d <= n - h
            pairs.append(np.stack([part[j], d + g], axis=1)[fits])
        pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
        drop = np.zeros(len(pairs), dtype=bool)
        for a, size, p in runs:  # multiples of a period say nothing new inside its run
            if size >= g + h and len(pairs):
                lo, hi = np.searchsorted(pairs[:, 0], [a, a + size - g - h + 1])
                cut = pairs[lo:hi]
                drop[lo:hi] |= (cut[:, 1] % p == 0) & (cut.sum(axis=1) + h <= a + size)
        pairs = pairs[~drop]
        last, upto = 0, 0
        for i, q in pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))].tolist():
            if q == last and i < upto or q > half:
                continue
            a, b = i - _reach(words, i, q, -1), i + _reach(words, i, q, 1)
            last, upto = q, b
            if b - a >= max(least - q, q):
                runs.append((a, b + q - a, q))
        g *= 2
    return runs


def runs_of(texts: list[list], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period) by start, then period; all lists in one pass.

    The surviving segments of all texts are laid end to end, with a word of its own after each, which is in no run.
    """
    number: dict = {}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int((sizes + 1).sum()), np.int64)
    for at, t in zip(begin.tolist(), texts, strict=True):
        words[at : at + len(t)] = np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t))
    words[begin + sizes] = len(number) + np.arange(len(texts))
    # counts are per text: the separators alone do not split one text's words from another's
    found: list[list] = [[] for _ in texts]
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    _, local = np.unique(owner * (len(number) + len(texts) + 1) + words, return_inverse=True)
    segments = surviving(local, least)
    if not segments:
        return found
    scale: dict[int, list] = defaultdict(list)
    for a, b in segments:  # segments of like length are scanned together, so that short ones take few lags
        scale[(b - a).bit_length()].append((a, b))
    for some in scale.values():
        size = np.array([b - a for a, b in some])
        start = np.array([a for a, _ in some])
        place = np.cumsum(size + 1) - size - 1
        laid = np.empty(int((size + 1).sum()), np.int64)
        inside = np.ones(len(laid), dtype=bool)
        inside[place + size] = False
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        _, laid[inside] = np.unique(local[at], return_inverse=True)
        laid[~inside] = len(at) + np.arange(len(some))
        for a, length, q in lag_scan(laid, least, int(size.max())):
            k = int(np.searchsorted(place, a, side="right")) - 1
            first = a - int(place[k]) + some[k][0]
            doc = int(owner[first])
            found[doc].append((first - int(begin[doc]), length, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: what stands between spaces and the characters 9 to 13."""
    return text.encode().split() if text else []


def _mapped(df: DataFrame, id: str, text: str, schema: str, row: Callable, prepare: Callable) -> DataFrame:
    """One row for each of df: row(id, words, runs) of the words that prepare(id, words) makes of a text's."""
    source = df.select(F.col(id), F.col(text).cast("string"))
    shape = source.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        arrow = to_arrow_schema(shape)
        for batch in batches:
            for i, j in slices([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)], AT_A_TIME):
                ids = batch.column(0)[i:j].to_pylist()
                words = [prepare(k, words_of(t)) for k, t in zip(ids, batch.column(1)[i:j].to_pylist(), strict=True)]
                rows = [row(k, w, r) for k, w, r in zip(ids, words, runs_of(words), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, shape)


def with_runs(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, runs, collapsed) for each row of df: its runs (start, length, period), and its text cut to the first
    period of each run, words joined by single spaces.

    Null and empty texts have no run and an empty collapsed text; repeated rows give equal rows; further columns of df
    are not read. A text of any length is worked on whole, in memory in proportion to its words.
    """
    kind = dict(df.select(id).dtypes)[id]
    schema = f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def row(key, words, runs):
        kept = kept_words(len(words), runs)
        return key, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join([w for w, k in zip(words, kept, strict=True) if k]).decode()

    return _mapped(df, id, text, schema, row, lambda _, words: words).withColumnRenamed("id", id)


def planted(doc_id: int | None, words: list) -> list:
    """The words of a document as op11 has them: one in ten by its id becomes periodic from some word on; a null id never."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def index_row(doc_id, words, runs):
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = kept_words(len(words), runs)
    every = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    collapsed = b" ".join([w for w, k in zip(words, kept, strict=True) if k])
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(every.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def run_index(df: DataFrame) -> DataFrame:
    """For op11: the runs of every document after `planted`, its longest run, and digests of all runs and of the collapsed text.

    The longest run's columns are null where there is none, exponent_milli with them. df has doc_id and text.
    """
    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return _mapped(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text", schema, index_row, planted)
