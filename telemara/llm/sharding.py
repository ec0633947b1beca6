"""Sharding by histogram sort: exact byte counts below probes, refined until the splitters meet their tolerance."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, others, renamed

#: Probes laid in each open interval in each round.
PROBES = 8
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def keys_of(df: DataFrame, id: str, text: str, *kept: str) -> DataFrame:
    """The sort key of each row, high then low, and its size. Equal texts share `high`, so they lie side by side."""
    words = F.coalesce(F.col(text), F.lit(""))
    return df.select(*kept, F.xxhash64(words).alias("high"), F.xxhash64(F.coalesce(F.col(id).cast("long"), F.lit(LOW))).alias("low"), (F.octet_length(words) + 1).cast("long").alias("size"))


#: Repeats of one row that a task numbers, or lays out, at a time.
CHUNK = 65_536


def spread_out(counts: DataFrame) -> DataFrame:
    """(high, low, size) for each row of a table of which counts has (high, low, size, n): a repeat's low is numbered().

    The repeats of a row are laid out in chunks, so that no task gets all of those of one row.
    """
    ones = counts.where("n = 1").select("high", "low", "size")
    many = counts.where("n > 1").select("high", "low", "size", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))).alias("chunk")).repartition("high", "low", "chunk")
    each = many.select("high", "size", "low", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("nth"))
    return ones.unionByName(each.select("high", numbered("nth").alias("low"), "size"))


def numbered(nth: str) -> Column:
    """The low key of the nth of equal rows, the first of which keeps its own."""
    return F.when(F.col(nth) == 0, F.col("low")).otherwise(F.xxhash64("low", nth))


def apart(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows, whose repeats get a low of their own each: they are numbered from 0 in groups of about one in CHUNK repeats."""
    again = counts.where("n > 1").select("high", "low", F.lit(True).alias("again"))
    marked = rows.withColumn("spread", F.pmod(F.monotonically_increasing_id(), F.lit(CHUNK))).join(again, ["high", "low"], "left")
    held = durable(marked.where("again").drop("again"))
    groups = held.groupBy("high", "low", "spread").agg(F.count("*").alias("m"))
    offsets = groups.select("high", "low", "spread", F.expr("coalesce(sum(m) over (partition by high, low order by spread rows between unbounded preceding and 1 preceding), 0)").alias("offset"))
    inner = held.withColumn("inner", F.expr("row_number() over (partition by high, low, spread order by size) - 1")).join(offsets, ["high", "low", "spread"])
    separate = inner.withColumn("nth", F.col("inner") + F.col("offset")).withColumn("low", numbered("nth"))
    return marked.where("again is null").select(*rows.columns).unionByName(separate.select(*rows.columns))


def below(key: tuple[int, int]) -> Column:
    high, low = key
    return F.col("high") < high if low == LOW else (F.col("high") < high) | ((F.col("high") == high) & (F.col("low") < low))


def tree(bounds: list[tuple[int, int]], leaf, lo: int = 0, hi: int | None = None) -> Column:
    """leaf(i) for the number i of bounds at or below a row's key, by a balanced tree of comparisons."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return leaf(lo)
    mid = (lo + hi) // 2
    return F.when(below(bounds[mid]), tree(bounds, leaf, lo, mid)).otherwise(tree(bounds, leaf, mid + 1, hi))


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (high, low) that cut the sorted rows into shards of near-equal bytes.

    Each round counts the exact bytes below PROBES candidates in every open interval in one aggregation of the whole
    table, and narrows the interval around each target. A splitter is settled once it is within tolerance of its
    target, or its interval holds one key only, in which case the nearer end is taken. The driver holds the probes'
    counts: shards * PROBES numbers.
    """
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return [(HIGH, HIGH)] * (shards - 1)
    targets = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    state: list = [((LOW, LOW), (HIGH, HIGH))] * (shards - 1)  # the open interval around each target
    done: list = [None] * (shards - 1)
    while None in done:
        open_ = sorted({state[k] for k, d in enumerate(done) if d is None})
        probes = sorted({p for lo, hi in open_ for p in between(lo, hi)} | {e for x in open_ for e in x})
        bin_ = tree(probes, lambda i: F.lit(i)).alias("bin")
        key = F.struct("high", "low")
        bins = {r.bin: r for r in keys.groupBy(bin_).agg(F.sum("size").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).collect()}  # a row a probe at most
        upto, at = [], 0
        for i in range(len(probes)):
            at += bins[i].n if i in bins else 0
            upto.append(at)
        for k, d in enumerate(done):
            if d is not None:
                continue
            lo, hi = state[k]
            i, j = probes.index(lo), probes.index(hi)
            near = min(range(i, j + 1), key=lambda p: abs(upto[p] - targets[k]))
            if abs(upto[near] - targets[k]) <= slack:
                done[k] = probes[near]
                continue
            b = min(max(bisect_right(upto, targets[k]), i + 1), j)
            # no key lies outside the bin's first and last, so the interval shrinks to them without another count
            first, last = tuple(bins[b].first), tuple(bins[b].last)
            if first == last:
                done[k] = probes[b - 1] if targets[k] - upto[b - 1] <= upto[b] - targets[k] else probes[b]
            else:
                state[k] = max(first, probes[b - 1]), min((last[0], last[1] + 1), probes[b]) if last[1] < HIGH else probes[b]
    return sorted(done)


def between(lo: tuple[int, int], hi: tuple[int, int]) -> list[tuple[int, int]]:
    """Up to PROBES keys strictly between two keys: evenly over the high part, or over the low part if that is settled."""
    if hi[0] - lo[0] > 1:
        step = max(1, (hi[0] - lo[0]) // PROBES)
        return [(x, LOW) for x in range(lo[0] + 1, hi[0], step)][: PROBES + 1] + [(hi[0], LOW)] * (hi[1] > LOW)
    if hi[0] > lo[0]:  # the high parts touch: the cut is within lo's, or at the start of hi's, or within hi's
        start = (hi[0], LOW)
        return [start] if lo < start < hi else within(lo[0], lo[1], HIGH) if hi == start else within(hi[0], LOW, hi[1])
    return within(lo[0], lo[1], hi[1])


def within(high: int, lo: int, hi: int) -> list[tuple[int, int]]:
    step = max(1, (hi - lo) // PROBES)
    return [(high, x) for x in range(lo + 1, hi, step)][: PROBES + 1]


def shard(df: DataFrame, shards: int = 16, tolerance: float = 0.005, id: str = "doc_id", text: str = "text", cell_rows: int = 1000) -> DataFrame:
    """df plus size, shard (0 to shards - 1) and slot (gapless from 0 in each shard): the `bytes` law.

    Size is the UTF-8 bytes of the text plus one; a null text counts as empty. Rows are sorted by a hash of the text,
    then of the id, and cut where the bytes are nearest to equal: within `tolerance` of a shard's share, or by half
    a row where a single row is larger. Copies of a text stay together unless they are more than a cut can spare, so
    a third of all rows being one text still makes equal shards; so do rows that repeat id and text, each of which has
    a key of its own beyond the first. An empty df gives no rows. Columns of df named size, shard or slot are replaced, all others come out as
    they went in.

    Rows move once, to cells of about `cell_rows` rows within their shard; slots are a cell's offset plus the rank in
    the cell, so no shard is ever sorted in one task.
    """
    plain, name = renamed(df)
    counts = durable(keys_of(plain, name[id], name[text]).groupBy("high", "low").agg(F.first("size").alias("size"), F.count("*").alias("n")))
    repeated = not counts.where("n > 1").isEmpty()
    keys = durable(spread_out(counts)) if repeated else counts
    cuts = splitters(keys, shards, tolerance)
    cells = max(1, keys.count() // (shards * cell_rows))
    part = tree(cuts, lambda i: F.lit(i))
    cell = F.pmod(F.xxhash64("low", "high"), F.lit(cells))
    rows = keys_of(plain, name[id], name[text], "*")
    placed = (apart(rows, counts) if repeated else rows).withColumns({"shard": part, "cell": cell})
    held = keys.select(part.alias("shard"), cell.alias("cell")).groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = held.select("shard", "cell", F.expr("coalesce(sum(n) over (partition by shard order by cell rows between unbounded preceding and 1 preceding), 0)").alias("base"))
    ranked = placed.withColumn("rank", F.expr("row_number() over (partition by shard, cell order by high, low)"))
    slot = (F.col("base") + F.col("rank") - 1).cast("long").alias("slot")
    return ranked.join(offsets, ["shard", "cell"]).select(*others(name, "size", "shard", "slot"), "size", F.col("shard").cast("int").alias("shard"), slot)


def shard_index(df: DataFrame, shards: int = 16) -> DataFrame:
    """For op5: what shard() decides about each document, without its text."""
    crc = F.crc32(F.coalesce("text", F.lit("")))
    made = shard(df.select("doc_id", "text", crc.alias("text_crc32")), shards)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
