"""Running values and exact ranks of keys that any number of rows may share.

running(): a segmented prefix scan. Rows are sorted by key and order in ranges; each range is scanned alone, and what its
first key brings along from earlier ranges is one row a range. ranked_values(): exact selection. Rows are counted below,
between and above three pivots, and only those of the part that holds the wanted rank are looked at again, until they are
few enough to be sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import settled

#: Associative functions of a scan: over rows, and of what came before with what is here. The last value of rows is the
#: max of structs that begin with their order.
JOINS = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b))}
#: A group of more rows than this is selected from by pivots; a smaller one is sorted in a task.
SMALL = 100_000
#: Parts between the quantiles from which pivots are taken.
GRID = 64


def _same(pairs) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def running(df: DataFrame, keys, order, made: dict[str, tuple[str, Column]], current: bool = False) -> DataFrame:
    """df plus, for each name, the max, min or sum of an expression over all rows before in the same key, and over the row
    itself if `current`; null where there is none. A name that df has is replaced.

    Null keys are a key. A key is as many tasks as it has ranges. `order` should end in a unique column: rows that no
    column tells apart are taken in any order.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys, order = list(keys), [F.col(o) if isinstance(o, str) else o for o in order]
    how = {f"__v{i}": JOINS[kind] for i, (kind, _) in enumerate(made.values())}
    valued = df.withColumns({v: e for v, (_, e) in zip(how, made.values(), strict=True)})
    placed = settled(valued.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))], F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*[over(v).alias(f"__t{v}") for v, (over, _) in how.items()])
    carried = totals.select("__r", *[f"__k{i}" for i in range(len(keys))], *[over(f"__t{v}").over(before).alias(f"__c{v}") for v, (over, _) in how.items()], F.count("*").over(before).alias("__n")).where("__n > 0").drop("__n")
    inside = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    scanned = placed.withColumns({f"__i{v}": over(v).over(inside) for v, (over, _) in how.items()})
    same = _same([("__range", "__r"), *[(k, f"__k{i}") for i, k in enumerate(keys)]])
    joined = scanned.join(F.broadcast(carried), same, "left")  # only a range's first key has begun before it: a row a range
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[with_(F.col(f"__c{v}"), F.col(f"__i{v}")).alias(k) for k, (v, (_, with_)) in zip(made, how.items(), strict=True)])


def _parts(v: Column, low, mid, high) -> dict[str, Column]:
    """Counts of the parts that three rising pivots make, each a part of its own, by their place."""
    return {"below": F.count_if(v < low), "at_low": F.count_if(v == low), "under": F.count_if((v > low) & (v < mid)), "at_mid": F.count_if((v == mid) & (mid > low)), "over": F.count_if((v > mid) & (v < high)), "at_high": F.count_if((v == high) & (high > mid)), "above": F.count_if(v > high)}


def _by_pivots(rows: DataFrame, by: list[str], wanted: DataFrame, small: int = SMALL) -> DataFrame:
    """(by, rank, value) for wanted (by, rank, n) groups of many rows; rows: (by, v), v not null.

    open_ has a row for each group and rank not yet found: the value lies strictly between low and high (null: no bound)
    and `below` rows lie beneath. There is one for each SMALL rows of the table and rank at most, so it is broadcast.
    """
    kind = dict(rows.dtypes)["v"]
    null = F.lit(None).cast(kind)
    open_ = settled(wanted.select(*by, "rank", null.alias("low"), null.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("left")))
    found, names, short = None, [f"_b{i}" for i in range(len(by))], None
    within = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    while not open_.isEmpty():
        state = F.broadcast(open_.withColumnsRenamed(dict(zip(by, names, strict=True))))
        inside = rows.join(state, _same(zip(by, names, strict=True)) & within)
        held = [*names, "rank", "low", "high", "below", "left"]
        grid = inside.groupBy(*held).agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], 1000).alias("q"))
        at = F.least(F.lit(GRID), F.floor((F.col("rank") - F.col("below")) * GRID / F.col("left"))).cast("int")
        pick = lambda k: F.element_at("q", F.greatest(F.lit(1), F.least(F.lit(GRID + 1), at + k)))
        pivots = settled(grid.select(*held, pick(0).alias("p1"), pick(1).alias("p2"), pick(2).alias("p3")))
        sent = F.broadcast(pivots)
        again = rows.join(sent, _same(zip(by, names, strict=True)) & within)
        counted = again.groupBy(*held, "p1", "p2", "p3").agg(*[c.alias(f"n_{k}") for k, c in _parts(F.col("v"), F.col("p1"), F.col("p2"), F.col("p3")).items()])
        upto, rest, part = F.col("below"), F.col("rank"), None
        bounds = {"below": ("low", "p1"), "at_low": "p1", "under": ("p1", "p2"), "at_mid": "p2", "over": ("p2", "p3"), "at_high": "p3", "above": ("p3", "high")}
        for name, edge in bounds.items():
            after = upto + F.col(f"n_{name}")
            now = F.struct((F.col(edge) if isinstance(edge, str) else null).alias("value"), (null if isinstance(edge, str) else F.col(edge[0])).alias("low"), (null if isinstance(edge, str) else F.col(edge[1])).alias("high"), upto.alias("below"), F.col(f"n_{name}").alias("left"))
            part = F.when(rest < after, now) if part is None else part.when(rest < after, now)
            upto = after
        turned = settled(counted.select(*[F.col(a).alias(b) for a, b in zip(names, by, strict=True)], "rank", part.alias("x")).select(*by, "rank", "x.*"))
        done = turned.where("value is not null").select(*by, "rank", "value")
        found = done if found is None else found.unionByName(done)
        rest = turned.where("value is null").select(*by, "rank", "low", "high", "below", "left")
        few = rest.where(F.col("left") <= small)
        short, open_ = few if short is None else short.unionByName(few), rest.where(F.col("left") > small)
    if found is None:
        return wanted.select(*by, "rank", null.alias("value")).where("false")
    last = rows.join(F.broadcast(short.withColumnsRenamed(dict(zip(by, names, strict=True)))), _same(zip(by, names, strict=True)) & within)
    sorted_ = last.groupBy(*names, "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("all"))  # `small` values at most
    return found.unionByName(sorted_.select(*[F.col(a).alias(b) for a, b in zip(names, by, strict=True)], "rank", F.element_at("all", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value")))


def ranked_values(df: DataFrame, by, value: str, ranks, small: int = SMALL) -> DataFrame:
    """(by, n, rank, value): for each group of df its number of values n, and the values at the ranks, from 0 in rising order.

    ranks(n) is a column, the array of the wanted ranks of a group of n values. Null values do not count. A group of more
    than `small` values is never brought together: each round counts the values around pivots, and keeps what is between.
    """
    if not by:
        return ranked_values(df.withColumn("_all", F.lit(0)), ["_all"], value, ranks, small).drop("_all")
    by, names = list(by), [f"_b{i}" for i in range(len(by))]
    here, there = dict(zip(by, names, strict=True)), _same(zip(by, names, strict=True))
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    counts = settled(rows.groupBy(*by).agg(F.count("*").alias("n")))
    wanted = counts.select(*by, "n", F.explode(F.array_distinct(F.transform(ranks(F.col("n")), lambda r: r.cast("long")))).alias("rank"))
    large = counts.where(F.col("n") > small)
    crowded = F.broadcast(large.withColumnsRenamed(here).select(*names))  # fewer than one in `small` rows
    sorted_ = rows.join(crowded, there, "left_anti").groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("all")).withColumnsRenamed(here)
    short = wanted.where(F.col("n") <= small).join(sorted_, there)
    out = short.select(*by, "n", "rank", F.element_at("all", (F.col("rank") + 1).cast("int")).alias("value"))
    if large.isEmpty():
        return out
    exact = _by_pivots(rows.join(crowded, there, "left_semi"), by, wanted.where(F.col("n") > small), small).withColumnsRenamed(here)
    sizes = F.broadcast(large)
    return out.unionByName(exact.join(sizes, there).select(*by, "n", "rank", "value"))
