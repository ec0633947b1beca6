"""Mixing sources to target weights by entropy balancing, rounded into copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, others, renamed, sums_before, word_count

#: A size of a source that so many documents have is dealt to as many cells, each ranked by itself.
CELL_ROWS = 1000
MOST = 3
WEIGHTS = (5, 2, 1)


def targets_of(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (source, source_size): plus target. Weights repeat over the sources by code point, null last.

    A target is the weight times a level, or `most` times the source's size if that is less; the level makes the
    targets sum to all sizes. That is what resharing every excess by weight comes to. Ranks and running sums are
    taken in ranges, so that any number of sources will do.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums_before(sources, [F.col("source").asc_nulls_last()], i="1")
    weighed = ranked.withColumn("w", F.element_at(cycle, (F.col("i") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    filled = durable(sums_before(weighed, [F.col("cap") / F.col("w"), F.col("i")], spent="cap", gone="w"))
    everything, weight = filled.agg(F.sum("source_size"), F.sum("w")).first()
    level = filled.withColumn("level", (F.lit(everything) - F.col("spent")) / (F.lit(weight) - F.col("gone")))
    found = level.where(F.col("level") <= F.col("cap") / F.col("w")).agg(F.max("level")).first()[0]
    return filled.select("source", "source_size", F.least("cap", F.col("w") * F.lit(float("inf") if found is None else found)).alias("target"))


def tilts(groups: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """targets plus tilt and scale: rate = least(most, exp(tilt * size / scale)) has the target tokens in expectation.

    groups (source, size, n) has one row for each size in a source. Among all rates up to `most`, these are the
    nearest to one in relative entropy that meet the source's tokens; the tilt is the dual variable. Newton's method
    on the dual, for all sources at once: each round is one aggregation of the groups; a step that leaves the bracket,
    or is over half as long as the one before, is replaced by the bracket's middle. So rounds end for every source by
    themselves: when its tokens are within 1e-9 of the target, where it stays, or when no number lies between the bracket's ends. A
    source whose target is `most` times its size has every rate at `most` (null tilt).
    """
    state = durable(
        targets.withColumn("key", key("source")).join(groups.where("size > 0").groupBy(key("source").alias("key")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.min("size").alias("least")), "key", "left")
        .withColumns({"tilt": F.lit(0.0), "lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "off": F.lit(1.0), "moved": F.lit(float("inf"))})
        .withColumn("free", F.coalesce((F.col("target") > 0) & (F.col("target") < most * F.col("source_size")), F.lit(False)))
    )
    sized = durable(groups.where("size > 0").select(key("source").alias("key"), "size", "n"))
    while True:
        x = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        rate = F.least(raw, F.lit(float(most)))
        tokens = F.col("n") * F.col("size") * rate
        sums = sized.join(state.where("free").select("key", "tilt", "scale"), "key").groupBy("key").agg(F.sum(tokens).alias("got"), F.sum(F.when(raw < most, tokens * x).otherwise(0.0)).alias("slope"))
        off = F.col("got") - F.col("target")
        step = F.col("tilt") - F.try_divide(off, F.col("slope"))
        lo, hi = F.when(off < 0, F.greatest("lo", "tilt")).otherwise(F.col("lo")), F.when(off > 0, F.least("hi", "tilt")).otherwise(F.col("hi"))
        moved = state.join(sums, "key", "left").select("*", off.alias("gap"), step.alias("step"), lo.alias("lo2"), hi.alias("hi2"))
        middle = F.when(F.col("lo2") == float("-inf"), 2 * F.col("hi2") - 1).when(F.col("hi2") == float("inf"), 2 * F.col("lo2") + 1).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2")) & (F.abs(F.col("step") - F.col("tilt")) <= F.least(F.lit(50.0), F.col("moved") / 2))
        new = F.when(F.abs(F.col("gap")) <= 1e-9 * F.col("target"), F.col("tilt")).when(inside, F.col("step")).otherwise(middle)
        names = [c for c in state.columns if c not in ("tilt", "lo", "hi", "off", "moved")]
        state = durable(moved.select(*names, F.when(F.col("free"), new).otherwise(F.col("tilt")).alias("tilt"), F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"), F.abs(F.col("gap") / F.col("target")).alias("off"), F.abs(new - F.col("tilt")).alias("moved")))
        if state.where("free and off > 1e-9 and tilt > lo and tilt < hi").isEmpty():
            break
    return state.select("key", "source", "source_size", "target", "scale", F.when(F.col("free"), F.round("tilt", 9)).alias("tilt"))


def key(source: str):
    """A source as a key that joins a null source with itself."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def group_copies(groups: DataFrame, tilted: DataFrame, most: int = MOST) -> DataFrame:
    """(key, size, n, k): how many copies, in all, the n documents of a source and size give.

    Whole rates are floors; fractions accumulate from the largest size down and give a copy at each half, which keeps
    the running sum within half a copy of what is due. What is then left of the target goes to one size in each power
    of two, from the largest down, so the source ends within half of its smallest such size.
    """
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("scale"))))
    due = groups.join(tilted, "key").withColumn("due", F.when(F.col("size") > 0, F.round(F.col("n") * rate, 9)).otherwise(F.lit(0.0)))
    upto = "sum(due - floor(due)) over (partition by key order by size desc rows between unbounded preceding and"
    carried = due.select("*", F.expr(f"round({upto} current row), 6)").alias("now"), F.expr(f"round(coalesce({upto} 1 preceding), 0), 6)").alias("then"))
    first = durable(carried.select("key", "size", "n", "target", (F.floor("due") + F.floor(F.col("now") + 0.5) - F.floor(F.col("then") + 0.5)).cast("long").alias("k")).withColumn("k", F.greatest(F.lit(0).cast("long"), F.least("k", F.col("n") * most))))
    left = first.groupBy("key").agg((F.max("target") - F.sum(F.col("k") * F.col("size"))).alias("left"))
    band = F.floor(F.log2("size")).alias("band")
    best = first.where("size > 0").groupBy("key", band).agg(F.max_by(F.struct("size", "n", "k"), F.struct(F.least("k", F.col("n") * most - F.col("k")), "size")).alias("c"))
    ladder = best.groupBy("key").agg(F.reverse(F.array_sort(F.collect_list("c"))).alias("c")).join(left, "key")
    fold = f"""aggregate(c, named_struct('left', left, 'out', cast(array() as array<struct<size:bigint, add:bigint>>)), (s, x) ->
        named_struct('left', s.left - x.size * least(x.n * {most} - x.k, greatest(-x.k, cast(round(s.left / x.size) as bigint))),
                     'out', concat(s.out, array(named_struct('size', x.size, 'add', least(x.n * {most} - x.k, greatest(-x.k, cast(round(s.left / x.size) as bigint))))))), s -> s.out)"""
    added = ladder.select("key", F.explode(F.expr(fold)).alias("x")).select("key", "x.size", "x.add")
    return first.join(added, ["key", "size"], "left").select("key", "size", "n", (F.col("k") + F.coalesce("add", F.lit(0))).alias("k"))


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """df plus size, source_size, target and copies (0 to `most`), by DataFrame operations alone.

    Size is the number of words (null: 0). Sources of no words get target 0 and documents of no words no copy. A null
    source is a source; repeated rows are documents of their own. The copies of one size in a source are dealt evenly
    to cells by a hash of the id, and within a cell in the order of that hash, so a size that a third of all rows
    share is no single task, and reruns agree. An empty df gives no rows. Columns of df named as the four added are
    replaced, all others come out as they went in.
    """
    plain, name = renamed(df)
    made = mixed_rows(plain, name[id], name[text], name[source], weights, most)
    return made.select(*others(name, "size", "source_size", "target", "copies"), "size", "source_size", "target", "copies")


def mixed_rows(df: DataFrame, id: str, text: str, source: str, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """df, whose columns have names like c0, plus size, source_size, target and copies."""
    keep = [F.col(c) for c in df.columns]
    order = F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    n_cells = max(1, -(-df.count() // CELL_ROWS))
    rows = df.select(*keep, word_count(F.col(text)).alias("size"), key(source).alias("key"), order.alias("order")).withColumn("cell", F.pmod("order", F.lit(n_cells)))
    cells = durable(rows.groupBy("key", "size", "cell").agg(F.count("*").alias("n"), F.first(source).alias("source")))
    groups = durable(cells.groupBy("key", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source")))
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    tilted = durable(tilts(groups, targets_of(sources, weights, most), most))
    copies = group_copies(groups.select("key", "size", "n"), tilted.select("key", "target", "scale", "tilt"), most).withColumnRenamed("n", "all")
    before = "coalesce(sum(n) over (partition by key, size order by cell rows between unbounded preceding and 1 preceding), 0)"
    quota = cells.select("key", "size", "cell", "n", F.expr(before).alias("before")).join(copies, ["key", "size"]).join(tilted.select("key", "source_size", "target"), "key")
    share = lambda upto: F.expr(f"(k * ({upto})) div all")
    quota = durable(quota.select("key", "size", "cell", "n", "source_size", "target", (share("before + n") - share("before")).alias("k")))
    ranked = rows.withColumn("rank", F.expr(f"row_number() over (partition by key, size, cell order by order, {id})"))
    each = F.expr("k div n + if(rank <= k % n, 1, 0)").cast("int")
    return ranked.join(quota, ["key", "size", "cell"]).select(*keep, "size", "source_size", "target", each.alias("copies"))


def mix_index(df: DataFrame) -> DataFrame:
    """For op7: what mix() decides about each document; taken is its size times its copies."""
    made = mix(df.select("doc_id", "text", "source"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def take_mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of df as often as it has copies, with df's columns, whatever their names."""
    plain, name = renamed(df)
    made = mixed_rows(plain, name[id], name[text], name[source]).where("copies > 0")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(others(name))
