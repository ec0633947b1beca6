"""Connected components by contraction: every round merges each node into the lowest of its neighbours' neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, hot_among, hot_keys, lookup


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), of any one type: (node, root), root the smallest node reachable; nodes without an edge are absent.

    Each round orders the nodes by a hash of its own, sends every node to the least of all nodes within two steps, and
    goes on with the graph of those that were chosen, until no edge is left. A star, a clique or a hub with
    everything around it is gone after one round; of a path about a third of the nodes remain, so rounds grow with
    the logarithm of the longest chain and there is no limit to them. A hub's edges are looked up by a broadcast of
    the few nodes with more than one in a thousand of all edges, minima are summed up before each shuffle, and each
    table goes to the shared folder, so a lost executor costs one step. Self-loops and repeated edges change nothing;
    an edge with a null end is ignored.
    """
    edges = edges.select("a", "b").where("a <> b")
    ends = durable(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    moves = []
    while True:
        rank = lambda x: F.struct(F.xxhash64(x, F.lit(len(moves))).alias("h"), F.col(x).alias("to"))  # noqa: B023, E731
        near = durable(ends.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("low"), F.count("*").alias("n")).select("node", F.least("low", rank("node")).alias("low"), "n"))
        if near.isEmpty():
            break
        hot = hot_among(near.select(F.col("node").alias("key"), "n"))
        step = durable(lookup(ends, "b", near.select("node", "low"), hot).groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low")).select("node", F.col("low.to").alias("to")))
        moves.append(step)
        left = lookup(lookup(ends, "a", step.select("node", F.col("to").alias("c")), hot), "b", step.select("node", F.col("to").alias("d")), hot)
        ends = durable(left.where("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")).distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = moves[-1].select("node", F.col("to").alias("root"))
    for step in reversed(moves[:-1]):
        after = label.select(F.col("node").alias("was"), "root")
        label = durable(lookup(step, "to", after, hot_keys(step, "to"), "left").select("node", F.coalesce("root", "to").alias("root")))
    least = label.groupBy(F.col("root").alias("top")).agg(F.min("node").alias("least"))
    return durable(lookup(label, "root", least, hot_keys(label, "root")).select("node", F.col("least").alias("root")))
