"""Components of long chains, hubs and cliques, against union-find."""

import random

import numpy as np
from pyspark.sql import functions as F

from telemara.llm import components, simhash


def union_find(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def test_path_star_and_clique(spark):
    order = list(range(5000))
    random.Random(1).shuffle(order)
    path = list(zip(order, order[1:]))
    star = [(7000, 7001 + i) for i in range(3000)]
    clique = [(20_000 + i, 20_000 + j) for i in range(30) for j in range(i)]
    edges = path + star + clique + [(5, 5), (order[0], order[1])]
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == union_find([(a, b) for a, b in edges if a != b])


def test_no_edges_and_names_of_any_type(spark):
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_fingerprints_that_drift_four_bits_a_step_are_one_component(spark):
    rng = np.random.default_rng(3)
    chain, fp = [], int(rng.integers(0, 2**63))
    for _ in range(200):
        chain.append(fp)
        for i in rng.choice(64, 4, replace=False):
            fp ^= 1 << int(i)
    fps = np.unique(np.array(chain, np.uint64)).view(np.int64)
    edges = simhash.near_fingerprints(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    roots = components.connected_components(edges)
    assert roots.count() == len(fps) and roots.agg(F.countDistinct("root")).first()[0] == 1
