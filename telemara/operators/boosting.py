"""Gradient-boosted trees over quantile bins, softmax over all classes, one aggregation of histograms a level.

Rows are binned once and packed into blocks that carry their class scores. For each level of a round's trees, one for
each class, every task adds up gradients by (class, node, feature, bin); the sums of a (class, node) meet in one further
task, which gives back only the best cut. The leaves of the last level need no histograms, only the sums of one feature.
So the driver holds trees alone. Scores are brought up to date and written to
the shared folder every few rounds; in between, tasks add the trees that a block has not seen.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import in_few, settled

BLOCK = 8192
#: Rounds of trees after which the scores of all rows are written anew.
REFRESH = 5


def quantile_edges(df: DataFrame, features, bins: int = 32, accuracy: int = 10_000) -> dict[str, np.ndarray]:
    """For each feature at most bins - 1 edges, from one aggregation; a value goes into the bin of the edges at most as great."""
    at = [i / bins for i in range(1, bins)]
    r = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, accuracy).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return {f: np.unique(np.array(r[f"q{i}"] or [], dtype=float)) for i, f in enumerate(features)}


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of values; NaN goes into the first bin."""
    return np.stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), side="right") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)


def _led(tree: list, bins: np.ndarray, at_leaf, i: int = 0):
    """at_leaf of the node below node i that each row ends in; each node compares its feature's column once."""
    if not isinstance(tree[i], tuple):
        return at_leaf(i)
    feature, cut, left, right = tree[i]
    return np.where(bins.T[feature] <= cut, _led(tree, bins, at_leaf, left), _led(tree, bins, at_leaf, right))


def leaf_of(tree: list, bins: np.ndarray) -> np.ndarray:
    """The node that each row ends in; a node is (feature, bin, left, right): left if the row's bin is at most bin, or a value."""
    return np.broadcast_to(_led(tree, bins, np.int64), len(bins))


def values_of(tree: list, bins: np.ndarray) -> np.ndarray:
    return np.broadcast_to(_led(tree, bins, lambda i: float(tree[i])), len(bins))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(x.T)  # class by class
    x = np.exp(x - x.max(axis=0))
    return (x / x.sum(axis=0)).T


def level_sums(columns: np.ndarray, at: np.ndarray, nodes: list[int], g: np.ndarray, h: np.ndarray, most: int) -> np.ndarray:
    """(node, g or h, feature, bin): sums over the rows at each of nodes, from two passes a feature; columns: bins by feature."""
    place = np.full(int(at.max()) + 1, len(nodes))
    place[nodes] = np.arange(len(nodes))
    first, size = place[at] * most, (len(nodes) + 1) * most
    made, cell = np.empty((len(columns), 2, size)), np.empty_like(first)
    for f, column in enumerate(columns):
        np.add(first, column, out=cell)
        made[f, 0], made[f, 1] = np.bincount(cell, g, size), np.bincount(cell, h, size)
    return np.ascontiguousarray(made[:, :, :-most].reshape(len(columns), 2, len(nodes), most).transpose(2, 1, 0, 3))


def best_cut(g: np.ndarray, h: np.ndarray, l2: float, least: float):
    """(gain, feature, bin) of the best cut of a node from its histograms (feature, bin), or None; ties: the first."""
    gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    G, H = g[0].sum(), h[0].sum()
    gr, hr = G - gl, H - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - G**2 / (H + l2)
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-9 else None


def _packed(df: DataFrame, features, edges, label: str, classes: int) -> DataFrame:
    """(bins, y, scores) blocks: bytes of the bins, of the classes and of zeros to begin with."""
    cuts = [edges[f] for f in features]
    shape = pa.schema([("bins", pa.binary()), ("y", pa.binary()), ("scores", pa.binary())])

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
            y = batch.column(1).to_numpy().astype(np.int32)
            for i in range(0, len(y), BLOCK):
                part = y[i : i + BLOCK]
                yield pa.RecordBatch.from_pydict({"bins": [binned(x[i : i + BLOCK], cuts).tobytes()], "y": [part.tobytes()], "scores": [np.zeros((len(part), classes)).tobytes()]}, schema=shape)

    known = df.where(F.col(label).isNotNull())
    values = F.array(*[F.col(f).cast("double") for f in features])  # a null comes as NaN
    return known.select(values.alias("x"), F.col(label).cast("int").alias("y")).mapInArrow(run, "bins binary, y binary, scores binary")


def _unpacked(batches, width: int, classes: int):
    for batch in batches:
        for b, y, s in zip(*batch.columns, strict=True):
            yield np.asfortranarray(np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, width)), np.frombuffer(y.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.float64).reshape(-1, classes)


def _added(scores: np.ndarray, bins: np.ndarray, rounds: list) -> np.ndarray:
    return scores + sum(np.stack([values_of(t, bins) for t in trees], axis=1) for trees in rounds) if rounds else scores


def boost_fit(df: DataFrame, features, label: str, classes: int, rounds: int = 30, depth: int = 3, rate: float = 0.15, l2: float = 1.0, least: float = 1e-3, bins: int = 32, edges: dict | None = None) -> dict:
    """A model of `rounds` trees for each class, from the rows of df whose label, 0 to classes - 1, is known.

    A node is cut where the gain of the squared gradient sums over hessians plus l2 is greatest and both sides have a
    hessian of `least` or more; ties go to the first feature and bin. edges: of the bins, else quantiles of df.
    """
    features = list(features)
    edges = edges or quantile_edges(df, features, bins)
    width, most = len(features), 1 + max((len(edges[f]) for f in features), default=0)
    spark, done, gains = df.sparkSession, [], np.zeros(width)
    blocks, seen = settled(in_few(_packed(df, features, edges, label, classes))), 0
    for r in range(rounds):
        trees: list[list] = [[0.0] for _ in range(classes)]
        open_ = {(k, 0) for k in range(classes)}
        for level in range(depth + 1):
            sent = spark.sparkContext.broadcast((done[seen:], trees, open_))

            def run(batches, sent=sent, shown=width if level < depth else 1):
                fresh, growing, wanted = sent.value
                sums: dict = {}
                for x, y, s in _unpacked(batches, width, classes):
                    p = softmax(_added(s, x, fresh))
                    g, h = np.ascontiguousarray((p - np.eye(classes)[y]).T), np.ascontiguousarray((p * (1 - p)).T)
                    columns = x.T[:shown].astype(np.int64)  # x lies column by column
                    for k in range(classes):
                        at = leaf_of(growing[k], x)
                        nodes = [int(n) for n in np.unique(at) if (k, int(n)) in wanted]
                        for node, hist in zip(nodes, level_sums(columns, at, nodes, g[k], h[k], most), strict=True):
                            sums[k, node] = sums[k, node] + hist if (k, node) in sums else hist
                for (k, node), hist in sums.items():
                    yield pa.RecordBatch.from_pydict({"k": [k], "node": [node], "body": [hist.tobytes()]}, schema=pa.schema([("k", pa.int32()), ("node", pa.int32()), ("body", pa.binary())]))

            def cut(key, pdf):
                g, h = sum(np.frombuffer(b, np.float64) for b in pdf["body"]).reshape(2, -1, most)
                best = best_cut(g, h, l2, least) if level < depth else None  # noqa: B023  called within the round
                row = {"k": key[0], "node": key[1], "value": -rate * g[0].sum() / (h[0].sum() + l2), "gain": best[0] if best else 0.0, "feature": best[1] if best else -1, "bin": best[2] if best else -1}
                return pd.DataFrame([row])

            found = blocks.mapInArrow(run, "k int, node int, body binary").groupBy("k", "node").applyInPandas(cut, "k int, node int, value double, gain double, feature int, bin int").collect()
            sent.unpersist()
            open_ = set()
            for row in sorted(found):
                tree = trees[row.k]
                if row.feature < 0:
                    tree[row.node] = row.value
                else:
                    gains[row.feature] += row.gain
                    tree[row.node] = (row.feature, row.bin, len(tree), len(tree) + 1)
                    open_ |= {(row.k, len(tree)), (row.k, len(tree) + 1)}
                    tree += [0.0, 0.0]
            if not open_:
                break
        done.append(trees)
        if len(done) - seen >= REFRESH and r + 1 < rounds:
            fresh = spark.sparkContext.broadcast(done[seen:])

            def update(batches, fresh=fresh):
                for x, y, s in _unpacked(batches, width, classes):
                    yield pa.RecordBatch.from_pydict({"bins": [x.tobytes()], "y": [y.tobytes()], "scores": [_added(s, x, fresh.value).tobytes()]}, schema=pa.schema([("bins", pa.binary()), ("y", pa.binary()), ("scores", pa.binary())]))

            blocks, seen = settled(blocks.mapInArrow(update, "bins binary, y binary, scores binary")), len(done)
    return {"features": features, "edges": edges, "trees": done, "classes": classes, "gains": gains}


def boost_scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Class probabilities of a matrix of values."""
    bins = binned(x, [model["edges"][f] for f in model["features"]])
    return softmax(_added(np.zeros((len(x), model["classes"])), bins, model["trees"]))


def boost_classify(df: DataFrame, model: dict, names: list[str]) -> DataFrame:
    """Df plus predicted, confidence (the greatest probability) and probabilities by class name, rounded to four places."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def chances(cols: pd.DataFrame) -> pd.Series:
        return pd.Series(list(boost_scores(sent.value, cols.to_numpy(float))))

    p = df.withColumn("_p", chances(F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(model["features"])])))
    known = F.array(*[F.lit(n) for n in names])
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    return p.withColumns({"predicted": F.element_at(known, best), "confidence": F.round(F.array_max("_p"), 4), "probabilities": F.map_from_arrays(known, F.transform("_p", lambda x: F.round(x, 4)))}).drop("_p")


def gain_importance(spark, model: dict, n: int = 8) -> DataFrame:
    """The n features with the greatest share of all gain, rounded to four places."""
    total = float(model["gains"].sum()) + 1e-9
    weights = [(f, round(float(g) / total, 4)) for f, g in zip(model["features"], model["gains"], strict=True)]
    return spark.createDataFrame(weights, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)
