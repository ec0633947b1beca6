"""A leaky-ReLU autoencoder whose gradients are summed in tasks, round by round.

Rows are packed once into blocks of float64 vectors, which Spark keeps batch by batch. A round reads the blocks of its batch
alone: every task runs its own through the network that the driver sent, and gives one row, the sum of its gradients; sums
of many tasks are added up in further tasks first. The driver holds the parameters and their Adam moments, whatever the rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import in_few, stored
from .features import standardise_fit

#: Vectors of a block at most; tasks from whose sums the driver takes one row each, more are added up in tasks.
BLOCK, DIRECT = 4096, 64
SLOPE = 0.01
LAYERS = ("W1", "b1", "W2", "b2", "W3", "b3", "W4", "b4")


def initial(d: int, hidden: int = 16, latent: int = 6, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights d-hidden-latent-hidden-d with variances that keep the size of signals."""
    rng, made, gain = np.random.default_rng(seed), {}, np.sqrt(2 / (1 + SLOPE**2))
    for i, (a, b) in enumerate(((d, hidden), (hidden, latent), (latent, hidden), (hidden, d)), start=1):
        made |= {f"W{i}": rng.normal(0, (gain if i % 2 else 1.0) / np.sqrt(a), (a, b)), f"b{i}": np.zeros(b)}
    return made


def leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, SLOPE * x)


def forward(p: dict, x: np.ndarray) -> tuple:
    """Pre-activation and activation of the first layer, code, pre-activation and activation of the third, output."""
    a = x @ p["W1"] + p["b1"]
    h = leaky(a)
    z = h @ p["W2"] + p["b2"]
    c = z @ p["W3"] + p["b3"]
    k = leaky(c)
    return a, h, z, c, k, k @ p["W4"] + p["b4"]


def gradients(p: dict, x: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Of half the squared error summed over rows and features; and that sum."""
    a, h, z, c, k, out = forward(p, x)
    e = out - x
    dk = (e @ p["W4"].T) * np.where(c > 0, 1.0, SLOPE)
    dz = dk @ p["W3"].T
    dh = (dz @ p["W2"].T) * np.where(a > 0, 1.0, SLOPE)
    made = {"W4": k.T @ e, "b4": e.sum(0), "W3": z.T @ dk, "b3": dk.sum(0), "W2": h.T @ dz, "b2": dz.sum(0), "W1": x.T @ dh, "b1": dh.sum(0)}
    return made, float((e * e).sum() / 2)


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in LAYERS])


def shaped(values: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in LAYERS:
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def scaled(x: np.ndarray, features, scale: dict) -> np.ndarray:
    """Rows of features by E4's scale: as standardise(), for a whole matrix; nulls have come as NaN."""
    mean, deviation = (np.array([scale[f][i] for f in features]) for i in (0, 1))
    return np.nan_to_num((x - mean) / deviation, nan=0.0, posinf=5.0, neginf=-5.0)


def packed(df: DataFrame, features, batches: int, scale: dict | None = None) -> DataFrame:
    """(batch, n, body): the vectors of df, by the scale if given, in blocks of one batch each; a row's batch is by a hash of its values."""
    values = F.array(*[F.col(f).cast("double") for f in features])

    def pack(chunks):
        waiting: dict[int, list] = {}
        row = lambda k: pa.RecordBatch.from_pydict({"batch": [k], "n": [sum(map(len, waiting[k]))], "body": [np.concatenate(waiting.pop(k)).tobytes()]}, schema=shape)
        shape = pa.schema([("batch", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])
        for chunk in chunks:
            x = chunk.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
            x = x if scale is None else scaled(x, features, scale)
            of = chunk.column(0).to_numpy()
            for k in np.unique(of):
                waiting.setdefault(int(k), []).append(x[of == k])
                if sum(map(len, waiting[int(k)])) >= BLOCK:
                    yield row(int(k))
        for k in list(waiting):
            yield row(k)

    return df.select(F.pmod(F.xxhash64(values), F.lit(batches)).cast("int").alias("batch"), values.alias("x")).mapInArrow(pack, "batch int, n long, body binary")


def _summing(batches, size: int):
    total, n = np.zeros(size), 0
    for batch in batches:
        for body, rows in zip(batch.column(0), batch.column(1), strict=True):
            total, n = total + np.frombuffer(body.as_buffer(), np.float64), n + rows.as_py()
    yield pa.RecordBatch.from_pydict({"body": [total.tobytes()], "n": [n]}, schema=pa.schema([("body", pa.binary()), ("n", pa.int64())]))


def summed_gradients(blocks: DataFrame, p: dict, tasks: int | None = None) -> tuple[np.ndarray, float, int]:
    """Gradients and loss of all vectors of blocks, and their number; one small row comes from each of few tasks.

    tasks: how many blocks has, counted if not given.
    """
    d, size = len(p["b4"]), flat(p).size + 1

    def run(batches):
        total, n = np.zeros(size), 0
        for batch in batches:
            for body in batch.column(0):
                x = np.frombuffer(body.as_buffer(), np.float64).reshape(-1, d)
                g, loss = gradients(p, x)
                total, n = total + np.r_[flat(g), loss], n + len(x)
        yield pa.RecordBatch.from_pydict({"body": [total.tobytes()], "n": [n]}, schema=pa.schema([("body", pa.binary()), ("n", pa.int64())]))

    sums = blocks.select("body").mapInArrow(run, "body binary, n long")
    if (blocks.rdd.getNumPartitions() if tasks is None else tasks) > DIRECT:
        sums = sums.repartition(DIRECT // 4).mapInArrow(lambda b: _summing(b, size), "body binary, n long")
    rows = sums.collect()
    total = sum((np.frombuffer(bytes(r.body), np.float64) for r in rows), np.zeros(size))
    return total[:-1], float(total[-1]), sum(r.n for r in rows)


def error_moments(blocks: DataFrame, p: dict) -> tuple[int, float, float]:
    """Number of vectors of blocks, and mean and population deviation of their mean squared errors; a task gives one row."""
    d, shape = len(p["b4"]), pa.schema([("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64())])

    def joined(a, b):
        n = a[0] + b[0]
        return (n, a[1] + (b[1] - a[1]) * b[0] / n, a[2] + b[2] + (b[1] - a[1]) ** 2 * a[0] * b[0] / n) if n else a

    def run(batches):
        made = (0, 0.0, 0.0)
        for batch in batches:
            for body in batch.column(0):
                x = np.frombuffer(body.as_buffer(), np.float64).reshape(-1, d)
                mse = ((forward(p, x)[-1] - x) ** 2).mean(axis=1)
                made = joined(made, (len(mse), float(mse.mean()), float(((mse - mse.mean()) ** 2).sum())))
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(shape.names, made, strict=True)}, schema=shape)

    made = (0, 0.0, 0.0)
    for r in blocks.select("body").mapInArrow(run, "n long, mean double, m2 double").collect():
        made = joined(made, tuple(r))
    return made[0], made[1], float(np.sqrt(made[2] / max(1, made[0])))


def autoencoder_fit(df: DataFrame, features, hidden: int = 16, latent: int = 6, sigmas: float = 3.0, epochs: int = 30, batches: int = 8, rate: float = 0.02, seed: int = 42) -> dict:
    """An autoencoder of the standardised features of df, which holds nominal rows; threshold mean + sigmas deviations.

    An epoch is one round for each batch of rows. Nulls, NaN and infinities are standardised as by E4. Without rows the
    network stays as it began and the threshold is infinite.
    """
    features = list(features)
    scale = standardise_fit(df, features)
    p = initial(len(features), hidden, latent, seed)
    blocks = stored(packed(df.select(*features), features, batches, scale), "blocks", "batch")
    parts = [in_few(blocks.where(F.col("batch") == k).select("body")).persist() for k in range(batches)]
    try:
        tasks = [part.rdd.getNumPartitions() for part in parts]
        w, first, second, t, losses = flat(p), np.zeros(flat(p).size), np.zeros(flat(p).size), 0, []
        for _ in range(epochs):
            total, rows = 0.0, 0
            for part, k in zip(parts, tasks, strict=True):
                g, loss, n = summed_gradients(part, shaped(w, p), k)
                total, rows = total + loss, rows + n
                if n:
                    g, t = g / n, t + 1
                    first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                    w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            losses.append(2 * total / max(1, rows * len(features)))
            if not rows:
                break
        n, mean, deviation = error_moments(reduce(DataFrame.unionByName, parts), shaped(w, p))
    finally:
        for part in parts:
            part.unpersist()
    model = {"features": features, "scale": scale, "weights": shaped(w, p), "mean": 0.0, "deviation": 1.0, "threshold": float("inf"), "losses": losses}
    if not n:
        return model
    return model | {"mean": mean, "deviation": deviation + 1e-6, "threshold": mean + sigmas * (deviation + 1e-6)}


def reconstruction_score(df: DataFrame, model: dict) -> DataFrame:
    """Df plus mse, z_deviation, ae_flag (at the threshold or above) and attributions, largest share first."""
    features, sent = model["features"], df.sparkSession.sparkContext.broadcast(model["weights"])

    @F.pandas_udf("array<double>")
    def squares(cols: pd.DataFrame) -> pd.Series:
        x = scaled(cols.to_numpy(float), features, model["scale"])
        return pd.Series(list((forward(sent.value, x)[-1] - x) ** 2))

    values = F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    out = df.withColumn("_sq", squares(values)).withColumn("_sum", F.aggregate("_sq", F.lit(0.0), lambda s, v: s + v))
    shares = F.zip_with(F.array(*[F.lit(f) for f in features]), "_sq", lambda n, v: F.struct((-v / (F.col("_sum") + 1e-9)).alias("minus"), n.alias("feature")))
    ranked = F.transform(F.array_sort(shares), lambda s: F.struct(s["feature"].alias("feature"), F.round(-s["minus"], 4).alias("share")))
    made = {"mse": F.col("_sum") / len(features), "attributions": ranked}
    made |= {"z_deviation": (made["mse"] - model["mean"]) / model["deviation"], "ae_flag": made["mse"] >= model["threshold"]}
    return out.withColumns(made).drop("_sq", "_sum")


def top_attributions(df: DataFrame, n: int = 4) -> DataFrame:
    """The first n attributions."""
    return df.withColumn("top", F.slice("attributions", 1, n))
