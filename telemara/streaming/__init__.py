"""Structured Streaming: contracts, detection, features and counters with per-key state."""

from __future__ import annotations

import json
import math
import warnings
from contextlib import contextmanager
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import features
from ..operators.contract import MONOTONIC, split_quarantine
from ..operators.detect import CRITICAL_11, ENGINE, Chart, Engine, _middle, chi_square_tail


@contextmanager
def few_states(spark: SparkSession):
    """A stream started in here keeps its state in two partitions a core at most: each batch opens and commits all of them."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_snapshot_stream(spark: SparkSession, path: str, schema, max_files: int = 1, fmt: str = "parquet") -> DataFrame:
    """Files of a folder as a stream, max_files a batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def write_metric_points(stream: DataFrame, path: str, checkpoint: str):
    """Appends (ts, name, value, unit, dimensions); a missing name is `unknown`, a missing value 0, missing dimensions none."""
    empty = F.lit(None).cast("map<string,string>") if "dimensions" not in stream.columns else F.col("dimensions")
    filled = stream.withColumns({"name": F.coalesce("name", F.lit("unknown")), "value": F.coalesce("value", F.lit(0.0)), "dimensions": F.coalesce(empty, F.create_map().cast("map<string,string>"))})
    return filled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_order(rows, order: list[str]) -> pd.DataFrame:
    """The rows of a key in one batch, whose size the source's files a trigger bound, in order."""
    return pd.concat(list(rows)).sort_values(order, kind="stable", ignore_index=True)


class Monotonic(StatefulProcessor):
    """Flags rows older than the newest accepted row of their key; the mark lasts from batch to batch."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:
        self.mark = handle.getValueState("mark", "at double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = in_order(rows, ["id"])
        mark = self.mark.get()[0] if self.mark.exists() else -np.inf
        late = []
        for t, passed, reset in zip(pdf["epoch"], pdf["passed"], pdf["reset"], strict=True):
            mark = -np.inf if reset else mark
            late.append(bool(passed and t < mark))
            mark = max(mark, t) if passed else mark
        self.mark.update((float(mark),))
        yield pd.DataFrame({self.key: [key[0]] * len(pdf), "id": pdf["id"].to_numpy(), "late": late})

    def close(self) -> None:
        pass


def check_monotonic_stream(stream: DataFrame, key: str) -> DataFrame:
    """Rows (key, id, epoch) of a stream with their verdict; a batch is judged in the order of its ids.

    A row whose column `passed` is false has failed a check before: it is not late and does not move the mark. A true
    `reset` forgets the key's mark before the row. Both columns may be missing.
    """
    given = {c: F.coalesce(c, F.lit(d)) if c in stream.columns else F.lit(d) for c, d in (("passed", True), ("reset", False))}
    rows = stream.select(key, "id", F.col("epoch").cast("double").alias("epoch"), *[v.alias(k) for k, v in given.items()])
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Monotonic(key), outputStructType=f"{key} string, id long, late boolean", outputMode="append", timeMode="none")


def trailing(past: np.ndarray, new: np.ndarray, width: int, current: bool) -> np.ndarray:
    """A window a row of `new`: the `width` values before it (or up to it), NaN where there are none yet."""
    series = np.concatenate([np.full(width, np.nan), past, new])
    first = width + len(past) - (width - 1 if current else width)
    return np.lib.stride_tricks.sliding_window_view(series, width)[first : first + len(new)]


def cents(x: float) -> float:
    """Two decimal places, halves up, as Spark rounds."""
    return float(Decimal(repr(float(x))).quantize(Decimal("0.01"), ROUND_HALF_UP)) + 0.0


def all_cents(x: np.ndarray) -> np.ndarray:
    """cents() of each value; only those that products of doubles cannot tell from a half go through decimals."""
    scaled = np.abs(x) * 100
    whole = np.floor(scaled)
    out = np.copysign(whole + (scaled - whole > 0.5), x) / 100 + 0.0
    near = np.flatnonzero(~(np.abs(scaled - whole - 0.5) > 1e-12 * (1 + scaled)))
    out[near] = [cents(v) for v in x[near]]
    return out


def severities(sigma: np.ndarray) -> np.ndarray:
    size = np.abs(sigma)
    return np.select([size >= 5, size >= 3.5, size >= 2.5], ["CRITICAL", "HIGH", "MEDIUM"], "LOW")


class Watch(StatefulProcessor):
    """All detectors of an engine on each row of a key: the last values and the charts' states go from batch to batch."""

    def __init__(self, key: str, order: list[str], engine: Engine, model, crit_sq: float, gate: float):
        self.key, self.order, self.engine, self.model, self.crit_sq, self.gate = key, order, engine, model, crit_sq, gate
        e = engine
        self.metrics = sorted({m for m, _ in e.zscore} | {m for m, _ in e.mad} | {m for m, *_ in e.ewma} | {m for a, b, _ in e.pairs for m in (a, b)})

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "text string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf, e = in_order(rows, self.order), self.engine
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"past": {}, "charts": [None] * len(e.ewma)}
        past = {m: np.array(held["past"].get(m, []), float) for m in self.metrics}
        new = {m: pdf[m].to_numpy(float) for m in self.metrics}
        charts = [Chart(lam=lam, direction=way, state=st) for (_, lam, way), st in zip(e.ewma, held["charts"], strict=True)]
        for at in range(0, len(pdf), 4096):
            part = {m: x[at : at + 4096] for m, x in new.items()}
            made = self.signals(pdf.iloc[at : at + 4096], past, part, charts)
            past = {m: np.concatenate([past[m], part[m]])[-e.window :] for m in self.metrics}
            if made:
                columns = {c: np.concatenate([x[c] for x in made]) for c in made[0]}
                yield pd.DataFrame({self.key: [key[0]] * len(columns["id"])} | columns)
        self.state.update((json.dumps({"past": {m: x.tolist() for m, x in past.items()}, "charts": [c.state() for c in charts]}),))

    def signals(self, pdf, past, new, charts) -> list[dict[str, np.ndarray]]:
        """The columns of what each detector that fires finds in the rows."""
        e, ids, out, n = self.engine, pdf["id"].to_numpy(), [], 0

        def put(flags, metric, detector, at, observed, baseline, sigma, grave, details, explicit=False):
            """grave and details are made of the rows that fire alone; details come as numbers or as texts."""
            i = np.flatnonzero(flags)
            if not len(i):
                return
            shown = {k: v(i) for k, v in details.items()}
            each = [[f"{json.dumps(k)}:{json.dumps(x)}" for x in v] if isinstance(v, list) else [f'{json.dumps(k)}:"{x}"' for x in all_cents(v).tolist()] for k, v in shown.items()]
            text = np.array(["{" + ",".join(x) + "}" for x in zip(*each, strict=True)], object)
            same = lambda v: np.full(len(i), v, object)
            out.append({"id": ids[i], "metric": same(metric), "detector": same(detector), "emission": np.full(len(i), at, np.int32), "observed": all_cents(observed[i]), "baseline": all_cents(baseline[i]), "sigma": all_cents(sigma[i]), "severity": grave(i).astype(object), "explicit": np.full(len(i), explicit), "details": text})

        beyond = lambda z, edge, way: {"upper": z >= edge, "lower": z <= -edge, "both": np.abs(z) >= edge}[way]
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            for m, way in e.zscore:
                w, x = trailing(past[m], new[m], e.window, False), new[m]
                mean, std = np.nanmean(w, axis=1), np.nanstd(w, axis=1, ddof=1)
                z = (x - mean) / (std + 1e-6)
                put((np.sum(~np.isnan(w), axis=1) >= e.min_samples) & beyond(z, e.z_limit, way), m, "z_score", n, x, mean, z, lambda i, z=z: severities(z[i]), {"window_std": lambda i, std=std: std[i]})
                n += 1
            for m, way in e.mad:
                w, x = trailing(past[m], new[m], e.window, False), new[m]
                middle = _middle(w)
                mad = _middle(np.abs(w - middle[:, None]))
                z = 0.6745 * (x - middle) / (mad + 1e-6)
                put((np.sum(~np.isnan(w), axis=1) >= e.min_samples) & beyond(z, e.mad_limit, way), m, "modified_z_score", n, x, middle, z, lambda i, z=z: severities(z[i]), {"window_mad": lambda i, mad=mad: mad[i]})
                n += 1
            for (m, _, _), chart in zip(e.ewma, charts, strict=True):
                z, flag, mean, low, high = (np.array(c) for c in zip(*chart.path(new[m].tolist()), strict=True))
                off = z - mean
                put(flag.astype(bool), m, "ewma", n, new[m], mean, off / np.maximum(1.0, 0.1 * np.abs(mean)), lambda i, off=off: severities(off[i]), {"ucl": lambda i, high=high: high[i], "lcl": lambda i, low=low: low[i]})
                n += 1
            if self.model is not None:
                features, centre, inverse = self.model
                d = pdf[features].to_numpy(float) - np.asarray(centre)
                parts = np.abs(d * (d @ inverse))
                square = np.maximum(0.0, np.einsum("ij,ij->i", d @ inverse, d))
                share = np.round(parts / (parts.sum(axis=1) + 1e-9)[:, None], 4)
                far, edge = np.sqrt(square), math.sqrt(self.crit_sq)
                details = {"p_value": lambda i: [f"{chi_square_tail(s, len(features)):.2e}" for s in square[i]], "top_contributor": lambda i: [features[k] for k in share[i].argmax(axis=1)], "top_attribution_pct": lambda i: [str(float(s)) for s in share[i].max(axis=1)]}
                put((square >= self.crit_sq) & (far >= self.gate * edge), "multivariate_system_state", "mahalanobis", n, far, np.full(len(d), edge), far - edge, lambda i: np.where(far[i] > self.gate * edge, "CRITICAL", "HIGH"), details, True)
            n += 1
            for a, b, expected in e.pairs:
                x, y = trailing(past[a], new[a], e.pair_window, True), trailing(past[b], new[b], e.pair_window, True)
                sx, sy = np.nanstd(x, axis=1), np.nanstd(y, axis=1)
                r = np.nanmean((x - np.nanmean(x, axis=1)[:, None]) * (y - np.nanmean(y, axis=1)[:, None]), axis=1) / (sx * sy)
                drift = np.abs(r - expected)
                firm = (np.sum(~np.isnan(x), axis=1) >= e.min_samples) & (sx > 1e-6) & (sy > 1e-6)
                put(firm & (drift >= e.drift_limit), f"correlation_{a}_vs_{b}", "correlation_drift", n, r, np.full(len(r), expected), 5 * drift, lambda i, drift=drift: np.where(drift[i] > 0.8, "HIGH", "MEDIUM"), {"drift_delta": lambda i, drift=drift: drift[i]})
                n += 1
        return out

    def close(self) -> None:
        pass


def detect_stream(stream: DataFrame, key: str, order=("ts", "id"), engine: Engine = ENGINE, model=None, crit_sq: float = CRITICAL_11, gate: float = 1.5) -> DataFrame:
    """The signals of D10 on a stream, row by row as the batch finds them; each batch is taken in order.

    A key's state is its last `engine.window` values of each metric and its charts, whatever the stream's length.
    """
    schema = f"{key} string, id long, metric string, detector string, emission int, observed double, baseline double, sigma double, severity string, explicit boolean, details string"
    made = stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Watch(key, list(order), engine, model, crit_sq, gate), outputStructType=schema, outputMode="append", timeMode="none")
    return made.withColumn("metadata", F.from_json("details", "map<string,string>")).drop("details")


class Rolling(StatefulProcessor):
    """E5: mean, deviation and difference of metrics over the last `window` rows of a key, the current one included.

    carried: columns of doubles that pass through.
    """

    def __init__(self, key: str, metrics: list[str], window: int, carried: list[str] | None = None):
        self.key, self.metrics, self.window, self.carried = key, metrics, window, metrics if carried is None else carried

    def init(self, handle) -> None:
        self.past = handle.getValueState("past", "text string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = in_order(rows, ["id"])
        past = json.loads(self.past.get()[0]) if self.past.exists() else {m: [] for m in self.metrics}
        out = pd.concat([pd.Series([key[0]] * len(pdf), name=self.key), pdf["id"], pdf[self.carried].astype(float)], axis=1)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            for m in self.metrics:
                x = pdf[m].to_numpy(float)
                w = trailing(np.array(past[m], float), x, self.window, True)
                out[f"{m}_mean"], out[f"{m}_std"] = np.nanmean(w, axis=1), np.nan_to_num(np.nanstd(w, axis=1, ddof=1))
                out[f"{m}_diff"] = np.diff(x, prepend=past[m][-1] if past[m] else x[0])
                past[m] = [*past[m], *x.tolist()][-self.window :]
        self.past.update((json.dumps(past),))
        yield out

    def close(self) -> None:
        pass


def stream_features(stream: DataFrame, key: str, metrics: list[str], window: int = 10) -> DataFrame:
    """E5: (key, id), the metrics, and their rolling mean, deviation and difference, as the batch features have them."""
    made = [f"{m}_{k}" for m in metrics for k in ("mean", "std", "diff")]
    schema = f"{key} string, id long, " + ", ".join(f"{c} double" for c in [*metrics, *made])
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Rolling(key, list(metrics), window), outputStructType=schema, outputMode="append", timeMode="none")


def stream_vectors(stream: DataFrame, key: str, scaler: dict | None = None, window: int = 10) -> DataFrame:
    """E5: (key, id) and the 41 columns of VECTOR, as vector_features has them of the rows in the order of id.

    stream: key, id and base metrics; one that is missing or null counts as 0. A key's state is its last `window` values
    of the rolling metrics. scaler: of standardise_fit over the vectors of training rows; with it, they come standardised.
    """
    base = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in stream.columns else F.lit(0.0).alias(c) for c in features.BASE]
    made = [f"{m}_{k}" for m in features.ROLLING for k in ("mean", "std", "diff")]
    schema = f"{key} string, id long, " + ", ".join(f"{c} double" for c in [*features.BASE, *made])
    rolling = Rolling(key, list(features.ROLLING), window, list(features.BASE))
    out = stream.select(key, "id", *base).groupBy(key).transformWithStateInPandas(statefulProcessor=rolling, outputStructType=schema, outputMode="append", timeMode="none")
    whole = features.with_rolled_names(features.with_ratios(out)).select(key, "id", *features.VECTOR)
    return whole if scaler is None else features.standardise(whole, scaler)


class Judge(StatefulProcessor):
    """The mark of C4 for rows that C1 to C3 let pass; a row comes and goes as text, so that no type changes."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:
        self.mark = handle.getValueState("mark", "at double, text string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = in_order(rows, ["place"])
        at, text = self.mark.get() if self.mark.exists() else (-np.inf, None)
        marks = []
        for t, shown, passed in zip(pdf["at"], pdf["shown"], pdf["passed"], strict=True):
            late = bool(passed and t < at)
            marks.append(text if late else None)
            if passed and t > at:
                at, text = float(t), shown
        if text is not None:
            self.mark.update((at, text))
        yield pd.DataFrame({"body": pdf["body"], "late_than": marks})

    def close(self) -> None:
        pass


def judged_stream(stream: DataFrame, judge, key: str, ts: str, place: str) -> DataFrame:
    """Stream plus error_code and error_message, C1 to C3 by judge(stream), then C4 in the order of the long `place`.

    A key's state is the newest accepted time. Rows must come in batches in that order, as files are read.
    """
    known = judge(stream)
    sent = known.select(F.col(key).cast("string").alias("key"), F.col(place).cast("long").alias("place"), F.col(ts).cast("double").alias("at"), F.col(ts).cast("string").alias("shown"), F.col("error_code").isNull().alias("passed"), F.to_json(F.struct(*known.columns)).alias("body"))
    out = sent.groupBy("key").transformWithStateInPandas(statefulProcessor=Judge("key"), outputStructType="body string, late_than string", outputMode="append", timeMode="none")
    row = out.select(F.from_json("body", known.schema).alias("x"), "late_than").select("x.*", "late_than")
    late = F.col("late_than").isNotNull()
    made = {"error_code": F.when(late, MONOTONIC).otherwise(F.col("error_code")), "error_message": F.when(late, F.concat(F.col(ts).cast("string"), F.lit(" < "), F.col("late_than"))).otherwise(F.col("error_message"))}
    return row.withColumns(made).drop("late_than")


def quarantine_stream(stream: DataFrame, judge, ids, valid: str, rejected: str, checkpoint: str, key: str | None = None, ts: str | None = None, place: str | None = None):
    """C6 on a stream: valid rows and envelopes go to a table each; each batch is computed once.

    judge(stream) adds error_code and error_message by C1 to C3. With key, ts and place, C4 follows in the same pass, with
    its mark in the stream's state. A batch that is run again after a failure overwrites its own folder in both tables.
    """
    checked = judge(stream) if key is None else judged_stream(stream, judge, key, ts, place)

    def split(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            good, bad = split_quarantine(kept, ids)
            good.write.mode("overwrite").parquet(f"{valid}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            kept.unpersist()

    with few_states(stream.sparkSession):
        return checked.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Investigation(StatefulProcessor):
    """The latest state of an incident. A resolved one stays as a mark against late rows; both go ttl_s after their last change."""

    def __init__(self, key: str, ttl_s: int):
        self.key, self.ttl_s = key, ttl_s

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "epoch long, status string", 1000 * self.ttl_s)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        last = in_order(rows, ["epoch"]).iloc[-1]
        epoch, status = int(last["epoch"]), str(last["status"])
        if self.state.exists() and self.state.get()[0] > epoch:
            epoch, status = self.state.get()  # late news change nothing, and do not put off the end
        else:
            self.state.update((epoch, status))
        yield pd.DataFrame({self.key: [key[0]], "epoch": [epoch], "status": [status], "active": [status != "RESOLVED"]})

    def close(self) -> None:
        pass


def active_stream(stream: DataFrame, key: str, ttl_s: int = 86_400) -> DataFrame:
    """G16 on a stream (key, epoch, status): after each batch the state of every incident with news, and whether it is active.

    An incident's state is kept for ttl_s seconds after its last change, resolved or not; of equal epochs the later row
    counts. live_investigations() reads what is active now.
    """
    schema = f"{key} long, epoch long, status string, active boolean"
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Investigation(key, ttl_s), outputStructType=schema, outputMode="append", timeMode="processingTime")


def live_investigations(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, epoch, status) of the incidents that active_stream holds active, read from its state below `checkpoint`.

    States whose time to live is over are left out, as they go with the next batch.
    """
    held = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    left = held.where(F.col("value.ttlExpirationMs") > F.unix_millis(F.current_timestamp()))
    return left.select(F.col(f"key.{key}").alias(key), "value.value.*").where("status <> 'RESOLVED'")


def windowed_counts(stream: DataFrame, ts: str, by, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """I1 and I3 on a stream: events of each window and label, final once the watermark has passed it."""
    at = stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").cast("long").alias("window_start"), *by, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads back what it wrote."""
    spark = stream.sparkSession
    with few_states(spark):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def run_until_idle(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """As run_to_table for a stream whose state has a time to live, which never ends by itself: it is stopped after a
    third batch in a row without rows (the first after a restart may be one of before), when all that is there has been read."""
    with few_states(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    try:
        while not query.awaitTermination(0.2):
            seen = {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
            if len(seen) > 2 and not any(seen[k] for k in sorted(seen)[-3:]):
                break
    finally:
        query.stop()
    return stream.sparkSession.read.parquet(path)
