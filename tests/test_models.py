"""E7, E8 and E10 against plain numpy: gradients, thresholds and attributions of the network, cuts and leaves of the trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemara.operators import boosting, features, reconstruction
from telemara.plans import models

SF = "/root/testdata/sf0.001"
NAMES = [f"f{i}" for i in range(8)]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(1200, 2))
    x = np.tanh(z @ rng.normal(size=(2, 8))) * 3 + 0.05 * rng.normal(size=(1200, 8))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in NAMES)).repartition(6).cache()
    return x, df


def test_network_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    p, x = reconstruction.initial(8, 5, 3, 1), rng.normal(size=(7, 8))
    grads, _ = reconstruction.gradients(p, x)
    for k, w in p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            kept = w[at]
            w[at] = kept + 1e-6
            high = reconstruction.gradients(p, x)[1]
            w[at] = kept - 1e-6
            low = reconstruction.gradients(p, x)[1]
            w[at] = kept
            assert grads[k][at] == pytest.approx((high - low) / 2e-6, rel=1e-4, abs=1e-6)


def test_summed_gradients_do_not_depend_on_how_rows_are_dealt(cloud, monkeypatch):
    x, df = cloud
    p = reconstruction.initial(8, 5, 3, 1)
    want, loss = reconstruction.gradients(p, x)
    for direct, parts in ((64, 6), (4, 9)):  # few tasks, and a second sum of many
        monkeypatch.setattr(reconstruction, "DIRECT", direct)
        got, total, n = reconstruction.summed_gradients(reconstruction.packed(df.repartition(parts), NAMES, 1), p)
        assert n == len(x) and total == pytest.approx(loss) and got == pytest.approx(reconstruction.flat(want))


def test_network_beats_principal_components_and_scores_as_plain_numpy(cloud):
    x, df = cloud
    model = reconstruction.autoencoder_fit(df, NAMES, hidden=16, latent=2, epochs=25, batches=4, rate=0.02)
    scaled = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    _, _, axes = np.linalg.svd(scaled - scaled.mean(axis=0))
    linear = ((scaled - scaled @ axes[:2].T @ axes[:2]) ** 2).mean()
    w = model["weights"]
    leaky = lambda v: np.where(v > 0, v, 0.01 * v)
    out = leaky((leaky(scaled @ w["W1"] + w["b1"]) @ w["W2"] + w["b2"]) @ w["W3"] + w["b3"]) @ w["W4"] + w["b4"]
    error = (out - scaled) ** 2
    mse = error.mean(axis=1)
    assert mse.mean() < linear and model["losses"][-1] < model["losses"][0] / 3
    assert model["threshold"] == pytest.approx(mse.mean() + 3 * (mse.std() + 1e-6))
    for r in reconstruction.top_attributions(reconstruction.reconstruction_score(df.where("id < 60"), model)).collect():
        assert r.mse == pytest.approx(mse[r.id]) and r.ae_flag == (mse[r.id] >= model["threshold"]) and r.z_deviation == pytest.approx((mse[r.id] - mse.mean()) / (mse.std() + 1e-6), rel=1e-6)
        share = error[r.id] / (error[r.id].sum() + 1e-9)
        assert [a.feature for a in r.top] == [NAMES[k] for k in np.argsort(-share)[:4]] and [a.share for a in r.top] == pytest.approx(np.sort(share)[::-1][:4], abs=6e-5)


def test_network_without_rows_or_with_nulls(spark, cloud):
    _, df = cloud
    assert reconstruction.autoencoder_fit(df.where("false"), NAMES)["threshold"] == float("inf")
    holes = df.limit(50).withColumn("f0", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("f0")))
    model = reconstruction.autoencoder_fit(holes, NAMES, epochs=2)
    assert np.isfinite(model["threshold"]) and reconstruction.reconstruction_score(holes, model).where("mse is null or isnan(mse)").count() == 0


def plain_boost(x, y, edges, classes, rounds, depth, rate, l2=1.0, least=1e-3):
    """One tree a class a round, grown level by level; nodes are dicts."""
    bins = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], axis=1)
    scores, forest = np.zeros((len(x), classes)), []
    for _ in range(rounds):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        trees = []
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])

            def grow(rows, level=0, g=g, h=h):
                G, H, best = g[rows].sum(), h[rows].sum(), None
                for f in range(x.shape[1]) if level < depth else ():
                    for b in range(len(edges[f])):
                        left = rows[bins[rows, f] <= b]
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl >= least and H - hl >= least:
                            gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, f, b, left)
                if best is None:
                    return -rate * G / (H + l2)
                return best[1], best[2], grow(best[3], level + 1), grow(rows[bins[rows, best[1]] > best[2]], level + 1)

            trees.append(grow(np.arange(len(x))))
        value = lambda t, r: value(t[2] if bins[r, t[0]] <= t[1] else t[3], r) if isinstance(t, tuple) else t
        scores += np.array([[value(t, r) for t in trees] for r in range(len(x))])
        forest.append(trees)
    return forest, scores


def nested(tree, i=0):
    node = tree[i]
    return (node[0], node[1], nested(tree, node[2]), nested(tree, node[3])) if isinstance(node, tuple) else node


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, abs=1e-9)


def test_trees_equal_a_plain_booster(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(260, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] + 0.5 * x[:, 2] > 0.3)
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y, strict=True)], "a double, b double, c double, y int").repartition(4)
    edges = {n: np.quantile(x[:, i], np.linspace(0, 1, 9)[1:-1]) for i, n in enumerate("abc")}
    model = boosting.boost_fit(df, list("abc"), "y", 3, rounds=3, depth=2, rate=0.3, edges=edges)
    want, scores = plain_boost(x, y, list(edges.values()), 3, 3, 2, 0.3)
    assert all(same(nested(t), w) for got, plain in zip(model["trees"], want, strict=True) for t, w in zip(got, plain, strict=True))
    p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    assert boosting.boost_scores(model, x) == pytest.approx(p, abs=1e-9)
    names = ["none", "one", "two"]
    for r in boosting.boost_classify(df, model, names).collect():
        k = next(i for i in range(len(x)) if x[i, 0] == r.a and x[i, 1] == r.b)
        assert r.predicted == names[int(p[k].argmax())] and r.confidence == pytest.approx(p[k].max(), abs=6e-5) and [r.probabilities[n] for n in names] == pytest.approx(p[k], abs=6e-5)
    weights = boosting.gain_importance(spark, model).collect()
    assert sum(r.importance for r in weights) == pytest.approx(1, abs=2e-4) and [r.importance for r in weights] == sorted((r.importance for r in weights), reverse=True)


def test_booster_with_nulls_and_without_rows(spark):
    df = spark.createDataFrame([(float(i) if i % 5 else None, i % 2) for i in range(40)] + [(1.0, None)], "a double, y int")
    model = boosting.boost_fit(df, ["a"], "y", 2, rounds=1)
    assert boosting.boost_classify(df, model, ["n", "p"]).where("confidence is null").count() == 0
    empty = boosting.boost_fit(df.where("false"), ["a"], "y", 2, rounds=1)
    assert boosting.boost_classify(df.limit(1), empty, ["n", "p"]).first().confidence == 0.5


def test_six_classes_are_learnt_on_one_part_and_found_in_the_other(spark):
    train, test = models.both(spark, SF)
    assert train.join(test, models.AT, "left_semi").count() == 0 and train.select("label").distinct().count() == 6
    out = boosting.boost_classify(test, models.boosted(train), list(models.ARCHETYPES)).select("label", "predicted").collect()
    majority = max(sum(r.label == k for r in out) for k in models.ARCHETYPES) / len(out)
    right = np.mean([r.label == r.predicted for r in out])
    assert right > 0.9 > majority and len(out) == test.count() and len(features.VECTOR) == 41
