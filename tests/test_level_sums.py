import numpy as np

from telemara.operators import boosting


def test_sums_of_a_level_are_those_of_each_node_from_two_passes_a_feature(monkeypatch):
    rng, most = np.random.default_rng(5), 8
    x, g, h, at = rng.integers(0, most, (500, 3)), rng.normal(size=500), rng.random(500), rng.integers(0, 12, 500)
    nodes, calls, real = [2, 3, 7, 11], [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: (calls.append(1), real(*a))[1])
    got = boosting.level_sums(np.ascontiguousarray(x.T), at, nodes, g, h, most)
    assert len(calls) == 2 * 3
    for sums, node in zip(got, nodes, strict=True):
        for f in range(3):
            for i, w in enumerate((g, h)):
                assert np.array_equal(sums[i, f], real(x[at == node, f], w[at == node], most))  # to the last bit


def test_no_node_has_no_sums():
    assert boosting.level_sums(np.zeros((2, 3), np.int64), np.zeros(3, np.int64), [], np.zeros(3), np.zeros(3), 4).shape == (0, 2, 2, 4)
