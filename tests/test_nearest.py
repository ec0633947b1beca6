"""the products of a block are held in strips."""

import tracemalloc

import numpy as np

from telemara.operators.retrieve import nearest


def test_products_of_a_block_are_held_in_strips():
    rng = np.random.default_rng(1)
    asked, rows = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(1500, 8)), rng.normal(size=(3000, 8))))
    own, other = np.arange(1500), rng.permutation(3000)
    nearest(own[:1], asked[:1], other, rows, 5)  # imports
    tracemalloc.start()
    got = nearest(own, asked, other, rows, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * 3000 * 8
    assert nearest(own, asked, other, rows, 5, strip=2000).sort_by("query_id")["id"].to_pylist() == got["id"].to_pylist()
    for q in (0, 700, 1499):
        score = np.where(other == q, -2.0, np.round(rows @ asked[q], 12))
        assert got["id"].to_numpy()[5 * q : 5 * q + 5].tolist() == other[np.lexsort((other, -score))[:5]].tolist()
