"""Leaves of the projection trees: bounded pieces, and pairs counted once however leaves are dealt out."""

import itertools

import numpy as np
import pandas as pd
import pytest

from ledgerloom.llm import forest


@pytest.fixture(scope="module")
def vectors():
    """Groups of 1 to 12 near copies with two labels."""
    rng = np.random.default_rng(3)
    x = [c + rng.standard_normal(16) * 0.06 for k, c in enumerate(rng.standard_normal((500, 16))) for _ in range(1 + k % 12)]
    return [(i, v.tolist(), i % 3 // 2) for i, v in enumerate(x)]


def test_workers_hand_on_bounded_pieces(spark, vectors, monkeypatch):
    """Deep trees put a vector into some fifty leaves; what a task makes of a batch must not be one frame."""
    monkeypatch.setattr(forest, "LEAF", 32)
    data = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    real = type(data).mapInPandas

    def checked(df, run, schema):
        def inside(batches):
            for out in run(batches):
                assert len(out) <= 10_000, f"{len(out)} rows in one frame"
                yield out

        return real(df, inside, schema)

    found = {}
    for nodes in (150, 10**9):
        monkeypatch.setattr(forest, "BUCKET", nodes, raising=False)
        with monkeypatch.context() as m:
            m.setattr(type(data), "mapInPandas", checked)
            found[nodes] = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(data).collect()}
    assert found[150] == found[10**9] and len(found[150]) == len(vectors)
    x, labels = np.array([v for _, v, _ in vectors]), np.array([label for *_, label in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T >= 0.93) & (labels[:, None] == labels)).sum(axis=1) - 1
    got = np.array([found[150][i][0] for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() > 0


@pytest.mark.parametrize("cells", [64, 1 << 21])
def test_pairs_count_in_their_first_leaf(monkeypatch, cells):
    monkeypatch.setattr(forest, "CELLS", cells)
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((30, 8)), 4, axis=0) + rng.standard_normal((120, 8)) * 0.01
    lists = [np.unique(rng.integers(0, 300, 40)).astype(np.int32) for _ in x]
    lists = [np.union1d(a, [200 + i % 2]).astype(np.int32) for i, a in enumerate(lists)]  # leaves 200 and on are this bucket's
    nodes, m = rng.permutation(10_000)[: len(x)], rng.integers(1, 4, len(x))
    own = [int((a >= 200).sum()) for a in lists]
    frame = pd.DataFrame({"dim": 8, "node": nodes, "m": m, "v": [v.tobytes() for v in x], "own": own, "leaves": [a.tobytes() for a in lists]})
    got = {r.a: r.links for r in forest._compared(0.93)(frame).itertuples()}
    unit, want = x / np.linalg.norm(x, axis=1, keepdims=True), dict.fromkeys(nodes.tolist(), 0)
    for i, j in itertools.combinations(range(len(x)), 2):
        common = np.intersect1d(lists[i], lists[j])
        if unit[i] @ unit[j] >= 0.93 and len(common) and common[0] >= 200:
            want[nodes[i]] += m[j]
            want[nodes[j]] += m[i]
    assert {a: n for a, n in got.items() if n} == {a: n for a, n in want.items() if n} != {}
