"""Pruned retrieval against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparkloom.operators import cells


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_top_k_equals_all_pairs(spark, monkeypatch, spread):
    """Clustered and scattered vectors, copies, null and zero vectors, small pieces; clustered queries visit few cells."""
    monkeypatch.setattr(cells, "ITEMS", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    v = (centres[rng.integers(0, 12, 900)] + spread * rng.normal(size=(900, 8))).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(1000, v[3]), (1001, v[3]), (1002, [0.0] * 8), (1003, [0.0] * 8), (1004, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    seen: list = []
    got: dict = {}
    asked = df.where("id % 20 = 0 or id > 1000")
    for r in cells.cosine_top_k(asked, df, "id", "v", 6, block_bytes=400, visited=seen).collect():
        got.setdefault(r.query, []).append((r.rank, r.item, r.score))
    held = {i: np.array(x) for i, x in rows if x is not None}
    one = lambda x: x / (np.linalg.norm(x) or 1)
    ids = sorted(held)
    table = np.array([one(held[i]) for i in ids])
    for q in [i for i in ids if i % 20 == 0 or i > 1000]:
        scores = np.round(table @ one(held[q]), 9)
        order = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:6]
        mine = sorted(got[q])
        assert [x for _, x, _ in mine] == [ids[j] for j in order] and [s for *_, s in mine] == pytest.approx([scores[j] for j in order], abs=2e-9)
    assert 1004 not in got and seen[0] <= seen[1] and (spread > 1 or seen[0] < 0.5 * seen[1])


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id long, v array<double>")
    assert sorted((r.query, r.item, r.rank) for r in cells.cosine_top_k(df, df, "id", "v", 5).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert cells.cosine_top_k(df, df.where("false"), "id", "v", 5).count() == 0 and cells.cosine_top_k(df.where("false"), df, "id", "v", 5).count() == 0


def test_centroids_of_random_samples():
    rng = random.Random(1)
    sample = np.array([[rng.choice([0.0, 1.0]) for _ in range(3)] for _ in range(50)])
    c = cells.fit_centroids(sample, 7)
    assert len(c) <= 7 and np.allclose(np.linalg.norm(c, axis=1), 1)


def test_scores_in_bounded_slices():
    """A task's largest matrix is bounded whatever its queries and items, and slices give what one product gives."""
    import tracemalloc

    import pyarrow as pa

    from sparkloom.operators import cells

    rng = np.random.default_rng(6)
    made = lambda name, n: pa.table({name: pa.array(np.arange(n)), "v": pa.array(list(rng.normal(size=(n, 8))), pa.list_(pa.float64()))})
    asked, held = made("query", 1500), made("item", 10_000)
    tracemalloc.start()
    got = cells._score(5)(asked, held)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    some = asked.slice(700, 3)
    assert got.slice(3500, 15).to_pylist() == cells._score(5)(some, held).to_pylist() and len(got) == 7500
