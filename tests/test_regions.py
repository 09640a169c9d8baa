"""Adaptive cells, voxel runs and polygon overlaps against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import geometry, regions

BOXES = "scene string, key long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def some_boxes(n, seed, level=0.0):
    """Nine tenths stand on one level, a third of them close together."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, z = (rng.uniform(0, 2), rng.uniform(0, 2)) if i % 3 == 0 else (rng.uniform(0, 60), rng.uniform(0, 60))
        y = level if i % 10 else rng.choice([0.5, 1.0, 1.5]) + rng.uniform(-0.06, 0.06)
        w, h = rng.uniform(0.1, 1.5), rng.choice([0.5, 1.0, 1.5])
        rows.append(("a" if i % 4 else "b", i, x, x + w, y, y + h, z, z + rng.uniform(0.1, 1.5)))
    return rows


def overlaps(a, b, axes):
    return all(a[i] < b[i + 1] and b[i] < a[i + 1] for i in axes)


def test_pairs_and_support_in_adaptive_cells(spark):
    rows = some_boxes(700, 1)
    df = spark.createDataFrame(rows + [("a", 5000, None, 1.0, 0.0, 1.0, 0.0, 1.0)], BOXES)
    pairs = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and overlaps(a, b, (2, 6))}
    placed, _ = regions.quad_cells(df, "scene", bound=16)
    sizes = [r["count"] for r in placed.groupBy("scene", "__level", "__i", "__k").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 150 and placed.select("key").distinct().count() == 700
    for bound in (8, 64, 10_000):
        got = [(r.a, r.b) for r in regions.touching_pairs(df, "scene", "key", bound=bound).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and overlaps(a, b, (2, 6)) and abs(round(a[4] - b[5], 6)) <= 0.05}
    got = [(r.key, r.under) for r in regions.supported(df, "scene", "key", bound=16).collect()]
    assert set(got) == want and len(got) == len(want) and want
    volumes = {(r.a, r.b): r.volume for r in geometry.box_pairs(df, "scene", "key").collect()}
    assert volumes.keys() == {(a[1], b[1]) for a in rows for b in rows if (a[1], b[1]) in pairs and overlaps(a, b, (4,))}


def test_equal_and_huge_boxes_end_the_splitting(spark):
    same = [("a", i, 1.0, 2.0, 0.0, 1.0, 1.0, 2.0) for i in range(60)] + [("a", 100 + i, 0.0, 50.0, 0.0, 1.0, 0.0, 50.0) for i in range(20)]
    df = spark.createDataFrame(same, BOXES)
    placed, _ = regions.quad_cells(df, "scene", bound=4)
    assert placed.count() < 80 * 200
    assert regions.touching_pairs(df, "scene", "key", bound=4).count() == 80 * 79 // 2
    assert regions.touching_pairs(df.where("false"), "scene", "key").count() == 0 and regions.supported(df.where("false"), "scene", "key").count() == 0


def test_voxel_runs_against_all_voxels(spark):
    rng = random.Random(5)
    rows = [("a" if i % 2 else "b", i, *[v for lo in (rng.uniform(-3, 12) for _ in range(3)) for v in (lo, lo + rng.uniform(0, 6))]) for i in range(40)]
    df = spark.createDataFrame(rows, BOXES)
    voxels = lambda b: {(i, j, k) for i in range(math.floor(b[2] / 1.5), math.floor(b[3] / 1.5) + 1) for j in range(math.floor(b[4] / 1.5), math.floor(b[5] / 1.5) + 1) for k in range(math.floor(b[6] / 1.5), math.floor(b[7] / 1.5) + 1)}
    for s in "ab":
        held: dict = {}
        for b in rows:
            if b[0] == s:
                for v in voxels(b):
                    held[v] = held.get(v, 0) + 1
        assert next(r.cells for r in regions.voxel_overlap(df, "scene", 1.5).collect() if r.scene == s) == sum(n > 1 for n in held.values())
    rooms = [("a", 1, 0.0, 9.0, 0.0, 5.0, 0.0, 9.0), ("a", 2, 4.0, 12.0, 1.0, 5.0, 2.0, 3.0), ("b", 3, 0.0, 3.0, 0.0, 3.0, 0.0, 3.0)]
    got = {r.key: (r.cells, r.volume) for r in regions.voxel_outside(df, spark.createDataFrame(rooms, BOXES), "scene", "key", 1.5).collect()}
    for b in rows:
        n = len(voxels(b) - set().union(*[voxels(r) for r in rooms if r[0] == b[0]]))
        assert got[b[1]] == (n, pytest.approx(n * 1.5**3))


def test_runs_grow_with_the_face(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.9, 0.0, 0.9, 0.0, 1e6)], BOXES)
    assert regions.voxel_runs(df, 1.0).count() == 1 and regions.voxel_outside(df, df, "scene", "key", 1.0).first().cells == 0


def test_footprint_overlaps_at_once(spark):
    """Random turns, touching and equal quads, triangles and nulls, against one pair at a time."""
    rng = random.Random(11)

    def quad():
        x, z, w, d, t = rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0.1, 2), rng.uniform(0.1, 2), rng.uniform(0, 7)
        c, s = math.cos(t), math.sin(t)
        out = [[x + u * c - v * s, z + u * s + v * c] for u, v in ((-w, -d), (w, -d), (w, d), (-w, d))]
        return out if rng.random() < 0.5 else out[::-1]

    unit = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    pairs = [(quad(), quad()) for _ in range(400)] + [(unit, unit), (unit, [[1.0, 0.0], [2.0, 0.0], [2.0, 1.0], [1.0, 1.0]]), (unit, unit[:3]), (unit[::-1], [[0.5, 0.5], [2.0, 0.5], [2.0, 2.0]])]
    want = [geometry.convex_overlap(p, q) for p, q in pairs]
    some = [i for i, (p, q) in enumerate(pairs) if len(p) == len(q) == 4]
    assert geometry.convex_overlaps(np.array([pairs[i][0] for i in some]), np.array([pairs[i][1] for i in some])) == pytest.approx([want[i] for i in some], abs=1e-9)
    df = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate([*pairs, (None, unit), (unit, unit[:2])])], "i long, p array<array<double>>, q array<array<double>>")
    got = {r.i: r.v for r in df.select("i", geometry.footprint_overlap(F.col("p"), F.col("q")).alias("v")).collect()}
    assert [got[i] for i in range(len(pairs))] == pytest.approx(want, abs=1e-9) and got[len(pairs)] is None and got[len(pairs) + 1] is None
    assert want[400] == pytest.approx(1.0) and want[401] == 0 and want[402] == pytest.approx(0.5)
