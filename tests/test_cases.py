"""Small cases with values by hand: validation metrics, votes, advantages over turns, and the batch algebra."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scans
from sparkloom.operators import batch, groups, metrics
from sparkloom.operators import recurrences as R


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_expected_best_of_draws(spark):
    """Of 1 to 5, three draws: the largest is k with probability (k^3 - (k - 1)^3) / 125."""
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([7.0],)], "v array<double>")
    best = [r[0] for r in df.select(metrics.best_of_n_expected(F.col("v"), 3)).collect()]
    assert best == pytest.approx([(1 * 1 + 2 * 7 + 3 * 19 + 4 * 37 + 5 * 61) / 125, 7.0])
    worst = [r[0] for r in df.select(metrics.best_of_n_expected(F.col("v"), 3, worst=True)).collect()]
    assert worst == pytest.approx([6 - best[0], 7.0])
    assert [r[0] for r in df.select(metrics.best_of_n_deviation(F.col("v"), 1)).collect()] == pytest.approx([2**0.5, 0.0])


def test_majority_vote(spark):
    df = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "A", 0.7), (2, 0, "A", 0.9), (2, 1, "B", 0.8), (2, 2, "B", 0.7), (2, 3, "A", 0.6)], "g int, i int, pred string, val double")
    assert rows_of(metrics.majority(df, "g", "pred", "i", "val"), "g", "pred", "val") == [(1, "A", 0.9), (2, "A", 0.9)]


def test_validation_metrics(spark):
    df = spark.createDataFrame([("source1", "prompt1", 0.8), ("source1", "prompt1", 0.9), ("source2", "prompt2", 0.7)], "s string, p string, score double")
    got = {(r.s, r.metric): r.value for r in metrics.validation_metrics(df, "s", "p", "score").collect()}
    assert got["source1", "mean@2"] == pytest.approx(0.85) and got["source1", "std@2"] == pytest.approx(0.05) and got["source2", "mean@1"] == pytest.approx(0.7)
    best = next(v for (s, m), v in got.items() if s == "source1" and m.startswith("best@2"))
    worst = next(v for (s, m), v in got.items() if s == "source1" and m.startswith("worst@2"))
    assert best == pytest.approx(0.8 * 0.25 + 0.9 * 0.75) and worst == pytest.approx(0.9 * 0.25 + 0.8 * 0.75)


def test_advantages_over_turns(spark):
    """Two turns of a conversation between masked observations: what stands in the observations doesn't matter."""
    reward = [0.0, 0.0, 0.1, 0.1, 0.1, 0.0, 0.0, 0.1, 1.0, 0.0, 0.0]
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    known = {2: 4.0, 3: 5.0, 4: 6.0, 7: 7.0, 8: 9.0, 9: 0.0, 10: 0.0}
    rng = random.Random(1)
    rows = [(s, i, reward[i], known.get(i, rng.uniform(-100, 100)), mask[i]) for s in (1, 2) for i in range(11)]
    df = spark.createDataFrame(rows, "s int, i int, r double, v double, m int")
    gamma, lam = 0.9, 0.5
    got: dict = {}
    for r in R.gae_rows(df, "s", "i", "r", "v", "m", gamma, lam).collect():
        got.setdefault(r.s, {})[r.i] = r.advantage
    # by hand: the last token of the second turn, then back through it, over the observation, and through the first turn
    a8 = 1.0 - 9.0
    a7 = 0.1 + 0.9 * 9.0 - 7.0 + 0.45 * a8
    a4 = 0.1 + 0.9 * 7.0 - 6.0 + 0.45 * a7
    a3 = 0.1 + 0.9 * 6.0 - 5.0 + 0.45 * a4
    a2 = 0.1 + 0.9 * 5.0 - 4.0 + 0.45 * a3
    for s in (1, 2):
        assert [got[s][i] for i in (2, 3, 4, 7, 8)] == pytest.approx([a2, a3, a4, a7, a8])
        assert [got[s][i] for i in (10, 9, 6, 5, 1, 0)] == pytest.approx([0.0, 0.0, a7, a7, a2, a2])
    arrays = df.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("i", "r", "v", "m"))).alias("h"))
    for r in arrays.select("s", scans.gae(F.col("h.r"), F.col("h.v"), F.col("h.m"), gamma, lam).alias("a")).collect():
        assert r.a == pytest.approx([got[r.s][i] for i in range(11)])


def test_returns_and_suffix_sums_by_hand(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [1, 1, 0, 1])], "r array<double>, m array<int>")
    x = df.select(scans.discounted_returns(F.col("r"), F.col("m"), 0.5).alias("a"), scans.suffix_sums(F.col("r"), F.col("m")).alias("b")).first()
    assert x.a == pytest.approx([2.0, 2.0, 5.0, 4.0])  # 4; 3 + 0.5 * 4; the third's mask ends the return: 2; 1 + 0.5 * 2
    assert x.b == pytest.approx([7.0, 6.0, 4.0, 4.0])


@pytest.mark.parametrize(("one", "other"), [("rloo", "rloo_vectorized"), ("grpo", "grpo_vectorized")])
def test_vectorised_estimators_agree(spark, one, other):
    """On groups of two and more rows the two forms give the same."""
    rng = random.Random(7)
    df = spark.createDataFrame([(i, i % 5 if i >= 10 else i // 2, rng.gauss(0, 1)) for i in range(64)], "i int, g int, s double")
    a = {r.i: r.advantage for r in groups.estimate(one, df, "g", "s").collect()}
    b = {r.i: r.advantage for r in groups.estimate(other, df, "g", "s").collect()}
    assert a == pytest.approx(b, abs=1e-4)


def test_estimators_by_hand(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0)], "i int, g string, s double")
    of = lambda name, **o: {r.i: r.advantage for r in groups.estimate(name, df, "g", "s", **o).collect()}
    assert of("grpo", eps=0.0) == pytest.approx({1: -1 / 2**0.5, 2: 1 / 2**0.5, 3: 5.0})
    assert of("rloo") == pytest.approx({1: -2.0, 2: 2.0, 3: 5.0}) and of("rloo_vectorized")[3] == 0.0
    assert of("gpg") == pytest.approx({1: -1.0, 2: 1.0, 3: 5.0})
    assert of("soft_mean", beta=0.0) == pytest.approx({1: -1.0, 2: 1.0, 3: 0.0})


def test_batches_by_hand(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "pos long, v string")
    assert rows_of(batch.chunk(df, 3), "chunk", "pos") == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
    with pytest.raises(ValueError, match="divide"):
        batch.chunk(df, 4)
    some = df.where("pos < 2")
    assert [v for _, v in rows_of(batch.repeat(some, 2, True), "slot", "v")] == ["v0", "v0", "v1", "v1"]
    assert [v for _, v in rows_of(batch.repeat(some, 2, False), "slot", "v")] == ["v0", "v1", "v0", "v1"]
    assert rows_of(batch.repeat_by(df.where("pos < 4"), F.col("pos")), "v") == [("v1",), ("v2",), ("v2",), ("v3",), ("v3",), ("v3",)]
    padded = batch.pad_to_divisor(df.where("pos < 3"), 7)
    assert rows_of(padded, "pos", "v") == [(0, "v0"), (1, "v1"), (2, "v2"), (3, "v0"), (4, "v1"), (5, "v2"), (6, "v0")]
    assert rows_of(batch.unpad(padded), "v") == [("v0",), ("v1",), ("v2",)]
    assert rows_of(batch.reorder(df, F.lit(5) - F.col("pos")), "slot", "v")[0] == (0, "v5")
    assert rows_of(batch.slice_rows(df, -3, None), "pos") == [(3,), (4,), (5,)]
    with pytest.raises(Exception, match="differs"):
        batch.union_columns(df, df.withColumn("v", F.lit("x")), "pos").collect()
    assert batch.union_columns(df, df.withColumn("w", F.lit(1)), "pos").columns == ["pos", "v", "w"]


def test_columns_unfold_in_order(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], "a"), (2, [5, 6, 7, 8], "b")], "k int, v array<int>, t string")
    assert rows_of(batch.unfold(df, 2, "v"), "k", "part", "v", "t") == [(1, 0, [1, 2], "a"), (1, 1, [3, 4], "a"), (2, 0, [5, 6], "b"), (2, 1, [7, 8], "b")]
    with pytest.raises(Exception, match="divide"):
        batch.unfold(df, 3, "v").collect()


def test_token_bucket_by_hand_and_step_by_step(spark):
    """A bucket of 10 that refills 1 a second; then random requests one at a time."""
    import numpy as np

    assert scans.waiting_times(np.array([0.0, 0.0, 5.0, 100.0]), np.array([8.0, 4.0, 5.0, 11.0]), 1.0, 10.0) == pytest.approx([0.0, 2.0, 2.0, 1.0])
    rng = random.Random(3)
    at, cost, have, now, want = 0.0, [], 4.0, 0.0, []
    times = []
    for _ in range(500):
        at += rng.expovariate(1.0)
        c = rng.uniform(0, 3)
        have = min(4.0, have + (at - now) * 1.3) - c
        now = at
        times.append(at)
        cost.append(c)
        want.append(max(0.0, -have / 1.3))
    assert scans.waiting_times(np.array(times), np.array(cost), 1.3, 4.0) == pytest.approx(want, abs=1e-9)
    df = spark.createDataFrame([([(0.0, 8.0), (0.0, 4.0)],), ([],), (None,)], "a array<struct<at: double, cost: double>>")
    assert [r[0] for r in df.select(scans.token_bucket(F.col("a"), 1.0, 10.0)).collect()] == [[0.0, 2.0], [], None]


def test_positions_beside_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(i % 7, i, "r", 5) for i in range(60)], "k long, __row long, __range string, __move int").repartition(4)
    x = batch.with_position(df, "k", "__row")
    assert x.columns == [*df.columns, "pos"] and rows_of(x, "pos", "__row") == [(p, i) for p, i in enumerate(i for _, i in sorted((i % 7, i) for i in range(60)))]
    assert x.where("__range <> 'r' or __move <> 5").count() == 0
