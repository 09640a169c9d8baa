"""Operators for whole tables and long sequences against brute force, whatever the ranges."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scans
from sparkloom.operators import metrics, sampling
from sparkloom.operators import recurrences as R


@pytest.fixture
def apart(spark):
    """Small partitions stay apart and small sides are shuffled, as large ones would be."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def brute_gae(reward, value, mask, gamma, lam):
    out, nv, g = [], 0.0, 0.0
    for r, v, m in zip(reversed(reward), reversed(value), reversed(mask), strict=True):
        if m:
            g, nv = r + gamma * nv - v + gamma * lam * g, v
        out.append(g)
    return out[::-1]


def brute_returns(reward, mask, gamma):
    out, c = [], 0.0
    for r, m in zip(reversed(reward), reversed(mask), strict=True):
        c = r + gamma * c
        out.append(c)
        c *= m
    return out[::-1]


def test_scans_of_rows_and_arrays(spark):
    """Sequences of 1 to 3000 rows over several ranges, null keys and masked rows; arrays give the same."""
    rng = random.Random(4)
    rows, want = [], {}
    for s, n in enumerate([1, 2, 3000, 5, 1, 700, 40, 1500]):
        key = None if s == 3 else s
        reward, value, mask = [rng.gauss(0, 1) for _ in range(n)], [rng.gauss(0, 1) for _ in range(n)], [int(rng.random() < 0.7) for _ in range(n)]
        rows += [(key, i, reward[i], value[i], mask[i]) for i in range(n)]
        sums = np.cumsum([r * m for r, m in zip(reward, mask, strict=True)][::-1])[::-1].tolist()
        for i, x in enumerate(zip(brute_gae(reward, value, mask, 0.99, 0.95), brute_returns(reward, mask, 0.99), sums, strict=True)):
            want[key, i] = x
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s long, i long, reward double, value double, mask int")
    a = R.gae_rows(df, "s", "i", "reward", "value", "mask", 0.99, 0.95)
    b = R.return_rows(a, "s", "i", "reward", "mask", 0.99)
    got = {(x.s, x.i): (x.advantage, x["return"], x.suffix_sum) for x in R.suffix_sum_rows(b, "s", "i", "reward", "mask").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    arrays = df.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("i", "reward", "value", "mask"))).alias("h"))
    arrays = arrays.unionByName(arrays.where("s = 0").select(F.lit(99).cast("long").alias("s"), F.slice("h", 1, 0).alias("h"))).unionByName(arrays.where("s = 0").select(F.lit(98).cast("long").alias("s"), F.when(F.lit(False), F.col("h")).alias("h")))
    f = lambda c: F.col(f"h.{c}")
    made = arrays.select("s", scans.gae(f("reward"), f("value"), f("mask"), 0.99, 0.95).alias("a"), scans.discounted_returns(f("reward"), f("mask"), 0.99).alias("b"), scans.suffix_sums(f("reward"), f("mask")).alias("c")).collect()
    for x in made:
        if x.s == 98:
            assert (x.a, x.b, x.c) == (None, None, None)
        else:
            assert np.array([x.a, x.b, x.c]).T == pytest.approx(np.array([want[x.s, i] for i in range(len(x.a))]).reshape(-1, 3), abs=1e-9)
    assert R.return_rows(df.where("false"), "s", "i", "reward", "mask", 0.99).count() == 0


def test_scan_of_a_million_steps_is_several_tasks(spark, apart):
    """One sequence in all ranges: each hands one row on, and the closed form of a geometric sum holds."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("one").alias("s"), F.col("id").alias("i"), F.lit(1.0).alias("reward"), F.lit(1).alias("mask"))
    x = R.return_rows(df, "s", "i", "reward", "mask", 0.999)
    parts = x.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    assert parts.count() > 1 and parts.agg(F.max("n")).first()[0] < 0.6 * n
    for r in x.where("i in (0, 400000, 999990, 999999)").collect():
        assert r["return"] == pytest.approx((1 - 0.999 ** (n - r.i)) / 0.001, rel=1e-9)


def test_response_mask_is_linear(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([5, 1],), ([1, None, 1],), ([],)], "ids array<int>")
    assert [x[0] for x in df.select(scans.response_mask(F.col("ids"), F.array(F.lit(3), F.lit(5)))).collect()] == [[1, 1, 1, 0, 0], [1, 0], [1, 1, 1], []]


def test_weighted_draws(spark, apart):
    """A row with half of all weight is drawn about half the time, in many groups of the join; others by their weights."""
    rows = [(i, 1000.0 if i == 500 else float(i % 4)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, w double").repartition(7)
    total = sum(w for _, w in rows)
    draws = sampling.weighted_draws(df, ["k"], F.col("w"), n=40_000)
    got = draws.collect()
    assert sorted(r.draw for r in got) == list(range(40_000))
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, sampling.weighted_draws(df.repartition(3), ["k"], F.col("w"), n=40_000).collect()))
    counts = Counter(r.k for r in got)
    assert abs(counts[500] / 40_000 - 1000 / total) < 0.01
    for m in (1, 2, 3):
        share = sum(n for k, n in counts.items() if k % 4 == m and k != 500) / 40_000
        assert abs(share - sum(w for k, w in rows if k % 4 == m and k != 500) / total) < 0.01
    assert sum(n for k, n in counts.items() if k % 4 == 0 and k != 500) <= 2  # no weight is one unit of 1e-8
    tasks = draws.where("k = 500").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
    one = sampling.weighted_draws(df.where("k in (1, 4)").withColumn("w", F.when(F.col("k") == 1, F.lit(None)).otherwise(F.col("w"))), ["k"], F.col("w"))
    assert [r.k for r in one.collect()] == [4, 4]  # null is no weight at all
    assert sampling.weighted_draws(df.where("false"), ["k"], F.col("w")).count() == 0


def test_shuffled_places_are_a_permutation(spark):
    """Places are a bijection, differ by epoch, and go back, so an epoch can go on from any place."""
    for n in (1, 2, 3, 17, 1000, 1024, 1025):
        x = spark.range(n).select("id", sampling.shuffled_place(F.col("id"), n, "a:0").alias("p"), sampling.shuffled_place(F.col("id"), n, "a:1").alias("q"))
        x = x.withColumn("back", sampling.shuffled_place(F.col("p"), n, "a:0", back=True))
        got = x.collect()
        assert sorted(r.p for r in got) == list(range(n)) and sorted(r.q for r in got) == list(range(n)) and all(r.back == r.id for r in got)
        if n >= 1000:
            assert sum(r.p == r.q for r in got) < n / 50 and sum(r.p == r.id for r in got) < n / 50
    whole = {r.p: r.id for r in got}
    rest = spark.range(700, 1025).select("id", sampling.shuffled_place(F.col("id"), 1025, "a:0", back=True).alias("row")).collect()
    assert {r.id: r.row for r in rest} == {p: i for p, i in whole.items() if p >= 700}


def test_bootstrap_mean_against_the_closed_form(spark):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", rng.gauss(10, 3)) for i in range(6000)] + [(7000, "one", 2.5), (7001, "none", None)]
    got = {r.g: r for r in metrics.bootstrap_mean(spark.createDataFrame(rows, "k long, g string, v double"), "g", "k", "v", replicates=64).collect()}
    for g in ("hot", "g0", "g3"):
        v = np.array([x for _, h, x in rows if h == g])
        assert abs(got[g]["mean"] - v.mean()) < 4 * v.std() / math.sqrt(64 * len(v)) + 1e-3
        assert 0.7 < got[g].deviation / (v.std() / math.sqrt(len(v))) < 1.35
    assert got["one"]["mean"] == 2.5 and got["one"].deviation == 0 and "none" not in got


def test_pairwise_accuracy_without_pairs(spark):
    """Ties in both, nulls, groups of one and a group of most rows, against all pairs."""
    from sparkloom.operators import groups

    rng = random.Random(12)
    rows = [("hot" if i % 4 else f"g{i % 7}", i, rng.choice([None, *range(30)]) if i % 3 else rng.random(), rng.choice([0.0, 0.25, 0.5, 1.0, None])) for i in range(600)]
    rows += [("one", 1000, 1.0, 1.0), ("flat", 1001, 1.0, 0.5), ("flat", 1002, 2.0, 0.5), (None, 1003, 1.0, 0.0), (None, 1004, 2.0, 1.0), ("back", 1005, 1.0, 1.0), ("back", 1006, 2.0, 0.0)]
    rows = [(g, i, None if s is None else float(s), a) for g, i, s, a in rows]
    got = {r.g: r.agreement for r in groups.pairwise_accuracy(spark.createDataFrame(rows, "g string, i long, s double, a double"), "g", "i", "s", "a").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = [(s, a) for h, _, s, a in rows if h == g and a is not None]
        pairs = [(x, y) for n, x in enumerate(mine) for y in mine[:n]]
        weight = sum(abs(x[1] - y[1]) for x, y in pairs)
        agree = sum(abs(x[1] - y[1]) for x, y in pairs if x[0] is not None and y[0] is not None and (x[0] - y[0]) * (x[1] - y[1]) > 0)
        if pairs:
            want[g] = agree / weight if weight else 0.5
    assert got == pytest.approx(want, abs=1e-9)


def test_estimators_take_null_and_hot_groups(spark):
    from sparkloom.operators import groups

    rows = [(None if i % 2 else f"g{i % 3}", float(i % 5)) for i in range(40)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, s double")
    for name, extra in (("grpo", {}), ("rloo", {}), ("soft_mean", {}), ("gpg", {})):
        out = groups.estimate(name, df, "g", "s", **extra)
        assert out.columns == ["g", "s", "advantage"] and out.count() == 41 and out.where("advantage is null").count() == 0
    mean = sum(s for g, s in rows if g is None) / 20
    assert {round(r.advantage - r.s, 9) for r in groups.estimate("grpo", df, "g", "s", by_std=False).where("g is null").collect()} == {round(-mean, 9)}


def test_bootstrap_replays_numpy(spark):
    """a15_bootstrap_exact draws what the generator of numpy draws in each group."""
    from sparkloom.plans import metric_queries

    folder = "/root/testdata/sf0.001"
    held: dict = {}
    for r in sorted(spark.read.parquet(f"{folder}/events.parquet").collect(), key=lambda r: r.event_id):
        held.setdefault(r.user_id, []).append(r.value)
    for r in metric_queries.a15_bootstrap_exact(spark, folder).collect():
        rng, v = np.random.RandomState(42), np.array(held[r.user_id])
        best = [max(v[j] for j in rng.choice(len(v), size=4, replace=True)) for _ in range(1000)]
        assert (r["mean"], r["std"]) == (round(float(np.mean(best)), 6), round(float(np.std(best)), 6))


def test_contained_texts_far_inside(spark):
    """Passages beyond the first stretch, over the seam of two, and of short texts; a text of one repeated letter."""
    from sparkloom.operators import matching

    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    stored = [(1, long), (2, "x" * 9000), (3, "short one"), (4, None), (5, "")]
    probes = [(10, long[4080:4140]), (11, long[-50:]), (12, "x" * 40), (13, long[9000:9060] + "!"), (14, "ort"), (15, ""), (16, None), (17, long[:33])]
    a, b = spark.createDataFrame(probes, "p long, t string"), spark.createDataFrame(stored, "s long, u string")
    got = sorted((r.p, r.s) for r in matching.containments(a, "p", "t", b, "s", "u").collect())
    assert got == sorted((p, s) for p, t in probes for s, u in stored if t and u and t in u)


def test_reuse_by_a_grid(spark):
    """The same rows as comparing with all kept before."""
    from sparkloom.operators import retrieval

    rng = random.Random(4)
    rows = [(i % 2, i, rng.choice(["a", "b"]), [rng.uniform(0, 3) for _ in range(3)]) for i in range(300)]
    got = {r.o: r.source for r in retrieval.reuse_earlier(spark.createDataFrame(rows, "g long, o long, d string, s array<double>"), "g", "o", "d", "s", 0.7).collect()}
    held: dict = {}
    for g, o, d, s in rows:
        found = next((q for q, t in held.get((g, d), []) if math.dist(s, t) <= 0.7), None)
        if found is None:
            held.setdefault((g, d), []).append((o, s))
        assert got[o] == (o if found is None else found)


def test_search_without_a_group(spark):
    from sparkloom.operators import matching

    df = spark.createDataFrame([(i, f"The {i}" if i % 3 else "nothing") for i in range(200)], "k long, t string").repartition(6)
    got = {r.k: r.place for r in matching.search(df, "t", "THE", [F.desc("k")]).collect()}
    assert got == {k: i for i, k in enumerate(sorted((k for k in range(200) if k % 3), reverse=True), 1)}


def test_score_at_the_last_of_many_words(spark):
    """The words are counted once a text, not once a word."""
    import time

    from sparkloom.functions import text as X

    n = 20_000
    df = spark.createDataFrame([("word " * n, 3.0), ("one", 4.0), (None, 5.0)], "t string, v double")
    at = time.time()
    got = [r[0] for r in df.select(scans.at_last(X.word_count(F.col("t")), F.col("v"))).collect()]
    assert got == [[0.0] * (n - 1) + [3.0], [4.0], None] and time.time() - at < 20
    assert spark.range(1).select(scans.at_last(F.lit(0), F.lit(1.0))).first()[0] == []
    ids = spark.range(1).select(F.sequence(F.lit(1), F.lit(20_000)).alias("ids"))
    at = time.time()
    mask = ids.select(scans.response_mask(F.col("ids"), F.array(F.lit(19_999)))).first()[0]
    assert mask == [1] * 19_999 + [0] and time.time() - at < 20


def test_bootstrap_draws_once_a_size(spark):
    """Groups of one size share their draws; nulls are null, as of numpy's NaN."""
    import time

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5 + i % 3)]) for i in range(4000)] + [(-1, [1.0, None]), (-2, []), (-3, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>").coalesce(1)
    at = time.time()
    got = {r.k: r.b for r in df.select("k", metrics.bootstrap_best(F.col("v"), 4, 1000, 42, 6).alias("b")).collect()}
    assert time.time() - at < 15 and [tuple(got[-i]) for i in (1, 2, 3)] == [(None, None)] * 3
    for k, v in rows[:5]:
        r = np.random.RandomState(42)
        best = [max(v[j] for j in r.choice(len(v), size=4, replace=True)) for _ in range(1000)]
        assert tuple(got[k]) == (round(float(np.mean(best)), 6), round(float(np.std(best)), 6))


def test_draws_meet_few_rows(spark, apart, monkeypatch):
    """A group of the join has few points, so a point is compared with few rows; sums beyond the machine's whole numbers are the same draws."""
    assert sampling.POINTS <= 16
    df = spark.range(3000).withColumn("w", F.col("id") % 7 + 0.5)
    draws = lambda: sorted(map(tuple, sampling.weighted_draws(df, ["id"], F.col("w"), n=2000).collect()))
    got = draws()
    monkeypatch.setattr(sampling, "_LONG", 1)
    assert draws() == got and len(got) == 2000
    monkeypatch.setattr(sampling, "COARSE", 3)
    assert draws() == got
