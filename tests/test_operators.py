"""Literal cases, round trips and properties of the operators."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import losses, scans, text
from sparkloom.operators import balance, batch, geometry, groups, masked, matching, metrics, retrieval
from sparkloom.sources import files


def test_group_mean_std_of_a_pair_and_a_single(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "g int, s double")
    got = {r.g: (r.mean, r.std, r.n) for r in masked.group_mean_std(df, "g", "s").collect()}
    assert got[0] == (2.0, pytest.approx(2**0.5), 2) and got[1] == (0.0, 1.0, 1)
    assert masked.group_mean_std(df.where("false"), "g", "s").count() == 0


@pytest.mark.parametrize(("mask", "want"), [((1, 0, 0, 1), 2.5), ((1, 0, 1, 0), float("nan"))])
def test_masked_mean_ignores_nan_only_at_mask_0(spark, mask, want):
    df = spark.createDataFrame(list(zip([1.0, 2.0, float("nan"), 4.0], mask, strict=True)), "v double, m int")
    assert df.agg(masked.masked_mean(F.col("v"), F.col("m"))).first()[0] == pytest.approx(want, nan_ok=True)


def test_majority_takes_the_first_seen_of_equals(spark):
    df = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "B", 0.7), (1, 3, "A", 0.6)], "g int, i int, v string, s double")
    assert metrics.majority(df, "g", "v", "i", "s").first().s == 0.9


def test_expected_best_of_two(spark):
    df = spark.createDataFrame([([0.8, 0.9, 0.7, 0.1],)], "v array<double>")
    assert df.select(metrics.best_of_n_expected(F.col("v"), 2)).first()[0] == pytest.approx(0.78125)


def test_gae_by_hand(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0], [0.1, 0.2, 0.3], [1, 1, 1])], "r array<double>, v array<double>, m array<int>")
    assert df.select(scans.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.95)).first()[0] == pytest.approx([0.651567, 0.6685, 0.7])


def test_gae_does_not_depend_on_masked_values(spark):
    mask, rewards = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0], [0, 0, 0.1, 0.1, 0.1, 0, 0, 0.1, 1, 0, 0]
    rng = np.random.default_rng(0)
    values = rng.random((2, len(mask)))
    values[1][np.array(mask) == 1] = values[0][np.array(mask) == 1]
    rows = [([float(x) for x in rewards], v.tolist(), mask) for v in values]
    df = spark.createDataFrame(rows, "r array<double>, v array<double>, m array<int>")
    a, b = (r[0] for r in df.select(scans.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.95)).collect())
    on = [i for i, m in enumerate(mask) if m]
    assert [a[i] for i in on] == [b[i] for i in on]


def test_single_rows_of_the_two_leave_one_out_estimators(spark):
    df = spark.createDataFrame([(1, 5.0)], "g int, s double")
    assert groups.estimate("rloo", df, "g", "s").first().advantage == 5.0
    assert groups.estimate("rloo_vectorized", df, "g", "s").first().advantage == 0.0
    with pytest.raises(KeyError):
        groups.estimate("nothing", df, "g", "s")


def test_chunks_and_round_trips(spark):
    df = spark.range(6).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("v"))
    assert [r.chunk for r in batch.chunk(df, 2).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        batch.chunk(df, 5)
    assert batch.same_rows(batch.unpad(batch.pad_to_divisor(df, 4)), df)
    assert [r.v for r in batch.repeat(df, 2).orderBy("slot").limit(4).collect()] == [1, 1, 2, 2]
    assert [r.v for r in batch.repeat(df, 2, interleave=False).orderBy("slot").limit(4).collect()] == [1, 2, 3, 4]
    assert batch.repeat_by(df, F.col("v") - 6).count() == 0


def test_positions_of_a_key_in_nine_tenths_of_rows(spark):
    """Several ranges share a hot key, and positions are those of a sort."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("t"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(r.pos, r.k, r.t) for r in batch.with_position(rows, "k", "t").select("pos", "k", "t").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((("hot" if i % 10 else str(i)), i) for i in range(20_000))
    assert sorted(got) == [(p, k, t) for p, (k, t) in enumerate(want)]


def test_streams_of_several_triggers(spark, tmp_path):
    """Three triggers over three files: the newest state of each key; a batch that is run again doesn't double."""
    from sparkloom.streaming import queues

    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(k, i * 10 + k) for k in range(i + 1)], "user long, id long").coalesce(1).write.mode("append").parquet(src)
    stream = queues.stream_of(spark, src, maxFilesPerTrigger="1")
    got = {r.user: (r.produced, r.oldest, r.newest) for r in queues.run_available(queues.bounded_queue(stream, "user", "id", 2), "update", "q").collect()}
    ids = {k: sorted(i * 10 + k for i in range(3) if k <= i) for k in range(3)}
    assert got == {k: (len(v), v[-2:][0], v[-1]) for k, v in ids.items()}
    totals = queues.run_available(stream.groupBy("user").agg(F.count("*").alias("n")), "complete", "c")
    assert {(r.user, r.n) for r in totals.collect()} == {(0, 3), (1, 2), (2, 1)}
    assert queues.run_available(stream.select("id"), "append", "a").count() == 6
    out, rows = str(tmp_path / "out"), spark.range(5)
    keep = queues.writer(out)
    for epoch in (0, 1, 1):
        keep(rows, epoch)
    assert spark.read.parquet(out).count() == 10


def test_back_pressure(spark):
    asked = spark.createDataFrame([(1, t) for t in (0, 1, 2, 3)] + [(2, 5)], "k int, t int")
    done = spark.createDataFrame([(1, 10), (1, 4)], "k int, at int")
    got = {(r.k, r.t): r.admitted for r in queues_admitted(asked, done).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 4, (1, 3): 10, (2, 5): 5}
    assert queues_admitted(asked, done.where("false")).where("admitted is null").count() == 2


def queues_admitted(asked, done):
    from sparkloom.streaming import queues

    return queues.admitted(asked, "k", "t", done, "at", 2)


def test_validation_of_many_samples(spark):
    """A prompt of 600 samples has every doubling up to 512 and its own size."""
    df = spark.range(600).select(F.lit("s").alias("src"), F.lit(1).alias("p"), (F.col("id") % 7 / 7.0).alias("v"))
    got = {r.metric: r.value for r in metrics.validation_metrics(df, "src", "p", "v").collect()}
    assert {f"best@{2**i}" for i in range(1, 10)} | {"best@600", "worst@600", "mean@600"} <= set(got) and "best@1024" not in got
    values = np.sort(np.arange(600) % 7 / 7.0)
    i = np.arange(600)
    for n in (2, 256, 600):
        share = ((i + 1) / 600) ** n - (i / 600) ** n
        assert got[f"best@{n}"] == pytest.approx((values * share).sum()) and got[f"worst@{n}"] == pytest.approx((values[::-1] * share).sum())


def test_positions_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(3, 1), (None, 2), (3, 0), (1, 5)], "k int, t int")
    got = [(r.k, r.t) for r in batch.with_position(df, "k", "t").orderBy("pos").collect()]
    assert got == [(None, 2), (1, 5), (3, 0), (3, 1)]
    assert batch.with_position(df.where("false"), "k").count() == 0


def test_horizontal_union_refuses_conflicts(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3)], "k int, v int")
    assert batch.union_columns(a, a, "k").first().v == 2
    with pytest.raises(Exception, match="v differs"):
        batch.union_columns(a, b, "k").collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=40), st.integers(1, 5))
def test_partitioning_is_complete_and_close(sizes, k):
    part = balance.largest_differencing(sizes, k)
    assert len(part) == len(sizes) and set(part) <= set(range(k))
    loads = [sum(s for s, p in zip(sizes, part, strict=True) if p == q) for q in range(k)]
    assert max(loads) - min(loads) <= max(sizes)
    with_equal = sizes * k
    part = balance.largest_differencing(with_equal, k, equal=True)
    assert all(part.count(p) == len(sizes) for p in range(k))


def test_box_pairs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        lo, size = rng.random(3) * 10, rng.random(3) * 2
        rows.append((i % 3, i, *[float(v) for pair in zip(lo, lo + size, strict=True) for v in pair]))
    df = spark.createDataFrame(rows, "s int, k int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    got = {(r.a, r.b) for r in geometry.box_pairs(df, "s", "k").collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and all(min(a[i + 1], b[i + 1]) > max(a[i], b[i]) for i in (2, 4, 6))}
    assert got == want


def test_edits_stop_at_terminate_and_move_only_the_first(spark):
    scenes = spark.createDataFrame([(1, [("a", None, [0.0]), ("a", None, [1.0]), ("b", "u", [2.0])])], "s int, objects array<struct<jid:string,uid:string,pos:array<double>>>")
    rows = [(1, 1, "move", "a", [9.0]), (1, 2, "remove", "u", None), (1, 3, "fly", "a", None), (1, 4, "terminate", None, None), (1, 5, "add", "c", [1.0])]
    edits = spark.createDataFrame(rows, "s int, i int, name string, target string, pos array<double>")
    got = geometry.apply_edits(scenes, edits, "s", "i").first().objects
    assert [(o.jid, o.pos) for o in got] == [("a", [9.0]), ("a", [1.0])]


def test_top_k_ties_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "k long, v array<double>")
    top = retrieval.cosine_top_k(df.where("k = 1"), df, "k", "v", 3).orderBy("rank").collect()
    assert [(r.item, r.score) for r in top] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert retrieval.cosine_top_k(df.where("false"), df, "k", "v", 3).count() == 0


def test_token_bucket_and_kl(spark):
    df = spark.createDataFrame([([(0.0, 8.0), (1.0, 8.0)],)], "a array<struct<at:double,cost:double>>")
    assert df.select(scans.token_bucket(F.col("a"), 1.0, 10.0)).first()[0] == [0.0, 5.0]
    k = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    assert k.select(losses.kl_penalty(F.col("a"), F.col("b"), "k3+")).first()[0] == pytest.approx(np.e - 2)


@pytest.mark.parametrize(("source", "want"), [("", 0.0), ("a", 0.0), ("aaaa", 2 * 6 / 20), ("abcd", 0.0), ("abab", 2 * 3 / 20)])
def test_repetition(source, want):
    import pandas as pd

    assert text.repetition(pd.Series([source]))[0] == pytest.approx(want)


def test_repetition_of_whole_texts_against_sorted_suffixes(spark):
    """Every conversation's text by the definition: sorted suffixes and their common prefixes."""

    def plain(t):
        suffixes = sorted(t[i:] for i in range(len(t)))
        common = sum(len(os.path.commonprefix(p)) for p in zip(suffixes, suffixes[1:], strict=False))
        return 2 * common / (len(t) * (len(t) + 1)) if len(t) > 1 else 0.0

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text", text.repetition_ratio(F.col("text")).alias("x")).collect()
    assert rows and all(r.x == pytest.approx(plain(r.text)) for r in rows)


def test_balance_against_all_splits(spark):
    """Two parts of up to ten sizes: never worse than the greedy split, sums kept, and close to the best of all splits."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 50, rng.integers(2, 11)).tolist()
        best = min(abs(sum(sizes) - 2 * sum(s for i, s in enumerate(sizes) if m >> i & 1)) for m in range(1 << len(sizes)))
        loads = [0, 0]
        for p, s in zip(balance.largest_differencing(sizes, 2), sizes, strict=True):
            loads[p] += s
        assert sum(loads) == sum(sizes) and best <= abs(loads[0] - loads[1]) <= max(sizes)
    parts = balance.largest_differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum(s for q, s in zip(parts, [8, 7, 6, 5, 4], strict=True) if q == p) for p in (0, 1)) == [14, 16]
    docs = spark.createDataFrame([("a", i, s) for i, s in enumerate([8, 7, 6, 5, 4])] + [("b", i, 3) for i in range(7)], "g string, k int, n int")
    got = {(r.g, r.part): r.load for r in balance.balanced_parts(docs, "g", "k", "n", 2).join(docs, ["g", "k"]).groupBy("g", "part").agg(F.sum("n").alias("load")).collect()}
    assert sorted(v for (g, _), v in got.items() if g == "a") == [14, 16] and sorted(v for (g, _), v in got.items() if g == "b") == [9, 12]


def test_batches_restore(spark):
    rows = [("a", i, s) for i, s in enumerate([5, 9, 2, 7, 7, 1, 30])]
    df = spark.createDataFrame(rows, "g string, k int, n long")
    x = balance.prepare_batches(df, "g", "k", "n", 20)
    loads: dict = {}
    for r in x.collect():
        loads[r.part] = loads.get(r.part, 0) + r.n
    assert sorted(loads) == list(range(4)) and sorted(r.slot for r in x.collect()) == list(range(7)) and max(loads.values()) == 30
    dealt = x.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "n"))), lambda v: v["n"]).alias("v"))
    assert sorted((r.g, r.k, r.value) for r in balance.restore_batches(dealt, "g", "v", x, "k").collect()) == rows


def test_edits_of_groups(spark):
    kind = "scene string, groups array<struct<group_name:string,objects:array<struct<desc:string,jid:string,uid:string,size:array<double>,pos:array<double>,rot:array<double>>>>>"
    box = lambda j, u=None: ("d", j, u, [1.0], [2.0], [3.0])
    scenes = spark.createDataFrame([("s", [("a", [box("1"), box("2", "u2")]), ("b", [box("2"), box("3")])]), ("t", [("a", [box("9")])])], kind)
    edits = [("s", 1, "rotate_object", "u2", None, None), ("s", 2, "replace_object", "3", "sofa", None), ("s", 3, "add_object", None, "lamp", "b"), ("s", 4, "add_object", None, "rug", "c"), ("s", 5, "remove_object", "2", None, None), ("s", 6, "scale_object", "1", None, None), ("s", 7, "terminate", None, None, None), ("s", 8, "remove_object", "1", None, None)]
    e = spark.createDataFrame(edits, "scene string, turn int, name string, target string, desc string, group string").withColumn("rot", F.array(F.lit(7.0))).withColumn("size", F.array(F.lit(8.0)))
    got = {r.scene: {g.group_name: [(o.desc, o.jid, list(o.size), list(o.pos), list(o.rot)) for o in g.objects] for g in r.groups} for r in geometry.apply_group_edits(scenes, e, "scene", "turn").collect()}
    assert got["s"] == {"a": [("d", "1", [8.0], [2.0], [3.0])], "b": [("sofa", None, [1.0], [2.0], [3.0]), ("lamp", None, [8.0], [0.0, 0.0, 0.0], [7.0])], "c": [("rug", None, [8.0], [0.0, 0.0, 0.0], [7.0])]}
    assert got["t"] == {"a": [("d", "9", [1.0], [2.0], [3.0])]}


def test_containments_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab "), int(n))) for n in rng.integers(0, 90, 60)]
    texts += [t[5:50] for t in texts[:20]] + ["a", "ab", "", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    other = df.select(F.col("id").alias("o"), F.col("t").alias("u"))
    got = {(r.id, r.o) for r in matching.containments(df, "id", "t", other, "o", "u").collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if a and b and a in b}


def test_matching_in_tiers(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (3, "w")], "k int, v string")
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "k int")
    assert {r.k: r.v for r in matching.fallback_lookup(df, "k", "v", a, b, default=F.lit("-")).collect()} == {1: "x", 2: "z", 3: "w", 4: "-", None: "-"}
    assert {(r.k, r.v, r.tier) for r in matching.first_tier("k", a, b, order="v").collect()} == {(1, "x", 1), (2, None, 1), (3, "w", 2)}
    assert sorted(str(r.k) for r in matching.skip_existing(df, a, "k").collect()) == ["3", "4", "None"] and matching.keep_existing(df, df.where("k is null"), "k").count() == 1
    left, right = spark.createDataFrame([(1, 2), (3, 3)], "p int, q int"), spark.createDataFrame([(1,), (2,), (3,)], "s int")
    assert sorted((r.p, r.s) for r in matching.either_key(left, right, ("p", "s"), ("q", "s")).collect()) == [(1, 1), (1, 2), (3, 3)]
    assert [r.v for r in matching.first_by_key(b.unionByName(b.withColumn("v", F.lit("a"))), "v", "k").orderBy("k").collect()] == ["a"] * 3


def test_ragged_and_equal_sizes(spark):
    df = spark.createDataFrame([("g", 1, [1, 2], [5]), ("g", 0, None, [6]), ("h", 0, [], [])], "g string, i int, a array<int>, b array<int>")
    got = {r.g: (r.a, r.a_offsets, r.b, r.b_offsets) for r in batch.ragged(df, "g", "i", "a", "b").collect()}
    assert got == {"g": ([1, 2], [0, 0, 2], [6, 5], [0, 1, 2]), "h": ([], [0, 0], [], [0, 0])}
    with pytest.raises(Exception, match="sizes differ: a: 2, b: 1"):
        batch.equal_sizes(df.where("i = 1"), "a", "b").collect()
    with pytest.raises(Exception, match="doesn't divide"):
        batch.unfold(df.where("i = 1"), 2, "b").collect()


def test_top_k_in_blocks_and_with_ties(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(300, 3)), 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit @ unit.T, 9)
    want = {(i, j, p) for i in range(0, 300, 7) for p, j in enumerate(np.lexsort((np.arange(300), -scores[i]))[:4], 1)}
    for size in (1 << 26, 300):
        got = retrieval.cosine_top_k(df.where("id % 7 = 0"), df, "id", "v", 4, block_bytes=size)
        assert {(r.query, r.item, r["rank"]) for r in got.collect()} == want


def test_curriculum(spark):
    items = spark.createDataFrame([(i,) for i in range(5)], "k int")
    results = spark.createDataFrame([(0, 0.0), (1, 1.0), (1, 0.5), (3, 1.0)], "k int, s double")
    got = [r.k for r in balance.curriculum_order(items, results, "k", "s", "1").orderBy("place").collect()]
    assert got[:3] == [3, 1, 0] and sorted(got[3:]) == [2, 4]


def test_points_outside_a_room(spark):
    triangle = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (4.0, 0.0), (0.0, 4.0))])
    df = spark.range(1)
    share = lambda x, y: df.select(geometry.outside_share([F.lit(x), F.lit(0.0), F.lit(0.0)], [F.lit(x + 1.0), F.lit(y), F.lit(1.0)], triangle, F.lit(2.0))).first()[0]
    assert share(0.0, 2.0) == 0.0 and share(0.0, 4.0) == 0.5 and share(5.0, 1.0) == 1.0 and 0.1 < share(2.5, 1.0) < 0.2  # an eighth



def test_points_outside_rooms_of_many_kinds(spark):
    """Against a polygon test of each point by itself; many rows in little time; nulls are outside."""
    import time

    rng = np.random.default_rng(3)
    kinds = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (0, 4)], [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], []]
    rows = [(i, *np.round(rng.uniform(-1, 4, 3), 2).tolist(), *np.round(rng.uniform(0, 3, 3), 2).tolist(), [[float(a), float(b)] for a, b in kinds[i % 4]]) for i in range(40)]
    rows += [(40, None, 0.0, 0.0, 1.0, 1.0, 1.0, rows[0][-1]), (41, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, None), (42, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, [[0.0, 0.0], None, [0.0, 4.0]])]
    df = spark.createDataFrame(rows, "i long, x double, y double, z double, a double, b double, c double, room array<array<double>>")
    c = F.col
    share = geometry.outside_share([c("x"), c("y"), c("z")], [c("x") + c("a"), c("y") + c("b"), c("z") + c("c")], c("room"), F.lit(2.0))
    got = {r.i: r.s for r in df.select("i", share.alias("s")).collect()}

    def inside(x: float, z: float, p: list) -> bool:
        return sum((a[1] > z) != (b[1] > z) and x < (b[0] - a[0]) * (z - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:] + p[:1], strict=True)) % 2 == 1

    for i, x, y, z, a, b, d, room in rows[:40]:
        at = lambda low, side, k: low + (low + side - low) * (k + 0.5) / 8
        flat = sum(inside(at(x, a, j), at(z, d, k), room) for j in range(8) for k in range(8))
        assert got[i] == 1 - flat * sum(-0.001 <= at(y, b, k) <= 2.001 for k in range(8)) / 512
    assert [got[i] for i in (40, 41, 42)] == [1.0] * 3
    begun = time.time()
    spark.range(100_000).select(geometry.outside_share([c("id") % 4 * 1.0, F.lit(0.0), F.lit(0.0)], [c("id") % 4 + 1.5, F.lit(1.0), F.lit(1.0)], F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in kinds[0]]), F.lit(1.0)).alias("s")).agg(F.sum("s")).collect()
    assert time.time() - begun < 30


def test_surface_points_tell_what_is_out_of_bounds(spark):
    """Boxes flush with walls and ceiling are inside, a millimetre is slack, one in a hundred points is tolerated; volume times share."""
    room = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))])  # an L

    def several(n, mesh, floor=room, **kw):
        found = geometry.out_of_bounds(mesh, floor, F.lit(1.0), F.lit(3.0), F.col("id"), **kw)
        return [tuple(r.o) for r in spark.range(0, n, 1, 1).select(found.alias("o")).collect()]

    def judged(mesh, floor=room, **kw):
        return several(1, mesh, floor, **kw)[0]

    def box(lo, hi):
        return geometry.box_mesh([F.lit(float(v)) for v in lo], [F.lit(float(v)) for v in hi])

    tetrahedron = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in t]) for t in (((0, 1, 0), (1, 1, 0), (0, 1, 1)), ((0, 1, 0), (0, 2, 0), (1, 1, 0)), ((0, 1, 0), (0, 1, 1), (0, 2, 0)), ((1, 1, 0), (0, 2, 0), (0, 1, 1)))])
    assert judged(box((0, 1, 0), (4, 3, 2))) == judged(box((3.0005, 1, 0), (4.0005, 3.0005, 2.0005))) == judged(box((2, 0.9995, 1.9995), (3, 1, 2))) == (0.0, False, 0.0)
    share, outside, volume = judged(box((3.002, 1, 0), (4.002, 2, 1)))  # one of six faces
    assert 0.11 < share < 0.23 and outside and abs(volume - share) < 1e-9
    share, outside, volume = judged(box((1, 1, 1), (3, 2, 3)), points=20_000)  # a quarter lies in the notch: 2 of top and bottom, 2 of the sides
    assert abs(share - 0.25) < 0.02 and outside and abs(volume - 4 * share) < 1e-9
    share, _, volume = judged(box((0, 2, 0), (1, 4, 1)), points=20_000)  # half above the ceiling: 1 of the top, 4 of the sides, of 10
    assert abs(share - 0.5) < 0.02 and abs(volume - 2 * share) < 1e-9
    assert abs(judged(box((0, 0, 0), (2, 2, 2)), points=20_000)[0] - 0.5) < 0.02  # half below the floor
    flat = F.array(F.array(*[F.array(*[F.lit(v) for v in p]) for p in ((3.95, 1.5, 0.0), (3.95, 1.5, 2.0), (4.0523, 1.5, 1.0))]))
    few = several(6, flat, points=2000)  # the tip beyond 4.001 is about a quarter
    assert all(0.2 < s < 0.31 and o and v == 0 for s, o, v in few)  # a triangle has no volume, nor has its bounding box
    tip = F.array(F.array(*[F.array(*[F.lit(v) for v in p]) for p in ((2.0, 1.5, 0.0), (2.0, 1.5, 2.0), (4.12, 1.5, 1.0))]))
    seen = several(40, tip)  # 0.3 in a hundred: found, and tolerated
    assert any(s > 0 for s, _, _ in seen) and all(o == (s > 0.01) for s, o, _ in seen) and sum(o for _, o, _ in seen) < 8
    assert several(3, F.array_repeat(tip[0], 12_000), points=20)[2][1:] == several(3, F.array_repeat(tip[0], 1), points=20)[2][1:] == (False, 0.0)  # large meshes
    assert judged(tetrahedron)[:2] == (0.0, False)
    away = F.transform(tetrahedron, lambda t: F.transform(t, lambda p: F.array(p[0] + 9, p[1], p[2])))
    assert np.allclose(judged(away)[2], 1 / 6) and np.allclose(judged(F.transform(away, F.reverse))[2], 1)  # inside out: the bounding box
    assert judged(F.slice(tetrahedron, 1, 0)) == judged(F.lit(None)) == judged(tetrahedron, F.lit(None)) == (None, None, None)
    assert judged(box((0, 1, 0), (1, 2, 1)), F.slice(room, 1, 2)) == (None, True, 0.1) and judged(tetrahedron, F.array(room[0], room[2])) == (None, False, 0.0)
    assert judged(F.array(F.array(F.array(F.lit(0.0))))) == judged(geometry.box_mesh([F.lit(0.0), F.lit(None), F.lit(0.0)], [F.lit(1.0)] * 3)) == (1.0, True, None)


def test_surface_points_of_many_meshes(spark):
    """Against each point by itself, for meshes and rooms of several kinds in one batch, in any order of rows."""
    import hashlib

    rng = np.random.default_rng(5)
    rooms = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (0, 4)], [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 4)]]
    rows = [(f"k{i}", np.round(rng.uniform(-1, 4.5, (1 + i % 4, 3, 3)), 3).tolist(), [[float(a), float(b)] for a, b in rooms[i % 3]], 0.0, 2.0 + i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "k string, mesh array<array<array<double>>>, room array<array<double>>, low double, high double")
    found = geometry.out_of_bounds(F.col("mesh"), F.col("room"), F.col("low"), F.col("high"), F.col("k"), points=60)
    got = {r.k: r.o.share for r in df.repartition(3).select("k", found.alias("o")).collect()}

    def numbers(seed: int):
        while True:
            seed = (seed + 0x9E3779B97F4A7C15) % 2**64
            z = seed
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ z >> shift) * factor % 2**64
            yield ((z ^ z >> 31) >> 11) / 2**53

    def near(x, z, a, b):
        length = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = min(1, max(0, ((x - a[0]) * (b[0] - a[0]) + (z - a[1]) * (b[1] - a[1])) / length)) if length else 0
        return ((x - a[0] - t * (b[0] - a[0])) ** 2 + (z - a[1] - t * (b[1] - a[1])) ** 2) ** 0.5 < 0.001

    for k, mesh, room, low, high in rows:
        draw, inside = numbers(int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:16], 16)), 0
        areas = [np.linalg.norm(np.cross(np.subtract(b, a), np.subtract(c, a))) for a, b, c in mesh]
        sides = list(zip(room, room[1:] + room[:1], strict=True))
        for _ in range(60):
            pick, u, v = next(draw) * sum(areas), next(draw), next(draw)
            a, b, c = mesh[next(i for i in range(len(areas)) if sum(areas[: i + 1]) >= pick or i + 1 == len(areas))]
            u, v = (1 - u, 1 - v) if u + v > 1 else (u, v)
            x, y, z = (a[i] + u * (b[i] - a[i]) + v * (c[i] - a[i]) for i in range(3))
            odd = sum((p[1] > z) != (q[1] > z) and x < (q[0] - p[0]) * (z - p[1]) / (q[1] - p[1]) + p[0] for p, q in sides) % 2
            inside += bool(odd or any(near(x, z, p, q) for p, q in sides)) and low - 0.001 <= y <= high + 0.001
        assert got[k] == 1 - inside / 60


def test_outside_query_judges_by_surface(spark):
    """A box that only its first tenth keeps inside: 1.3 of its surface's 10, not 0.05 of its volume, lie in the room."""
    from sparkloom import registry

    rows = registry.queries()["n53_outside"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_size"), "p_partkey").collect()
    far = [r.share for r in rows if r.p_size == 39]
    assert len(far) > 10 and abs(sum(far) / len(far) - 0.87) < 0.01
    assert all(r.outside and abs(r.volume - 2 * r.share) < 1e-6 for r in rows)


def test_faulty_json_is_a_row(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"desc": "x"}\n{broken\n')
    rows = files.read_documents(spark, str(tmp_path), files.OBJECT).collect()
    assert sorted((r.desc or "", bool(r["_corrupt_record"])) for r in rows) == [("", True), ("x", False)]
