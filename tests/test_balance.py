"""Balancing: cases by hand, groups over the ends of batches, and a table of batches against one at a time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import balance
from sparkloom.plans import scene_queries


def test_parts_by_hand():
    part = balance.largest_differencing([5, 5, 10], 2)
    assert part[0] == part[1] != part[2]
    part = balance.largest_differencing([4, 5, 6, 7, 8], 2)
    loads = sorted(sum(s for s, p in zip([4, 5, 6, 7, 8], part, strict=True) if p == i) for i in range(2))
    assert loads == [14, 16]  # differences 8-7, 6-5, then 4-1, 3-1
    part = balance.largest_differencing([1, 2, 3, 4, 5, 6], 3, equal=True)
    assert sorted(sum(s for s, p in zip(range(1, 7), part, strict=True) if p == i) for i in range(3)) == [7, 7, 7] and all(part.count(i) == 2 for i in range(3))
    with pytest.raises(ValueError, match="divide"):
        balance.largest_differencing([1, 2, 3], 2, equal=True)
    assert balance.largest_differencing([], 3) == [] and sorted(balance.largest_differencing([7, 7, 7], 3)) == [0, 1, 2]
    assert balance.lightest_first([5, 1, 1, 1, 1, 1], 2) == [0, 1, 1, 1, 1, 1]


def test_groups_over_the_ends_of_batches(spark):
    """Arrow batches of seven rows: groups are cut at their own ends, in the order of their keys."""
    rows = [(f"g{i % 11}" if i % 11 else None, i, (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(5)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = {(r.g, r.k): r.part for r in balance.balanced_parts(df, "g", "k", "n", 3).collect()}
        micro = {(r.g, r.k): (r.part, r.of) for r in balance.micro_batches(df, "g", "k", "n", 400).collect()}
    finally:
        spark.conf.set(key, before)
    for g in {r[0] for r in rows}:
        mine = sorted((k, n) for h, k, n in rows if h == g)
        want = balance.largest_differencing([n for _, n in mine], 3)
        assert [got[g, k] for k, _ in mine] == want
        of = max(1, -(-sum(n for _, n in mine) // 400))
        assert {micro[g, k][1] for k, _ in mine} == {of} and {micro[g, k][0] for k, _ in mine} == set(range(of))
    assert len(got) == len(micro) == 300 and balance.balanced_parts(df.where("false"), "g", "k", "n", 3).count() == 0


def test_balance_over_the_table(spark):
    """d01_balance: every batch's loads are those of the method on its documents alone."""
    folder = "/root/testdata/sf0.001"
    held: dict = {}
    for r in sorted(scene_queries._batches(spark, folder).collect(), key=lambda r: r.doc_id):
        held.setdefault(r.batch, []).append(r.n_chars)
    got: dict = {}
    for r in scene_queries.d01_balance(spark, folder).collect():
        got.setdefault(r.batch, []).append((r.part, r.chars, r.docs))
    for b, sizes in held.items():
        part = balance.largest_differencing(sizes, 4)
        assert sorted(got[b]) == sorted((p, sum(s for s, q in zip(sizes, part, strict=True) if p == q), part.count(p)) for p in set(part))
    assert got.keys() == held.keys()


@pytest.mark.parametrize(
    ("given", "wanted", "score"),
    [("the cat", "the cat", 1.0), ("abcd", "abcd", 1.0), ("xyz", "abc", 0.0), ("", "abc", 0.0), ("abcde", "abcdx", (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25), ("abcd", "abcdefgh", 2.718281828459045 ** (1 - 8 / 4)), ("aaaa", "a", 0.0)],
)
def test_bleu_by_hand(given, wanted, score):
    assert text.bleu_score(given, wanted) == pytest.approx(score, abs=1e-9)


def test_bleu_of_columns(spark):
    df = spark.createDataFrame([("abcd", "abcd"), (None, "a"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(text.bleu(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]
