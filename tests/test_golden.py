"""Values written by hand from the definitions, not from another engine: answers, partitions, batches, edits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x = 12", "12"), ("a = b = 7 dollars", "7"), ("1,234,567", "1234567"), ("1,234.5", "1,234.5"), ("an apple", "apple"), (r"The answer is $\frac12$", r"\frac{1}{2}"), (r"\text{yes}", "yes"),
        (r"\textbf{(C)} 3", "(C)3"), (r"\overline{AB}", "AB"), (r"\boxed{\boxed{5}}", r"\boxed{5}"), (r"\sqrt3", r"\sqrt{3}"), (r"\frac{3}{4}", r"\frac{3}{4}"), (r"90^\circ", "90"), (r"5\text{ cm}", "5"), (r"10\%", r"10\%"), (r"\$5.50", "5.50"),
        (r"3\mbox{ km}", "3"), ("12 degrees", "12"), ("7{,}000", "7000"), (r"\frac123", r"\frac{1}{2}3"),
    ],
)
def test_final_answer(spark, text, want):
    assert column(spark, X.final_answer, [text]) == [want]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"\frac12", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\dfrac{1}{2}", r"\frac{1}{2}"), (r"\tfrac 1 2", r"\frac{1}{2}"), (r"\sqrt3", r"\sqrt{3}"), ("3/4", r"\frac{3}{4}"), ("-3/4", r"\frac{-3}{4}"), ("03/4", "03/4"), ("0.5", r"\frac{1}{2}"),
        (".5", r"\frac{1}{2}"), ("x=5", "5"), ("abc=5", "abc=5"), (r"5\text{ cm}", "5"), (r"50\%", "50"), (r"\left(1, 2\right)", "(1,2)"), (r"90^\circ", "90"), (r"\$7", "7"), ("", ""), (r"\frac1", r"\frac1"), (r"{.25", "{0.25"), ("1 .5", "10.5"), ("a\nb", "ab"),
    ],
)
def test_strip_latex(spark, text, want):
    assert column(spark, X.strip_latex, [text]) == [want]


def test_normalized_math(spark):
    assert column(spark, X.normalized_math, [r" \text{ even } ", r"\text{a} b", None, "  x = 2 ", "xyz = 2"]) == ["even", r"\text{a}b", None, "2", "xyz=2"]


def test_answer_in_prose(spark):
    texts = ["So the answer is 42.", "ANSWER: 7", "3 apples is the answer", r"Hence \boxed{\frac{1}{2}} and done", "we get 5. The end", "the answer is none", "12", r"x \fbox{9}", "It is 4. Thus y = 10"]
    got = column(spark, X.answer_in_prose, texts)
    assert [(g.matched, g.answer) for g in got] == [(True, "42."), (True, "7"), (True, "3 apples"), (True, r"\frac{1}{2}"), (True, "5"), (False, "none"), (False, "12"), (True, "9"), (True, "4")]


def test_last_boxed(spark):
    assert column(spark, X.last_boxed, [r"\boxed{a{b}c} x \boxed{1}", r"\boxed{a", "none", None, r"\boxed{}", r"\boxed{{x}} tail } }"]) == ["1", None, None, None, "", "{x}"]


@pytest.mark.parametrize(("a", "b", "want"), [("1/2", r"\frac{1}{2}", True), ("0.5", r"\frac12", True), ("3", "3.0", True), ("(1, 2)", "(1,2)", True), ("(1, 2)", "(2,1)", False), ("x", "y", False), ("1,000", "1000", False)])
def test_graded(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.graded(F.col("a"), F.col("b"))).first()[0] is want


def test_batches_sources_and_feedback(spark):
    df = spark.createDataFrame([(["#### 5", "none"], ["5", "6"], "b", [("user", "q"), ("assistant", "#### 5")]), (["#### 1", "#### 6"], ["5", "6"], "a", [("user", "q")])], "s array<string>, g array<string>, src string, m array<struct<role:string,content:string>>")
    assert [r[0] for r in df.select(X.score_batch(F.col("s"), F.col("g"), X.number_score)).collect()] == [[1.0, 0.0], [0.0, 1.0]]
    assert [r[0] for r in df.select(X.score_by_source(F.col("src"), {("a", "c"): F.lit(1.0), ("b",): F.lit(2.0)})).collect()] == [2.0, 1.0]
    with pytest.raises(Exception, match="no scorer for b"):
        df.select(X.score_by_source(F.col("src"), {("a",): F.lit(1.0)})).collect()
    got = [r[0] for r in df.select(X.answer_feedback(F.col("m"), F.lit("5"))).collect()]
    assert (got[0].done, got[0].reward) == (True, 1.0) and got[0].response.endswith("correct!") and (got[1].done, got[1].reward) == (False, 0.0)
