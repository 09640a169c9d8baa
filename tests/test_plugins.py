"""The append log as a source, tools as table functions, and equality of expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import algebra
from sparkloom.operators import tools
from sparkloom.session import scratch
from sparkloom.sources import log
from sparkloom.streaming import queues as Q

SCHEMA = "k long, v string"


def test_log_reads_whole_commits(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *k: spark.createDataFrame([(i, f"v{i}") for i in k], SCHEMA)
    log.append(rows(1, 2, 3).repartition(3), path)
    assert sorted(r.k for r in log.read(spark, path).collect()) == [1, 2, 3]
    log.append(rows(3, 4), path)
    (tmp_path / "log" / "data" / "left-over.parquet").write_bytes(b"of a task that failed")
    assert sorted(r.k for r in log.read(spark, path).collect()) == [1, 2, 3, 3, 4] and log.commits(path) == [1, 2]
    log.append(rows().where("false"), path)
    assert log.read(spark, path).count() == 5 and log.read(spark, path).schema.simpleString() == "struct<k:bigint,v:string>"
    with pytest.raises(Exception, match="appended"):
        rows(9).write.format(log.NAME).option("path", path).mode("overwrite").save()


def test_a_taken_number_is_not_overwritten(tmp_path):
    w = log.LogWriter(str(tmp_path), log.T.StructType([log.T.StructField("k", log.T.LongType())]))
    (tmp_path / "data").mkdir()
    for i in range(3):
        w.commit([log.Written([f"p{i}.parquet"])])
    (tmp_path / "000000000005.json").write_text("[]")
    w.commit([log.Written(["p9.parquet"]), None])
    assert log.commits(str(tmp_path)) == [1, 2, 3, 5, 6] and log.parts(str(tmp_path), 6) == [f"{tmp_path}/data/p9.parquet"]


def test_log_stream_goes_on_from_its_offset(spark, tmp_path):
    """Rows appended between triggers arrive once, also after a restart, and nothing new is nothing."""
    path, state, out = str(tmp_path / "log"), str(tmp_path / "state"), scratch(spark, "out")

    def trigger():
        return sorted(r.k for r in Q.run_available(log.read_stream(spark, path, SCHEMA), "append", "log", state, out=out).collect())

    log.append(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), path)
    assert trigger() == [1, 2]
    assert trigger() == [1, 2]
    log.append(spark.createDataFrame([(2, "c")], SCHEMA), path)
    log.append(spark.createDataFrame([(3, "d")], SCHEMA), path)
    assert trigger() == [1, 2, 2, 3]


def test_tools_live_with_their_partition(spark):
    rows = [(c, t, None if t == 2 else "a b " * (c or 7)) for c in (1, 2, 3, None) for t in (3, 1, 2)]
    df = spark.createDataFrame(rows, "c long, t long, text string").repartition(5)
    got = sorted(map(tuple, tools.tool_sessions(df, "c", "t", "text").collect()), key=str)
    want = []
    for c in (1, 2, 3, None):
        n = 2 * (c or 7)
        want += [(c, 1, 1, n, n), (c, 2, 2, 0, n), (c, 3, 3, n, 2 * n), (c, None, 3, None, 2 * n)]
    assert got == sorted(want, key=str)
    assert tools.tool_sessions(df, "c", "t", "text", "chars").columns == ["c", "t", "call", "chars", "total"]
    assert tools.tool_sessions(df.where("false"), "c", "t", "text").count() == 0
    with pytest.raises(Exception, match="measure is one of"):
        tools.tool_sessions(df, "c", "t", "text", "lines").collect()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("(x+1)^2", "x^2+2x+1", True), (r"\frac{2}{4}", "0.5", True), (r"\frac12", ".5", True), ("x^2-1", "(x-1)(x+1)", True), ("x^2+1", "(x-1)(x+1)", False),
        (r"\frac{x^2-1}{x-1}", "x + 1", True), ("2(a+b)", "2a+2b", True), ("ab", "b a", True), ("1,000", "10^3", True), ("x = 5", "5", True), ("-x^2", "(-x)^2", False),
        (r"\sqrt{8}", r"2\sqrt{2}", True), (r"\sqrt{\frac{4}{9}}", "2/3", True), (r"\sqrt{2}", "1.414", False), (r"2\pi r", r"r \cdot 2 \pi", True), (r"\sin(x)^2", r"\sin(x)\sin(x)", True),
        ("2^{-3}", r"\frac{1}{8}", True), ("3-2-1", "0", True), ("12/3/2", "2", True), ("x^{y}", "y^{x}", False), (r"\left(x+y\right)^3", "x^3+3x^2y+3xy^2+y^3", True), ("2^3^2", "512", True),
        ("1/0", "1", None), ("x +", "x", None), ("(x", "x", None), ("", "1", None), (None, "1", None), ("5 apples & pears", "5", None), ("1 2", "12", None),
    ],
)
def test_equal_expressions(a, b, want):
    assert algebra.same_expression(a, b) is want and algebra.same_expression(b, a) is want


def test_long_expressions_are_linear():
    n = 20_000
    assert algebra.same_expression("+".join(["x"] * n), f"{n}x") is True
    assert algebra.same_expression("(" * 5000 + "x" + ")" * 5000, "x") is None and algebra.same_expression("(x+1)^9999", "(1+x)^9999") is True


def test_expressions_of_columns(spark):
    df = spark.createDataFrame([("2x", "x+x"), ("2x", "x"), (None, "x"), ("@", "x")], "a string, b string")
    assert [r[0] for r in df.select(algebra.expressions_equal(F.col("a"), F.col("b"))).collect()] == [True, False, None, None]


def test_any_of_several_answers(spark):
    df = spark.createDataFrame([("x+1", ["2", "1 + x"]), ("one", ["one", None]), ("one", ["1"]), (None, ["1"]), ("1", None), ("1", [])], "a string, g array<string>")
    assert [r[0] for r in df.select(algebra.any_equal(F.col("a"), F.col("g"))).collect()] == [True, True, False, None, None, False]


def test_a_text_is_read_once(monkeypatch):
    """One reading gives the values at all points, and a text that comes again none."""
    made = []

    class Counted(algebra.Reader):
        def __init__(self, *args):
            made.append(args)
            super().__init__(*args)

    monkeypatch.setattr(algebra, "Reader", Counted)
    assert algebra.same_expression("(x + 7719)^2/3", r"\frac{1}{3}(x + 7719)(7719 + x)") is True and len(made) == 2
    assert algebra.same_expression("(x + 7719)^2/3", r"\frac{1}{3}(x + 7719)(7719 + x)") is True and len(made) == 2
    assert len(set(algebra.values("x"))) == len(algebra.PLACES) and algebra.values("1/2305843009213693951") is None
