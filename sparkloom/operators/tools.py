"""Tools as table functions: one instance a partition of a table argument, with a life from its first row to the end."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

MEASURES = {"words": lambda text: len(text.split()), "chars": len}


@udtf
class ToolSession:
    """tool_session(TABLE, key, order, text, measure): a tool that a conversation creates with its first row, calls with each and releases at its end.

    analyze asks for one instance a key, rows in order, and makes the schema from the arguments: the key and the order as
    they are, the call's number, its measure and the total so far. The release is a last row without an order, with the
    number of calls and the total. A null text measures 0; null keys are one conversation.
    """

    def __init__(self) -> None:
        self.made: tuple | None = None
        self.calls = self.total = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, text: AnalyzeArgument, measure: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if measure.value not in MEASURES:
            raise ValueError(f"measure is one of {', '.join(MEASURES)}")
        missing = [c.value for c in (key, order, text) if c.value not in rows.dataType.fieldNames()]
        if missing:
            raise ValueError(f"the table has no column {', '.join(map(str, missing))}")
        fields = [rows.dataType[c.value] for c in (key, order)]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("call", T.LongType()), T.StructField(measure.value, T.LongType()), T.StructField("total", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

    def eval(self, row: Row, key: str, order: str, text: str, measure: str) -> Iterator[tuple]:
        if self.made is None:
            self.made = (row[key],)
        n = MEASURES[measure](row[text] or "")
        self.calls, self.total = self.calls + 1, self.total + n
        yield row[key], row[order], self.calls, n, self.total

    def terminate(self) -> Iterator[tuple]:
        if self.made is not None:
            yield self.made[0], None, self.calls, None, self.total


def tool_sessions(df: DataFrame, key: str, order: str, text: str, measure: str = "words") -> DataFrame:
    """(key, order, call, measure, total): see ToolSession."""
    return ToolSession(df.asTable(), F.lit(key), F.lit(order), F.lit(text), F.lit(measure))


def register(spark: SparkSession) -> None:
    """tool_session for SQL."""
    spark.udtf.register("tool_session", ToolSession)
