"""An append log as a Spark data source: batch and streaming reader with offsets, and a writer whose commits are whole.

A log is a folder on storage that all machines mount: parts in `data/` and one numbered manifest a commit that lists its
parts. A manifest appears under its number at once or not at all, so readers see whole commits, and a stream's offset is
the number of the last commit that it has read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

NAME = "append_log"


def commits(path: str, after: int = 0, to: int | None = None) -> list[int]:
    """Numbers of the log's commits after one and up to another."""
    try:
        found = sorted(int(f[:-5]) for f in os.listdir(path) if f.endswith(".json"))
    except FileNotFoundError:
        return []
    return [n for n in found if n > after and (to is None or n <= to)]


def parts(path: str, number: int) -> list[str]:
    with open(f"{path}/{number:012d}.json") as f:
        return [f"{path}/data/{name}" for name in json.load(f)]


@dataclass
class Part(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _read(part: Part, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in pq.ParquetFile(part.path).iter_batches(columns=schema.names):
        yield pa.RecordBatch.from_arrays([batch.column(n).cast(schema.field(n).type) for n in schema.names], schema=schema)


class LogReader(DataSourceReader):
    """All commits that are there when the query is planned; a part is a task."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, to_arrow_schema(schema)

    def partitions(self) -> list[Part]:
        return [Part(p) for n in commits(self.path) for p in parts(self.path, n)] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema) if partition.path else iter(())


class LogStream(DataSourceStreamReader):
    """Commits after the offset that the checkpoint holds, each once."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, to_arrow_schema(schema)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commit": max(commits(self.path), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(p) for n in commits(self.path, start["commit"], end["commit"]) for p in parts(self.path, n)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema)


class LogWriter(DataSourceArrowWriter):
    """Each task writes parts under names of their own; the commit lists those of the tasks that ended well."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(f"{self.path}/data", exist_ok=True)
        writer, name = None, f"{uuid.uuid4().hex}.parquet"
        for batch in iterator:
            if batch.num_rows:
                writer = writer or pq.ParquetWriter(f"{self.path}/data/{name}", batch.schema)
                writer.write_batch(batch)
        if writer:
            writer.close()
        return Written([name] if writer else [])

    def commit(self, messages: list[Written]) -> None:
        names = [n for m in messages if m for n in m.names]
        os.makedirs(self.path, exist_ok=True)
        made = f"{self.path}/{uuid.uuid4().hex}.tmp"
        with open(made, "w") as f:
            json.dump(names, f)
        number = max(commits(self.path), default=0) + 1
        while True:  # a number that another writer has taken meanwhile is never overwritten
            try:
                os.link(made, f"{self.path}/{number:012d}.json")
                break
            except FileExistsError:
                number += 1
        os.unlink(made)

    def abort(self, messages: list[Written]) -> None:
        for name in [n for m in messages if m for n in m.names]:
            if os.path.exists(f"{self.path}/data/{name}"):
                os.unlink(f"{self.path}/data/{name}")


class AppendLog(DataSource):
    """Options: path. Without a schema the first part's is taken; a log without parts needs one."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        for n in commits(self.options["path"]):
            for p in parts(self.options["path"], n):
                return from_arrow_schema(pq.read_schema(p))
        raise ValueError("the log is empty; give a schema")

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> LogStream:  # noqa: N802
        return LogStream(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log can only be appended to")
        return LogWriter(self.options["path"], schema)


def append(df: DataFrame, path: str) -> None:
    """One commit with the rows of df."""
    df.sparkSession.dataSource.register(AppendLog)
    df.write.format(NAME).option("path", path).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(AppendLog)
    return spark.read.format(NAME).option("path", path).load()


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    spark.dataSource.register(AppendLog)
    return spark.readStream.format(NAME).schema(schema).option("path", path).load()
