"""Readers and sinks: Parquet lists, text prompts, JSON documents with faults counted, JSON lines by step, nested schemas made flat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Objects of a scene, and a scene of either form.
OBJECT = T.StructType.fromJson(
    {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (
        ("desc", "string"), ("jid", "string"), ("uid", "string"),
        *((n, {"type": "array", "elementType": "double", "containsNull": True}) for n in ("size", "pos", "rot")),
    )]}
)


def read_parquet(spark: SparkSession, paths: list[str], max_rows: int | None = None, key: str | None = None, seed: str | None = None) -> DataFrame:
    """The files' rows; with max_rows that many of them, by the hash of seed and key or else by the key."""
    df = spark.read.parquet(*paths)
    if max_rows is None:
        return df
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))) if seed is not None else F.col(key)
    return df.orderBy(order, key).limit(max_rows)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt) stripped lines that aren't empty."""
    return spark.read.text(path).select(F.trim("value").alias("prompt")).where("prompt <> ''")


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents with their file name; `_corrupt_record` holds what can't be parsed, so faults are rows, not errors."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.withColumn("file", F.col("_metadata.file_name"))


def write_steps(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines, a folder a step."""
    df.write.partitionBy(step).mode("append").json(path)


def flat_columns(schema: T.StructType, separator: str = "/", prefix: str = "") -> list[Column]:
    """Columns that make a nested schema flat, named by their path."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            out += flat_columns(f.dataType, separator, path)
        else:
            out.append(F.col(path).alias(path.replace(".", separator)))
    return out


def positional_split(df: DataFrame, position: str, ratio: float) -> tuple[DataFrame, DataFrame]:
    """The first floor(rows * ratio) rows by position, and the rest."""
    n = int(df.count() * ratio)
    return df.where(F.col(position) < n), df.where(F.col(position) >= n)


def override(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, other's values win unless null."""
    columns = [c for c in base.columns if c != key]
    o = other.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(o, key, "full").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in which a broken line is a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def append_log(df: DataFrame, path: str, step: str, steps: list[int]) -> None:
    """JSON lines, one append a step, in this order."""
    for i in steps:
        df.where(F.col(step) == i).write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write df unless there is something at the path already, which then stays."""
    df.write.mode("ignore").parquet(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """df written to the path and read from it."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fan_out(df: DataFrame, **paths: str) -> dict[str, DataFrame]:
    """The same rows written in several formats (format=path), each read back."""
    out = {}
    for kind, path in paths.items():
        df.write.format(kind).save(path)
        out[kind] = df.sparkSession.read.schema(df.schema).format(kind).load(path)
    return out


def joined_turns(df: DataFrame, group: str, order: str, text: str, separator: str = "|") -> DataFrame:
    """(group, responses, n): a group's texts in order, joined, and how many they are."""
    held = F.sort_array(F.collect_list(F.struct(order, text)))
    return df.groupBy(group).agg(held.alias("__h")).select(group, F.array_join(F.transform("__h", lambda x: x[text]), separator).alias("responses"), F.size("__h").alias("n"))


def class_from_folder(spark: SparkSession, path: str, column: str, name: str = "class") -> DataFrame:
    """Parquet files by folder, with what their folder says of a column as text."""
    return spark.read.parquet(path).withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), rf"{column}=([^/]+)/", 1))
