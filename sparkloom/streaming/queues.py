"""Streams by processing order and integer versions: bounded queues, counters, count windows and state machines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch


def stream_of(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over a Parquet file or folder with the schema it has. As a pattern, the path may name a single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, mode: str, name: str, state: str | None = None, keys: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    """Run a stream over what is there and give its result: the last state for complete and update, all rows for append.

    Results go to the shared folder, a folder an epoch, so a batch that is run again replaces its own rows. For complete
    the newest epoch counts, for update the newest row of each key (`keys`; the first column if none are given). `state` is
    the checkpoint to go on from and `out` the results' folder (new ones if None).
    """
    spark = stream.sparkSession
    out, checkpoint = out or scratch(spark, f"{name}-out"), state or scratch(spark, f"{name}-state")
    schema = stream.schema
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(writer(out)).start().awaitTermination()
    try:
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("__epoch", T.LongType())])).parquet(out)
    except AnalysisException as e:  # nothing arrived, so nothing was written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if mode == "append":
        return rows.drop("__epoch")
    if mode == "complete":
        newest = rows.agg(F.max("__epoch")).first()[0]
        return rows.where(F.col("__epoch").eqNullSafe(F.lit(newest))).drop("__epoch")
    by = list(keys) or [schema.fieldNames()[0]]
    row = F.struct(*[F.col(c) for c in schema.fieldNames()])
    last = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]).agg(F.max_by(row, "__epoch").alias("__r"))
    return last.select("__r.*")


def writer(out: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each epoch's rows to a folder of its own, replacing what a failed try left."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/__epoch={epoch}")

    return keep


def admitted(requests: DataFrame, key: str, order: str, finished: DataFrame, at: str, limit: int) -> DataFrame:
    """Staleness back-pressure: (key, order, admitted) for each request of a producer that may run at most `limit` ahead.

    A request is the n-th of its key by order; it is admitted when fewer than `limit` of those before it are still
    unfinished, so its start is the later of its own order and the moment the (n - limit)-th result (finished, by `at`) is
    there; null if that never comes. Both sides are numbered within their key, and joined by key and number.
    """
    asked = requests.select(key, order).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    done = finished.select(key, at).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(at)) + limit).withColumnRenamed(at, "__free")
    start = F.when(F.col("n") <= limit, F.col(order)).when(F.col("__free").isNotNull(), F.greatest(order, "__free"))
    return asked.join(done, [key, "n"], "left").select(key, order, start.alias("admitted"))


def bounded_queue(stream: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """(key, produced, dropped, oldest, newest): a FIFO a key that drops its oldest when full.

    State is at most `capacity` orders and two counters a key. Rows of a trigger are taken by `order`.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        produced, dropped, held = state.get if state.exists else (0, 0, [])
        held = list(held)
        for o in sorted(v for b in batches for v in b[order]):
            produced += 1
            held.append(int(o))
            if len(held) > capacity:
                held.pop(0)
                dropped += 1
        state.update((produced, dropped, held))
        yield pd.DataFrame({key: [k[0]], "produced": [produced], "dropped": [dropped], "oldest": [held[0]], "newest": [held[-1]]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, order).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, produced long, dropped long, oldest long, newest long", "produced long, dropped long, held array<long>", "update", GroupStateTimeout.NoTimeout)


def state_machine(stream: DataFrame, key: str, order: str, event: str, first: str, step: Callable[[str, str], str]) -> DataFrame:
    """(key, state, steps): step(state, event) applied to each key's events by order; state is a name and a counter."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (first, 0)
        for _, e in sorted((o, e) for b in batches for o, e in zip(b[order], b[event], strict=True)):
            now, n = step(now, e), n + 1
        state.update((now, n))
        yield pd.DataFrame({key: [k[0]], "state": [now], "steps": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, order, event).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, state string, steps long", "state string, n long", "update", GroupStateTimeout.NoTimeout)


def count_windows(stream: DataFrame, sequence: str, size: int, *aggregates) -> DataFrame:
    """Aggregates of every `size` consecutive numbers of a sequence that starts at 0."""
    return stream.groupBy(F.floor(F.col(sequence) / size).cast("long").alias("window")).agg(*aggregates)


def queue_capacity(workers: Column, batch: int, ahead: float) -> Column:
    """Samples that a queue holds at most: each worker's batches, and as many more as they may run ahead."""
    return F.ceil(workers * batch * (1 + ahead)).cast("long")
