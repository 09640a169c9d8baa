"""Queues with consumers and controls over several triggers, a replayed batch and a timer."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from sparkloom.session import scratch
from sparkloom.streaming import queues as Q
from sparkloom.streaming import stateful

SCHEMA = "k long, i long, kind string, at timestamp"


def add(spark, folder, rows):
    spark.createDataFrame([(*r, None)[:3] + (r[3] if len(r) > 3 else None,) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, state, out):
    with stateful.list_state(spark):
        stream = stateful.consumed_queue(spark.readStream.schema(SCHEMA).parquet(folder), "k", "i", F.col("kind"))
        return {r.k: (r.taken, r.left, r.closed) for r in Q.run_available(stream, "update", "q", state, out=out).collect()}


def test_queue_over_three_triggers_and_a_replay(spark, tmp_path):
    folder, state, out = str(tmp_path / "in"), str(tmp_path / "state"), scratch(spark, "out")
    add(spark, folder, [(1, 2, "put"), (1, 1, "put"), (1, 3, "take"), (2, 1, "take"), (2, 2, "take"), (3, 1, None)])
    assert run(spark, folder, state, out) == {1: (1, 1, False), 2: (0, 0, False), 3: (0, 0, False)}
    before = str(tmp_path / "kept")
    shutil.copytree(state, before)
    add(spark, folder, [(2, 3, "put"), (1, 5, "clear"), (1, 4, "put"), (1, 6, "put"), (3, 2, "put"), (3, 3, "close")])
    want = {1: (1, 1, False), 2: (1, 0, False), 3: (0, 1, True)}
    assert run(spark, folder, state, out) == want
    assert run(spark, folder, before, out) == want  # the second batch again, from the state before it
    add(spark, folder, [(3, 4, "take"), (3, 5, "take"), (2, 4, "close"), (2, 5, "put"), (2, 6, "take")])
    # 2: one take waited for its second put, which closing let go; what comes after is put and taken
    assert run(spark, folder, before, out) == {1: (1, 1, False), 2: (2, 0, True), 3: (1, 0, True)}


def test_idle_queue_is_closed_by_a_timer(spark, tmp_path):
    folder = str(tmp_path / "in")
    stamp = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    state, out = str(tmp_path / "state"), scratch(spark, "out")

    def go():
        with stateful.list_state(spark):
            rows = spark.readStream.schema(SCHEMA).parquet(folder).withWatermark("at", "1 second")
            return {r.k: (r.taken, r.left, r.closed) for r in Q.run_available(stateful.consumed_queue(rows, "k", "i", F.col("kind"), idle=10_000, time="at"), "update", "q", state, out=out).collect()}

    for batch in ([(1, 1, "put", 0), (2, 1, "put", 0)], [(2, 2, "put", 8)], [(3, 1, "put", 30)], [(3, 2, "put", 31)]):
        rows = spark.createDataFrame([(k, i, kind) for k, i, kind, _ in batch], "k long, i long, kind string").withColumn("at", stamp(batch[0][3]))
        rows.coalesce(1).write.mode("append").parquet(folder)
        got = go()
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 2, False)}
