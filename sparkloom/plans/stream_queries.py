"""Streaming operators over events: each runs the stream over what is there and returns its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import queues as Q
from .common import r


def _events(s, d):
    return Q.stream_of(s, f"{d}/events.parquet")


def m01_bounded_queue(s, d):
    return Q.run_available(Q.bounded_queue(_events(s, d), "user_id", "event_id", 20), "update", "queue")


def m03_statistics(s, d):
    """What a queue of 40 a type has taken in, dropped and still holds."""
    x = Q.run_available(Q.bounded_queue(_events(s, d), "event_type", "event_id", 40), "update", "statistics")
    return x.select("event_type", "produced", "dropped", (F.col("produced") - F.col("dropped")).alias("size"), "oldest", "newest")


def m05_batches(s, d):
    x = Q.count_windows(_events(s, d), "event_id", 64, F.count("*").alias("n"), F.min("event_id").alias("first"))
    return Q.run_available(x, "complete", "batches").where("n = 64")


def m07_capacity(s, d):
    """What a queue of each event type would have to hold, by its users."""
    x = _events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.max("user_id").alias("top"))
    return Q.run_available(x, "complete", "capacity").select("event_type", Q.queue_capacity(F.col("top"), 4, 0.5).alias("capacity"), "n")


def m08_stale(s, d):
    """Samples behind the current version: one is taken in every 1000 events, and the newest is now."""
    now = s.read.parquet(f"{d}/events.parquet").agg(F.floor(F.max("event_id") / 1000).alias("v")).first()["v"]
    behind = F.lit(now) - F.floor(F.col("event_id") / 1000)
    x = _events(s, d).groupBy("user_id").agg(F.sum((behind >= 1).cast("int")).alias("stale"), F.count("*").alias("n"))
    return Q.run_available(x, "complete", "stale")


def m10_metric_windows(s, d):
    x = Q.count_windows(_events(s, d), "event_id", 100, F.avg("value").alias("mean"), F.max("value").alias("max"), F.sum("value").alias("sum"))
    return Q.run_available(x, "complete", "windows").select("window", r("mean", 4).alias("mean"), r("max", 4).alias("max"), r("sum", 2).alias("sum"))


def m13_state_machine(s, d):
    def step(state: str, event: str) -> str:
        if state == "TERMINATED":
            return state
        return {"click": "GENERATING", "view": "TOOLS", "purchase": "TERMINATED"}.get(event, "PENDING")

    return Q.run_available(Q.state_machine(_events(s, d), "user_id", "event_id", "event_type", "PENDING", step), "update", "machine")


def m15_append(s, d):
    x = _events(s, d).where("value > 90").select("event_id", r("value", 4).alias("value"))
    return Q.run_available(x, "append", "append")


def m16_resume(s, d):
    """The second run over the same checkpoint finds nothing new."""
    state = scratch(s, "resume")
    x = lambda: _events(s, d).select("event_id")
    first = Q.run_available(x(), "append", "first", state).agg(F.count("*").alias("n")).withColumn("run", F.lit(1))
    again = Q.run_available(x(), "append", "again", state).agg(F.count("*").alias("n")).withColumn("run", F.lit(2))
    return first.unionByName(again)


def m17_kept_groups(s, d):
    x = _events(s, d).groupBy("user_id").agg(F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    return Q.run_available(x, "complete", "groups").where("sd > 0 or n = 1").select("user_id", "n")


def m19_termination(s, d):
    x = _events(s, d).select("event_id", F.when(F.col("value") > 95, "length").when(F.col("user_id") % 7 == 0, "assistant_turns").when(F.col("user_id") % 5 == 0, "user_turns").when(F.col("event_type") == "click", "tools").otherwise("stop").alias("reason"))
    return Q.run_available(x, "append", "termination")


QUERIES = {
    "m01_bounded_queue": (m01_bounded_queue, "select user_id, count(*) as produced, greatest(count(*) - 20, 0) as dropped, list_min(list_reverse_sort(list(event_id))[1:20]) as oldest, max(event_id) as newest from events group by 1"),
    "m03_statistics": (m03_statistics, "select event_type, count(*) as produced, greatest(count(*) - 40, 0) as dropped, least(count(*), 40) as size, list_min(list_reverse_sort(list(event_id))[1:40]) as oldest, max(event_id) as newest from events group by 1"),
    "m05_batches": (m05_batches, "select event_id // 64 as window, count(*) as n, min(event_id) as first from events group by 1 having count(*) = 64"),
    "m07_capacity": (m07_capacity, "select event_type, cast(ceil(max(user_id) * 4 * 1.5) as bigint) as capacity, count(*) as n from events group by 1"),
    "m08_stale": (m08_stale, "select user_id, count(case when (select max(event_id) // 1000 from events) - event_id // 1000 >= 1 then 1 end) as stale, count(*) as n from events group by 1"),
    "m10_metric_windows": (m10_metric_windows, "select event_id // 100 as window, round(avg(value), 4) as mean, round(max(value), 4) as max, round(sum(value), 2) as sum from events group by 1"),
    "m13_state_machine": (m13_state_machine, "select user_id, case when count(case when event_type = 'purchase' then 1 end) > 0 then 'TERMINATED' else case arg_max(event_type, event_id) when 'click' then 'GENERATING' when 'view' then 'TOOLS' else 'PENDING' end end as state, count(*) as steps from events group by 1"),
    "m15_append": (m15_append, "select event_id, round(value, 4) as value from events where value > 90"),
    "m16_resume": (m16_resume, "select 1 as run, count(*) as n from events union all select 2, 0"),
    "m17_kept_groups": (m17_kept_groups, "select user_id, count(*) as n from events group by 1 having stddev_pop(value) > 0 or count(*) = 1"),
    "m19_termination": (m19_termination, "select event_id, case when value > 95 then 'length' when user_id % 7 = 0 then 'assistant_turns' when user_id % 5 = 0 then 'user_turns' when event_type = 'click' then 'tools' else 'stop' end as reason from events"),
}
