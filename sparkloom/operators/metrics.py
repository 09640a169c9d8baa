"""Metric aggregation: rules by name, best / worst / majority of n, validation roll-ups and summaries."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reduce_kind(name: Column) -> Column:
    """max if the name contains it, else min if it contains that (so minibatch is a min), else mean."""
    return F.when(name.contains("max"), "max").when(name.contains("min"), "min").otherwise("mean")


def aggregation_kind(name: Column, last: tuple[str, ...] = (), weighted: tuple[str, ...] = ()) -> Column:
    """How a metric is aggregated: explicit lists first, then what its name contains, in this order; else avg."""
    has = lambda *words: reduce(lambda a, b: a | b, [name.contains(w) for w in words])
    return (
        F.when(name.isin(*last) if last else F.lit(False), "last")
        .when(name.isin(*weighted) if weighted else F.lit(False), "weighted_avg")
        .when(name.startswith("timing_s/"), "sum")
        .when(has("mean", "avg"), "avg")
        .when(has("max"), "max")
        .when(has("min"), "min")
        .when(has("sum", "total"), "sum")
        .otherwise("avg")
    )


def aggregate_by_kind(df: DataFrame, kind: Column, value: str, order: str, weight: str, *by: str) -> DataFrame:
    """(by..., kind, value): each group of a long metric table by its kind, in one aggregation."""
    k = df.withColumn("kind", kind)
    aggs = k.groupBy(*by, "kind").agg(
        F.max_by(value, order).alias("last"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.max(value).alias("max"),
        F.min(value).alias("min"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_avg"),
    )
    picked = F.coalesce(*[F.when(F.col("kind") == n, F.col(n)) for n in ("last", "sum", "avg", "max", "min", "weighted_avg")], F.col("avg"))
    return aggs.select(*by, "kind", picked.alias("value"))


def reduce_by_name(df: DataFrame, name: str, value: str, *by: str) -> DataFrame:
    """(by..., name, value): mean, or max or min where the name says so."""
    aggs = df.groupBy(*by, name).agg(F.max(value).alias("mx"), F.min(value).alias("mn"), F.avg(value).alias("av"))
    kind = reduce_kind(F.col(name))
    return aggs.select(*by, name, F.when(kind == "max", F.col("mx")).when(kind == "min", F.col("mn")).otherwise(F.col("av")).alias("value"))


def majority(df: DataFrame, group: str, vote: str, order: str, value: str) -> DataFrame:
    """(group, vote, value): the most frequent vote, the first seen among equals, with its first value."""
    votes = df.groupBy(group, vote).agg(F.count("*").alias("__n"), F.min(F.struct(order, value)).alias("__f"))
    w = Window.partitionBy(group).orderBy(F.desc("__n"), F.col(f"__f.{order}"))
    return votes.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(group, vote, F.col(f"__f.{value}").alias(value))


def best_of_n_expected(values: Column, n: int, worst: bool = False) -> Column:
    """Expectation of the best (or worst) of n draws with replacement from an array: what a bootstrap estimates."""
    ordered = F.sort_array(values, asc=not worst)
    size = F.size(values).cast("double")
    terms = F.transform(ordered, lambda x, i: x * (F.pow((i + 1) / size, F.lit(n)) - F.pow(i / size, F.lit(n))))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def best_of_n_deviation(values: Column, n: int, worst: bool = False) -> Column:
    """Population deviation of the best (or worst) of n draws with replacement, from its second moment."""
    square = F.transform(F.sort_array(values, asc=not worst), lambda x, i: x * x * (F.pow((i + 1) / F.size(values).cast("double"), F.lit(n)) - F.pow(i / F.size(values).cast("double"), F.lit(n))))
    mean = best_of_n_expected(values, n, worst)
    return F.sqrt(F.greatest(F.aggregate(square, F.lit(0.0), lambda a, x: a + x) - mean * mean, F.lit(0.0)))


@lru_cache(256)
def _draws(size: int, n: int, times: int, seed: int) -> np.ndarray:
    """The places that `times` calls of choice for n of `size` draw: they depend on the size alone, and one call draws the same."""
    return np.random.RandomState(seed).choice(size, size=(times, n), replace=True)


def bootstrap_best(values: Column, n: int, times: int, seed: int, digits: int) -> Column:
    """struct<mean, std>: mean and population deviation of the best of n draws with replacement from an array, over so many
    resamples by numpy's generator, rounded; null for no values and where a null or NaN is drawn."""

    def run(v: pa.Array) -> pa.Array:
        sizes, flat = np.asarray(v.value_lengths().fill_null(0)), v.flatten().to_numpy(zero_copy_only=False)
        out = np.full((len(v), 2), np.nan)
        for i, (end, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
            if size:
                best = flat[end - size : end][_draws(size, n, times, seed)].max(axis=1)
                out[i] = round(float(np.mean(best)), digits), round(float(np.std(best)), digits)
        return pa.StructArray.from_arrays([pa.array(c, from_pandas=True) for c in out.T], names=["mean", "std"])

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "mean double, std double")(values)


def validation_metrics(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """(source, metric, value, prompts): mean@N, std@N, and expected best@n and worst@n for n = 2, 4, ... < N and N, by
    prompt, then averaged over the prompts that have the metric (N is part of its name).

    A prompt's values are sorted once; each best@n (worst@n) is one fold over them, for as many n as its N asks.
    """
    g = df.groupBy(source, prompt).agg(F.sort_array(F.collect_list(value)).alias("__v"), F.count(value).alias("__n"), F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    N = F.col("__n")
    doublings = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.greatest(N, F.lit(2)))), F.lit(1)).cast("int")), lambda i: F.pow(F.lit(2.0), i).cast("long")), lambda n: n < N)
    sizes = F.when(N > 1, F.concat(doublings, F.array(N))).otherwise(F.array().cast("array<long>"))
    at = lambda i, n: F.pow(i / N.cast("double"), n)
    best = lambda n: F.aggregate(F.transform("__v", lambda x, i: x * (at(i + 1, n) - at(i, n))), F.lit(0.0), lambda a, x: a + x)
    worst = lambda n: F.aggregate(F.transform("__v", lambda x, i: x * (at(N - i, n) - at(N - i - 1, n))), F.lit(0.0), lambda a, x: a + x)
    row = lambda name, n, v: F.struct(F.concat(F.lit(f"{name}@"), n.cast("string")).alias("metric"), v.cast("double").alias("value"))
    rows = F.concat(F.array(row("mean", N, F.col("__m")), row("std", N, F.col("__s"))), F.transform(sizes, lambda n: row("best", n, best(n))), F.transform(sizes, lambda n: row("worst", n, worst(n))))
    long = g.where(N > 0).select(source, F.explode(rows).alias("__x"))
    return long.groupBy(source, F.col("__x.metric").alias("metric")).agg(F.avg("__x.value").alias("value"), F.count("*").alias("prompts"))


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """(metric, n, mean, std, min, max) of the columns, without nulls, NaN and infinities; std is of the population."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) as (metric, value)")
    finite = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return finite.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def explained_variance(returns: str, values: str) -> Column:
    return 1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)


def flops(tokens: Column, squares: Column, parameters: float, layers: int, width: int) -> Column:
    """Six per parameter and token, and twelve per layer, width and squared length."""
    return 6.0 * parameters * tokens + 12.0 * layers * width * squares


def role_lengths(df: DataFrame, group: str, role: str, length: Column, prompt: str = "user") -> DataFrame:
    """(group, prompt, response): lengths added up by whether the role is the prompt's."""
    mine = F.col(role) == prompt
    return df.groupBy(group).agg(F.sum(F.when(mine, length).otherwise(0)).alias("prompt"), F.sum(F.when(~mine, length).otherwise(0)).alias("response"))


def spread_and_idle(df: DataFrame, group: str, value: str, workers: int) -> DataFrame:
    """(group, spread, throughput, idle) of times: largest less smallest, rows by worker time, smallest over largest."""
    x = df.groupBy(group).agg(F.max(value).alias("a"), F.min(value).alias("b"), F.sum(value).alias("t"), F.count("*").alias("n"))
    return x.select(group, (F.col("a") - F.col("b")).alias("spread"), (F.col("n") / (F.col("t") * workers + 1)).alias("throughput"), (F.col("b") / (F.col("a") + 1)).alias("idle"))


def timing(df: DataFrame, stage: str, seconds: str, tokens: str, workers: int, generated: tuple[str, ...] = ()) -> DataFrame:
    """(stage, ms_per_token, throughput): stages named in `generated` count rows as their tokens, others all tokens."""
    x = df.groupBy(stage).agg(F.sum(seconds).alias("t"), F.count("*").alias("n"), F.sum(tokens).alias("k"))
    mine = F.when(F.col(stage).isin(*generated), F.col("n")).otherwise(F.col("k")) if generated else F.col("k")
    return x.select(stage, (F.col("t") * 1000 / mine).alias("ms_per_token"), (F.col("k") / (F.col("t") * workers)).alias("throughput"), F.col("k").alias("tokens"))


def validation_name(source: Column, metric: Column, n: Column, core: Column) -> Column:
    """val-core or val-aux, source and metric with its number of samples, by slashes."""
    return F.concat_ws("/", F.when(core, "val-core").otherwise("val-aux"), source, F.concat(metric, n.cast("string")))


def mean_of_means(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """(source, score, n): the mean over prompts of the mean over their samples."""
    return df.groupBy(source, prompt).agg(F.avg(value).alias("m")).groupBy(source).agg(F.avg("m").alias("score"), F.count("*").alias("n"))


def moments(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., mean, max, min, std): std is of a sample."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))


def percentiles(df: DataFrame, group: str, value: str, *ranks: float, accuracy: int = 10_000, exact: bool = True) -> DataFrame:
    """(group, avg, p50, ...): interpolated percentiles, or within 1 / accuracy of the ranks where groups are too large to sort."""
    of = (lambda q: F.percentile(value, q)) if exact else (lambda q: F.percentile_approx(value, q, accuracy))
    return df.groupBy(group).agg(F.avg(value).alias("avg"), *[of(q).alias(f"p{round(q * 100)}") for q in ranks])


def slowest(df: DataFrame, group: str, value: str, key: str, *columns: str) -> DataFrame:
    """(group, key, columns..., top): the row of the largest value of each group, equal ones by the largest key."""
    x = df.groupBy(group).agg(F.max_by(F.struct(key, *columns), F.struct(value, key)).alias("m"), F.max(value).alias("top"))
    return x.select(group, F.col(f"m.{key}").alias(key), *[F.col(f"m.{c}").alias(c) for c in columns], "top")


def unbalance(df: DataFrame, part: str, size: str) -> DataFrame:
    """(least, most, spread) of the parts' total sizes."""
    x = df.groupBy(part).agg(F.sum(size).alias("t"))
    return x.agg(F.min("t").alias("least"), F.max("t").alias("most"), (F.max("t") - F.min("t")).alias("spread"))


def extents(df: DataFrame, group: str, value: Column, low: float, high: float) -> DataFrame:
    """(group, extent, n, in_range): largest less smallest value, rows, and those within [low, high]."""
    return df.groupBy(group).agg((F.max(value) - F.min(value)).alias("extent"), F.count("*").alias("n"), F.sum(F.when(value.between(low, high), 1).otherwise(0)).alias("in_range"))


def preference_metrics(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """(chosen, rejected, margin, accuracy): mean scores, their mean difference and how often the chosen one is higher."""
    return df.agg(F.avg(chosen).alias("chosen"), F.avg(rejected).alias("rejected"), F.avg(F.col(chosen) - F.col(rejected)).alias("margin"), F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("accuracy"))


def weighted_rewards(df: DataFrame, group: str, kind: str, value: str, weights: dict[str, float], other: float) -> DataFrame:
    """(group, reward): the mean of each kind, weighted, cut to [-1, 1] and added up."""
    weight = F.lit(other)
    for k, w in weights.items():
        weight = F.when(F.col(kind) == k, w).otherwise(weight)
    per = df.groupBy(group, kind).agg((F.sum(F.col(value) * weight) / F.count("*")).alias("x"))
    return per.groupBy(group).agg(F.sum(F.least(F.greatest("x", F.lit(-1.0)), F.lit(1.0))).alias("reward"))


def worst_named(df: DataFrame, group: str, value: str, key: str, n: int = 3) -> DataFrame:
    """(group, text): the keys of each group's n largest values by commas, and how many more there are."""
    w = Window.partitionBy(group)
    x = df.withColumn("__rn", F.row_number().over(w.orderBy(F.desc(value), key))).withColumn("__n", F.count("*").over(w)).where(F.col("__rn") <= n)
    named = x.groupBy(group, "__n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__rn", key))), lambda y: y[key].cast("string")), ", ").alias("t"))
    more = F.when(F.col("__n") > n, F.concat(F.lit(" and "), (F.col("__n") - n).cast("string"), F.lit(" more"))).otherwise("")
    return named.select(group, F.concat("t", more).alias("text"))


def lines_of(df: DataFrame, group: str, line: Column) -> DataFrame:
    """(group, text): a line a row, sorted."""
    return df.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))


def loss_report(df: DataFrame, oob: str, collision: str, limit: float) -> DataFrame:
    """(oob, oob_std, col, valid): mean losses in thousandths and the share of scenes whose losses add up to the limit at most."""
    total = F.round(F.col(oob) + F.col(collision), 9)
    return df.agg((F.avg(oob) * 1000).alias("oob"), (F.stddev_pop(oob) * 1000).alias("oob_std"), (F.avg(collision) * 1000).alias("col"), F.avg((total <= limit).cast("double")).alias("valid"))


def probability_gap(df: DataFrame, by: str, log_p: str, other: str) -> DataFrame:
    """(by, max, mean, std, pearson) of two policies' token probabilities: their distance and correlation."""
    x = df.withColumn("__p", F.exp(log_p)).withColumn("__q", F.exp(other)).withColumn("__d", F.abs(F.col("__p") - F.col("__q")))
    return x.groupBy(by).agg(F.max("__d").alias("max"), F.avg("__d").alias("mean"), F.stddev_samp("__d").alias("std"), F.corr("__p", "__q").alias("pearson"))


def top_covariance(df: DataFrame, group: str, a: str, b: str, share: float, *ties: str) -> DataFrame:
    """The share (at least one) of each group's rows with the largest covariance of a and b (at nine digits), as `cov`."""
    w = Window.partitionBy(group)
    cov = F.round((F.col(a) - F.avg(a).over(w)) * (F.col(b) - F.avg(b).over(w)), 9)
    x = df.withColumn("cov", cov).withColumn("__rn", F.row_number().over(w.orderBy(F.desc("cov"), *ties))).withColumn("__n", F.count("*").over(w))
    return x.where(F.col("__rn") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share))).drop("__rn", "__n")


def non_improvement(df: DataFrame, key: str, order: str, value: str, penalty: float) -> DataFrame:
    """df with `penalty` where the value is no larger than the one before it, else 0."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("penalty", F.when(before.isNotNull() & (F.col(value) <= before), penalty).otherwise(0.0))


#: Least 16-bit numbers at which a Poisson variable of mean 1 is at least 1, 2, ...: 65536 times its distribution function.
POISSON = tuple(int(65536 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(8))


def bootstrap_mean(df: DataFrame, group: str, key: str, value: str, replicates: int = 32, seed: str = "boot") -> DataFrame:
    """(group, mean, deviation): mean and population deviation of the group's mean over resamples of its rows.

    In each replicate a row counts as often as a Poisson variable of mean 1 says, which the md5 of seed, block and the
    row's key gives. All replicates are sums that tasks add up before anything moves, so a hot group is many tasks. Null
    values are left out; a replicate without rows is none.
    """
    blocks = -(-replicates // 8)
    drawn = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("__v"), *[F.md5(F.concat(F.lit(f"{seed}:{b}:"), F.col(key).cast("string"))).alias(f"__h{b}") for b in range(blocks)])
    digit = lambda i: F.conv(F.substring(f"__h{i // 8}", i % 8 * 4 + 1, 4), 16, 10).cast("int")
    counted = drawn.select(group, "__v", *[digit(i).alias(f"__u{i}") for i in range(replicates)])
    times = lambda i: reduce(lambda a, b: a + b, [(F.col(f"__u{i}") >= t).cast("int") for t in POISSON])
    weighted = counted.select(group, "__v", *[times(i).alias(f"__w{i}") for i in range(replicates)])
    sums = weighted.groupBy(group).agg(*[x for i in range(replicates) for x in (F.sum(F.col("__v") * F.col(f"__w{i}")).alias(f"__s{i}"), F.sum(f"__w{i}").alias(f"__n{i}"))])
    means = F.array(*[F.when(F.col(f"__n{i}") > 0, F.col(f"__s{i}") / F.col(f"__n{i}")) for i in range(replicates)])
    m = sums.select(group, F.explode(means).alias("m")).where(F.col("m").isNotNull())
    return m.groupBy(group).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("deviation"))
