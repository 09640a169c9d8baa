"""Masked aggregates over rows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import with_position


def masked_sum(value: Column, mask: Column) -> Column:
    """Sum of value * mask; what stands at mask 0 is ignored, NaN included."""
    return F.sum(F.when(mask != 0, value * mask).otherwise(F.lit(0.0)))


def masked_mean(value: Column, mask: Column) -> Column:
    return masked_sum(value, mask) / (F.sum(mask) + F.lit(1e-8))


def masked_moments(df: DataFrame, value: Column, mask: Column, *by: str) -> DataFrame:
    """(by..., n, mean, var): the masked mean and the unbiased variance, null where n < 2, in two passes for accuracy."""
    m = df.select(*by, value.cast("double").alias("__v"), mask.alias("__m"))
    means = m.groupBy(*by).agg(masked_mean(F.col("__v"), F.col("__m")).alias("mean"), F.sum("__m").alias("n"))
    joined = m.join(means, list(by)) if by else m.crossJoin(F.broadcast(means))
    spread = joined.groupBy(*by, "mean", "n").agg(masked_mean((F.col("__v") - F.col("mean")) ** 2, F.col("__m")).alias("__s"))
    return spread.select(*by, "n", "mean", F.when(F.col("n") > 1, F.col("__s") * F.col("n") / (F.col("n") - 1)).alias("var"))


def whiten(df: DataFrame, value: str, mask: Column, name: str = "white", shift_mean: bool = True) -> DataFrame:
    """(value - mean) / sqrt(var + 1e-8) over all masked rows; the moments are one row, broadcast."""
    moments = masked_moments(df, F.col(value), mask).select(F.col("mean").alias("__mean"), F.col("var").alias("__var"))
    white = (F.col(value) - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)
    return df.crossJoin(F.broadcast(moments)).withColumn(name, white if shift_mean else white + F.col("__mean")).drop("__mean", "__var")


def group_mean_std(df: DataFrame, group: str, score: str, eps: float = 1e-6) -> DataFrame:
    """(group, mean, std, n): variance from sums, clamped at eps; a single row has mean 0 and deviation 1."""
    s = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.var_samp(score).alias("v"))
    one = F.col("n") == 1
    return s.select(group, "n", F.when(one, 0.0).otherwise(F.col("m")).alias("mean"), F.when(one, 1.0).otherwise(F.sqrt(F.greatest(F.col("v"), F.lit(eps)))).alias("std"))


def aggregate_loss(df: DataFrame, row: str, loss: Column, mask: Column, mode: str, width: int | None = None) -> DataFrame:
    """One row `loss` from token rows (row, loss, mask), in one of four ways of averaging tokens and sequences."""
    if mode == "token-mean":
        return df.agg(masked_mean(loss, mask).alias("loss"))
    sums = df.groupBy(row).agg(masked_sum(loss, mask).alias("s"), F.sum(mask).alias("n"))
    if mode == "seq-mean-token-sum":
        return sums.where("n > 0").agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return sums.where("n > 0").agg(F.avg(F.col("s") / (F.col("n") + 1e-8)).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return sums.agg((F.sum("s") / width).alias("loss"))
    raise ValueError(mode)


def dense_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """df with a 0-based number for each distinct key, in order; the distinct keys are numbered by ranges, not in one task."""
    keys = with_position(df.select(F.col(key).alias("__key")).distinct(), "__key", name=name)
    return df.join(keys, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def next_token_loss(df: DataFrame, row: str, order: list[str], log_p: str, mask: str) -> DataFrame:
    """(row, loss): minus the log-probabilities of the tokens before masked ones, averaged over the masked ones."""
    after = F.lead(mask).over(Window.partitionBy(row).orderBy(*order))
    x = df.withColumn("__next", after)
    return x.groupBy(row).agg((F.sum(F.when(F.col("__next") == 1, -F.col(log_p)).otherwise(0.0)) / F.greatest(F.sum(F.coalesce("__next", F.lit(0))), F.lit(1))).alias("loss"))
