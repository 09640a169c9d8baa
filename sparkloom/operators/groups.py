"""Group-relative estimators: a statistic of each group, broadcast back to its rows.

All take rows with a group and a score and add `advantage`. What they need of a group are a few moments, which tasks add
up before anything moves; a join brings them back to the rows, so a group of any size is many tasks (AQE splits its part of
the join). Null is a group like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import with_position
from .masked import whiten
from .recurrences import scan_rows, tally_maps

MOMENTS = ("__n", "__mean", "__std")
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Add an estimator under a name; another one under the same name is an error."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if REGISTRY.get(name, f) is not f:
            raise ValueError(f"{name} is taken")
        REGISTRY[name] = f
        return f

    return add


def estimate(name: str, df: DataFrame, group: str, score: str, **options) -> DataFrame:
    """The estimator of that name over df; an unknown name is an error."""
    if name not in REGISTRY:
        raise KeyError(name)
    return REGISTRY[name](df, group, score, **options)


def with_aggregates(df: DataFrame, group: str, **aggregates: Column) -> DataFrame:
    """df with one more column for each aggregate of its row's group."""
    stats = df.groupBy(F.col(group).alias("__group")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return df.join(stats, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")


def _moments(df: DataFrame, group: str, score: str) -> DataFrame:
    return with_aggregates(df, group, __n=F.count("*"), __mean=F.avg(score), __std=F.stddev_samp(score))


@register("grpo")
def grpo(df: DataFrame, group: str, score: str, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(s - mean) / (sample deviation + eps); a single row has mean 0 and deviation 1."""
    n, mean, std = F.col("__n"), F.col("__mean"), F.col("__std")
    centred = F.col(score) - F.when(n == 1, 0.0).otherwise(mean)
    return _moments(df, group, score).withColumn("advantage", centred / (F.when(n == 1, 1.0).otherwise(std) + eps) if by_std else centred).drop(*MOMENTS)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, group: str, score: str, eps: float = 1e-6) -> DataFrame:
    """As grpo, with the variance clamped at eps first."""
    n, mean, std = F.col("__n"), F.col("__mean"), F.col("__std")
    floor = F.when(n == 1, 1.0).otherwise(F.sqrt(F.greatest(std * std, F.lit(eps))))
    return _moments(df, group, score).withColumn("advantage", (F.col(score) - F.when(n == 1, 0.0).otherwise(mean)) / (floor + eps)).drop(*MOMENTS)


@register("grpo_passk")
def grpo_passk(df: DataFrame, group: str, score: str, order: str, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """Only a group's best row (ties: least `order`) gets the distance to the second best; groups of one get null."""
    every = Window.partitionBy(group)
    w = every.orderBy(F.desc(score), order)
    n, std = F.count("*").over(every), F.stddev_samp(score).over(every)
    gap = F.col(score) - F.lead(score).over(w)
    scaled = gap / (std + eps) if by_std else gap
    return df.withColumn("advantage", F.when(n < 2, F.lit(None).cast("double")).when(F.row_number().over(w) == 1, scaled).otherwise(0.0))


@register("rloo")
def rloo(df: DataFrame, group: str, score: str) -> DataFrame:
    """Leave-one-out: n / (n - 1) (s - mean); a single row keeps its score."""
    n, mean = F.col("__n"), F.col("__mean")
    return _moments(df, group, score).withColumn("advantage", F.when(n > 1, (F.col(score) - mean) * n / (n - 1)).otherwise(F.col(score))).drop(*MOMENTS)


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, group: str, score: str) -> DataFrame:
    """As rloo, but a single row gets 0."""
    n, mean = F.col("__n"), F.col("__mean")
    return _moments(df, group, score).withColumn("advantage", F.when(n > 1, (F.col(score) - mean) * n / (n - 1)).otherwise(0.0)).drop(*MOMENTS)


@register("opo")
def opo(df: DataFrame, group: str, score: str, length: str) -> DataFrame:
    """Minus the group's length-weighted mean; a single row has baseline 0."""
    held = with_aggregates(df, group, __n=F.count("*"), __mean=F.sum(F.col(score) * F.col(length)) / F.sum(length))
    return held.withColumn("advantage", F.col(score) - F.when(F.col("__n") > 1, F.col("__mean")).otherwise(0.0)).drop(*MOMENTS)


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame, group: str, score: str, length: str) -> DataFrame:
    """Minus the group mean (a single row: 0), then whitened over all tokens: each row counts `length` times."""
    centred = _moments(df, group, score).withColumn("__c", F.col(score) - F.when(F.col("__n") > 1, F.col("__mean")).otherwise(0.0)).drop(*MOMENTS)
    return whiten(centred, "__c", F.col(length), "advantage").drop("__c")


@register("gpg")
def gpg(df: DataFrame, group: str, score: str, f_norm: float = 1.0) -> DataFrame:
    """alpha (s - mean) / f_norm, alpha being rows by rows with a score other than 0; a single row has mean 0."""
    alpha = df.agg((F.count("*") / F.greatest(F.lit(1), F.sum((F.col(score) != 0).cast("int")))).alias("__alpha"))
    held = _moments(df, group, score).crossJoin(F.broadcast(alpha))  # one row
    return held.withColumn("advantage", F.col("__alpha") * (F.col(score) - F.when(F.col("__n") > 1, F.col("__mean")).otherwise(0.0)) / f_norm).drop("__alpha", *MOMENTS)


@register("soft_mean")
def soft_mean(df: DataFrame, group: str, score: str, beta: float = 1.0) -> DataFrame:
    """Minus the group's soft mean (logsumexp(beta s) - ln n) / beta; the mean for beta 0."""
    held = with_aggregates(df, group, __n=F.count("*"), __mean=F.avg(score), __top=F.max(F.col(score) * beta))
    held = with_aggregates(held, group, __sum=F.sum(F.exp(F.col(score) * beta - F.col("__top"))))
    base = (F.col("__top") + F.log(F.col("__sum")) - F.log(F.col("__n").cast("double"))) / beta if beta else F.col("__mean")
    return held.withColumn("advantage", F.col(score) - base).drop("__top", "__sum", *MOMENTS)


def preference_pairs(df: DataFrame, position: str, score: str) -> DataFrame:
    """df with `preferred`: of the rows 2i and 2i + 1 the one with the higher score, the first if equal."""
    w = Window.partitionBy(F.floor(F.col(position) / 2)).orderBy(F.desc(score), position)
    return df.withColumn("preferred", F.row_number().over(w) == 1)


def pairwise_accuracy(df: DataFrame, group: str, position: str, score: str, accuracy: str) -> DataFrame:
    """(group, agreement): over pairs of a group's rows, how often score and accuracy order them alike, weighted by the
    distance of the accuracies; one half where all accuracies are equal. Groups of one row have no pairs and are left out,
    null scores agree with nothing, and rows without an accuracy don't count.

    No pair is made. Scores are ranked; two ranks differ in a highest bit, so at one level of halving they are in the two
    halves of one block. At each level a block's rows are run through by accuracy with the number and the sum of those of
    its lower half so far, which gives the weight of all pairs that the halves order alike. That is rows times log2 of a
    group's scores, and a scan by ranges, so a hot group is many tasks.
    """
    rows = df.where(F.col(accuracy).isNotNull()).select(F.col(group).alias("__g"), F.col(position).alias("__p"), F.col(score).cast("double").alias("__s"), F.col(accuracy).cast("double").alias("__a"))
    scores = with_position(rows.where("__s is not null").select("__g", "__s").distinct(), ["__g", "__s"], name="__r")
    spans = scores.groupBy(F.col("__g").alias("__h")).agg(F.min("__r").alias("__first"), (F.max("__r") - F.min("__r")).alias("__span"))
    ranked = scores.join(spans, F.col("__g").eqNullSafe(F.col("__h"))).select(F.col("__g").alias("__h"), F.col("__s").alias("__t"), (F.col("__r") - F.col("__first")).alias("__r"), "__span")
    placed = rows.join(ranked, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__s") == F.col("__t"))).drop("__h", "__t")
    levels = F.sequence(F.lit(0), F.length(F.bin("__span")) - 1)
    side = F.expr("shiftright(__r, __level) & 1")
    halves = placed.where("__span > 0").withColumn("__level", F.explode(levels)).withColumn("__block", F.expr("shiftright(__r, __level + 1)")).withColumn("__left", (side == 0).cast("int")).withColumn("__right", side.cast("int"))
    every = rows.select("__g", "__p", "__a", F.lit(-1).alias("__level"), F.lit(0).cast("long").alias("__block"), F.lit(1).alias("__left"), F.lit(1).alias("__right"))
    both = halves.select(*every.columns).unionByName(every).withColumn("__key", F.to_json(F.struct("__g", "__level", "__block")))
    run = scan_rows(both, "__key", ["__a", "__left", "__p"], tally_maps(), 3, [F.col("__a"), F.col("__left")], ["__n", "__sum"])
    weight = F.when(F.col("__right") == 1, F.col("__a") * F.col("__n") - F.col("__sum")).otherwise(0.0)
    of = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    sums = run.groupBy(F.col("__g").alias(group)).agg(of(F.col("__level") >= 0).alias("s"), of(F.col("__level") < 0).alias("w"), F.sum((F.col("__level") < 0).cast("int")).alias("n"))
    spread = sums.where("n > 1")
    return spread.select(group, F.when(F.col("w") > 1e-12, F.col("s") / F.col("w")).otherwise(0.5).alias("agreement"))


def preference_weights(score: Column, lowest: Column, highest: Column, how: str, power: float = 2.0) -> Column:
    """Weights by which rows are drawn again (see sampling.weighted_draws): pow (|s| to a power), max_min (1 for a group's
    extremes, 0 for others) or max_random (0.4 for the best, 0.1 for others); each and 1e-8 more."""
    w = {
        "pow": F.pow(F.abs(score), F.lit(power)),
        "max_min": F.when((score == highest) | (score == lowest), 1.0).otherwise(0.0),
        "max_random": F.when(score == highest, 0.4).otherwise(0.1),
    }[how]
    return F.greatest(w + F.lit(1e-8), F.lit(1e-8))

