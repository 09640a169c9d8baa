"""Preparation of training sets: filters, splits, preference rows, multiple choice, caches and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_filter(df: DataFrame, length: Column, limit: int, name: str = "n") -> DataFrame:
    """Rows whose length is at most the limit, with it as a column; rows without a length go."""
    return df.withColumn(name, length).where(F.col(name) <= limit)


def accuracy_band(df: DataFrame, group: str, accuracy: str, low: float, high: float, truncated: Column | None = None) -> DataFrame:
    """Rows of groups whose mean accuracy lies in [low, high]; with truncated, of groups in which it holds for no row.

    The verdict is one aggregation a group, joined back, so a large group isn't sorted or held by one task.
    """
    bad = F.lit(0) if truncated is None else truncated.cast("int")
    kept = df.groupBy(group).agg(F.avg(accuracy).alias("__m"), F.max(bad).alias("__t")).where(F.col("__m").between(low, high) & (F.col("__t") == 0)).select(group)
    return df.join(kept, group, "left_semi")


def repeat_self(df: DataFrame, times: int, name: str = "copy") -> DataFrame:
    """Every row so many times, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(times))))


def union_of_keys(*parts: DataFrame) -> DataFrame:
    """Each row of any part once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def split_label(key: Column, seed: str, train: int = 9, of: int = 10) -> Column:
    """train or test by the hash of seed and key: `train` parts of `of`, the same in every run."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.when(draw % of < train, "train").otherwise("test")


def preference_rows(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, rank, text): two rows a key, the first text by order as chosen (0) and the last as rejected (1)."""
    both = df.groupBy(key).agg(F.min_by(text, order).alias("__c"), F.max_by(text, order).alias("__r"))
    return both.select(key, F.posexplode(F.array("__c", "__r")).alias("rank", text))


def multiple_choice(df: DataFrame, key: str, options: Column, seed: str, right: str) -> DataFrame:
    """(key, options, letter): options in the order of the hash of seed, key and option, and the letter of the right one."""
    drawn = F.transform(options, lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), o)).alias("draw"), o.alias("option")))
    listed = F.transform(F.sort_array(drawn), lambda o: o["option"])
    return df.select(key, listed.alias("options")).withColumn("letter", F.chr(F.array_position("options", F.lit(right)) + 64))


def known_ids(df: DataFrame, key: str, known: DataFrame, group: str, penalty: float) -> DataFrame:
    """(group, valid, penalty): how many rows name a known key, and so much for each that doesn't."""
    theirs = known.select(F.col(known.columns[0]).alias(key), F.lit(1).alias("__known")).distinct()
    marked = df.join(theirs, key, "left")
    return marked.groupBy(group).agg(F.count("__known").alias("valid"), (F.count(F.when(F.col("__known").isNull(), 1)) * penalty).alias("penalty"))


def cached_by(df: DataFrame, key: str, *by: str) -> DataFrame:
    """df with `cached`, the least key of the rows that agree in `by` (null with null): what an exact cache would give again."""
    named = [F.col(c).alias(f"__{c}") for c in by]
    first = df.groupBy(*named).agg(F.min(key).alias("cached"))
    same = F.lit(True)
    for c in by:
        same = same & df[c].eqNullSafe(first[f"__{c}"])
    return df.join(first, same).drop(*[f"__{c}" for c in by])


def last_of(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value): the value of the last row by order."""
    return df.groupBy(group).agg(F.max_by(value, order).alias(value))


def sample_by_hash(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows of least hash of seed and key: a sample of fixed size for a log."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("__draw", draw).orderBy("__draw", key).limit(n).drop("__draw")


def best_of(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """One row a group: the first by order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def coverage(df: DataFrame, key: str, cache: DataFrame) -> DataFrame:
    """(cached, total, coverage): rows whose key the cache has, all rows, and their share in percent."""
    theirs = cache.select(F.col(key), F.lit(1).alias("__c")).distinct()
    return df.join(theirs, key, "left").agg(F.count("__c").alias("cached"), F.count("*").alias("total"), (F.count("__c") / F.count("*") * 100).alias("coverage"))


def missing_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """df with a null column of the given type for each name that it lacks."""
    return df.select("*", *[F.lit(None).cast(k).alias(n) for n, k in kinds.items() if n not in df.columns])


def last_turns(df: DataFrame, group: str, turn: str, least: int) -> DataFrame:
    """(group, last): the last turn of the groups that have got to `least`."""
    return df.groupBy(group).agg(F.max(turn).alias("last")).where(F.col("last") >= least)


def prompt_columns(text: Column, gold: Column, style: str = "rule") -> list[Column]:
    """prompt (one user message) and reward_model (style and ground truth) of a training row."""
    message = F.struct(F.lit("user").alias("role"), text.alias("content"))
    return [F.array(message).alias("prompt"), F.struct(F.lit(style).alias("style"), F.coalesce(gold, F.lit("")).alias("ground_truth")).alias("reward_model")]


def collapsed(**columns: Column) -> Column:
    """Columns as one map of strings, null ones left out."""
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in columns]), F.array(*[c.cast("string") for c in columns.values()]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())
