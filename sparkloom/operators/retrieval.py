"""Similarity retrieval: cosine top-k of a query set against all rows (see cells), softmax, nucleus cut and re-ranking."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import cosine_top_k  # noqa: F401


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def cosine(a: Column, b: Column) -> Column:
    """Null where either is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))


def size_similarity(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-F.pow(distance(a, b), F.lit(2)) / (2 * sigma * sigma))


def hybrid(cosine: Column, size: Column, weight: float) -> Column:
    """The two similarities, weighted; a missing one counts as 0."""
    return weight * F.coalesce(cosine, F.lit(0.0)) + (1 - weight) * F.coalesce(size, F.lit(0.0))


def aspect_difference(a: Column, b: Column) -> Column:
    """Mean distance of the logs of the three side ratios; sides count as 0.001 at least, null as ones."""
    side = lambda v, i: F.greatest(F.coalesce(F.get(v, i), F.lit(1.0)), F.lit(0.001))
    log_ratio = lambda v, i, j: F.log(side(v, i) / side(v, j))
    pairs = ((0, 1), (0, 2), (1, 2))
    return reduce(lambda x, y: x + y, [F.abs(log_ratio(a, i, j) - log_ratio(b, i, j)) for i, j in pairs]) / len(pairs)


def nucleus(df: DataFrame, group: str, score: str, tie: str, temperature: float = 1.0, top_p: float = 1.0) -> DataFrame:
    """df with p: softmax of score / temperature in each group; what lies beyond top_p (the row that crosses it stays) goes."""
    w = Window.partitionBy(group)
    order = w.orderBy(F.desc(score), tie)
    e = df.withColumn("__e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    p = e.withColumn("p", F.col("__e") / F.sum("__e").over(w))
    before = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = p.withColumn("__b", before).where(F.col("__b") <= top_p)
    return kept.withColumn("p", F.col("p") / F.sum("p").over(w)).drop("__e", "__b")


def threshold_with_fallback(df: DataFrame, group: str, score: str, threshold: float, fallback: float) -> DataFrame:
    """Rows at or above the threshold; where a group has none, those at or above the lower fallback."""
    best = F.max(score).over(Window.partitionBy(group))
    return df.withColumn("__m", best).where(F.col(score) >= F.when(F.col("__m") >= threshold, F.lit(threshold)).otherwise(F.lit(fallback))).drop("__m")


def reuse_earlier(df: DataFrame, group: str, order: str, description: str, size: str, limit: float) -> DataFrame:
    """(group, order, source): each row reuses the first earlier row of its group that wasn't itself reused, has the same
    description and a size within limit; else its own order.

    The decision depends on those before, so the rows of one group and description are one task's. Sizes lie in a grid of
    cells as wide as the limit, and a row only looks into the cells around its own, so a row costs no more when many were
    kept before it.
    """
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sizes = np.array(pdf[size].tolist(), np.float64).reshape(len(pdf), -1)
        cells = np.floor(sizes / limit if limit > 0 else sizes).astype(np.int64)
        around = list(product((-1, 0, 1), repeat=sizes.shape[1]))
        held: dict[tuple, list[tuple]] = {}
        source = []
        for o, v, c in zip(pdf[order].tolist(), sizes, map(tuple, cells.tolist()), strict=True):
            near = [x for step in around for x in held.get(tuple(i + j for i, j in zip(c, step, strict=True)), ()) if np.linalg.norm(v - x[1]) <= limit]
            found = min((q for q, _ in near), default=None)
            if found is None:
                held.setdefault(c, []).append((o, v))
            source.append(o if found is None else found)
        return pd.DataFrame({group: pdf[group], order: pdf[order], "source": source})

    kinds = dict(df.dtypes)
    return df.select(group, order, description, size).groupBy(group, description).applyInPandas(pick, f"{group} {kinds[group]}, {order} {kinds[order]}, source {kinds[order]}")


def views_max(df: DataFrame, query: str, item: str, image: str, text: str, threshold: float) -> DataFrame:
    """(query, item, image, rank): an item's best view counts; items pass by the image score alone and rank by image and text together."""
    best = df.groupBy(query, item).agg(F.max(image).alias("image"), F.max(text).alias("text")).where(F.col("image") >= threshold)
    w = Window.partitionBy(query).orderBy(F.desc(F.round(F.col("image") + F.col("text"), 9)), item)
    return best.withColumn("rank", F.row_number().over(w))
