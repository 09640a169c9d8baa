"""Exact top-k by cosine with cells that are left out when they can't matter.

Items lie in cells around centroids; a cell's radius is the largest distance of its items. On unit vectors a query's
distance to a centroid, less the radius, bounds its distance to any item of the cell. A query first visits the nearest
cells that hold k items, which bounds its k-th best; then only cells whose bound can still beat that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Rows that the centroids are fitted on, at most (those of least hash), and centroids, at most.
SAMPLE, CENTROIDS = 10_000, 256
#: Items of a cell and queries that one task scores at a time.
ITEMS, QUERIES = 20_000, 2_000
#: Scores that a task holds at a time, about: some of its queries against all items of the piece.
SCORES = 2_000_000
#: What rounding may cost a bound.
SLACK = 1e-6
#: The cell of items without direction, which score 0 with everything.
NOWHERE = -1


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size == 0, 1, size)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Spherical k-means from the first k distinct rows; empty centroids stay."""
    sample = unit(sample[np.linalg.norm(sample, axis=1) > 0])
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    _, first = np.unique(sample, axis=0, return_index=True)
    centroids = sample[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centroids.T, axis=1)
        for c in np.unique(near):
            mean = sample[near == c].mean(axis=0)
            if (length := np.linalg.norm(mean)) > 0:
                centroids[c] = mean / length
    return centroids


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.clip(v @ centroids.T, -1, 1), 0))


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long vectors, without a Python object a number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.unique(np.asarray(column.value_lengths()))
    if len(sizes) != 1:
        return np.array(column.to_pylist(), np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(sizes[0]))


def in_cells(items: DataFrame, centroids: np.ndarray) -> DataFrame:
    """items (item, v) with cell (the nearest centroid) and distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch.column(1))
            nowhere = np.linalg.norm(v, axis=1) == 0
            d = _distances(unit(v), centroids) if len(centroids) else np.zeros((len(v), 1))
            cell = np.where(nowhere, NOWHERE, np.argmin(d, axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(np.where(nowhere, 0.0, d.min(axis=1)))], names=["item", "v", "cell", "distance"])

    return items.mapInArrow(run, "item long, v array<double>, cell int, distance double")


def _score_bounds(q: np.ndarray, cells: list[tuple[int, float, int]], centroids: np.ndarray) -> np.ndarray:
    """The best score that any item of each cell can have with each query."""
    out = np.zeros((len(q), len(cells)))
    real = [i for i, (c, _, _) in enumerate(cells) if c != NOWHERE]
    if real:
        d = _distances(q, centroids[[cells[i][0] for i in real]])
        least = np.maximum(d - np.array([cells[i][1] for i in real])[None, :], 0)
        out[:, real] = 1 - least * least / 2
    return out


def _visits(cells: list[tuple[int, float, int]], centroids: np.ndarray, k: int, second: bool):
    """Queries (query, v[, kth, seen]) to a row (query, v, cell) for each cell to visit: the first that hold k items, or all others that may beat kth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array([n for _, _, n in cells])
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(_vectors(batch.column(1)))
            bound = _score_bounds(v, cells, centroids)
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            if second:
                kth = batch.column(2).to_numpy(zero_copy_only=False)
                first = ~first & (bound + SLACK >= np.where(np.isnan(kth), -2, kth)[:, None])
            row, c = np.nonzero(first)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.array([x for x, _, _ in cells], np.int32)[c])], names=["query", "v", "cell"])

    return run


def best_places(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest scores, equal ones by the least key."""
    if scores.shape[1] <= k:
        return np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)
    limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    width = int((scores >= limit).sum(axis=1).max())  # ties at the limit come along
    some = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width]
    order = np.lexsort((keys[some], -np.take_along_axis(scores, some, 1)), axis=1)[:, :k]
    return np.take_along_axis(some, order, 1)


def _score(k: int):
    schema = pa.schema([("query", pa.int64()), ("item", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The k best items of a piece of a cell for each of some queries."""
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        keys = held.column("item").to_numpy()
        v, items = unit(_vectors(asked.column("v"))), unit(_vectors(held.column("v"))).T
        at, found, given = [], [], []
        step = max(1, SCORES // len(keys))
        for start in range(0, len(v), step):
            scores = np.round(v[start : start + step] @ items, 9)
            best = best_places(scores, keys, k)
            at.append(start + np.repeat(np.arange(len(scores)), best.shape[1]))
            found.append(keys[best.ravel()])
            given.append(np.take_along_axis(scores, best, 1).ravel())
        return pa.table([asked.column("query").take(np.concatenate(at)), pa.array(np.concatenate(found)), pa.array(np.concatenate(given))], schema=schema)

    return run


def _visit(visits: DataFrame, stored: DataFrame, pieces: DataFrame, k: int, per: int) -> DataFrame:
    """(query, item, score) of visits (query, v, cell): every piece of the cell meets the queries in bounded groups."""
    of = visits.groupBy("cell").agg(F.ceil(F.count("*") / per).cast("int").alias("groups"))
    sized = F.broadcast(pieces.join(of, "cell"))  # at most CENTROIDS rows and one
    asked = visits.join(sized, "cell").withColumn("group", F.pmod(F.xxhash64("query"), "groups").cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    held = stored.join(sized, "cell").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    by = ["cell", "piece", "group"]
    asked, held = asked.select(*by, "query", "v"), held.select(*by, "item", "v")
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_score(k), "query long, item long, score double")


def cosine_top_k(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, block_bytes: int = 64 << 20, visited: list | None = None) -> DataFrame:
    """(query, item, score, rank): each query's k most similar items; ties (at nine digits) go to the least item key.

    Exact, with cells left out by the triangle inequality. Items are written once by cell, in pieces of about ITEMS; the
    queries that visit a cell meet each piece in groups of about QUERIES (block_bytes of vectors at most), so no task holds
    all of either side. The driver sees the fitting sample (at most SAMPLE rows) and one row a cell. Vectors without
    direction score 0 with everything.
    `visited`, if a list, gets the number of visits and of all pairs of a query and a cell.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v"))
    rows = items.select(F.col(key).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    sample = rows.orderBy(F.xxhash64("item", "v"), "item").limit(SAMPLE).collect()
    if not sample or asked.isEmpty():
        return spark.createDataFrame([], "query long, item long, score double, rank int")
    centroids = fit_centroids(np.array([r.v for r in sample], np.float64), max(1, min(CENTROIDS, int(len(sample) ** 0.5))))
    per = max(1, min(QUERIES, block_bytes // (8 * len(sample[0].v) + 8)))
    placed = staged(in_cells(rows, centroids), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
    cells = sorted((r.cell, r.radius, r.n) for r in sizes.collect())
    pieces = spark.createDataFrame([(c, -(-n // ITEMS)) for c, _, n in cells], "cell int, pieces int")
    stored = placed.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("item"), "pieces").cast("int")).select("cell", "piece", "item", "v")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    best = lambda df: df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    schema = "query long, v array<double>, cell int"
    first = staged(asked.where(F.col("v").isNotNull()).mapInArrow(_visits(cells, centroids, k, False), schema), "visits")
    near = staged(best(_visit(first, stored, pieces, k, per)), "near")
    limit = near.groupBy("query").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    again = staged(asked.where(F.col("v").isNotNull()).join(limit, "query").select("query", "v", "kth").mapInArrow(_visits(cells, centroids, k, True), schema), "visits")
    if visited is not None:
        visited += [first.count() + again.count(), asked.count() * len(cells)]
    return best(near.drop("rank").unionByName(_visit(again, stored, pieces, k, per)))
