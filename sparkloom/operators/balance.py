"""Workload balancing: number partitioning and token-budget micro-batches, group by group."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def largest_differencing(sizes: list[float], k: int, equal: bool = False) -> list[int]:
    """The part of each size in a k-way split with near equal sums: states of k partial sums are merged, those with the
    widest spread first, largest against smallest. With equal, all parts get as many members; k must divide."""
    if equal and len(sizes) % k:
        raise ValueError("k must divide the number of sizes")
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    heap: list[tuple] = []

    def push(sums: list[tuple[float, list[int]]], tie: int) -> None:
        sums.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (-(sums[0][0] - sums[-1][0]), tie, sums))

    if equal:
        for n, at in enumerate(range(0, len(order), k)):
            push([(sizes[i], [i]) for i in order[at : at + k]], n)
    else:
        for n, i in enumerate(order):
            push([(sizes[i], [i]), *[(0, []) for _ in range(k - 1)]], n)
    tie = len(order)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        tie += 1
        push([(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)], tie)
    out = [0] * len(sizes)
    if heap:
        for part, (_, members) in enumerate(heap[0][2]):
            for i in members:
                out[i] = part
    return out


def lightest_first(sizes: list[float], k: int) -> list[int]:
    """Each size, in the order given, to the part that is lightest so far."""
    parts = [(0.0, p) for p in range(k)]
    out = []
    for s in sizes:
        total, p = heapq.heappop(parts)
        out.append(p)
        heapq.heappush(parts, (total + s, p))
    return out


def _by_group(df: DataFrame, group: str, key: str, size: str, split: Callable[[list], list[list]], names: list[str]) -> DataFrame:
    """(group, key, names...): split gives one list of integers a name for the sizes of a group in the order of its keys.

    Rows are sorted by (group, key) within partitions and cut into groups as they come; a group that goes over the end of an
    Arrow batch is carried into the next, so thousands of small groups cost no call each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            sizes = table.column(2).to_pylist()
            parts = [split(sizes[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            columns = [pa.array([x for p in parts for x in p[i]], pa.int32()) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in table.columns[:2]], *columns], names=[group, key, *names])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            groups = table.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]]]
            if len(cuts) > 1:
                yield made(table.slice(0, cuts[-1]), cuts)
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield made(held, [0, held.num_rows])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(group, key, size).repartition(group).sortWithinPartitions(group, key)
    return rows.mapInArrow(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, {', '.join(f'{n} int' for n in names)}")


def balanced_parts(df: DataFrame, group: str, key: str, size: str, k: int, method: str = "differencing") -> DataFrame:
    """(group, key, part) with each group's rows split into k parts of near equal sums of size.

    A group is one batch of a trainer, so it is small.
    """
    of = largest_differencing if method == "differencing" else lightest_first
    return _by_group(df, group, key, size, lambda sizes: [of(sizes, k)], ["part"])


def micro_batches(df: DataFrame, group: str, key: str, size: str, budget: int) -> DataFrame:
    """(group, key, part, of): each group's rows in ceil(total / budget) parts (at most one a row), the parts ordered by
    falling load and dealt from both ends, so the lightest lie in the middle."""

    def split(sizes: list) -> list[list[int]]:
        k = min(len(sizes), max(1, -(-int(sum(sizes)) // budget)))
        part = largest_differencing(sizes, k)
        loads = [0.0] * k
        for p, s in zip(part, sizes, strict=True):
            loads[p] += s
        ranked = sorted(range(k), key=lambda p: (-loads[p], p))
        place = {p: i for i, p in enumerate(ranked[::2] + ranked[1::2][::-1])}
        return [[place[p] for p in part], [k] * len(part)]

    return _by_group(df, group, key, size, split, ["part", "of"])


def trainer_batches(key: Column, seed: str, batches: int) -> Column:
    """The batch of a row: the hash of seed and key over so many batches, so that groups stay one trainer batch's size."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(batches))


def prepare_batches(df: DataFrame, group: str, key: str, size: str, budget: int) -> DataFrame:
    """df with part (its micro-batch), of (their number) and slot (its place when micro-batches follow one another): rows
    travel with their micro-batch, and slot is the index list that restores them."""
    from pyspark.sql import Window

    parts = micro_batches(df, group, key, size, budget)
    slot = F.row_number().over(Window.partitionBy(group).orderBy("part", key)) - 1
    return df.join(parts.withColumn("slot", slot), [group, key])


def restore_batches(dealt: DataFrame, group: str, values: str, index: DataFrame, key: str) -> DataFrame:
    """(group, key, value): the value at each slot of a group (array column `values` in the order of the micro-batches) back
    at the key that index (group, key, slot) names for that slot."""
    long = dealt.select(group, F.posexplode(values).alias("slot", "value"))
    return index.select(group, key, "slot").join(long, [group, "slot"]).select(group, key, "value")


def curriculum_order(items: DataFrame, results: DataFrame, key: str, score: str, seed: str) -> DataFrame:
    """(key, mean, place): items ordered by their mean result so far, the best solved first and those without results last;
    equal ones by the hash of seed and key. Places come from ranges, not from one task's sort."""
    from .batch import with_position

    means = results.groupBy(key).agg(F.avg(score).alias("mean"))
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    ranked = items.select(key).join(means, key, "left").withColumn("__m", F.coalesce(-F.col("mean"), F.lit(float("inf")))).withColumn("__d", draw)
    return with_position(ranked, ["__m", "__d"], key, name="place").select(key, "mean", "place")
