"""Batch algebra: positions, gathers, slices, chunks, repeats and padding of rows and arrays.

Rows have no order of their own in Spark, so every positional operation works on an explicit position column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_position(df: DataFrame, by: str | list[str], *ties: str, name: str = "pos") -> DataFrame:
    """df with its 0-based position in the order of `by` and ties, nulls first, without sorting all rows in one task.

    Ranges of the order are sorted and numbered by themselves; rows that are equal in one key are parted by the ties, so
    no key is one task's. The numbered rows are written once, their ranges counted, and each range moved by the rows before
    it, a table of one row a range. The number of ranges is the session's number of shuffle partitions (AQE merges small
    ones).
    """
    keys = [by] if isinstance(by, str) else list(by)
    order = [*keys, *ties]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part, row, move = (unused(df, n) for n in ("__range", "__row", "__move"))
    numbered = staged(ranged.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()), "numbered")
    sizes = numbered.groupBy(F.col(part).alias("range")).agg(F.count("*").alias("n"), F.min(row).alias("first")).orderBy("range").collect()
    before, starts = 0, []
    for s in sizes:
        starts.append((s["range"], before - s["first"]))
        before += s.n
    moved = df.sparkSession.createDataFrame(starts, f"{part} int, {move} long")
    return numbered.join(F.broadcast(moved), part).withColumn(name, F.col(row) + F.col(move)).drop(part, row, move)


def select_positions(df: DataFrame, picks: DataFrame, pos: str = "pos") -> DataFrame:
    """Gather: picks is (slot, pos); duplicates and the order of slots are kept."""
    return picks.join(df, pos).drop(pos)


def slice_rows(df: DataFrame, start: int | None, stop: int | None, step: int = 1, pos: str = "pos", total: int | None = None) -> DataFrame:
    """Rows of a Python slice with a positive step; negative bounds count from the end."""
    n = total if total is not None else df.count()
    first, last, _ = slice(start, stop, step).indices(n)
    return df.where((F.col(pos) >= first) & (F.col(pos) < last) & (F.pmod(F.col(pos) - first, F.lit(step)) == 0))


def pop(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest); a missing name is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(missing)
    return df.select(*names), df.drop(*names)


def union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Horizontal union by key; columns that both have must be equal (null equals null), else the query fails."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    other = right.select(key, *[F.col(c).alias(f"__{c}" if c in shared else c) for c in right.columns if c != key])
    out = left.join(other, key)
    for c in shared:
        checked = F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs")))
        out = out.withColumn(c, checked).drop(f"__{c}")
    return out


def concat(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def chunk(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """df with `chunk`, n equal pieces in order; rows that don't divide are an error."""
    total = df.count()
    if total % n:
        raise ValueError(f"{total} rows don't divide into {n}")
    return df.withColumn("chunk", F.floor(F.col(pos) / max(total // n, 1)).cast("long"))


def split(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """df with `piece`, of `size` rows each but the last."""
    return df.withColumn("piece", F.floor(F.col(pos) / size).cast("long"))


def repeat(df: DataFrame, n: int, interleave: bool = True, pos: str = "pos", total: int | None = None) -> DataFrame:
    """Each row n times with its new position: aabb if interleaved, else abab."""
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = total if total is not None else (0 if interleave else df.count())
    return out.withColumn("slot", (F.col(pos) * n + F.col("rep")) if interleave else (F.col("rep") * rows + F.col(pos)))


def repeat_by(df: DataFrame, count: Column) -> DataFrame:
    """Each row as often as its count says; 0, null or less drops it (Spark's sequence(1, 0) would count down)."""
    return df.where(count > 0).withColumn("rep", F.explode(F.sequence(F.lit(1), count.cast("int"))))


def unfold(df: DataFrame, n: int, *arrays: str) -> DataFrame:
    """n rows a row: the listed arrays cut into n equal pieces, other columns repeated; a length that n doesn't divide is an error."""
    out = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for a in arrays:
        fits = F.when(F.size(a) % n == 0, F.floor(F.size(a) / n).cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{a} doesn't divide into {n}: "), F.size(a).cast("string"))))
        out = out.withColumn(a, F.slice(F.col(a), F.col("part") * fits + 1, fits))
    return out


def fold(df: DataFrame, size: int, *values: str, pos: str = "pos") -> DataFrame:
    """Groups of `size` consecutive rows as arrays, in order."""
    held = F.sort_array(F.collect_list(F.struct(pos, *values)))
    return df.groupBy(F.floor(F.col(pos) / size).cast("long").alias("row")).agg(held.alias("__h")).select("row", *[F.col(f"__h.{v}").alias(v) for v in values])


def pad_to_divisor(df: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    """Rows from the start again (cyclically) until k divides; `is_pad` marks them and positions go on."""
    n = df.count()
    lack = -n % k
    marked = df.withColumn("is_pad", F.lit(False))
    rounds = [df.where(F.col(pos) < lack - r * n).withColumn(pos, F.col(pos) + (r + 1) * n).withColumn("is_pad", F.lit(True)) for r in range(-(-lack // n) if n else 0)]
    return concat(marked, *rounds)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def pad_with_row(df: DataFrame, size: int, last: bool = True, pos: str = "pos") -> DataFrame:
    """`size` more copies of the last (or first) row, at the end."""
    n = df.count()
    row = df.where(F.col(pos) == (n - 1 if last else 0))
    more = row.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(size)))) if size > 0 else row.where("false").withColumn("__i", F.lit(0))
    return df.unionByName(more.withColumn(pos, F.lit(n - 1).cast("long") + F.col("__i")).drop("__i"))


def minibatches(df: DataFrame, size: int, epochs: int, key: str, seed: str) -> DataFrame:
    """(epoch, batch) of each row in each epoch: rows by the md5 of seed, epoch and key; the size must divide."""
    n = df.count()
    if n % size:
        raise ValueError("the size must divide the rows")
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")
    numbered = with_position(each.withColumn("__d", draw), ["epoch", "__d"], key, name="slot").drop("__d")
    slot = F.col("slot") - F.col("epoch") * n
    return numbered.withColumn("slot", slot).withColumn("batch", F.floor(F.col("slot") / size).cast("long"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same rows as often."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def pad_array(a: Column, width: Column | int, value: Column, left: bool = False) -> Column:
    """The array with `value` added up to a width; a longer one stays."""
    more = F.array_repeat(value, F.greatest(F.lit(0), (F.lit(width) if isinstance(width, int) else width) - F.size(a)))
    return F.concat(more, a) if left else F.concat(a, more)


def truncate_array(a: Column, width: int, how: str) -> Column:
    """At most `width` elements: how is left (keep the end), right (keep the start), middle (width // 2 and the rest) or error."""
    n = F.size(a)
    head = width // 2
    kept = {
        "left": F.slice(a, F.greatest(F.lit(1), n - width + 1), F.lit(width)),
        "right": F.slice(a, 1, width),
        "middle": F.when(n <= width, a).otherwise(F.concat(F.slice(a, F.lit(1), F.lit(head)), F.slice(a, F.greatest(F.lit(1), n - (width - head) + 1), F.lit(width - head)))),
        "error": F.when(n <= width, a).otherwise(F.raise_error(F.lit("too long"))),
    }
    return kept[how]


def keep_masked(a: Column, mask: Column) -> Column:
    """The elements whose mask is 1."""
    return F.transform(F.filter(F.arrays_zip(a.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])


def suffix_within_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The latest rows of each group whose sizes together fit the budget; older ones are dropped."""
    after = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__used", F.sum(size).over(after)).where(F.col("__used") <= budget).drop("__used")


def informative_groups(df: DataFrame, group: str, score: str) -> DataFrame:
    """Rows of groups whose scores differ (population deviation above 0) or that have one row."""
    w = Window.partitionBy(group)
    return df.withColumn("__s", F.stddev_pop(score).over(w)).withColumn("__n", F.count("*").over(w)).where((F.col("__s") > 0) | (F.col("__n") == 1)).drop("__s", "__n")


def equal_sizes(df: DataFrame, *arrays: str) -> DataFrame:
    """df, if in each row all these arrays are of one length; another row is an error when it is read."""
    same = reduce(lambda a, c: a & (F.size(c) == F.size(arrays[0])), arrays[1:], F.lit(True))
    sizes = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.size(c).cast("string")) for c in arrays])
    return df.withColumn(arrays[0], F.when(same, F.col(arrays[0])).otherwise(F.raise_error(F.concat(F.lit("sizes differ: "), sizes))))


def ragged(df: DataFrame, group: str, order: str, *arrays: str) -> DataFrame:
    """(group, values and offsets of each array column): rows of a group, a batch, end to end without padding.

    Row i of a batch has offsets[i]:offsets[i + 1] of the values. A null array is empty.
    """
    whole = df.select(group, order, *[F.coalesce(a, F.array().cast(df.schema[a].dataType)).alias(a) for a in arrays])
    w = Window.partitionBy(group).orderBy(order, *arrays).rowsBetween(Window.unboundedPreceding, 0)
    ends = [F.sum(F.size(a)).over(w).cast("int").alias(f"__end_{a}") for a in arrays]
    held = F.sort_array(F.collect_list(F.struct(order, *arrays, *[f"__end_{a}" for a in arrays])))
    rows = whole.select("*", *ends).groupBy(group).agg(held.alias("__h"))
    offsets = lambda a: F.concat(F.array(F.lit(0)), F.col(f"__h.__end_{a}"))
    return rows.select(group, *[c for a in arrays for c in (F.flatten(F.col(f"__h.{a}")).alias(a), offsets(a).alias(f"{a}_offsets"))])


def reorder(df: DataFrame, order: Column, pos: str = "pos") -> DataFrame:
    """df with `slot`, the place that each row takes: order is a permutation of the positions, as an expression."""
    return df.withColumn("slot", order.cast("long")).drop(pos)


def inverse_permutation(df: DataFrame, group: str, key: str, *order: str) -> DataFrame:
    """(group, at, was): the place of each row in the given order, and by key, both from 1 within the group."""
    w = Window.partitionBy(group)
    return df.select(group, F.row_number().over(w.orderBy(*order)).alias("at"), F.row_number().over(w.orderBy(key)).alias("was"))


def union_maps(a: Column, b: Column) -> Column:
    """Both maps' entries; a key that both have must have one value (null with null), else the query fails."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    same = F.forall(shared, lambda k: a[k].eqNullSafe(b[k]))
    rest = F.map_filter(b, lambda k, _: ~F.array_contains(shared, k))
    return F.when(same, F.map_concat(a, rest)).otherwise(F.raise_error(F.lit("maps differ in a shared key")))


def lists_by_key(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """(key, values...): each column's values as an array, in order."""
    held = F.sort_array(F.collect_list(F.struct(order, *[v for v in values if v != order])))
    return df.groupBy(key).agg(held.alias("__h")).select(key, *[F.col(f"__h.{v}").alias(v) for v in values])


def rows_where(df: DataFrame, mask: Column) -> DataFrame:
    """The rows whose mask holds; null counts as not."""
    return df.where(F.coalesce(mask, F.lit(False)))


def consistent(df: DataFrame, *columns: str) -> DataFrame:
    """(columns..., rows): how many values each column has, and how many rows there are."""
    return df.agg(*[F.count(c).alias(c) for c in columns], F.count("*").alias("rows"))


def text_size(df: DataFrame, *columns: str) -> DataFrame:
    """(`column`_bytes..., rows): bytes of the columns' texts, and rows."""
    return df.agg(*[F.sum(F.octet_length(c)).alias(f"{c}_bytes") for c in columns], F.count("*").alias("rows"))
