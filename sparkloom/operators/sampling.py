"""Draws over whole tables: running sums of weights, weighted draws with replacement, and keyed permutations of positions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

#: Points of a draw that meet in one group of the join, about: each is compared with all rows of the group.
POINTS = 8
#: Cells that tell a point's range, at most: a table of as many rows and one more a range, which every task gets.
COARSE = 50_000
#: Weights count in whole units of this size.
UNIT = 1e-8
_NUMBER = "decimal(38,0)"


#: Sums of a range below this are whole numbers of the machine; others are decimals.
_LONG = 1 << 62


def _range_sums(df: DataFrame, order: list[str], weights: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """df with `__range` and, by name, the sum of that weight over the rows of its range before it; and, by range, what is before it and after it."""
    spark = df.sparkSession
    held = staged(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    number = lambda c: F.coalesce(F.col(c).cast(_NUMBER), F.lit(Decimal(0)).cast(_NUMBER))
    sums = [x for n, w in weights.items() for x in (F.sum(number(w)).alias(n), F.sum(F.abs(number(w))).alias(f"__abs_{n}"))]
    sizes = held.groupBy("__range").agg(*sums).orderBy("__range").collect()
    rows, totals = [], dict.fromkeys(weights, Decimal(0))
    for r in sizes:
        rows.append((r["__range"], *[x for n in weights for x in (totals[n], totals[n] + r[n])]))
        totals = {n: totals[n] + r[n] for n in weights}
    schema = T.StructType([T.StructField("__range", T.IntegerType()), *[T.StructField(f"__{end}_{n}", T.DecimalType(38, 0)) for n in weights for end in ("from", "to")]])
    inner = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kind = lambda n: "long" if all(r[f"__abs_{n}"] < _LONG for r in sizes) else _NUMBER
    before = {n: F.coalesce(F.sum(number(w).cast(kind(n))).over(inner), F.lit(0)).cast(kind(n)) for n, w in weights.items()}
    return held.withColumns(before), spark.createDataFrame(rows, schema)


def with_running_sums(df: DataFrame, order: list[str], weights: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """df with a column a name: the sum of that weight over the rows before it, and `__range`; and, by range, what is before it and after it.

    Ranges of the order are sorted and summed by themselves and written once; each is moved by the sums of those before it,
    a table of one row a range. Sums are exact, so they don't depend on the ranges. Rows that are equal in the
    whole order stand in any order among themselves. The number of ranges is the session's number of shuffle partitions.
    """
    held, ranges = _range_sums(df, order, weights)
    out = held.join(F.broadcast(ranges.select("__range", *[f"__from_{n}" for n in weights])), "__range")
    for n in weights:
        out = out.withColumn(n, (F.col(n).cast(_NUMBER) + F.col(f"__from_{n}")).cast(_NUMBER))
    return out.drop(*[f"__from_{n}" for n in weights]), ranges


def with_running_sum(df: DataFrame, order: list[str], weight: str, name: str = "before") -> tuple[DataFrame, DataFrame]:
    """with_running_sums of one weight; the ranges are (__range, from, to)."""
    out, ranges = with_running_sums(df, order, {name: weight})
    return out, ranges.select("__range", F.col(f"__from_{name}").alias("from"), F.col(f"__to_{name}").alias("to"))


def point(draw: Column, seed: str, total: Decimal) -> Column:
    """A whole number in [0, total) from 120 bits of the md5 of seed and draw."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), draw.cast("string")))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")
    return ((part(1) * F.lit(Decimal(1 << 60)).cast("decimal(19,0)") + part(16)).cast(_NUMBER) % F.lit(total).cast(_NUMBER)).cast(_NUMBER)


def weighted_draws(df: DataFrame, order: list[str], weight: Column, n: int | None = None, seed: str = "42") -> DataFrame:
    """(draw, order...): n draws with replacement (as many as rows if None), each row as likely as its weight.

    Weights count in units of UNIT, at least one; a null one is nothing. A draw's point lies in one row's interval of the
    running sum of weights. The axis is cut into cells of equal weight, with about POINTS points each; points and intervals
    meet by range of rows and cell. So a row with half of all weight is in half the cells and many tasks, and many rows
    without much weight are parted by their ranges. Draws are the same in every run. No rows give no draws.
    """
    units = F.greatest(F.round(weight.cast("double") / UNIT), F.lit(1.0)).cast(_NUMBER)
    rows, ranges = _range_sums(df.select(*order, F.coalesce(units, F.lit(Decimal(0)).cast(_NUMBER)).alias("__w")), order, {"__at": "__w"})
    ranges = ranges.toDF("__range", "from", "to")
    found = ranges.agg(F.max("to")).first()[0]
    if not found:
        return df.select(F.lit(0).cast("long").alias("draw"), *order).where("false")
    n = rows.count() if n is None else n
    kind = dict(rows.dtypes)["__at"]
    width = max(1, -(-int(found) * POINTS // max(n, 1)))
    if kind == "bigint":  # a range has less, so it is one cell
        width = min(width, _LONG)
    cell = lambda c, size=width, kind=_NUMBER: F.call_function("div", c, F.lit(Decimal(size)).cast(_NUMBER).cast(kind)).cast("long")
    coarse = -(-int(found) // COARSE)
    spark = df.sparkSession
    points = spark.range(n).select(F.col("id").alias("draw"), point(F.col("id"), seed, found).alias("__p")).withColumn("__coarse", cell(F.col("__p"), coarse))
    # Which range a point is in: ranges by the coarse cells that they reach. From there on places are those in the range.
    reach = ranges.where(F.col("to") > F.col("from")).withColumn("__coarse", F.explode(F.sequence(cell(F.col("from"), coarse), cell(F.col("to") - 1, coarse))))
    met = points.join(F.broadcast(reach), "__coarse").where((F.col("__p") >= F.col("from")) & (F.col("__p") < F.col("to")))
    inside = met.select("draw", "__range", (F.col("__p") - F.col("from")).cast(kind).alias("__p")).withColumn("__cell", cell(F.col("__p"), kind=kind))
    end = (F.col("__at") + F.col("__w").cast(kind)).cast(kind)
    spread = rows.where("__w > 0").select("__range", *order, "__at", end.alias("__end")).withColumn("__cell", F.explode(F.sequence(cell(F.col("__at"), kind=kind), cell(F.col("__end") - 1, kind=kind))))
    hit = inside.join(spread, ["__range", "__cell"]).where((F.col("__p") >= F.col("__at")) & (F.col("__p") < F.col("__end")))
    return hit.select("draw", *order)


def _round(x: Column, key: str, n: int, bits: int) -> Column:
    """A number of so many bits from one of as many, by the md5 of key, round and number."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{key}:{n}"), x.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1))


def _feistel(x: Column, half: int, rounds: list[tuple[str, int]], back: bool) -> Column:
    """One pass of a Feistel network over numbers of 2 * half bits; forwards or backwards."""
    mask = F.lit((1 << half) - 1).cast("long")
    state = F.struct(F.shiftright(x, half).alias("l"), x.bitwiseAND(mask).alias("r"))
    # An array of one is a name for its element; nested expressions would double with every round.
    for key, n in rounds:
        state = F.transform(F.array(state), _back_round(key, n, half) if back else _round_of(key, n, half))[0]
    return F.transform(F.array(state), lambda s: F.shiftleft(s["l"], half).bitwiseOR(s["r"]))[0]


def _round_of(key: str, n: int, half: int):
    return lambda s: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_round(s["r"], key, n, half)).alias("r"))


def _back_round(key: str, n: int, half: int):
    return lambda s: F.struct(s["r"].bitwiseXOR(_round(s["l"], key, n, half)).alias("l"), s["l"].alias("r"))


def shuffled_place(position: Column, n: int, key: str, rounds: int = 4, back: bool = False, walks: int = 64) -> Column:
    """The place of row `position` (0 to n - 1) in the shuffled order that `key` names; with back, the row at a place.

    A keyed permutation: a Feistel network over the least even number of bits that holds n, applied again while the result
    is n or more (cycle walking). No sort, no shuffle and no state, so an epoch can be read from any place on. At least a
    quarter of the numbers are below n, so `walks` steps miss with a probability of 0.75 ** walks (1e-8); then the query fails.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    steps = [(key, i) for i in (reversed(range(rounds)) if back else range(rounds))]
    walk = lambda s, _: F.when(s["done"], s).otherwise(_walked(s["x"], half, steps, back, n))
    first = _walked(position.cast("long"), half, steps, back, n)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, walk)
    return F.when(found["done"], found["x"]).otherwise(F.raise_error(F.lit("no place found")))


def _walked(x: Column, half: int, steps: list[tuple[str, int]], back: bool, n: int) -> Column:
    return F.transform(F.array(_feistel(x, half, steps, back)), lambda y: F.struct((y < n).alias("done"), y.alias("x")))[0]
