"""Boxes in space: adaptive cells for pairs of boxes, and voxels as runs along one axis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Boxes of a cell from which on it is split, and levels of cells, at most.
BOUND, DEPTH = 64, 20


def _at(x: Column, low: float, width: float, level: Column) -> Column:
    """Which of the 2 ** level cells of an axis a coordinate is in; the outermost reach beyond."""
    n = F.pow(F.lit(2.0), level)
    return F.least(F.greatest(F.floor((x - low) / width * n), F.lit(0)), n - 1).cast("long")


def quad_cells(boxes: DataFrame, scene: str, axes: tuple[str, str] = ("x", "z"), bound: int = BOUND) -> tuple[DataFrame, tuple[float, ...]]:
    """boxes with __level, __i and __k for each cell of an adaptive grid that they touch; and the grid's origin and widths.

    Every scene starts as one cell. A cell with more than `bound` boxes is split in four, unless its boxes are so large that
    most would be in several of them. A level is one aggregation over the boxes that are still in crowded cells; nothing
    but the extent of all boxes comes to the driver. Boxes with a null side are left out.
    """
    x, z = axes
    sides = [f"{a}{i}" for a in axes for i in (0, 1)]
    boxes = boxes.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in sides]))
    lo_x, hi_x, lo_z, hi_z = boxes.agg(F.min(f"{x}0"), F.max(f"{x}1"), F.min(f"{z}0"), F.max(f"{z}1")).first()
    grid = (0.0, 1.0, 0.0, 1.0) if lo_x is None else (float(lo_x), max(float(hi_x - lo_x), 1e-9), float(lo_z), max(float(hi_z - lo_z), 1e-9))
    cell = [scene, "__i", "__k"]
    now = staged(boxes.withColumn("__level", F.lit(0)).withColumn("__i", F.lit(0).cast("long")).withColumn("__k", F.lit(0).cast("long")), "level")
    leaves = None
    for level in range(DEPTH + 1):
        below = F.lit(level + 1)

        def halves(axis: str, at: str, low: float, width: float, below: Column = below) -> tuple[Column, Column]:
            first = F.greatest(_at(F.col(f"{axis}0"), low, width, below), F.col(at) * 2)
            last = F.least(_at(F.col(f"{axis}1"), low, width, below), F.col(at) * 2 + 1)
            return first, F.greatest(first, last)

        (i0, i1), (k0, k1) = halves(x, "__i", *grid[:2]), halves(z, "__k", *grid[2:])
        sizes = now.groupBy(*cell).agg(F.count("*").alias("n"), F.sum((i1 - i0 + 1) * (k1 - k0 + 1)).alias("then"))
        crowded = staged(sizes.where((F.col("n") > bound) & (F.col("then") <= 2 * F.col("n"))).select(*cell).withColumn("__split", F.lit(True)), "crowded")
        if level == DEPTH or crowded.isEmpty():
            return (now if leaves is None else leaves.unionByName(now)), grid
        marked = now.join(crowded, cell, "left")
        rest = staged(marked.where("__split is null").drop("__split"), "leaves")
        leaves = rest if leaves is None else leaves.unionByName(rest)
        split = marked.where("__split").drop("__split").withColumn("__a", F.explode(F.sequence(i0, i1))).withColumn("__b", F.explode(F.sequence(k0, k1)))
        now = staged(split.withColumn("__level", below).withColumn("__i", F.col("__a")).withColumn("__k", F.col("__b")).drop("__a", "__b"), "level")
    raise AssertionError


def _mine(a: str, b: str, axes: tuple[str, str], grid: tuple[float, ...]) -> Column:
    """Whether a pair's common corner is in the cell in which they meet, so that one cell of several reports it."""
    (x, z), level = axes, F.col(f"{a}.__level")
    corner = lambda c: F.greatest(F.col(f"{a}.{c}0"), F.col(f"{b}.{c}0"))
    return (_at(corner(x), *grid[:2], level) == F.col(f"{a}.__i")) & (_at(corner(z), *grid[2:], level) == F.col(f"{a}.__k"))


def _same(a: str, b: str, *columns: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in columns])


def touching_pairs(boxes: DataFrame, scene: str, key: str, axes: tuple[str, str] = ("x", "z"), bound: int = BOUND) -> DataFrame:
    """Pairs (aliases a and b, key of a below that of b) of a scene's boxes that share more than a border along both axes, each once."""
    placed, grid = quad_cells(boxes, scene, axes, bound)
    a, b = placed.alias("a"), placed.alias("b")
    overlap = reduce(lambda x, y: x & y, [(F.col(f"a.{c}0") < F.col(f"b.{c}1")) & (F.col(f"b.{c}0") < F.col(f"a.{c}1")) for c in axes])
    return a.join(b, _same("a", "b", scene, "__level", "__i", "__k") & (F.col(f"a.{key}") < F.col(f"b.{key}")) & overlap & _mine("a", "b", axes, grid))


def supported(boxes: DataFrame, scene: str, key: str, slack: float = 0.05, bound: int = BOUND) -> DataFrame:
    """(scene, key, under): boxes whose bottom (y0) is within slack of another's top (y1), where both share floor space.

    Boxes meet by cell of the floor and by level of height, so many boxes on one level are parted by where they stand.
    """
    placed, grid = quad_cells(boxes, scene, ("x", "z"), bound)
    level = lambda y: F.floor(F.round(y / slack, 6))
    upper = placed.withColumn("__y", F.explode(F.array(*[level(F.col("y0")) + i for i in (-1, 0, 1)]))).alias("a")
    lower = placed.withColumn("__y", level(F.col("y1"))).alias("b")
    near = F.abs(F.round(F.col("a.y0") - F.col("b.y1"), 6)) <= slack
    overlap = reduce(lambda x, y: x & y, [(F.col(f"a.{c}0") < F.col(f"b.{c}1")) & (F.col(f"b.{c}0") < F.col(f"a.{c}1")) for c in "xz"])
    met = upper.join(lower, _same("a", "b", scene, "__level", "__i", "__k", "__y") & (F.col(f"a.{key}") != F.col(f"b.{key}")) & near & overlap & _mine("a", "b", ("x", "z"), grid))
    return met.select(F.col(f"a.{scene}").alias(scene), F.col(f"a.{key}").alias(key), F.col(f"b.{key}").alias("under"))


def voxel_runs(boxes: DataFrame, pitch: float, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """boxes with i, j, lo and hi: for each column of voxels that a box touches, from which voxel to before which along the last axis.

    Rows grow with the box's face, not with its volume.
    """
    cell = lambda c: F.floor(F.col(c) / pitch)
    a, b, c = axes
    runs = boxes.withColumn("lo", cell(f"{c}0")).withColumn("hi", cell(f"{c}1") + 1)
    return runs.withColumn("i", F.explode(F.sequence(cell(f"{a}0"), cell(f"{a}1")))).withColumn("j", F.explode(F.sequence(cell(f"{b}0"), cell(f"{b}1"))))


def covered(runs: DataFrame, by: list[str], least: int) -> DataFrame:
    """(by..., lo, hi): the stretches of each column in which at least so many runs lie, by a sweep over their ends.

    Ends at one place are added up first, so a column has at most as many rows as places, however many boxes.
    """
    ends = runs.select(*by, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*by, F.col("e.at").alias("lo")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*by).orderBy("lo")
    swept = steps.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.lead("lo").over(w))
    return swept.where((F.col("n") >= least) & F.col("hi").isNotNull()).select(*by, "lo", "hi")


def voxel_overlap(boxes: DataFrame, scene: str, pitch: float) -> DataFrame:
    """(scene, cells, volume): voxels of side `pitch` that two or more boxes of the scene touch."""
    shared = covered(voxel_runs(boxes, pitch), [scene, "i", "j"], 2)
    return shared.groupBy(scene).agg(F.sum(F.col("hi") - F.col("lo")).alias("cells"), (F.sum(F.col("hi") - F.col("lo")) * float(pitch**3)).alias("volume"))


def voxel_outside(boxes: DataFrame, rooms: DataFrame, scene: str, key: str, pitch: float) -> DataFrame:
    """(scene, key, cells, volume): the box's voxels that are in none of its scene's rooms (boxes, too; a room may be several)."""
    runs = voxel_runs(boxes, pitch)
    inside = covered(voxel_runs(rooms, pitch), [scene, "i", "j"], 1).withColumnRenamed("lo", "from").withColumnRenamed("hi", "to")
    held = runs.join(inside, [scene, "i", "j"]).where((F.col("lo") < F.col("to")) & (F.col("from") < F.col("hi")))
    held = held.groupBy(scene, key).agg(F.sum(F.least("hi", "to") - F.greatest("lo", "from")).alias("inside"))
    every = runs.groupBy(scene, key).agg(F.sum(F.col("hi") - F.col("lo")).alias("all"))
    cells = F.col("all") - F.coalesce("inside", F.lit(0))
    return every.join(held, [scene, key], "left").select(scene, key, cells.alias("cells"), (cells * float(pitch**3)).alias("volume"))
