"""Boxes and scenes: overlap joins, support, what lies outside a room, footprints and edits of nested scene documents."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from . import regions


def overlap(lo_a: list[Column], hi_a: list[Column], lo_b: list[Column], hi_b: list[Column]) -> Column:
    """Volume (or area) shared by two axis-aligned boxes."""
    sides = [F.greatest(F.least(ha, hb) - F.greatest(la, lb), F.lit(0.0)) for la, ha, lb, hb in zip(lo_a, hi_a, lo_b, hi_b, strict=True)]
    return reduce(lambda x, y: x * y, sides)


def box_pairs(boxes: DataFrame, scene: str, key: str, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(scene, a, b, volume) of the pairs a < b of a scene whose boxes overlap; boxes has `{axis}0` and `{axis}1`.

    Pairs are found in adaptive cells along the first and the last axis: see regions.quad_cells.
    """
    side = lambda t, i: [F.col(f"{t}.{x}{i}") for x in axes]
    volume = overlap(side("a", 0), side("a", 1), side("b", 0), side("b", 1))
    met = regions.touching_pairs(boxes, scene, key, (axes[0], axes[-1]))
    return met.select(F.col(f"a.{scene}").alias(scene), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), volume.alias("volume")).where("volume > 0")


def outside_volume(lo: list[Column], hi: list[Column], room_lo: list[Column], room_hi: list[Column]) -> Column:
    """Volume of a box that lies outside a room."""
    whole = reduce(lambda x, y: x * y, [h - low for low, h in zip(lo, hi, strict=True)])
    return whole - overlap(lo, hi, room_lo, room_hi)


def yaw(q: Column) -> Column:
    """Rotation about the vertical axis of a quaternion array (x, y, z, w)."""
    x, y, z, w = (F.get(q, F.lit(i)) for i in range(4))
    return F.atan2(2 * (w * y + x * z), 1 - 2 * (x * x + y * y))


def footprint(pos: Column, size: Column, angle: Column) -> Column:
    """Four corners (x, z) of a box's base turned by the angle."""
    c, s = F.cos(angle), F.sin(angle)

    def corner(i: int, j: int) -> Column:
        x, z = i * F.get(size, F.lit(0)) / 2, j * F.get(size, F.lit(2)) / 2
        return F.array(F.get(pos, F.lit(0)) + x * c + z * s, F.get(pos, F.lit(2)) - x * s + z * c)

    return F.array(*[corner(i, j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def clip_box(lo: Column, hi: Column, limit: Column, least: float) -> tuple[Column, Column]:
    """One side of a box cut to [0, limit], grown about its middle to at least `least` (as far as the limit allows)."""
    a, b = F.greatest(lo, F.lit(0.0)), F.least(hi, limit)
    want = F.least(F.greatest(b - a, F.lit(least)), limit)
    start = F.least(F.greatest((a + b) / 2 - want / 2, F.lit(0.0)), limit - want)
    return F.floor(start), F.ceil(start + want)


def flatten_groups(groups: Column) -> Column:
    """All groups' objects in one array."""
    return F.flatten(F.transform(groups, lambda g: g["objects"]))


def remove_objects(objects: Column, target: Column) -> Column:
    """Without every object whose jid or uid is the target; an empty target matches nothing."""
    return F.filter(objects, lambda o: ~is_target(o, target))


def change_first(objects: Column, target: Column, field: str, value: Column) -> Column:
    """The first object whose jid or uid is the target with another value of a field; none is no fault."""
    at = F.array_position(F.transform(objects, lambda o: is_target(o, target)), True)
    # An array of one is a name for the place; within the objects' lambda it would be sought again for each of them.
    return F.transform(F.array(at), lambda p: F.transform(objects, lambda o, i: F.when(i + 1 == p, o.withField(field, value)).otherwise(o)))[0]


#: An edit's fields besides its order: which of them count depends on its name.
EDIT = "name string, target string, desc string, pos array<double>, rot array<double>, size array<double>, group string"


def new_object(e: Column) -> Column:
    """The object that an add describes, without jid and uid, with what is left out filled in."""
    vector = lambda c, *v: F.coalesce(c, F.array(*[F.lit(float(x)) for x in v]))
    none = F.lit(None).cast("string")
    return F.struct(F.coalesce(e["desc"], F.lit("New furniture piece")).alias("desc"), none.alias("jid"), none.alias("uid"), vector(e["size"], 1, 1, 1).alias("size"), vector(e["pos"], 0, 0, 0).alias("pos"), vector(e["rot"], 0, 0, 0, 1).alias("rot"))


def is_target(o: Column, target: Column) -> Column:
    """Whether an object's jid or uid is the target; an empty target and null are nothing's."""
    return (F.coalesce(target, F.lit("")) != "") & (o["jid"].eqNullSafe(target) | o["uid"].eqNullSafe(target))


def edit_kind(name: Column) -> Column:
    """add, remove, move, rotate, scale or replace, for these names with or without `_object`; null for others."""
    return F.coalesce(*[F.when(name.isin(k, f"{k}_object"), F.lit(k)) for k in ("add", "remove", "move", "rotate", "scale", "replace")])


def whole_object(o: Column, have: list[str]) -> Column:
    """An object with all fields, null where it has none of the name."""
    kinds = {"desc": "string", "jid": "string", "uid": "string", "size": "array<double>", "pos": "array<double>", "rot": "array<double>"}
    return F.struct(*[(o[n] if n in have else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def apply_edits(scenes: DataFrame, edits: DataFrame, scene: str, order: str) -> DataFrame:
    """(scene, objects) after each scene's edits in order.

    scenes: (scene, objects array<struct<desc, jid, uid, size, pos, rot>>, of which some may be missing); edits: (scene,
    order, and the fields of EDIT). Names are add, remove, move, rotate, scale and replace, also with `_object`; all but
    add and remove change the first object that is the target; terminate ends a scene's edits, others are skipped.
    """
    have = scenes.schema["objects"].dataType.elementType.fieldNames()
    one = F.struct(F.lit("").alias("group_name"), F.transform("objects", lambda o: whole_object(o, have)).alias("objects"))
    x = _after_edits(scenes.select(scene, F.array(one).alias("groups")), edits.withColumn("group", F.lit("")), scene, order)
    return x.select(scene, F.get("groups", F.lit(0))["objects"].alias("objects"))


def apply_group_edits(scenes: DataFrame, edits: DataFrame, scene: str, order: str) -> DataFrame:
    """(scene, groups) after each scene's edits; scenes: (scene, groups array<struct<group_name, objects>>).

    An add goes to the group it names (default_group if none), which is made if it isn't there; a remove takes the target
    out of all groups, other edits change the first group that holds it.
    """
    have = scenes.schema["groups"].dataType.elementType["objects"].dataType.elementType.fieldNames()
    whole = F.transform("groups", lambda g: F.struct(g["group_name"].alias("group_name"), F.transform(g["objects"], lambda o: whole_object(o, have)).alias("objects")))
    return _after_edits(scenes.select(scene, whole.alias("groups")), edits, scene, order)


#: Places and numbers of what edits add come after all that a scene had.
_ADDED = 1 << 40


def _after_edits(scenes: DataFrame, edits: DataFrame, scene: str, order: str) -> DataFrame:
    """Edits as joins, so that a scene costs what its objects and edits are, not their product.

    What is added has no id, so it is no later edit's target: an object's changes are those of its own ids. Which object an
    edit hits follows from the edits before it (`_hits`); of several moves, turns or sizes of an object the last counts.
    Scenes are written once, numbered, so that equal names stay several scenes.
    """
    kinds = [x.split() for x in EDIT.split(", ")]
    have = {c.lower() for c in edits.columns}
    fields = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in kinds]
    is_id = lambda c: F.coalesce(c, F.lit("")) != ""
    two = lambda o: is_id(o["jid"]) & is_id(o["uid"]) & (o["jid"] != o["uid"])
    linked = F.exists("groups", lambda g: F.coalesce(F.exists(g["objects"], two), F.lit(False)))
    heads = F.transform("groups", lambda g: F.struct(g["group_name"].alias("name"), g["objects"].isNull().alias("none")))
    held = staged(scenes.select(F.monotonically_increasing_id().alias("row"), F.col(scene).alias("scene"), heads.alias("heads"), F.coalesce(linked, F.lit(False)).alias("linked"), "groups"), "scenes")

    turns = Window.partitionBy("scene").orderBy("order", *[n for n, _ in kinds])
    ended = F.count(F.when(F.col("name") == "terminate", 1)).over(turns.rowsBetween(Window.unboundedPreceding, -1))
    numbered = edits.select(F.col(scene).alias("scene"), F.col(order).alias("order"), *fields).withColumn("n", F.row_number().over(turns).cast("long")).withColumn("ended", ended)
    live = numbered.withColumn("kind", edit_kind(F.col("name"))).where("ended = 0 and kind is not null").drop("order", "name", "ended").join(held.select("scene", "row", "linked"), "scene").drop("scene")

    listed = F.filter(F.transform("groups", lambda g, i: F.transform(g["objects"], lambda o: F.struct(i.cast("long").alias("g"), o.alias("o")))), lambda x: x.isNotNull())
    places = held.select("row", "linked", F.posexplode(F.flatten(listed)).alias("at", "x")).select("row", "linked", F.col("at").cast("long").alias("at"), "x.g", "x.o")
    hits = _hits(places.select("row", "linked", "at", "o.jid", "o.uid"), live.where(F.col("kind") != "add").where(is_id(F.col("target"))), not held.where("linked").isEmpty())
    last = lambda kind, field: F.max(F.when(F.col("kind") == kind, F.struct("n", field))).alias(kind)
    changes = hits.groupBy("row", "at").agg(last("move", "pos"), last("rotate", "rot"), last("scale", "size"), last("replace", "desc"), F.max(F.col("kind") == "remove").alias("removed"))
    now = lambda kind, field: F.when(F.col(kind).isNull(), F.col(f"o.{field}")).otherwise(F.col(f"{kind}.{field}")).alias(field)
    desc = F.when(F.col("replace").isNull(), F.col("o.desc")).otherwise(F.coalesce("replace.desc", F.lit("Replacement object"))).alias("desc")
    kept = [F.when(F.col("replace").isNull(), F.col(f"o.{i}")).alias(i) for i in ("jid", "uid")]
    changed = F.struct(desc, *kept, now("scale", "size"), now("move", "pos"), now("rotate", "rot"))
    old = places.join(changes, ["row", "at"], "left").where(~F.coalesce("removed", F.lit(False))).select("row", "g", "at", F.lit(None).cast("string").alias("name"), changed.alias("o"))

    groups = held.select("row", F.posexplode("heads").alias("g", "head")).select("row", F.col("g").cast("long").alias("g"), "head")
    first = groups.groupBy("row", F.col("head.name").alias("name")).agg(F.min("g").alias("there"))
    adds = live.where(F.col("kind") == "add").select("row", F.coalesce("group", F.lit("default_group")).alias("name"), "n", new_object({n: F.col(n) for n, _ in kinds}).alias("o"))
    made = adds.join(first, ["row", "name"], "left").withColumn("g", F.coalesce("there", F.min("n").over(Window.partitionBy("row", "name")) + _ADDED))
    both = old.unionByName(made.select("row", "g", (F.col("n") + _ADDED).alias("at"), "name", "o"))
    filled = both.groupBy("row", "g").agg(F.max("name").alias("name"), F.transform(F.sort_array(F.collect_list(F.struct("at", "o"))), lambda x: x["o"]).alias("objects"))
    empty = F.from_json(F.lit("[]"), dict(filled.dtypes)["objects"])
    objects = F.when(F.coalesce("head.none", F.lit(False)), F.lit(None)).otherwise(F.coalesce("objects", empty))
    part = F.struct("g", F.struct(F.coalesce("head.name", "name").alias("group_name"), objects.alias("objects")).alias("part"))
    whole = filled.join(groups, ["row", "g"], "full").groupBy("row").agg(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]).alias("groups"))
    none = F.from_json(F.lit("[]"), dict(whole.dtypes)["groups"])
    return held.select("row", F.col("scene").alias(scene), "heads").join(whole, "row", "left").select(scene, F.when(F.col("heads").isNotNull(), F.coalesce("groups", none)).alias("groups"))


def _hits(objects: DataFrame, edits: DataFrame, linked: bool) -> DataFrame:
    """edits (row, n, kind, target, ...) with the place `at` of each object that they hit; objects: (row, linked, at, jid, uid).

    An edit's object is the first that still has the id: the k-th by place if k - 1 were replaced before, none once they
    were removed. That holds where no object has two different ids; rows that have one are `linked`, and their edits are
    read in order, ids and numbers only.
    """
    ids = objects.where("not linked").select("row", "at", F.explode(F.array_distinct(F.array("jid", "uid"))).alias("target")).where("target <> ''")
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("row", "target").orderBy("at")))
    past = Window.partitionBy("row", "target").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).over(past)
    asked = edits.where("not linked").withColumn("gone", before("replace")).withColumn("removed", before("remove")).where("removed = 0").drop("removed")
    one = asked.where("kind <> 'remove'").withColumn("rank", (F.col("gone") + 1).cast("int")).join(ranked, ["row", "target", "rank"])
    rest = asked.where("kind = 'remove'").join(ranked, ["row", "target"]).where("rank > gone")
    out = one.select(*edits.columns, "at").unionByName(rest.select(*edits.columns, "at"))
    if not linked:
        return out

    def follow(places: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        holders: dict[str, list[int]] = {}
        places, asked = places.sort_values("at", ascending=False), asked.sort_values("n")
        for at, *names in zip(places["at"].tolist(), places["jid"], places["uid"], strict=True):
            for i in {x for x in names if x}:
                holders.setdefault(i, []).append(at)
        gone: set[int] = set()
        found: list[tuple[int, int]] = []
        for n, kind, target in zip(asked["n"].tolist(), asked["kind"], asked["target"], strict=True):
            have = holders.get(target, [])
            while have and have[-1] in gone:
                have.pop()
            hit = [x for x in have if x not in gone] if kind == "remove" else have[-1:]
            if kind in ("remove", "replace"):
                gone.update(hit)
            if kind == "remove":
                have.clear()
            found += [(n, x) for x in hit]
        row = asked["of"].iloc[0] if len(asked) else None
        return pd.DataFrame({"row": [row] * len(found), "n": [n for n, _ in found], "at": [x for _, x in found]})

    several = edits.where("linked")
    read = objects.where("linked").select("row", "at", "jid", "uid").groupBy("row").cogroup(several.select(F.col("row").alias("of"), "n", "kind", "target").groupBy("of")).applyInPandas(follow, "row long, n long, at long")
    return out.unionByName(several.join(read, ["row", "n"]).select(*edits.columns, "at"))


def inside_polygons(x: np.ndarray, z: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Whether points (rows, points) are in their row's polygon (rows, corners, 2): an odd number of sides cross the ray to
    their right. Points whose ray meets a side without a number are not."""
    inside, known = np.zeros(x.shape, bool), np.ones(x.shape, bool)
    with np.errstate(all="ignore"):
        for a, b in zip(np.moveaxis(corners, 1, 0), np.moveaxis(np.roll(corners, -1, 1), 1, 0), strict=True):
            (ax, az), (bx, bz) = a.T[:, :, None], b.T[:, :, None]
            over = ((az > z) != (bz > z)) | np.isnan(az + bz)
            cut = (bx - ax) * (z - az) / (bz - az) + ax
            known &= ~(over & np.isnan(cut))
            inside ^= over & (x < cut)
    return inside & known


def beside_polygons(x: np.ndarray, z: np.ndarray, corners: np.ndarray, slack: float) -> np.ndarray:
    """Whether points (rows, points) are less than `slack` from a side of their row's polygon (rows, corners, 2)."""
    near = np.zeros(x.shape, bool)
    with np.errstate(all="ignore"):
        for a, b in zip(np.moveaxis(corners, 1, 0), np.moveaxis(np.roll(corners, -1, 1), 1, 0), strict=True):
            (ax, az), (dx, dz) = a.T[:, :, None], (b - a).T[:, :, None]
            size = dx * dx + dz * dz
            along = np.clip(np.where(size > 0, ((x - ax) * dx + (z - az) * dz) / size, 0.0), 0.0, 1.0)
            near |= (x - ax - along * dx) ** 2 + (z - az - along * dz) ** 2 < slack * slack
    return near


def outside_share(lo: list[Column], hi: list[Column], floor: Column, height: Column, steps: int = 8, slack: float = 0.001) -> Column:
    """Share of a box's points, at the middles of steps ** 3 cells, that lie outside a room: a polygon floor and a height.

    That is a share of the box's volume by a grid; out_of_bounds draws points on the surface. Points within `slack` of the
    height count as inside; a box or room without numbers has all points outside. Whole Arrow batches at a time, a thousand
    rows at once.
    """

    def shares(box: np.ndarray, corners: np.ndarray, top: np.ndarray) -> np.ndarray:
        x, y, z = (box[:, i, None] + (box[:, i + 3, None] - box[:, i, None]) * (np.arange(steps) + 0.5) / steps for i in range(3))
        flat = inside_polygons(np.repeat(x, steps, axis=1), np.tile(z, (1, steps)), corners).sum(axis=1)
        tall = ((y >= -slack) & (y <= top[:, None] + slack)).sum(axis=1)
        return 1 - flat * tall / float(steps**3)

    def run(sides: pa.Array, room: pa.Array, top: pa.Array) -> pa.Array:
        box = sides.flatten().to_numpy(zero_copy_only=False).reshape(-1, 6)
        sizes, top = np.asarray(room.value_lengths().fill_null(0)), top.to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.ones(len(box))
        for n in {*sizes.tolist()} - {0}:  # a few kinds of polygons, not rows
            kind = np.flatnonzero(sizes == n)
            for rows in np.array_split(kind, -(-len(kind) // 1000)):
                held = room.take(pa.array(rows)).flatten()
                corners = np.stack([pc.list_element(pc.if_else(pc.equal(pc.list_value_length(held), 2), held, nowhere), i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
                out[rows] = shares(box[rows], corners.reshape(len(rows), n, 2), top[rows])
        return pa.array(out)

    nowhere = pa.scalar([None, None], pa.list_(pa.float64()))
    run.__annotations__ = {"sides": pa.Array, "room": pa.Array, "top": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(F.array(*[c.cast("double") for c in (*lo, *hi)]), floor.cast("array<array<double>>"), height.cast("double"))


def uniform_numbers(seeds: np.ndarray, n: int) -> np.ndarray:
    """The first n numbers in [0, 1) of the splitmix64 generator for each seed of 64 bits: (seeds, n)."""
    z = seeds.astype(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def box_mesh(lo: list[Column], hi: list[Column]) -> Column:
    """An axis-aligned box as a mesh: two triangles a face, corners against the clock as seen from outside."""

    def corner(axis: int, end: Column, i: int, j: int) -> Column:
        b, c = (axis + 1) % 3, (axis + 2) % 3
        at = {axis: end, b: (lo, hi)[i][b], c: (lo, hi)[j][c]}
        return F.array(*[at[k].cast("double") for k in range(3)])

    def face(axis: int, end: Column, one: tuple[int, int], other: tuple[int, int]) -> list[Column]:
        return [F.array(*[corner(axis, end, *ij) for ij in (start, *ends)]) for start, ends in (((0, 0), (one, other)), ((1, 1), (other, one)))]

    sides = [(axis, end, order) for axis in range(3) for end, order in ((lo[axis], ((0, 1), (1, 0))), (hi[axis], ((1, 0), (0, 1))))]
    return F.array(*[triangle for axis, end, order in sides for triangle in face(axis, end, *order)])


def out_of_bounds(mesh: Column, floor: Column, low: Column, high: Column, key: Column, seed: str = "42", points: int = 500, tolerated: float = 0.01, slack: float = 0.001) -> Column:
    """Struct (share, outside, volume) of an object in a room: the share of `points` random points of its surface that lie
    outside the room, whether it is over `tolerated`, and then that share of the object's volume, else 0.

    mesh: triangles of three corners (x, y, z), see box_mesh; floor: the corners (x, z) of a polygon; low and high: floor and
    ceiling. A triangle is drawn as often as it is large and any point of it alike, by three of uniform_numbers a point, whose
    seed is the first half of the md5 of seed and key. Points less than `slack` from the polygon or within it of floor and
    ceiling are inside; those without numbers are not. The share is 1 less the share inside, so 5 of 500 points come to more
    than 0.01 by a rounding, as in the reference. A mesh without a volume (open, or inside out) counts its bounding box's.
    Where nothing can be drawn or told, for want of a triangle or of three corners of the floor, share is null, and an object
    whose bounding box leaves the room's is outside by a tenth of its volume; outside and volume are null if a box is unknown.
    """

    def surface(corners: np.ndarray, doubled: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, ...]:
        pick, u, v = np.moveaxis(uniform_numbers(seeds, 3 * points).reshape(len(seeds), points, 3), 2, 0)
        sums = np.cumsum(np.sqrt((doubled**2).sum(axis=2)), axis=1)
        at = np.stack([np.searchsorted(s, p) for s, p in zip(sums, pick * sums[:, -1:], strict=True)]).clip(max=sums.shape[1] - 1)
        far = u + v > 1  # beyond the third side: the parallelogram's other half is turned over
        u, v = np.where(far, 1 - u, u), np.where(far, 1 - v, v)
        start = corners[:, :, :1]
        sides = np.concatenate((start, corners[:, :, 1:] - start), axis=2).reshape(-1, 9)
        held = sides[at + np.arange(len(seeds))[:, None] * sums.shape[1]]
        return tuple(held[:, :, i] + u * held[:, :, i + 3] + v * held[:, :, i + 6] for i in range(3))

    def judged(corners: np.ndarray, room: np.ndarray, low: np.ndarray, high: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, ...]:
        doubled = np.cross(corners[:, :, 1] - corners[:, :, 0], corners[:, :, 2] - corners[:, :, 0])
        ends = [f(corners, axis=(1, 2)) for f in (np.min, np.max)]
        volume = (doubled[:, :, 0] * corners[:, :, :, 0].sum(axis=2)).sum(axis=1) / 6
        volume = np.where(volume > 0, volume, np.prod(ends[1] - ends[0], axis=1))
        if room.shape[1] < 3:
            walls = [np.stack((w[:, 0], y, w[:, 1]), axis=1) for w, y in ((room.min(axis=1), low), (room.max(axis=1), high))]
            known = ~np.isnan(np.hstack((*ends, *walls))).any(axis=1)
            beyond = ((ends[0] < walls[0]) | (ends[1] > walls[1])).any(axis=1)
            return np.full(len(seeds), np.nan), np.where(known, beyond, np.nan), np.where(known, np.where(beyond, volume * 0.1, 0.0), np.nan)
        x, y, z = surface(corners, doubled, seeds)
        flat = inside_polygons(x, z, room) | beside_polygons(x, z, room, slack)
        inside = flat & (y >= low[:, None] - slack) & (y <= high[:, None] + slack)
        share = 1.0 - inside.sum(axis=1) / points
        return share, share > tolerated, np.where(share > tolerated, volume * share, 0.0)

    def run(mesh: pa.Array, floor: pa.Array, low: pa.Array, high: pa.Array, digest: pa.Array) -> pa.Array:
        sizes = [np.asarray(v.value_lengths().fill_null(0)) for v in (mesh, floor)]
        low, high = (v.to_numpy(zero_copy_only=False).astype(np.float64) for v in (low, high))
        seeds = np.frombuffer(b"".join(digest.to_pylist()), ">u8")[::2]
        out = np.full((3, len(seeds)), np.nan)
        for m, n in {*zip(sizes[0].tolist(), sizes[1].tolist(), strict=True)}:  # kinds of meshes and polygons
            if m == 0 or n == 0:
                continue
            kind = np.flatnonzero((sizes[0] == m) & (sizes[1] == n))
            for rows in np.array_split(kind, min(len(kind), -(-len(kind) * max(m, 3 * points) // 100_000))):  # a MB at once, or a row
                corners, room = (v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1, *s) for v, s in ((mesh, (3, 3)), (floor, (2,))))
                with np.errstate(all="ignore"):
                    out[:, rows] = judged(corners, room, low[rows], high[rows], seeds[rows])
        unknown = np.isnan(out)
        fields = [pa.array(v.astype(bool) if i == 1 else v, mask=unknown[i]) for i, v in enumerate(out)]
        return pa.StructArray.from_arrays(fields, ["share", "outside", "volume"])

    run.__annotations__ = dict.fromkeys(("mesh", "floor", "low", "high", "digest", "return"), pa.Array)
    nowhere = lambda n: F.array(*[F.lit(None).cast("double")] * n)
    triangles = F.transform(mesh.cast("array<array<array<double>>>"), lambda t: F.when((F.size(t) == 3) & F.forall(t, lambda p: F.size(p) == 3), F.flatten(t)).otherwise(nowhere(9)))
    corners = F.transform(floor.cast("array<array<double>>"), lambda p: F.when(F.size(p) == 2, p).otherwise(nowhere(2)))
    digest = F.unhex(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))))
    return F.arrow_udf(run, "share double, outside boolean, volume double")(F.flatten(triangles), F.flatten(corners), low.cast("double"), high.cast("double"), digest)


def convex_overlap(p: list, q: list) -> float:
    """Area that two convex polygons (lists of (x, z), either direction) share: p cut by each side of q."""

    def area(poly: list) -> float:
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(poly, poly[1:] + poly[:1], strict=True)) / 2

    p, q = [tuple(x) for x in p], [tuple(x) for x in q]
    if area(q) < 0:
        q = q[::-1]
    for (ax, az), (bx, bz) in zip(q, q[1:] + q[:1], strict=True):
        side = [(bx - ax) * (z - az) - (bz - az) * (x - ax) for x, z in p]
        out = []
        for i, (x, z) in enumerate(p):
            before, now = side[i - 1], side[i]
            if before * now < 0:
                t = before / (before - now)
                px, pz = p[i - 1]
                out.append((px + t * (x - px), pz + t * (z - pz)))
            if now >= 0:
                out.append((x, z))
        p = out
        if len(p) < 3:
            return 0.0
    return abs(area(p))


def _turned(p: np.ndarray) -> np.ndarray:
    """Twice the signed area of each polygon of (rows, corners, 2)."""
    x, z = p[:, :, 0], p[:, :, 1]
    return (x * np.roll(z, -1, 1) - np.roll(x, -1, 1) * z).sum(axis=1)


def convex_overlaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """convex_overlap of many pairs at once: (rows, corners, 2) each.

    Every row's p is cut by the same side of its q in one step: corners are marked as kept, cuts are put before them, and
    what is left moves to the front. Rows differ in how many corners they have left, so that number goes along.
    """
    q = np.where((_turned(q) < 0)[:, None, None], q[:, ::-1], q)
    n, m = p.shape[:2]
    count = np.full(n, m)
    for a, b in zip(np.moveaxis(q, 1, 0), np.moveaxis(np.roll(q, -1, 1), 1, 0), strict=True):
        there = np.arange(p.shape[1])[None, :] < count[:, None]
        side = (b - a)[:, None, 0] * (p[:, :, 1] - a[:, None, 1]) - (b - a)[:, None, 1] * (p[:, :, 0] - a[:, None, 0])
        prior = (np.arange(p.shape[1])[None, :] - 1) % np.maximum(count, 1)[:, None]
        before, was = np.take_along_axis(side, prior, 1), np.take_along_axis(p, prior[:, :, None], 1)
        crosses = there & (before * side < 0)
        t = before / np.where(crosses, before - side, 1.0)
        cut = was + t[:, :, None] * (p - was)
        points = np.stack((cut, p), axis=2).reshape(n, -1, 2)
        keep = np.stack((crosses, there & (side >= 0)), axis=2).reshape(n, -1)
        order = np.argsort(~keep, axis=1, kind="stable")
        count = keep.sum(axis=1)
        width = max(int(count.max(initial=0)), 1)
        p = np.take_along_axis(points, order[:, :width, None], 1)
    there = np.arange(p.shape[1])[None, :] < count[:, None]
    p = np.where(there[:, :, None], p, p[:, :1])  # corners beyond the last fall on the first and add nothing
    return np.where(count < 3, 0.0, np.abs(_turned(p)) / 2)


def footprint_overlap(a: Column, b: Column) -> Column:
    """convex_overlap of two footprint columns (arrays of corners), whole Arrow batches at a time; null for null or fewer than three corners."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        sizes = [np.asarray(v.value_lengths().fill_null(0)) for v in (x, y)]
        out = np.full(len(x), np.nan)
        for m, k in {*zip(sizes[0].tolist(), sizes[1].tolist(), strict=True)}:  # a few kinds of polygons, not rows
            if min(m, k) < 3:
                continue
            rows = np.flatnonzero((sizes[0] == m) & (sizes[1] == k))
            p, q = (v.take(pa.array(rows)).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), c, 2) for v, c in ((x, m), (y, k)))
            out[rows] = convex_overlaps(p, q)
        return pa.array(out, mask=np.isnan(out))

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def repair(scenes: DataFrame, scene: str, size: float, step: float = 0.2, rounds: int = 50) -> DataFrame:
    """(scene, key, x, z, removed): boxes outside [0, size] move step by step towards the middle, those that never fit are removed.

    scenes: (scene, key, x, z, w), w being the side of a box. A scene is one room's boxes, so a small group; nothing is random.
    """

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.sort_values("key").copy()
        for c in ("x", "z"):
            for _ in range(rounds):
                low, high = out[c] - out["w"] / 2 < 0, out[c] + out["w"] / 2 > size
                if not (low | high).any():
                    break
                out[c] += step * (low.astype(float) - high.astype(float)) * ~(low & high)
        fits = out["w"] <= size
        for c in ("x", "z"):
            fits &= (out[c] - out["w"] / 2 >= -1e-9) & (out[c] + out["w"] / 2 <= size + 1e-9)
        return out.assign(removed=~fits)[[scene, "key", "x", "z", "removed"]]

    kind = dict(scenes.dtypes)[scene]
    return scenes.groupBy(scene).applyInPandas(fix, f"{scene} {kind}, key long, x double, z double, removed boolean")
