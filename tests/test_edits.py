"""Edits of scenes with many objects: by hand, by brute force and within a time that grows with the scene, not its square."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from sparkloom.operators import geometry

OBJECT = "struct<desc:string,jid:string,uid:string,size:array<double>,pos:array<double>,rot:array<double>>"


def test_change_first_of_a_large_scene(spark):
    n = 40_000
    scenes = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i % 30_000).cast("string").alias("jid"), F.lit(None).cast("string").alias("uid"), F.array(i * 1.0).alias("pos"))).alias("objects"))
    at = time.time()
    x = scenes.select(geometry.change_first(F.col("objects"), F.lit("7"), "pos", F.array(F.lit(-1.0))).alias("o")).select(F.posexplode("o"))
    assert [(r.pos, r.col.pos) for r in x.where("col.pos[0] <> pos").collect()] == [(7, [-1.0])] and x.count() == n
    assert time.time() - at < 40


def test_a_large_scene_grows_by_adds(spark):
    """Each add goes behind those before it, into a group that the first one makes."""
    n = 30_000
    scenes = spark.createDataFrame([("s", []), ("t", None)], f"scene string, groups array<struct<group_name:string,objects:array<{OBJECT}>>>")
    edits = spark.range(n).select(F.lit("s").alias("scene"), F.col("id").alias("turn"), F.lit("add").alias("name"), F.lit("").alias("target"), F.col("id").cast("string").alias("desc"), F.concat(F.lit("g"), F.col("id") % 3).alias("group"))
    at = time.time()
    got = {r.scene: r.groups for r in geometry.apply_group_edits(scenes, edits, "scene", "turn").collect()}
    assert got["t"] is None and [(g.group_name, [int(o.desc) for o in g.objects]) for g in got["s"]] == [(f"g{i}", list(range(i, n, 3))) for i in range(3)]
    assert time.time() - at < 60


def test_null_is_nothings_id(spark):
    scenes = spark.createDataFrame([("s", [("d", "1", None, [1.0], [1.0], [1.0])])], f"scene string, objects array<{OBJECT}>")
    edits = spark.createDataFrame([("s", 1, "remove", None), ("s", 2, "move", None)], "scene string, turn int, name string, target string")
    assert [o.jid for o in geometry.apply_edits(scenes, edits, "scene", "turn").first().objects] == ["1"]


def _scene(spark, n, name):
    """n objects, of which each gets an edit by its id."""
    at = lambda x: F.array(x * 1.0)
    o = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit("d").alias("desc"), i.cast("string").alias("jid"), F.lit(None).cast("string").alias("uid"), at(i).alias("size"), at(i).alias("pos"), at(i).alias("rot")))
    edits = spark.range(n).select(F.lit("s").alias("scene"), F.col("id").alias("turn"), name.alias("name"), F.col("id").cast("string").alias("target"), F.lit("new").alias("desc"), *[F.array(F.lit(-1.0)).alias(f) for f in ("pos", "rot", "size")])
    return spark.range(1).select(F.lit("s").alias("scene"), o.alias("objects")), edits


def test_a_large_scene_of_moves_turns_and_removals(spark):
    n, names = 20_000, F.array(*[F.lit(x) for x in ("move", "rotate", "scale", "remove")])
    scenes, edits = _scene(spark, n, F.get(names, (F.col("id") % 4).cast("int")))
    at = time.time()
    got = [(o.jid, o.pos[0], o.rot[0], o.size[0]) for o in geometry.apply_edits(scenes, edits, "scene", "turn").first().objects]
    assert got == [(str(i), *[-1.0 if i % 4 == k else float(i) for k in range(3)]) for i in range(n) if i % 4 < 3]
    assert time.time() - at < 60


def test_one_id_of_many_objects(spark):
    """Replacements of an id go from object to object; a removal takes what is left, also where objects have two ids."""
    n = 6_000
    for uid in (None, "u"):
        scenes, _ = _scene(spark, n, F.lit("x"))
        scenes = scenes.withColumn("objects", F.transform("objects", lambda o: F.struct(o["desc"], F.lit("a").alias("jid"), F.lit(uid).cast("string").alias("uid"), o["size"], o["pos"], o["rot"])))  # noqa: B023
        edits = spark.range(n).select(F.lit("s").alias("scene"), F.col("id").alias("turn"), F.when(F.col("id") == n // 2, "remove").otherwise("replace").alias("name"), F.lit("a").alias("target"), F.col("id").cast("string").alias("desc"))
        at = time.time()
        got = [(o.desc, o.jid, o.pos[0]) for o in geometry.apply_edits(scenes, edits, "scene", "turn").first().objects]
        assert got == [(str(i), None, float(i)) for i in range(n // 2)]
        assert time.time() - at < 60
