"""Joins, geometry, scenes, balancing, sources and data preparation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scans
from ..functions import text as X
from ..operators import balance, batch, geometry, matching, prepare, regions
from ..operators import groups as G
from ..session import if_small, scratch
from ..sources import files
from .common import r, table


def _boxes(s, d):
    """A box a part, its brand the scene."""
    p, k = table(s, d, "part"), F.col("p_partkey")
    x, y, z = (k * 7 % 101) / 2.0, (k * 13 % 89) / 2.0, (k * 29 % 97) / 2.0
    w = F.col("p_size") / 10.0
    return p.select("p_brand", k.alias("key"), x.alias("x0"), (x + w).alias("x1"), y.alias("y0"), (y + w).alias("y1"), z.alias("z0"), (z + w).alias("z1"))


_BOX = "(select p_brand, p_partkey as key, (p_partkey * 7 % 101) / 2.0::double as x0, (p_partkey * 7 % 101) / 2.0::double + p_size / 10.0::double as x1, (p_partkey * 13 % 89) / 2.0::double as y0, (p_partkey * 13 % 89) / 2.0::double + p_size / 10.0::double as y1, (p_partkey * 29 % 97) / 2.0::double as z0, (p_partkey * 29 % 97) / 2.0::double + p_size / 10.0::double as z1 from part)"
_SIDE = "greatest(least(a.{0}1, b.{0}1) - greatest(a.{0}0, b.{0}0), 0)"
_VOL = " * ".join(_SIDE.format(c) for c in "xyz")


def j07_box_pairs(s, d):
    return geometry.box_pairs(_boxes(s, d), "p_brand", "key").select("p_brand", "a", "b", r("volume", 4).alias("volume"))


def j09_supported(s, d):
    return regions.supported(_boxes(s, d), "p_brand", "key").select("key").distinct()


def j02_tiered_match(s, d):
    """Customers to nations by id, else by a number derived from theirs; the first tier wins."""
    c, n = table(s, d, "customer"), if_small(table(s, d, "nation"))
    exact = c.where("c_custkey % 2 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey")
    near = c.join(n, F.col("c_custkey") % 25 == F.col("n_nationkey")).select("c_custkey", F.col("n_nationkey"))
    return matching.first_tier("c_custkey", exact, near, order="n_nationkey")


def j04_fallback_lookup(s, d):
    li = table(s, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    a = li.where("l_discount > 0.05").groupBy("p_partkey").agg(F.max("l_quantity").alias("q"))
    b = li.groupBy("p_partkey").agg(F.min("l_quantity").alias("q"))
    return matching.fallback_lookup(table(s, d, "part").select("p_partkey"), "p_partkey", "q", a, b)


def j05_either_key(s, d):
    """OR of two keys as a union of two equi-joins."""
    s1, li = table(s, d, "supplier").select("s_suppkey"), table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return matching.either_key(li, s1, ("l_suppkey", "s_suppkey"), ("l_partkey", "s_suppkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"))


def j06_resume(s, d):
    return matching.skip_existing(table(s, d, "documents"), table(s, d, "labels").where("quality = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


def j10_valid_ids(s, d):
    x = prepare.known_ids(table(s, d, "events"), "user_id", table(s, d, "customer").select("c_custkey"), "event_type", 0.2)
    return x.withColumn("penalty", r("penalty", 4))


def n47_footprint(s, d):
    p = table(s, d, "part")
    half = (F.col("p_size") % 7) / 10.0
    q = F.array(F.lit(0.0), F.sin(half), F.lit(0.0), F.cos(half))
    angle = geometry.yaw(q)
    size, pos = F.array(F.col("p_size") / 10.0, F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0))
    c = geometry.footprint(pos, size, angle)
    return p.select("p_partkey", r(angle).alias("yaw"), r(c[0][0]).alias("x"), r(c[0][1]).alias("z"))


def n50_outside(s, d):
    b = _boxes(s, d)
    side = lambda i: [F.col(f"{c}{i}") for c in "xyz"]
    v = geometry.outside_volume(side(0), side(1), [F.lit(0.0)] * 3, [F.lit(50.0), F.lit(40.0), F.lit(45.0)])
    return b.select("key", r(v, 4).alias("outside"), (F.round(v, 6) > 0).alias("out"))


def n51_cells(s, d):
    """Voxels of side 5 that boxes of a scene share."""
    return regions.voxel_overlap(_boxes(s, d), "p_brand", 5).select("p_brand", "cells", r("volume", 1).alias("volume"))


def n52_voxel_outside(s, d):
    """Voxels of side 5 of each box outside its scene's room, which is two boxes."""
    b = _boxes(s, d)
    corner = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x0", "x1", "y0", "y1", "z0", "z1"), v, strict=True)])
    rooms = b.select("p_brand").distinct().withColumn("r", F.explode(F.array(corner(0, 49, 0, 39, 0, 29), corner(0, 24, 0, 39, 0, 44)))).select("p_brand", "r.*")
    return regions.voxel_outside(b, rooms, "p_brand", "key", 5).select("key", "cells", r("volume", 1).alias("volume"))


def n57_clip_box(s, d):
    p = table(s, d, "part")
    lo, hi = geometry.clip_box(F.col("p_size") - 10.0, F.col("p_size") + (F.col("p_partkey") % 30).cast("double"), F.lit(45.0), 28.0)
    return p.select("p_partkey", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def _scene(s, d):
    p = table(s, d, "part")
    o = F.struct(F.col("p_partkey").cast("string").alias("jid"), F.lit(None).cast("string").alias("uid"), F.array((F.col("p_size") * 1.0), F.lit(0.0)).alias("pos"))
    return p.groupBy("p_brand").agg(F.sort_array(F.collect_list(o)).alias("objects"))


def t48_flatten(s, d):
    p = table(s, d, "part")
    g = p.groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_list(F.struct("p_partkey"))).alias("objects"))
    x = g.groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_type").alias("group_name"), "objects")).alias("groups"))
    flat = geometry.flatten_groups(F.col("groups"))
    return x.select("p_brand", F.size("groups").alias("groups"), F.size(flat).alias("objects"), F.aggregate(flat, F.lit(0).cast("long"), lambda a, o: a + o["p_partkey"]).alias("total"))


def t50_remove(s, d):
    x = _scene(s, d)
    return x.select("p_brand", F.size(geometry.remove_objects(F.col("objects"), F.lit("7"))).alias("n"))


def t51_move_first(s, d):
    x = _scene(s, d)
    moved = geometry.change_first(F.col("objects"), F.get("objects", F.lit(1))["jid"], "pos", F.array(F.lit(-5.0), F.lit(1.0)))
    return x.select("p_brand", r(F.aggregate(moved, F.lit(0.0), lambda a, o: a + o["pos"][0]), 2).alias("total"))


def t53_apply_edits(s, d):
    """All kinds of edits over scenes of a brand and size, so a scene is small."""
    p = table(s, d, "part")
    key, x = F.col("p_partkey"), F.col("p_size") * 1.0
    o = F.struct(F.lit("d").alias("desc"), key.cast("string").alias("jid"), F.lit(None).cast("string").alias("uid"), F.array(x).alias("size"), F.array(x).alias("pos"), F.array(x).alias("rot"))
    scenes = p.groupBy("p_brand", "p_size").agg(F.sort_array(F.collect_list(o)).alias("objects")).withColumn("scene", F.concat_ws(":", "p_brand", "p_size"))
    names = F.array(*[F.lit(n) for n in ("remove_object", "move_object", "add_object", "rotate_object", "scale_object", "replace_object", "look")])
    at = F.array(F.lit(100.0))
    edits = p.select(F.concat_ws(":", "p_brand", "p_size").alias("scene"), key.alias("order"), F.get(names, (key % 7).cast("int")).alias("name"), key.cast("string").alias("target"), F.lit("new").alias("desc"), at.alias("pos"), at.alias("rot"), at.alias("size"))
    x = geometry.apply_edits(scenes, edits, "scene", "order")
    total = lambda f: r(F.aggregate("objects", F.lit(0.0), lambda a, o: a + o[f][0]), 2).alias(f)
    return x.select("scene", F.size("objects").alias("n"), F.size(F.filter("objects", lambda o: o["jid"].isNotNull())).alias("ids"), total("pos"), total("rot"), total("size"))


def t54_integrity(s, d):
    x = _scene(s, d)
    return x.select("p_brand", (F.size("objects") > 0).alias("has_objects"), F.forall("objects", lambda o: o["jid"].isNotNull() & (F.size(o["pos"]) == 2)).alias("whole"))


def _batches(s, d):
    """Documents in trainer batches of about 64 of one source."""
    docs = table(s, d, "documents").select("doc_id", "source", "n_chars")
    return docs.withColumn("batch", F.concat_ws(":", F.col("source"), F.floor(F.col("doc_id") / 64).cast("string")))


def d01_balance_totals(s, d):
    docs = _batches(s, d)
    x = balance.balanced_parts(docs, "batch", "doc_id", "n_chars", 4).join(docs.select("doc_id", "n_chars"), "doc_id")
    return x.groupBy("batch").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), (F.max("part") < 4).alias("within"))


def d01_balance(s, d):
    docs = _batches(s, d)
    x = balance.balanced_parts(docs, "batch", "doc_id", "n_chars", 4).join(docs.select("doc_id", "n_chars"), "doc_id")
    return x.groupBy("batch", "part").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("docs"))


def d02_greedy(s, d):
    x = balance.balanced_parts(table(s, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 2, "greedy")
    return x.select("o_custkey", "o_orderkey", F.col("part").alias("part"))


def d04_micro_batches(s, d):
    x = balance.micro_batches(_batches(s, d), "batch", "doc_id", "n_chars", 20000)
    return x.groupBy("batch").agg(F.max("of").alias("batches"), F.count("*").alias("docs"))


def d12_sampler(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.concat(F.lit("1:"), F.col("doc_id").cast("string"))).alias("draw"))


def s05_prompts(s, d):
    path = scratch(s, "prompts")
    table(s, d, "benchmark").select(F.concat(F.lit("  "), F.regexp_replace("text", "\n", "\n\n"), F.lit(" ")).alias("value")).write.text(path)
    return files.read_prompts(s, path).groupBy("prompt").agg(F.count("*").alias("n"))


def s06_json_documents(s, d):
    path = scratch(s, "documents")
    rows = table(s, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "event_type"))).alias("value"))
    rows.write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])
    x = files.read_documents(s, path, schema)
    return x.groupBy(F.col("_corrupt_record").isNotNull().alias("broken")).agg(F.count("*").alias("n"), F.count("event_id").alias("ids"))


def s09_json_split(s, d):
    path = scratch(s, "json")
    batch.with_position(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").write.json(path)
    a, b = files.positional_split(s.read.schema("o_orderkey long, o_orderstatus string, pos long").json(path), "pos", 0.9)
    return a.select("o_orderkey", F.lit("train").alias("split")).unionByName(b.select("o_orderkey", F.lit("test").alias("split")))


def s10_steps(s, d):
    path = scratch(s, "steps")
    files.write_steps(table(s, d, "events").select((F.col("event_id") % 7).alias("step"), "event_id", "event_type"), path)
    return s.read.schema("event_id long, event_type string, step int").json(path).groupBy("step").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def s11_parquet_round_trip(s, d):
    path = scratch(s, "parquet")
    table(s, d, "customer").write.parquet(path)
    return files.read_parquet(s, [path]).select("c_custkey", "c_mktsegment")


def s12_responses(s, d):
    return files.joined_turns(table(s, d, "conversations"), "conv_id", "turn", "text")


def s16_flatten(s, d):
    e = table(s, d, "events").select("event_id", F.struct(F.struct(F.col("user_id").alias("id")).alias("user"), F.col("event_type").alias("type")).alias("meta"))
    return e.select(*files.flat_columns(e.schema, "_"))


def s20_override(s, d):
    """Every customer, with the supplier of the same number winning where there is one."""
    base = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    other = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return files.override(base, other, "k").select("k", r("v", 2).alias("v"))


def s21_cached(s, d):
    x = prepare.coverage(table(s, d, "documents"), "doc_id", table(s, d, "labels"))
    return x.withColumn("coverage", r("coverage", 4))


def s25_append(s, d):
    a, b = table(s, d, "documents").select("doc_id", "n_chars"), table(s, d, "documents").where("n_chars < 500").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "n_chars")
    return a.unionByName(b)


def t57_prompt_rows(s, d):
    row = table(s, d, "benchmark").select("item_id", *prepare.prompt_columns(F.col("text"), F.get(F.split("text", " "), F.lit(0))))
    return row.select("item_id", F.col("prompt")[0]["role"].alias("role"), F.length(F.col("prompt")[0]["content"]).alias("n"), F.col("reward_model.ground_truth").alias("gold"))


def t58_collapse(s, d):
    e = table(s, d, "events").select("event_id", prepare.collapsed(kind=F.col("event_type"), user=F.col("user_id")).alias("extra"))
    return e.select("event_id", F.col("extra")["kind"].alias("kind"), F.col("extra")["user"].alias("user"))


def f01_custom_scorer(s, d):
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.str.count("the").astype(float)

    return table(s, d, "benchmark").select("item_id", score("text").alias("score"))


def f03_last_token_score(s, d):
    c = table(s, d, "conversations").withColumn("scores", scans.at_last(X.word_count(F.col("text")), F.col("turn").cast("double")))
    return c.select("conv_id", "turn", F.size("scores").alias("n"), r(F.element_at("scores", -1)).alias("last"))


def f07_registry(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("score"))
    out = None
    for name in ("grpo", "rloo", "rloo_vectorized"):
        x = G.estimate(name, li, "l_orderkey", "score").agg(r(F.sum(F.abs("advantage")), 3).alias("total")).withColumn("name", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


_RECURSIVE_GREEDY = "with recursive o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as i from orders), f as (select o_custkey, o_orderkey, i, 0 as part, o_totalprice as a, 0.0::double as b from o where i = 1 union all select o.o_custkey, o.o_orderkey, o.i, case when f.a <= f.b then 0 else 1 end, case when f.a <= f.b then f.a + o.o_totalprice else f.a end, case when f.a <= f.b then f.b else f.b + o.o_totalprice end from f join o on o.o_custkey = f.o_custkey and o.i = f.i + 1) select o_custkey, o_orderkey, part from f"
_IN = "greatest(least(x1, 50) - greatest(x0, 0), 0) * greatest(least(y1, 40) - greatest(y0, 0), 0) * greatest(least(z1, 45) - greatest(z0, 0), 0)"
_OUT = f"((x1 - x0) * (y1 - y0) * (z1 - z0) - {_IN})"
_A, _B = "greatest(p_size - 10.0::double, 0)", "least(p_size + (p_partkey % 30)::double, 45)"
_W = f"least(greatest({_B} - {_A}, 28), 45)"
_ST = f"least(greatest(({_A} + {_B}) / 2 - {_W} / 2, 0), 45 - {_W})"

QUERIES = {
    "d01_balance": (d01_balance, None),
    "d01_balance_totals": (d01_balance_totals, "select source || ':' || cast(floor(doc_id / 64.0) as bigint) as batch, count(*) as docs, sum(n_chars) as chars, true as within from documents group by 1"),
    "d02_greedy": (d02_greedy, _RECURSIVE_GREEDY),
    "d04_micro_batches": (d04_micro_batches, "select source || ':' || cast(floor(doc_id / 64.0) as bigint) as batch, cast(least(count(*), greatest(1, ceil(sum(n_chars) / 20000.0))) as int) as batches, count(*) as docs from documents group by 1"),
    "d12_sampler": (d12_sampler, "select doc_id, md5('1:' || doc_id) as draw from documents"),
    "f01_custom_scorer": (f01_custom_scorer, "select item_id, cast((length(text) - length(replace(text, 'the', ''))) / 3 as double) as score from benchmark"),
    "f03_last_token_score": (f03_last_token_score, r"select conv_id, turn, len(regexp_split_to_array(trim(text), '\s+')) as n, turn::double as last from conversations"),
    "f07_registry": (f07_registry, "with x as (select l_quantity as s, count(*) over (partition by l_orderkey) as n, avg(l_quantity) over (partition by l_orderkey) as m, stddev_samp(l_quantity) over (partition by l_orderkey) as d from lineitem) select 'grpo' as name, round(sum(abs(case when n = 1 then s / (1 + 1e-6) else (s - m) / (d + 1e-6) end)), 3) as total from x union all select 'rloo', round(sum(abs(case when n = 1 then s else (s - m) * n / (n - 1) end)), 3) from x union all select 'rloo_vectorized', round(sum(abs(case when n = 1 then 0 else (s - m) * n / (n - 1) end)), 3) from x"),
    "j02_tiered_match": (j02_tiered_match, "select c_custkey, case when c_custkey % 2 = 0 then 1 else 2 end as tier, case when c_custkey % 2 = 0 then c_nationkey else c_custkey % 25 end as n_nationkey from customer"),
    "j04_fallback_lookup": (j04_fallback_lookup, "select p_partkey, coalesce((select max(l_quantity) from lineitem where l_partkey = p_partkey and l_discount > 0.05), (select min(l_quantity) from lineitem where l_partkey = p_partkey)) as q from part"),
    "j05_either_key": (j05_either_key, "select s_suppkey, count(*) as n from (select distinct l_orderkey, l_partkey, l_suppkey, s_suppkey from lineitem join supplier on l_suppkey = s_suppkey or l_partkey = s_suppkey) group by 1"),
    "j06_resume": (j06_resume, "select source, count(*) as n from documents where doc_id not in (select doc_id from labels where quality = 1) group by 1"),
    "j07_box_pairs": (j07_box_pairs, f"select a.p_brand, a.key as a, b.key as b, round({_VOL}, 4) as volume from {_BOX} a join {_BOX} b on a.p_brand = b.p_brand and a.key < b.key where {_VOL} > 0"),
    "j09_supported": (j09_supported, f"select distinct a.key from {_BOX} a join {_BOX} b on a.p_brand = b.p_brand and a.key <> b.key and abs(round(a.y0 - b.y1, 6)) <= 0.05 and a.x0 < b.x1 and b.x0 < a.x1 and a.z0 < b.z1 and b.z0 < a.z1"),
    "j10_valid_ids": (j10_valid_ids, "select event_type, count(c_custkey) as valid, round(count(case when c_custkey is null then 1 end) * 0.2::double, 4) as penalty from events left join customer on c_custkey = user_id group by 1"),
    "n47_footprint": (n47_footprint, "select p_partkey, round(w, 6) + 0.0 as yaw, round(1 - p_size / 20.0::double * cos(w) - sin(w), 6) + 0.0 as x, round(3 + p_size / 20.0::double * sin(w) - cos(w), 6) + 0.0 as z from (select *, (p_size % 7) / 5.0::double as w from part)"),
    "n50_outside": (n50_outside, f"select key, round({_OUT}, 4) + 0.0 as outside, round({_OUT}, 6) > 0 as out from {_BOX}"),
    "n51_cells": (n51_cells, f"with c as (select p_brand, key, i, j, k from (select *, unnest(range(cast(floor(x0 / 5) as bigint), cast(floor(x1 / 5) as bigint) + 1)) as i from {_BOX}), lateral (select unnest(range(cast(floor(y0 / 5) as bigint), cast(floor(y1 / 5) as bigint) + 1)) as j), lateral (select unnest(range(cast(floor(z0 / 5) as bigint), cast(floor(z1 / 5) as bigint) + 1)) as k)), g as (select p_brand, i, j, k from c group by all having count(*) > 1) select p_brand, count(*) as cells, round(count(*) * 125.0::double, 1) as volume from g group by 1"),
    "n52_voxel_outside": (n52_voxel_outside, f"with c as (select p_brand, key, unnest(range(cast(floor(x0 / 5) as bigint), cast(floor(x1 / 5) as bigint) + 1)) as i, y0, y1, z0, z1 from {_BOX}), e as (select p_brand, key, i, unnest(range(cast(floor(y0 / 5) as bigint), cast(floor(y1 / 5) as bigint) + 1)) as j, z0, z1 from c), f as (select key, i, j, unnest(range(cast(floor(z0 / 5) as bigint), cast(floor(z1 / 5) as bigint) + 1)) as k from e) select key, count(case when not (i between 0 and 9 and j between 0 and 7 and k between 0 and 5 or i between 0 and 4 and j between 0 and 7 and k between 0 and 8) then 1 end) as cells, round(count(case when not (i between 0 and 9 and j between 0 and 7 and k between 0 and 5 or i between 0 and 4 and j between 0 and 7 and k between 0 and 8) then 1 end) * 125.0::double, 1) as volume from f group by key"),
    "n57_clip_box": (n57_clip_box, f"select p_partkey, cast(floor({_ST}) as bigint) as lo, cast(ceil({_ST} + {_W}) as bigint) as hi from part"),
    "s05_prompts": (s05_prompts, "select trim(p) as prompt, count(*) as n from (select unnest(string_split(text, chr(10))) as p from benchmark) where trim(p) <> '' group by 1"),
    "s06_json_documents": (s06_json_documents, "select event_id % 10 = 0 as broken, count(*) as n, count(case when event_id % 10 <> 0 then 1 end) as ids from events group by 1"),
    "s09_json_split": (s09_json_split, "select o_orderkey, case when row_number() over (order by o_orderkey) <= cast(floor((select count(*) from orders) * 0.9) as bigint) then 'train' else 'test' end as split from orders"),
    "s10_steps": (s10_steps, "select cast(event_id % 7 as int) as step, count(*) as n, sum(event_id) as ids from events group by 1"),
    "s11_parquet_round_trip": (s11_parquet_round_trip, "select c_custkey, c_mktsegment from customer"),
    "s12_responses": (s12_responses, "select conv_id, string_agg(text, '|' order by turn, text) as responses, count(*) as n from conversations group by 1"),
    "s16_flatten": (s16_flatten, "select event_id, user_id as meta_user_id, event_type as meta_type from events"),
    "s20_override": (s20_override, "select coalesce(c_custkey, s_suppkey) as k, round(coalesce(s_acctbal, c_acctbal), 2) as v from customer full join supplier on s_suppkey = c_custkey"),
    "s21_cached": (s21_cached, "select count(l.doc_id) as cached, count(*) as total, round(count(l.doc_id) / count(*)::double * 100, 4) as coverage from documents d left join labels l using (doc_id)"),
    "s25_append": (s25_append, "select doc_id, n_chars from documents union all select doc_id + 1000000000, n_chars from documents where n_chars < 500"),
    "t48_flatten": (t48_flatten, "select p_brand, count(distinct p_type) as groups, count(*) as objects, sum(p_partkey) as total from part group by 1"),
    "t50_remove": (t50_remove, "select p_brand, count(case when p_partkey <> 7 then 1 end) as n from part group by 1"),
    "t51_move_first": (t51_move_first, "select p_brand, round(sum(p_size) - case when count(*) > 1 then list(p_size order by cast(p_partkey as varchar))[2] + 5 else 0 end, 2)::double as total from part group by 1"),
    "t53_apply_edits": (t53_apply_edits, "select p_brand || ':' || p_size as scene, count(case when k <> 0 then 1 end) + count(case when k = 2 then 1 end) as n, count(case when k not in (0, 5) then 1 end) as ids, round(sum(case k when 0 then 0 when 1 then 100 when 2 then p_size + 100 else p_size end)::double, 2) as pos, round(sum(case k when 0 then 0 when 3 then 100 when 2 then p_size + 100 else p_size end)::double, 2) as rot, round(sum(case k when 0 then 0 when 4 then 100 when 2 then p_size + 100 else p_size end)::double, 2) as size from (select *, p_partkey % 7 as k from part) group by p_brand, p_size"),
    "t54_integrity": (t54_integrity, "select p_brand, true as has_objects, true as whole from part group by 1"),
    "t57_prompt_rows": (t57_prompt_rows, "select item_id, 'user' as role, length(text) as n, string_split(text, ' ')[1] as gold from benchmark"),
    "t58_collapse": (t58_collapse, "select event_id, event_type as kind, cast(user_id as varchar) as \"user\" from events"),
}
