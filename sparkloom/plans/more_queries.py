"""The rest of the inventory that is data processing: registries, retrieval cascades, rewards, parsers and state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions import text as X
from ..operators import balance, batch, geometry, matching, retrieval
from ..operators import groups as G
from ..operators import metrics as M
from ..session import if_small, scratch
from ..sources import files
from ..streaming import queues as Q
from .common import r, table


def s07_tolerant_load(s, d):
    path = scratch(s, "scenes")
    table(s, d, "part").select(F.when(F.col("p_partkey") % 7 == 0, "nope").otherwise(F.to_json(F.struct("p_partkey", "p_brand"))).alias("value")).write.text(path)
    return files.read_tolerant(s, path, "p_partkey long, p_brand string").groupBy("p_brand").agg(F.count("*").alias("n"))


def s13_append_log(s, d):
    path = scratch(s, "log")
    e = table(s, d, "events").select((F.col("event_id") % 3).alias("step"), F.struct("event_type", "value").alias("data"))
    files.append_log(e, path, "step", [0, 1, 2])
    return s.read.schema("step long, data struct<event_type:string,value:double>").json(path).groupBy("step").agg(F.count("*").alias("n"), r(F.sum("data.value"), 3).alias("value"))


def s19_snapshot(s, d):
    held = table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    return files.snapshot(held, scratch(s, "snapshot")).select("o_custkey", F.array_join("keys", ",").alias("keys"))


def s24_reuse(s, d):
    """A materialised batch is read again, not computed again."""
    path = scratch(s, "rollout")
    made = table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    files.write_once(made, path)
    files.write_once(made.where("false"), path)  # there already
    return s.read.parquet(path)


def b11_zip(s, d):
    a = table(s, d, "customer").select("c_custkey", "c_acctbal")
    b = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return batch.union_columns(a, b, "c_custkey").select("c_custkey", r("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


def b33_gather_ragged(s, d):
    u = table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids")).withColumnRenamed("user_id", "pos")
    picks = table(s, d, "orders").select(F.col("o_orderkey").alias("slot"), F.col("o_custkey").cast("long").alias("pos"))
    return batch.select_positions(u, picks).select("slot", F.size("ids").alias("n"))


def b34_concat_ragged(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return batch.concat(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")).select("user_id", F.size("ids").alias("n"))


def j01_positional_join(s, d):
    a = batch.with_position(table(s, d, "customer").select("c_custkey"), "c_custkey")
    b = batch.with_position(table(s, d, "part").select("p_partkey"), "p_partkey")
    return batch.union_columns(a, b, "pos").select("pos", "c_custkey", "p_partkey")


def a14_throughput(s, d):
    x = M.timing(table(s, d, "events"), "event_type", "value", "user_id", 16)
    return x.select("event_type", r("throughput").alias("throughput"), "tokens")


def w06_nucleus(s, d):
    p = table(s, d, "part").select("p_brand", "p_partkey", (F.col("p_size") / 10.0).alias("score"))
    return retrieval.nucleus(p, "p_brand", "score", "p_partkey", 1.0, 0.7).groupBy("p_brand").agg(F.count("*").alias("kept"), r(F.sum("p"), 5).alias("p"))


def w07_history(s, d):
    c = table(s, d, "conversations").withColumn("size", F.size(F.split(F.trim("text"), r"\s+")))
    return batch.suffix_within_budget(c, "conv_id", "turn", "size", 80).groupBy("conv_id").agg(F.min("turn").alias("first"), F.sum("size").alias("used"))


def _views(s, d):
    """Three views an item, two queries."""
    p = table(s, d, "part")
    v = p.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("view"), "p_size").withColumn("query", F.explode(F.array(F.lit(1), F.lit(2))))
    return v.select("query", F.col("p_partkey").alias("item"), ((F.col("p_partkey") * 7 + F.col("view") * 31 + F.col("query") * 17) % 97).cast("double").alias("image"), ((F.col("p_size") * F.col("query")) % 23).cast("double").alias("text"))


_VIEWS = "(select q as query, p_partkey as item, ((p_partkey * 7 + v * 31 + q * 17) % 97)::double as image, ((p_size * q) % 23)::double as text from part, range(3) a(v), (values (1), (2)) b(q))"


def k02_views(s, d):
    return retrieval.views_max(_views(s, d), "query", "item", "image", "text", 60.0).where("rank <= 20").select("query", "item", "image", "rank")


def k06_reuse(s, d):
    p = table(s, d, "part").select("p_brand", "p_partkey", "p_type", F.array(F.col("p_size").cast("double"), F.lit(1.0)).alias("size"))
    return retrieval.reuse_earlier(p, "p_brand", "p_partkey", "p_type", "size", 0.0).select("p_partkey", "source")


def k12_band_draw(s, d):
    return matching.band_draw(table(s, d, "part"), "p_brand", "p_partkey", F.col("p_size").between(10, 20), 0.1, "5").select("p_brand", "p_partkey")


def k13_search(s, d):
    order = [F.desc(F.length("text")), F.col("conv_id"), F.col("turn")]
    return matching.search(table(s, d, "conversations"), "text", "the", order, "role").select("role", "conv_id", "turn", "place")


def k14_cascade(s, d):
    """Catalog A, then B for what is unresolved, then a fixed fallback."""
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("asset"))
    sizes = table(s, d, "part").select("p_partkey", "p_size")
    b = sizes.join(if_small(table(s, d, "nation")), F.col("p_size") == F.col("n_nationkey")).select("p_partkey", F.col("n_name").alias("asset"))
    return matching.fallback_lookup(sizes.select("p_partkey"), "p_partkey", "asset", a, b, default=F.lit("none"))


def n12_loss_registry(s, d):
    li = table(s, d, "lineitem").withColumns({"lp": -F.col("l_discount") * 10, "old": -F.col("l_tax") * 10, "adv": (F.col("l_quantity") - 25) / 25})
    losses = [r(F.avg(f(F.col("lp"), F.col("old"), F.col("adv"))), 5).alias(n) for n, f in sorted(L.POLICY_LOSSES.items())]
    return li.groupBy("l_suppkey").agg(*losses)


def n23_masks_and_weights(s, d):
    li = table(s, d, "lineitem")
    q = F.exp(10.0 * (F.col("l_tax") - F.col("l_discount")))
    m = (F.col("l_returnflag") != "R").cast("int")
    kept = m * L.accepted(q, 1.7).cast("int")
    return li.groupBy("l_suppkey").agg(F.sum(m).alias("before"), F.sum(kept).alias("after"), r(F.sum(kept * F.least(q, F.lit(2.0)))).alias("weight"))


def n24_prefixed_metrics(s, d):
    li = table(s, d, "lineitem").where("l_returnflag <> 'R'")
    z = 10.0 * (F.col("l_tax") - F.col("l_discount"))
    one = li.agg(r(F.avg(-z), 5).alias("kl"), r(F.avg(F.exp(z) - z - 1), 5).alias("k3_kl"))
    return one.selectExpr("stack(2, 'rollout_corr/kl', kl, 'rollout_corr/k3_kl', k3_kl) as (metric, value)")


def n34_overlong(s, d):
    n = F.length("text")
    return table(s, d, "conversations").select("conv_id", "turn", r(L.overlong_penalty(n, 150, 100, 1.0)).alias("penalty"))


def n38_size_distance(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", r(retrieval.distance(F.array(F.col("p_size") * 1.0, F.lit(2.0), F.lit(3.0)), F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0)))).alias("distance"))


def n39_box_dimensions(s, d):
    p = table(s, d, "part")
    a = F.when(F.col("p_partkey") % 3 == 0, F.array(F.col("p_size") * 1.0, F.lit(2.0)))
    b = F.when(F.col("p_partkey") % 3 == 1, F.array(F.col("p_size") * 2.0, F.lit(4.0)))
    x = F.coalesce(a, b, F.array(F.lit(1.0), F.lit(1.0)))
    return p.select("p_partkey", x[0].alias("x"), x[1].alias("y"))


def n41_mesh_reward(s, d):
    p = table(s, d, "part")
    collision = L.piecewise(F.col("p_size") * 2.0, [(20.0, 1.0), (45.0, 0.0), (100.0, -1.0)])
    outside = L.piecewise(F.col("p_size") * 1.5, [(10.0, 1.0), (30.0, 0.0), (100.0, -1.0)])
    return p.select("p_partkey", r((collision + outside) / 2, 5).alias("reward"))


def n42_turn_reward(s, d):
    """Scene terms of a turn weighted by the turn's table; few objects at the last turn override all with -1."""
    e = table(s, d, "events").select("event_id", "user_id", (F.col("event_id") % 4).cast("int").alias("turn"), (F.col("value") / 100).alias("depth"), (F.col("user_id") % 20).alias("objects"))
    weights = s.createDataFrame([(t, 0.50771 + 0.1 * t, 0.49229 - 0.1 * t) for t in range(4)], "turn int, w1 double, w2 double")
    depth = L.piecewise(F.col("depth"), [(0.05, 1.0), (0.2, 0.5), (0.4, 0.0), (0.7, -0.5), (1.0, -1.0)])
    count = L.object_count_reward(F.col("objects"), F.col("turn") == 3)
    x = e.join(F.broadcast(weights), "turn")
    reward = F.when((F.col("objects") < 4) & (F.col("turn") == 3), -1.0).otherwise(F.col("w1") * depth + F.col("w2") * count)
    return x.select("event_id", r(reward, 4).alias("reward"))


def n43_object_count(s, d):
    p = table(s, d, "part")
    n = F.col("p_size") % 20
    return p.select("p_partkey", r(L.object_count_reward(n, F.lit(True))).alias("reward"), (n < 4).alias("override"))


def n48_yaw(s, d):
    p = table(s, d, "part")
    h = (F.col("p_size") - 25) / 20.0
    return p.select("p_partkey", r(geometry.yaw(F.array(F.lit(0.0), F.sin(h), F.lit(0.0), F.cos(h)))).alias("yaw"))


def n49_rotated_overlap(s, d):
    """A square of side 2 turned about its centre by any angle shares 8 / (1 + |sin| + |cos|) with the unturned one."""
    p = table(s, d, "part")
    size, pos = F.array(F.lit(2.0), F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.5), F.lit(0.0), F.lit(-3.0))
    turned, plain = geometry.footprint(pos, size, F.radians(F.col("p_partkey") % 360)), geometry.footprint(pos, size, F.lit(0.0))
    return p.select("p_partkey", r(geometry.footprint_overlap(turned, plain), 5).alias("area"))


def n54_repair(s, d):
    """Scenes of a brand and size, so a scene is small."""
    scene = F.concat_ws(":", "p_brand", "p_size").alias("scene")
    p = table(s, d, "part").select(scene, F.col("p_partkey").alias("key"), (F.col("p_size") / 5.0 - 1).alias("x"), (F.col("p_size") / 6.0).alias("z"), (F.col("p_size") % 12 + 0.5).alias("w"))
    x = geometry.repair(p, "scene", 10.0)
    return x.groupBy("scene").agg(F.count("*").alias("n"), F.sum(F.col("removed").cast("int")).alias("removed"))


def t11_fractions(s, d):
    p = table(s, d, "part")
    x = X.strip_latex(F.concat(F.lit(r"\tfrac"), (F.col("p_size") % 9 + 1).cast("string"), F.lit(r"2 \sqrt5")))
    return p.select("p_partkey", x.alias("value"))


def t14_grade(s, d):
    """Equal once normalised, else part by part for tuples."""
    p = table(s, d, "part")
    a = F.concat(F.lit("( "), F.col("p_size").cast("string"), F.lit(", 1,000 )"))
    b = F.concat(F.lit("("), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 1).cast("string"), F.lit(", 1000)"))
    parts = lambda t: F.transform(F.split(F.regexp_replace(t, r"^\(\s*|\s*\)$", ""), r",\s+"), X.clean_number)
    return p.select("p_partkey", (parts(a) == parts(b)).alias("equal"))


def t22_contains(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", X.contains_gold(F.col("text"), F.array(F.lit("the"), F.lit("Of!"))).alias("has"))


def t28_mixed_score(s, d):
    p = table(s, d, "part")
    t = F.concat(F.lit("<think>x</think>"), F.lit(r" \boxed{"), (F.col("p_size") % 4).cast("string"), F.lit("}"))
    return p.select("p_partkey", r(0.9 * (X.last_boxed(t) == "2").cast("double") + 0.1 * X.think_format(t).cast("double")).alias("score"))


def t33_lenient_json(s, d):
    e = table(s, d, "events")
    t = F.concat(F.lit('so: {"a": True, "b": """x "y" z""", "c": ['), F.col("user_id").cast("string"), F.lit(", None,],} ok"))
    return e.select("event_id", X.parsed_json(t).alias("json"))


def t36_fenced(s, d):
    e = table(s, d, "events")
    t = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye"))
    return e.select("event_id", F.from_json(X.fenced(t), "k int")["k"].alias("k"))


def t40_channel_calls(s, d):
    e = table(s, d, "events")
    t = F.concat(F.lit("<|channel|>commentary to=functions."), "event_type", F.lit(" <|constrain|>json<|message|>"), "props", F.lit("<|call|> tail"))
    c = X.channel_calls(t)
    return e.select("event_id", F.size(c).alias("n"), c[0]["name"].alias("name"), c[0]["arguments"].alias("arguments"))


def t47_group_scene(s, d):
    p = table(s, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey"))).alias("objects"))
    g = p.select("p_brand", F.array(F.struct(F.lit("main_group").alias("group_name"), F.col("objects").alias("objects"))).alias("groups"))
    return g.select("p_brand", F.col("groups")[0]["group_name"].alias("name"), F.size(geometry.flatten_groups(F.col("groups"))).alias("n"))


def t55_two_formats(s, d):
    p = table(s, d, "part")
    j = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.array(F.col("p_size")).alias("objects")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.array(F.col("p_size"), F.col("p_size")).alias("objects"))).alias("groups"))))
    x = F.from_json(j, "objects array<int>, groups array<struct<objects:array<int>>>")
    return p.select("p_partkey", F.size(F.coalesce(x["objects"], geometry.flatten_groups(x["groups"]))).alias("n"))


def t56_gold_answer(s, d):
    p = table(s, d, "part")
    t = F.concat(F.lit("because\n#### "), F.format_number(F.col("p_size") * 1000, 0))
    return p.select("p_partkey", F.regexp_replace(X.last_match(t, r"#### (\-?[0-9\.\,]+)"), ",", "").alias("gold"))


def t65_any_gold(s, d):
    p = table(s, d, "part")
    a = X.last_boxed(F.when(F.col("p_size") % 3 == 0, "nothing").otherwise(F.concat(F.lit(r"\boxed{"), (F.col("p_size") % 5).cast("string"), F.lit("}"))))
    same = lambda g: (a == g) | F.coalesce(X.numbers_equal(a, F.lit(g)), F.lit(False))
    hit = same("1") | same("4.0")
    return p.select("p_partkey", F.when(a.isNull(), 0.0).when(hit, 1.0).otherwise(0.0).alias("score"), a.isNotNull().cast("double").alias("format"))


def d05_prepare(s, d):
    """Rows with their micro-batch: every part within the budget, unless it is a single row."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    x = balance.prepare_batches(o, "o_custkey", "o_orderkey", "size", 500_000)
    loads = x.groupBy("o_custkey", "part").agg(F.sum("size").alias("load"), F.count("*").alias("rows"))
    return loads.groupBy("o_custkey").agg(F.sum("rows").alias("orders"), F.sum("load").alias("total"), F.count("*").alias("parts"))


def d06_restore(s, d):
    """Results in the order of the micro-batches go back to their rows by the index lists."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    x = balance.prepare_batches(o, "o_custkey", "o_orderkey", "size", 500_000)
    dealt = x.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "size"))), lambda v: v["size"] * 2).alias("results"))
    return balance.restore_batches(dealt, "o_custkey", "results", x, "o_orderkey").select("o_orderkey", F.col("value").alias("doubled"))


def d11_curriculum(s, d):
    """Parts by the mean quantity ordered of them so far, most first; parts without orders last."""
    li = table(s, d, "lineitem").where("l_shipdate < '1995-01-01'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("double").alias("q"))
    return balance.curriculum_order(table(s, d, "part"), li, "p_partkey", "q", "7").select("p_partkey", "place")


def b02_equal_sizes(s, d):
    u = table(s, d, "events").groupBy("user_id").agg(F.collect_list("event_id").alias("ids"), F.collect_list(F.coalesce("value", F.lit(0.0))).alias("values"))
    return batch.equal_sizes(u, "ids", "values").select("user_id", F.size("ids").alias("n"))


def b29_ragged(s, d):
    words = table(s, d, "conversations").select("conv_id", "turn", F.split(F.trim("text"), r"\s+").alias("words"))
    x = batch.ragged(words, "conv_id", "turn", "words")
    return x.select("conv_id", F.size("words").alias("n"), F.array_join(F.transform("words_offsets", lambda v: v.cast("string")), ",").alias("offsets"))


def f15_feedback(s, d):
    """A conversation's last answer against a gold number."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    said = F.transform("h", lambda m: F.struct(m["role"].alias("role"), F.concat(m["text"], F.lit(" #### "), m["turn"].cast("string")).alias("content")))
    x = c.select("conv_id", X.answer_feedback(said, F.lit("1")).alias("f"))
    return x.select("conv_id", F.col("f.done").alias("done"), F.col("f.reward").alias("reward"))


def t12_batched(s, d):
    c = table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    text = F.transform("k", lambda v: F.concat(F.lit("#### "), (v % 4).cast("string")))
    scores = X.score_batch(text, F.transform("k", lambda v: F.lit("3")), X.number_score)
    return c.select("o_custkey", F.aggregate(scores, F.lit(0.0), lambda a, v: a + v).alias("score"))


def t17_prose(s, d):
    p = table(s, d, "part")
    t = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Thus the answer is "), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(r"we find \boxed{"), F.col("p_size").cast("string"), F.lit("} here"))).otherwise("no idea")
    return p.select("p_partkey", X.answer_in_prose(t).alias("a")).select("p_partkey", F.col("a.matched").alias("matched"), F.col("a.answer").alias("answer"))


def t19_normalized(s, d):
    p = table(s, d, "part")
    t = F.concat(F.lit(r" \text{ \dfrac"), (F.col("p_size") % 9 + 1).cast("string"), F.lit(r"7 } "))
    return p.select("p_partkey", X.normalized_math(t).alias("value"))


def t49_add(s, d):
    """An object a part, to the group that its size names; groups are made as they come."""
    p = table(s, d, "part")
    scenes = p.select("p_brand").distinct().withColumn("groups", F.from_json(F.lit("[]"), "array<struct<group_name:string,objects:array<struct<desc:string,jid:string,uid:string,size:array<double>,pos:array<double>,rot:array<double>>>>>"))
    edits = p.select("p_brand", F.col("p_partkey").alias("order"), F.lit("add_object").alias("name"), F.lit("").alias("target"), F.col("p_name").alias("desc"), F.concat(F.lit("g"), (F.col("p_size") % 3).cast("string")).alias("group"))
    x = geometry.apply_group_edits(scenes, edits, "p_brand", "order").select("p_brand", F.explode("groups").alias("g"))
    return x.select("p_brand", F.col("g.group_name").alias("name"), F.size("g.objects").alias("n"), F.array_join("g.objects.desc", "|").alias("descs"))


def t52_replace(s, d):
    """Each even part's object replaced: it keeps its place and loses its id."""
    p = table(s, d, "part")
    o = F.struct(F.lit("old").alias("desc"), F.col("p_partkey").cast("string").alias("jid"), F.lit(None).cast("string").alias("uid"), F.array(F.lit(1.0)).alias("size"), F.array(F.col("p_size") * 1.0).alias("pos"), F.array(F.lit(0.0)).alias("rot"))
    scenes = p.groupBy("p_brand").agg(F.sort_array(F.collect_list(o)).alias("objects"))
    edits = p.where("p_partkey % 2 = 0").select("p_brand", F.col("p_partkey").alias("order"), F.lit("replace_object").alias("name"), F.col("p_partkey").cast("string").alias("target"), F.lit("new").alias("desc"))
    x = geometry.apply_edits(scenes, edits, "p_brand", "order").select("p_brand", F.explode("objects").alias("o"))
    return x.groupBy("p_brand", F.col("o.desc").alias("desc")).agg(F.count("o.jid").alias("ids"), F.count("*").alias("n"), r(F.sum(F.col("o.pos")[0]), 2).alias("total"))


def t68_by_source(s, d):
    o = table(s, d, "orders")
    text = F.concat(F.lit("#### "), (F.col("o_orderkey") % 3).cast("string"))
    scorers = {("O", "P"): X.number_score(text, F.lit("2")), ("F",): X.number_score(text, F.lit("1"), score=0.5)}
    return o.select("o_orderkey", X.score_by_source(F.col("o_orderstatus"), scorers).alias("score"))


def m06_back_pressure(s, d):
    """Views may run five ahead of clicks, user by user."""
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    views, clicks = e.where("event_type = 'view'"), e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("at"))
    return Q.admitted(views, "user_id", "event_id", clicks, "at", 5).select("event_id", "admitted")


def n53_outside(s, d):
    """Boxes in a square room by 500 random points of each one's surface: the share outside, the flag and the volume.

    A box is 500 points' work, so boxes are dealt evenly first, however few files and rows there are.
    """
    p = table(s, d, "part").select("p_partkey", "p_size").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    x = F.col("p_size") / 10.0
    lo, hi = [x, F.lit(0.0), F.lit(0.0)], [x + 1.0, F.lit(2.0), F.lit(1.0)]
    room = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    found = geometry.out_of_bounds(geometry.box_mesh(lo, hi), room, F.lit(0.0), F.lit(1.0), F.col("p_partkey"))
    return p.select("p_partkey", found.alias("o")).select("p_partkey", r("o.share").alias("share"), "o.outside", r("o.volume").alias("volume"))


def d03_equal_parts(s, d):
    o = batch.with_position(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").withColumn("batch", F.floor(F.col("pos") / 30).cast("long"))
    x = balance.balanced_parts(o, "batch", "o_orderkey", "o_totalprice", 5)
    return x.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"))


def d10_broadcast(s, d):
    return table(s, d, "customer").join(if_small(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


def m09_version(s, d):
    x = Q.count_windows(Q.stream_of(s, f"{d}/events.parquet"), "event_id", 250, F.count("*").alias("steps"), F.max("event_id").alias("last"))
    return Q.run_available(x, "complete", "version")


def m14_turn_state(s, d):
    def step(state: str, event: str) -> str:
        return str(int(state) + 1) if event == "click" else state

    return Q.run_available(Q.state_machine(Q.stream_of(s, f"{d}/events.parquet"), "user_id", "event_id", "event_type", "0", step), "update", "turns").select("user_id", F.col("state").cast("long").alias("clicks"))


def f02_batched_scorer(s, d):
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return (a.str.len() - b.str.len()).abs().astype(float)

    return table(s, d, "conversations").select("conv_id", "turn", F.pandas_udf(score, "double")("text", "role").alias("score"))


def f04_overlong_manager(s, d):
    c = table(s, d, "conversations").withColumn("n", F.length("text"))
    score = (F.col("turn") % 2).cast("double")
    return c.select("conv_id", "turn", r(score + L.overlong_penalty(F.col("n"), 100, 50, 0.5)).alias("reward"))


def f06_registry_conflicts(s, d):
    """Events name their estimator: what the registry has under it gives their mean advantage, an unknown name is refused."""
    try:
        G.register("grpo")(lambda df, group, score: df)
        raise AssertionError("a taken name was given again")
    except ValueError:
        pass
    e = table(s, d, "events").select("event_type", "user_id", "value")
    found = None
    for kind, name in (("click", "grpo"), ("view", "rloo"), ("signup", "no such estimator")):
        rows = e.where(F.col("event_type") == kind)
        try:
            x = G.estimate(name, rows, "user_id", "value").agg(F.count("*").alias("n"), r(F.sum(F.abs("advantage")), 3).alias("total"))
        except KeyError:
            x = rows.agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
        x = x.select(F.lit(kind).alias("event_type"), "n", "total")
        found = x if found is None else found.unionByName(x)
    return found


def f09_table_function(s, d):
    from pyspark.sql.functions import udtf

    class Windows:
        def eval(self, text: str):
            words = (text or "").split()
            for i in range(max(len(words) - 2, 0)):
                yield i, " ".join(words[i : i + 3])

    s.udtf.register("three_words", udtf(Windows, returnType="at int, words string"))
    table(s, d, "benchmark").createOrReplaceTempView("loom_benchmark")
    return s.sql("select item_id, count(*) as n, max(at) as last from loom_benchmark, lateral three_words(text) group by item_id")


def f12_generator(s, d):
    """New rows made from a data set by a function of data sets."""
    double = lambda df: df.select((F.col("item_id") + 1000).alias("item_id"), F.reverse("text").alias("text"))
    b = table(s, d, "benchmark").select("item_id", "text")
    return b.unionByName(double(b)).select("item_id", F.length("text").alias("n"))


def f16_chunked_scores(s, d):
    c = table(s, d, "conversations").repartition(4, "conv_id")
    return c.groupBy("conv_id").agg(r(F.avg(F.length("text"))).alias("score"))


_Q = "exp(10 * (l_tax - l_discount))"
_K = "case when l_returnflag <> 'R' and exp(10 * (l_tax - l_discount)) between 1 / 1.7::double and 1.7 then 1 else 0 end"
_PWC = "case when {0} <= {1} then 1 when {0} <= {2} then 1 - ({0} - {1}) / ({2} - {1}) when {0} <= 100 then -({0} - {2}) / (100 - {2}) else -1 end"
_DEP = "case when dp <= 0.05 then 1 when dp <= 0.2 then 1 - 0.5 * (dp - 0.05) / 0.15 when dp <= 0.4 then 0.5 - 0.5 * (dp - 0.2) / 0.2 when dp <= 0.7 then -0.5 * (dp - 0.4) / 0.3 when dp <= 1 then -0.5 - 0.5 * (dp - 0.7) / 0.3 else -1 end"
_NORMAL = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w not in ('', 'a', 'an', 'the')), ' ')"
def _outside_sql() -> str:
    """A box of 1 x 2 x 1 is twelve triangles, four for each of x, y and z, two of them at its low end; all areas are 1, those of y 0.5.

    A point takes three numbers of splitmix64: where it is along the areas' sum of 10, and its place on the triangle.
    """
    three = lambda f: ", ".join(f.format(c=c, k=k) for k, c in enumerate("auv", 1))
    low = "& 18446744073709551615::uhugeint)::ubigint"
    mixed = lambda shift, factor: three(f"(xor({{c}}, {{c}} >> {shift})::uhugeint * {factor}::uhugeint {low} as {{c}}")
    steps = {
        "h": "select row_number() over () as id, p_partkey, p_size / 10.0::double as x, ('0x' || substr(md5(concat_ws(':', '42', p_partkey)), 1, 16))::uhugeint as seed from part",
        "z": f"select id, p_partkey, x, {three(f'(seed + (3 * i + {{k}})::uhugeint * {0x9E3779B97F4A7C15}::uhugeint {low} as {{c}}')} from h, range(500) t(i)",
        "y": f"select id, p_partkey, x, {mixed(30, 0xBF58476D1CE4E5B9)} from z",
        "w": f"select id, p_partkey, x, {mixed(27, 0x94D049BB133111EB)} from y",
        "n": f"select id, p_partkey, x, {three('(xor({c}, {c} >> 31) >> 11) / 9007199254740992.0::double as {c}')} from w",
        "m": "select id, p_partkey, x, 10 * a as a, case when u + v > 1 then 1 - u else u end as u, case when u + v > 1 then 1 - v else v end as v from n",
        "t": "select id, p_partkey, x, u, v, greatest(ceil(case when a <= 4 then a when a <= 6 then 2 * a - 4 else a + 2 end)::int - 1, 0) as t from m",
        "e": "select id, p_partkey, x, t // 4 as axis, t // 2 % 2 as high, t % 2 as back, case when t // 2 % 2 = 1 then u else v end as b, case when t // 2 % 2 = 1 then v else u end as c from t",
        "f": "select id, p_partkey, x, axis, high, abs(back - b) as b, abs(back - c) as c from e",
        "p": "select id, p_partkey, x, x + case axis when 0 then high when 1 then c else b end as px, 2 * case axis when 0 then b when 1 then high else c end as py from f",
        "s": "select p_partkey, x, 1 - count(case when px between -0.001::double and 4.001::double and py <= 1.001::double then 1 end) / 500.0::double as share from p group by id, p_partkey, x",
    }
    out = "share > 0.01::double as outside, case when x is not null then round(case when share > 0.01::double then 2 * share else 0 end, 6) + 0.0 end as volume"
    return f"with {', '.join(f'{n} as ({q})' for n, q in steps.items())} select p_partkey, round(share, 6) + 0.0 as share, {out} from s"


QUERIES = {
    "a14_throughput": (a14_throughput, "select event_type, round(sum(user_id) / (sum(value) * 16), 6) as throughput, sum(user_id) as tokens from events group by 1"),
    "b11_zip": (b11_zip, "select c_custkey, round(c_acctbal, 2) as c_acctbal, c_mktsegment from customer"),
    "b33_gather_ragged": (b33_gather_ragged, "select o_orderkey as slot, n from orders join (select user_id, count(*) as n from events group by 1) on user_id = o_custkey"),
    "b34_concat_ragged": (b34_concat_ragged, "select user_id, count(*) as n from events group by 1"),
    "d03_equal_parts": (d03_equal_parts, "select (rn - 1) // 30 as batch, count(*) as n, 5 as parts from (select row_number() over (order by o_orderkey) as rn from orders) group by 1"),
    "b02_equal_sizes": (b02_equal_sizes, "select user_id, count(*) as n from events group by 1"),
    "b29_ragged": (b29_ragged, r"with w as (select conv_id, turn, len(regexp_split_to_array(trim(text), '\s+')) as k from conversations), c as (select conv_id, turn, sum(k) over (partition by conv_id order by turn) as u from w) select conv_id, max(u) as n, '0,' || string_agg(cast(cast(u as bigint) as varchar), ',' order by turn) as offsets from c group by 1"),
    "d05_prepare": (d05_prepare, "select o_custkey, count(*) as orders, sum(cast(round(o_totalprice) as bigint)) as total, least(count(*), greatest(1, ceil(sum(cast(round(o_totalprice) as bigint)) / 500000.0))) as parts from orders group by 1"),
    "d06_restore": (d06_restore, "select o_orderkey, 2 * cast(round(o_totalprice) as bigint) as doubled from orders"),
    "d11_curriculum": (d11_curriculum, "select p_partkey, row_number() over (order by m desc nulls last, md5('7:' || p_partkey), p_partkey) - 1 as place from part left join (select l_partkey, avg(l_quantity::double) as m from lineitem where l_shipdate < '1995-01-01' group by 1) on l_partkey = p_partkey"),
    "f15_feedback": (f15_feedback, "select conv_id, coalesce(max(case when role = 'assistant' then turn end) = 1, false) as done, case when max(case when role = 'assistant' then turn end) = 1 then 1.0::double else 0 end as reward from conversations group by 1"),
    "t12_batched": (t12_batched, "select o_custkey, count(case when o_orderkey % 4 = 3 then 1 end)::double as score from orders group by 1"),
    "t17_prose": (t17_prose, "select p_partkey, p_size % 3 < 2 as matched, case when p_size % 3 < 2 then cast(p_size as varchar) else 'no idea' end as answer from part"),
    "t19_normalized": (t19_normalized, r"select p_partkey, '\frac{' || (p_size % 9 + 1) || '}{7}' as value from part"),
    "t49_add": (t49_add, "select p_brand, 'g' || (p_size % 3) as name, count(*) as n, string_agg(p_name, '|' order by p_partkey) as descs from part group by 1, 2"),
    "t52_replace": (t52_replace, "select p_brand, case when p_partkey % 2 = 0 then 'new' else 'old' end as desc, count(case when p_partkey % 2 = 1 then 1 end) as ids, count(*) as n, round(sum(p_size)::double, 2) as total from part group by 1, 2"),
    "t68_by_source": (t68_by_source, "select o_orderkey, case when o_orderstatus = 'F' then case when o_orderkey % 3 = 1 then 0.5::double else 0 end else case when o_orderkey % 3 = 2 then 1.0::double else 0 end end as score from orders"),
    "m06_back_pressure": (m06_back_pressure, "with v as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'view'), c as (select user_id, event_id as free, row_number() over (partition by user_id order by event_id) + 5 as n from events where event_type = 'click') select event_id, case when n <= 5 then event_id when free is not null then greatest(event_id, free) end as admitted from v left join c using (user_id, n)"),
    "n53_outside": (n53_outside, _outside_sql()),
    "d10_broadcast": (d10_broadcast, "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1"),
    "f02_batched_scorer": (f02_batched_scorer, "select conv_id, turn, abs(length(text) - length(role))::double as score from conversations"),
    "f04_overlong_manager": (f04_overlong_manager, "select conv_id, turn, round(turn % 2 + least(-(length(text) - 100) / 50.0::double * 0.5, 0), 6) as reward from conversations"),
    "f06_registry_conflicts": (f06_registry_conflicts, "with x as (select event_type, value as s, count(*) over w as n, avg(value) over w as m, stddev_samp(value) over w as d from events window w as (partition by event_type, user_id)) select 'click' as event_type, count(*) as n, round(sum(abs(case when n = 1 then s / (1 + 1e-6) else (s - m) / (d + 1e-6) end)), 3) as total from x where event_type = 'click' union all select 'view', count(*), round(sum(abs(case when n = 1 then s else (s - m) * n / (n - 1) end)), 3) from x where event_type = 'view' union all select 'signup', count(*), null from x where event_type = 'signup'"),
    "f09_table_function": (f09_table_function, r"select item_id, len(w) - 2 as n, len(w) - 3 as last from (select item_id, regexp_split_to_array(trim(text), '\s+') as w from benchmark) where len(w) > 2"),
    "f12_generator": (f12_generator, "select item_id, length(text) as n from benchmark union all select item_id + 1000, length(text) from benchmark"),
    "f16_chunked_scores": (f16_chunked_scores, "select conv_id, round(avg(length(text)), 6) as score from conversations group by 1"),
    "j01_positional_join": (j01_positional_join, "select a.pos, c_custkey, p_partkey from (select c_custkey, row_number() over (order by c_custkey) - 1 as pos from customer) a join (select p_partkey, row_number() over (order by p_partkey) - 1 as pos from part) b using (pos)"),
    "k02_views": (k02_views, f"select query, item, image, rank from (select *, row_number() over (partition by query order by image + text desc, item) as rank from (select query, item, max(image) as image, max(text) as text from {_VIEWS} group by 1, 2) where image >= 60) where rank <= 20"),
    "k06_reuse": (k06_reuse, "select p_partkey, min(p_partkey) over (partition by p_brand, p_type, p_size) as source from part"),
    "k12_band_draw": (k12_band_draw, "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by md5('5:' || p_partkey), p_partkey) as rn, count(*) over (partition by p_brand) as n from part where p_size between 10 and 20) where rn <= greatest(1, floor(n * 0.1))"),
    "k13_search": (k13_search, "select role, conv_id, turn, row_number() over (partition by role order by length(text) desc, conv_id, turn) as place from conversations where contains(lower(text), 'the')"),
    "k14_cascade": (k14_cascade, "select p_partkey, coalesce('A' || s_suppkey, n_name, 'none') as asset from part left join supplier on s_suppkey = p_partkey left join nation on n_nationkey = p_size"),
    "m09_version": (m09_version, "select event_id // 250 as window, count(*) as steps, max(event_id) as last from events group by 1"),
    "m14_turn_state": (m14_turn_state, "select user_id, count(case when event_type = 'click' then 1 end) as clicks from events group by 1"),
    "n12_loss_registry": (n12_loss_registry, "with x as (select *, -l_discount * 10 as lp, exp(-l_discount * 10 + l_tax * 10) as q, (l_quantity - 25) / 25 as adv from lineitem), u as (select *, greatest(-adv * q, -adv * least(greatest(q, 0.8), 1.2)) as u from x) select l_suppkey, round(avg(-lp * adv), 5) + 0.0 as gpg, round(avg(case when adv < 0 then least(u, -adv * 3.0) else u end), 5) + 0.0 as vanilla from u group by 1"),
    "n23_masks_and_weights": (n23_masks_and_weights, f"select l_suppkey, count(case when l_returnflag <> 'R' then 1 end) as before, sum({_K}) as after, round(sum({_K} * least({_Q}, 2)), 6) as weight from lineitem group by 1"),
    "n24_prefixed_metrics": (n24_prefixed_metrics, "select 'rollout_corr/kl' as metric, round(avg(10 * (l_discount - l_tax)), 5) + 0.0 as value from lineitem where l_returnflag <> 'R' union all select 'rollout_corr/k3_kl', round(avg(exp(10 * (l_tax - l_discount)) - 10 * (l_tax - l_discount) - 1), 5) from lineitem where l_returnflag <> 'R'"),
    "n34_overlong": (n34_overlong, "select conv_id, turn, round(least(-(length(text) - 150) / 100.0::double, 0), 6) + 0.0 as penalty from conversations"),
    "n38_size_distance": (n38_size_distance, "select p_partkey, round(sqrt(pow(p_size - 1, 2) + 4), 6) as distance from part"),
    "n39_box_dimensions": (n39_box_dimensions, "select p_partkey, case p_partkey % 3 when 0 then p_size::double when 1 then p_size * 2.0::double else 1 end as x, case p_partkey % 3 when 0 then 2.0::double when 1 then 4 else 1 end as y from part"),
    "n41_mesh_reward": (n41_mesh_reward, f"select p_partkey, round(({_PWC.format('(p_size * 2.0::double)', 20, 45)} + {_PWC.format('(p_size * 1.5::double)', 10, 30)}) / 2, 5) + 0.0 as reward from part"),
    "n42_turn_reward": (n42_turn_reward, f"select event_id, round(case when ob < 4 and tn = 3 then -1 else (0.50771::double + 0.1 * tn) * {_DEP} + (0.49229::double - 0.1 * tn) * case when ob >= 15 then 1 when ob >= 5 then (ob - 5) / 10.0::double else -1 end end, 4) + 0.0 as reward from (select *, event_id % 4 as tn, value / 100 as dp, user_id % 20 as ob from events)"),
    "n43_object_count": (n43_object_count, "select p_partkey, round(case when p_size % 20 >= 15 then 1 when p_size % 20 >= 5 then (p_size % 20 - 5) / 10.0::double else -1 end, 6) as reward, p_size % 20 < 4 as override from part"),
    "n48_yaw": (n48_yaw, "select p_partkey, round((p_size - 25) / 10.0::double, 6) as yaw from part"),
    "n49_rotated_overlap": (n49_rotated_overlap, "select p_partkey, round(8 / (1 + abs(sin(radians(p_partkey % 360))) + abs(cos(radians(p_partkey % 360)))), 5) as area from part"),
    "n54_repair": (n54_repair, "select p_brand || ':' || p_size as scene, count(*) as n, count(case when p_size % 12 + 0.5 > 10 then 1 end) as removed from part group by p_brand, p_size"),
    "s07_tolerant_load": (s07_tolerant_load, "select case when p_partkey % 7 <> 0 then p_brand end as p_brand, count(*) as n from part group by 1"),
    "s13_append_log": (s13_append_log, "select event_id % 3 as step, count(*) as n, round(sum(value), 3) as value from events group by 1"),
    "s19_snapshot": (s19_snapshot, "select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as keys from orders group by 1"),
    "s24_reuse": (s24_reuse, "select p_brand, count(*) as n from part group by 1"),
    "t11_fractions": (t11_fractions, r"select p_partkey, '\frac{' || (p_size % 9 + 1) || '}{2}\sqrt{5}' as value from part"),
    "t14_grade": (t14_grade, "select p_partkey, p_partkey % 2 = 0 as equal from part"),
    "t22_contains": (t22_contains, f"select conv_id, turn, true as has from conversations where {_NORMAL} is not null"),
    "t28_mixed_score": (t28_mixed_score, "select p_partkey, round(case when p_size % 4 = 2 then 0.9::double else 0 end + 0.1, 6) as score from part"),
    "t33_lenient_json": (t33_lenient_json, """select event_id, '{"a": true, "b": "x \\"y\\" z", "c": [' || user_id || ', null]}' as json from events"""),
    "t36_fenced": (t36_fenced, "select event_id, cast(json_extract(props, '$.k') as int) as k from events"),
    "t40_channel_calls": (t40_channel_calls, "select event_id, 1 as n, event_type as name, props as arguments from events"),
    "t47_group_scene": (t47_group_scene, "select p_brand, 'main_group' as name, count(*) as n from part group by 1"),
    "t55_two_formats": (t55_two_formats, "select p_partkey, case when p_partkey % 2 = 0 then 1 else 2 end as n from part"),
    "t56_gold_answer": (t56_gold_answer, "select p_partkey, cast(p_size * 1000 as varchar) as gold from part"),
    "t65_any_gold": (t65_any_gold, "select p_partkey, case when p_size % 3 <> 0 and p_size % 5 in (1, 4) then 1.0::double else 0 end as score, case when p_size % 3 <> 0 then 1.0::double else 0 end as format from part"),
    "w06_nucleus": (w06_nucleus, "with p as (select *, exp(p_size / 10.0::double) / sum(exp(p_size / 10.0::double)) over (partition by p_brand) as p from part), c as (select *, sum(p) over (partition by p_brand order by p_size desc, p_partkey rows between unbounded preceding and 1 preceding) as b from p) select p_brand, count(*) as kept, 1.0::double as p from c where coalesce(b, 0) <= 0.7 group by 1"),
    "w07_history": (w07_history, r"select conv_id, min(turn) as first, sum(n) as used from (select *, sum(n) over (partition by conv_id order by turn desc rows unbounded preceding) as u from (select *, len(regexp_split_to_array(trim(text), '\s+')) as n from conversations)) where u <= 80 group by 1"),
}
