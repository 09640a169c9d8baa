"""Further rows of the inventory: constructors, invariants, preparation recipes and rewards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import losses as L
from ..functions import text as X
from ..operators import batch, groups, masked, matching, prepare, retrieval
from ..operators import metrics as M
from ..session import scratch
from ..sources import files
from .common import r, table


def b01_columns_by_kind(s, d):
    """Column kinds of a batch, dense numbers and objects, with how many values each has."""
    df = table(s, d, "events")
    kind = lambda f: "number" if isinstance(f.dataType, T.NumericType) else "object"
    parts = [F.struct(F.lit(f.name).alias("name"), F.lit(kind(f)).alias("kind"), F.count(f.name).alias("n")) for f in df.schema.fields]
    return df.agg(F.array(*parts).alias("c")).select(F.inline("c"))


def b12_equal_maps(s, d):
    """Null-safe equality of nested values."""
    e = table(s, d, "events").select("event_id", F.struct("event_type", "value").alias("a"), F.struct(F.col("event_type"), F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")).alias("value")).alias("b"))
    return e.select("event_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def b30_consistency(s, d):
    return batch.consistent(table(s, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")


def b31_sizes(s, d):
    return batch.text_size(table(s, d, "documents"), "text")


def b36_keys(s, d):
    """Named columns of a batch, and what is left of it, side by side again."""
    got, rest = batch.pop(table(s, d, "part").withColumn("key", F.col("p_partkey")), "p_partkey", "p_name")
    left = rest.select("key", F.col("p_size").alias("left"))
    return got.join(left, F.col("p_partkey") == F.col("key")).select("p_partkey", "p_name", "left")


def b39_padded_to_ragged(s, d):
    held = F.sort_array(F.collect_list("event_id"))
    u = table(s, d, "events").groupBy("user_id").agg(held.alias("ids"))
    padded = u.withColumn("wide", batch.pad_array(F.col("ids"), 40, F.lit(-1).cast("long")))
    mask = F.transform("wide", lambda x: (x >= 0).cast("int"))
    return padded.withColumn("mask", mask).select("user_id", F.size(batch.keep_masked(F.col("wide"), F.col("mask"))).alias("n"), F.size("wide").alias("width"))


def s01_sampled_parquet(s, d):
    return files.read_parquet(s, [f"{d}/orders.parquet"], 50, "o_orderkey", "42").select("o_orderkey")


def s02_nested_fields(s, d):
    e = table(s, d, "conversations").select("conv_id", "turn", F.struct(F.struct(F.col("text").alias("question"), F.col("role").alias("answer")).alias("extra")).alias("x"))
    return e.select("conv_id", "turn", F.col("x.extra.question").alias("question"), F.col("x.extra.answer").alias("answer"))


def s03_optional_columns(s, d):
    return prepare.missing_columns(table(s, d, "conversations"), role="string", tools="string").select("conv_id", "turn", "role", "tools")


def s04_preferences(s, d):
    path = scratch(s, "preferences")
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("chosen"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("rejected"))
    o.write.parquet(path)
    return files.read_parquet(s, [path])


def s08_class_from_name(s, d):
    """The class of a file is its folder."""
    path = scratch(s, "classes")
    table(s, d, "part").select("p_partkey", "p_size").write.partitionBy("p_size").parquet(path)
    return files.class_from_folder(s, path, "p_size").groupBy("class").agg(F.count("*").alias("n"))


def s14_fan_out(s, d):
    """The same rows to two sinks."""
    made = files.fan_out(table(s, d, "customer").select("c_custkey", "c_mktsegment"), parquet=scratch(s, "a"), json=scratch(s, "b"))
    parts = [x.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("k")).withColumn("sink", F.lit(n)) for n, x in made.items()]
    return batch.concat(*parts)


def s22_cache_stats(s, d):
    x = table(s, d, "pages")
    return x.agg(F.count("*").alias("files"), r(F.sum(F.octet_length("html")) / 1e9, 9).alias("gb"))


def s23_step_order(s, d):
    e = table(s, d, "events").select((F.col("event_id") % 12).cast("string").alias("stem")).distinct().withColumn("step", F.col("stem").cast("int"))
    return batch.with_position(e, "step", name="place").select("stem", (F.col("place") + 1).cast("int").alias("place"))


def j03_prompt_index(s, d):
    """Whole prompts and passages from inside and at the ends of stored texts; and stored texts inside longer prompts."""
    b = table(s, d, "benchmark").where(F.length("text") > 60)
    n = F.length("text")
    inner = F.when(F.col("item_id") % 4 == 1, F.substring("text", 1, 60)).when(F.col("item_id") % 4 == 2, F.col("text").substr(n - 59, F.lit(60))).when(F.col("item_id") % 4 == 3, F.concat(F.lit("Please: "), "text", F.lit(" Thanks."))).otherwise(F.col("text"))
    probes = b.select(F.col("item_id").alias("probe"), inner.alias("prompt"))
    return matching.prompt_index(probes, "probe", "prompt", table(s, d, "benchmark"), "item_id", "text").select("probe", F.col("item_id").alias("item"), "tier")


def a08_kinds(s, d):
    """Every event type with every ending: which rule its name falls under."""
    ends = ("_max", "_min", "/mean", "_total", "_avg_max", "", "batch")
    names = table(s, d, "events").select("event_type").distinct().withColumn("end", F.explode(F.array(*[F.lit(e) for e in ends])))
    df = names.select(F.concat(F.when(F.col("event_type") == "click", "timing_s/").otherwise(""), "event_type", "end").alias("name"))
    return df.select("name", M.aggregation_kind(F.col("name"), last=("view",), weighted=("purchase_avg_max",)).alias("kind"), M.reduce_kind(F.col("name")).alias("reduced"))


def a25_rejection_metrics(s, d):
    li = table(s, d, "lineitem").where("l_returnflag <> 'R'").withColumn("w", F.exp(F.lit(10.0) * (F.col("l_tax") - F.col("l_discount"))))
    seq = li.groupBy("l_orderkey").agg(F.exp(F.sum(F.log("w"))).alias("w"), F.count("*").alias("n"))
    ok = L.accepted(F.col("w"), 2.0)
    return seq.agg(r(F.avg((~ok).cast("double"))).alias("rejected"), r(F.sum(F.when(~ok, F.col("n")).otherwise(0)) / F.sum("n")).alias("rejected_tokens"), r(F.avg((F.col("w") > 2).cast("double"))).alias("high"), r(F.avg((F.col("w") < 0.5).cast("double"))).alias("low"))


def a29_distributed_mean(s, d):
    li = table(s, d, "lineitem").withColumn("m", (F.col("l_returnflag") == "R").cast("int"))
    return li.agg(r(F.sum(F.col("l_quantity") * F.col("m")) / F.sum("m")).alias("mean"))


def g09_block_leave_one_out(s, d):
    """Leave-one-out over blocks of four consecutive orders, of two sources weighted."""
    o = batch.with_position(table(s, d, "orders"), "o_orderkey")
    w = Window.partitionBy(F.floor(F.col("pos") / 4))
    n = F.count("*").over(w)
    loo = lambda c: F.when(n > 1, F.col(c) - (F.sum(c).over(w) - F.col(c)) / (n - 1)).otherwise(F.col(c))
    o = o.withColumn("a", F.col("o_totalprice") / 1000).withColumn("b", (F.col("o_custkey") % 7).cast("double"))
    return o.select("o_orderkey", r(0.70710678 * loo("a") + 0.29289322 * loo("b"), 5).alias("advantage"))


def g14_dispatch(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("score"))
    x = groups.estimate("opo", li, "l_orderkey", "score", length="l_linenumber")
    return x.groupBy("l_orderkey").agg(r(F.sum("advantage"), 5).alias("total"))


def n01_penalty_names(s, d):
    li = table(s, d, "lineitem")
    a, b = -F.col("l_discount"), -F.col("l_tax")
    return li.groupBy("l_suppkey").agg(*[r(F.sum(L.kl_penalty(a, b, k)), 5).alias(n) for k, n in (("kl", "kl"), ("mse+", "mse"), ("low_var_kl+", "low_var_kl"))])


def n08_clip_cov(s, d):
    """A hash-drawn tenth of the tokens whose covariance lies in a band get no loss."""
    x = table(s, d, "lineitem").withColumns({"lp": -F.col("l_discount") * 10, "adv": (F.col("l_quantity") - 25) / 25})
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey")), 1, 8), 16, 10).cast("long") % 10 == 0
    means = x.agg(F.avg("lp").alias("ml"), F.avg("adv").alias("ma"))
    y = x.crossJoin(F.broadcast(means)).withColumn("cov", (F.col("lp") - F.col("ml")) * (F.col("adv") - F.col("ma")))
    off = (F.col("cov") > 0.05) & (F.col("cov") < 0.5) & draw
    return y.groupBy("l_suppkey").agg(F.sum(F.when(off, 1).otherwise(0)).alias("off"), r(F.avg(F.when(off, 0.0).otherwise(-F.col("adv") * F.col("lp"))), 5).alias("loss"))


def n11_corrected_loss(s, d):
    x = table(s, d, "lineitem").withColumns({"lp": -F.col("l_discount") * 10, "old": -F.col("l_tax") * 10, "adv": (F.col("l_quantity") - 25) / 25})
    w = L.importance_weight(F.col("lp") - F.col("old"), 2.0)
    keep = L.accepted(F.exp(F.col("lp") - F.col("old")), 1.8).cast("int")
    return x.groupBy("l_suppkey").agg(r(masked.masked_mean(-F.col("adv") * F.col("lp") * w, keep), 5).alias("loss"))


def n14_entropy_loss(s, d):
    li = table(s, d, "lineitem").withColumn("h", F.col("l_tax") * 3)
    return li.agg(r(masked.masked_mean(F.col("h"), (F.col("l_returnflag") != "R").cast("int"))).alias("loss"))


def n19_clip(s, d):
    return table(s, d, "part").select("p_partkey", L.clip(F.col("p_size"), 10, 30).cast("long").alias("size"))


def n29_contrast(s, d):
    """Each order against the mean price of its customer's orders of the other status."""
    o = table(s, d, "orders").withColumn("acc", F.col("o_orderstatus") == "O")
    g = o.groupBy("o_custkey", "acc").agg(F.avg("o_totalprice").alias("other"))
    x = o.join(g.withColumn("acc", ~F.col("acc")), ["o_custkey", "acc"], "left")
    z = F.when(F.col("acc"), F.col("o_totalprice") - F.col("other")).otherwise(F.col("other") - F.col("o_totalprice")) / 100000
    return x.where("other is not null").select("o_orderkey", r(L.dpo_loss(z, F.lit(0.0), 1.0), 5).alias("loss"))


def n33_round_up(s, d):
    return table(s, d, "part").select("p_partkey", L.ceil_div(F.col("p_size"), 8).alias("parts"), L.round_up(F.col("p_size"), 8).alias("size"))


def n36_hybrid(s, d):
    """Cosine to the first part's vector and closeness in size, weighted."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 0").first()
    if one is None:
        return e.select("vec_id", F.lit(0.0).alias("score"))
    size = lambda i: F.array((i % 7 + 1).cast("double"), (i % 5 + 1).cast("double"), (i % 3 + 1).cast("double"))
    near = retrieval.size_similarity(size(F.col("vec_id")), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)), 2.0)
    return e.select("vec_id", r(retrieval.hybrid(retrieval.cosine(F.col("v"), F.array(*[F.lit(x) for x in one.v])), near, 0.7), 5).alias("score"))


def n44_area_reward(s, d):
    area = F.col("p_size") * 1.0
    knots = [(4.0, -1.0), (8.0, 0.0), (15.0, 1.0), (30.0, 1.0), (40.0, 0.0), (50.0, -1.0)]
    return table(s, d, "part").select("p_partkey", r(L.piecewise(area, knots), 5).alias("reward"))


def n46_support_reward(s, d):
    p = table(s, d, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") < 4).cast("double")).alias("rate"))
    return p.select("p_brand", r(L.rate_reward(F.col("rate"), 0.1), 5).alias("reward"))


def n56_topk_divergence(s, d):
    """Divergence of two softmaxes over the first one's four largest entries."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("t"), F.reverse(F.col("embedding").cast("array<double>")).alias("u"))
    both = e.select("vec_id", F.posexplode(F.arrays_zip("t", "u")).alias("i", "x"))
    w = Window.partitionBy("vec_id")
    norm = both.withColumn("lt", F.col("x.t") - F.log(F.sum(F.exp("x.t")).over(w))).withColumn("lu", F.col("x.u") - F.log(F.sum(F.exp("x.u")).over(w)))
    top = norm.withColumn("rn", F.row_number().over(w.orderBy(F.desc("x.t"), "i"))).where("rn <= 4")
    return top.groupBy("vec_id").agg(r(F.sum(F.exp("lt") * (F.col("lt") - F.col("lu"))), 5).alias("kl"))


def n58_sequence(s, d):
    p = table(s, d, "part")
    want = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (F.col("p_size") + i * 2) % 10)
    given = F.array((F.col("p_size") + 2) % 10, (F.col("p_size") + 4) % 10, (F.col("p_size") + F.col("p_partkey") % 3 + 5) % 10)
    return p.select("p_partkey", (want == given).cast("double").alias("reward"))


def t07_strict_box(s, d):
    p = table(s, d, "part")
    boxed = X.last_boxed(X.tail(F.concat(F.lit(r"\boxed{9} "), F.repeat(F.lit("x"), F.col("p_size") * 4), F.lit(" end")), 100))
    return p.select("p_partkey", F.when(boxed == "9", 1.0).otherwise(-1.0).alias("score"))


def t09_boxed_equal(s, d):
    p = table(s, d, "part")
    boxed = X.strip_latex(X.last_boxed(F.concat(F.lit(r"\boxed{\dfrac "), (F.col("p_size") % 3).cast("string"), F.lit("4}"))))
    return p.select("p_partkey", F.when(boxed == X.strip_latex(F.lit("1/4")), 1.0).otherwise(0.0).alias("score"))


def t15_units(s, d):
    t = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " million").otherwise(" %"))
    return table(s, d, "part").select("p_partkey", r(X.value_with_unit(t), 4).alias("value"))


def t26_contains_score(s, d):
    c = table(s, d, "conversations")
    t = F.concat(F.lit("<answer>"), "text", F.lit("</answer>"))
    return c.select("conv_id", "turn", r(X.answer_score(t, F.array(F.element_at(F.split("text", " "), 2), F.lit("zzz")), contains=True)).alias("score"))


def t30_step_judge(s, d):
    return table(s, d, "part").select("p_partkey", r(X.step_verdict(F.col("p_size") % 6 - 1, F.col("p_partkey") % 6 - 1), 4).alias("score"))


def t31_point_reward(s, d):
    points = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (F.col("p_size") * i) % 20)
    return table(s, d, "part").select("p_partkey", r(X.point_reward(points, 5, 9), 5).alias("reward"))


def t38_embedded_scene(s, d):
    e = table(s, d, "events").select("event_id", F.concat(F.lit("make it <scene>"), F.when(F.col("event_id") % 3 == 0, F.lit("{bad")).otherwise(F.col("props")), F.lit("</scene> nice")).alias("t"))
    parsed = F.from_json(X.first_tag(F.col("t"), "scene"), "k int")
    return e.select("event_id", parsed["k"].alias("k"), X.without_tags(F.col("t"), "scene").alias("prompt"))


def t44_first_pattern(s, d):
    """The first pattern of an ordered table that a name contains."""
    kind = X.first_rule(F.col("p_name"), [(("red",), "warm"), (("blue",), "cold"), (("e",), "any")])
    return table(s, d, "part").select("p_partkey", kind.alias("kind")).where("kind is not null")


def t66_tag_balance(s, d):
    c = table(s, d, "conversations").withColumn("t", F.concat(F.when(F.col("turn") % 3 == 0, "<think>a</think>").otherwise("<think>"), F.lit("<answer>"), "text", F.lit("</answer>")))
    balanced = F.regexp_count("t", F.lit("<think>")) == F.regexp_count("t", F.lit("</think>"))
    a = X.first_tag(F.col("t"), "answer")
    return c.select("conv_id", "turn", balanced.alias("balanced"), F.when(F.length(a) >= 1000, F.lit("")).otherwise(a).alias("answer"))


def t72_bleu(s, d):
    """Against the conversation's first turn."""
    c = table(s, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("ref"))
    return c.join(first, "conv_id").select("conv_id", "turn", r(X.bleu(F.col("text"), F.col("ref")), 5).alias("bleu"))


def t75_search_text(s, d):
    b = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("h"))
    return b.select("conv_id", X.search_text(F.transform("h", lambda x: x["text"])).alias("text"))


def d07_packed_order(s, d):
    o = table(s, d, "documents").withColumn("work", L.workload(F.col("n_chars")))
    w = Window.partitionBy("source").orderBy("work", "doc_id")
    return o.select("doc_id", (F.row_number().over(w) % 2 == 1).alias("rising"))


def d08_padded_chunks(s, d):
    o = batch.pad_to_divisor(batch.with_position(table(s, d, "orders").select("o_orderkey"), "o_orderkey"), 16)
    return batch.chunk(o, 16).groupBy("chunk").agg(F.count("*").alias("n"), F.sum(F.col("is_pad").cast("int")).alias("pads"))


def m12_limited(s, d):
    e = table(s, d, "events")
    return e.groupBy("event_type").agg(r(F.avg(F.when(F.col("value") > 99, 0.0).otherwise(F.col("value"))), 4).alias("score"), F.sum((F.col("value") > 99).cast("int")).alias("timeouts"))


_LG = "(select *, -l_discount * 10 as lp, -l_tax * 10 as old, (l_quantity - 25) / 25 as adv from lineitem)"
_PW = "case when a <= 4 then -1 when a <= 8 then -1 + (a - 4) / 4 when a <= 15 then (a - 8) / 7 when a <= 30 then 1 when a <= 40 then 1 - (a - 30) / 10 when a <= 50 then -(a - 40) / 10 else -1 end"
_GRAMS = "select conv_id, turn, n, substr({0}, i, n) as s, count(*) as c from (select *, unnest(range(1, length({0}) - n + 2)) as i from x) group by all"

QUERIES = {
    "a08_kinds": (a08_kinds, "select n as name, case when n = 'view' then 'last' when n = 'purchase_avg_max' then 'weighted_avg' when n like 'timing_s/%' then 'sum' when n like '%mean%' or n like '%avg%' then 'avg' when n like '%max%' then 'max' when n like '%min%' then 'min' when n like '%sum%' or n like '%total%' then 'sum' else 'avg' end as kind, case when n like '%max%' then 'max' when n like '%min%' then 'min' else 'mean' end as reduced from (select distinct case when event_type = 'click' then 'timing_s/' else '' end || event_type || e as n from events, (values ('_max'), ('_min'), ('/mean'), ('_total'), ('_avg_max'), (''), ('batch')) t(e))"),
    "a25_rejection_metrics": (a25_rejection_metrics, "select round(avg(case when w between 0.5 and 2 then 0.0::double else 1 end), 6) as rejected, round(sum(case when w between 0.5 and 2 then 0 else n end) / sum(n), 6) as rejected_tokens, round(avg(case when w > 2 then 1.0::double else 0 end), 6) as high, round(avg(case when w < 0.5 then 1.0::double else 0 end), 6) as low from (select exp(sum(10 * (l_tax - l_discount))) as w, count(*) as n from lineitem where l_returnflag <> 'R' group by l_orderkey)"),
    "a29_distributed_mean": (a29_distributed_mean, "select round(avg(l_quantity), 6) as mean from lineitem where l_returnflag = 'R'"),
    "b01_columns_by_kind": (b01_columns_by_kind, "select name, case when name in ('event_id', 'user_id', 'value') then 'number' else 'object' end as kind, n from (unpivot (select count(event_id) as event_id, count(ts) as ts, count(user_id) as user_id, count(event_type) as event_type, count(value) as value, count(props) as props from events) on columns(*) into name name value n)"),
    "b12_equal_maps": (b12_equal_maps, "select event_id, event_id % 5 <> 0 or value is null as same from events"),
    "b30_consistency": (b30_consistency, "select count(l_orderkey) as l_orderkey, count(l_partkey) as l_partkey, count(l_quantity) as l_quantity, count(*) as rows from lineitem"),
    "b31_sizes": (b31_sizes, "select sum(octet_length(encode(text))) as text_bytes, count(*) as rows from documents"),
    "b36_keys": (b36_keys, "select p_partkey, p_name, p_size as left from part"),
    "b39_padded_to_ragged": (b39_padded_to_ragged, "select user_id, count(*) as n, greatest(count(*), 40) as width from events group by 1"),
    "d07_packed_order": (d07_packed_order, "select doc_id, row_number() over (partition by source order by 24576 * n_chars + n_chars * n_chars, doc_id) % 2 = 1 as rising from documents"),
    "d08_padded_chunks": (d08_padded_chunks, "with n as (select count(*) as n, ((count(*) + 15) // 16) as k from orders) select i as chunk, k as n, greatest(0, least(k, (i + 1) * k - n)) as pads from n, range(16) t(i)"),
    "g09_block_leave_one_out": (g09_block_leave_one_out, "with o as (select *, (row_number() over (order by o_orderkey) - 1) // 4 as g, o_totalprice / 1000 as a, (o_custkey % 7)::double as b from orders), x as (select *, count(*) over (partition by g) as n, sum(a) over (partition by g) as sa, sum(b) over (partition by g) as sb from o) select o_orderkey, round(0.70710678::double * case when n > 1 then a - (sa - a) / (n - 1) else a end + 0.29289322::double * case when n > 1 then b - (sb - b) / (n - 1) else b end, 5) + 0.0 as advantage from x"),
    "g14_dispatch": (g14_dispatch, "select l_orderkey, round(sum(l_quantity - case when n > 1 then base else 0 end), 5) + 0.0 as total from (select *, count(*) over (partition by l_orderkey) as n, sum(l_quantity * l_linenumber) over (partition by l_orderkey) / sum(l_linenumber) over (partition by l_orderkey) as base from lineitem) group by 1"),
    "j03_prompt_index": (j03_prompt_index, "with p as (select item_id as probe, case item_id % 4 when 1 then substr(text, 1, 60) when 2 then substr(text, length(text) - 59, 60) when 3 then 'Please: ' || text || ' Thanks.' else text end as t from benchmark where length(text) > 60), x as (select probe, item_id as item, case when t = text then 1 else 2 end as tier from p join benchmark on t = text or (length(t) > 50 and (contains(text, t) or (text <> '' and contains(t, text))))) select probe, item, tier from x qualify row_number() over (partition by probe order by tier, item) = 1"),
    "m12_limited": (m12_limited, "select event_type, round(avg(case when value > 99 then 0 else value end), 4) as score, count(case when value > 99 then 1 end) as timeouts from events group by 1"),
    "n01_penalty_names": (n01_penalty_names, "select l_suppkey, round(sum(l_tax - l_discount), 5) + 0.0 as kl, round(sum(0.5 * pow(l_tax - l_discount, 2)), 5) as mse, round(sum(exp(l_discount - l_tax) - (l_discount - l_tax) - 1), 5) as low_var_kl from lineitem group by 1"),
    "n08_clip_cov": (n08_clip_cov, f"with x as {_LG}, m as (select avg(lp) as ml, avg(adv) as ma from x), y as (select *, (lp - ml) * (adv - ma) > 0.05 and (lp - ml) * (adv - ma) < 0.5 and cast('0x' || substr(md5(l_orderkey || ':' || l_partkey || ':' || l_suppkey), 1, 8) as bigint) % 10 = 0 as off from x, m) select l_suppkey, count(case when off then 1 end) as off, round(avg(case when off then 0 else -adv * lp end), 5) + 0.0 as loss from y group by 1"),
    "n11_corrected_loss": (n11_corrected_loss, f"select l_suppkey, round(sum(case when exp(lp - old) between 1 / 1.8::double and 1.8 then -adv * lp * least(exp(lp - old), 2) else 0 end) / (count(case when exp(lp - old) between 1 / 1.8::double and 1.8 then 1 end) + 1e-8), 5) + 0.0 as loss from {_LG} group by 1"),
    "n14_entropy_loss": (n14_entropy_loss, "select round(sum(case when l_returnflag <> 'R' then l_tax * 3 else 0 end) / (count(case when l_returnflag <> 'R' then 1 end) + 1e-8), 6) as loss from lineitem"),
    "n19_clip": (n19_clip, "select p_partkey, least(greatest(p_size, 10), 30) as size from part"),
    "n29_contrast": (n29_contrast, "with g as (select o_custkey, o_orderstatus = 'O' as acc, avg(o_totalprice) as other from orders group by 1, 2), x as (select o_orderkey, case when o_orderstatus = 'O' then o_totalprice - other else other - o_totalprice end / 100000 as z from orders join g on g.o_custkey = orders.o_custkey and g.acc <> (o_orderstatus = 'O')) select o_orderkey, round(greatest(-z, 0) + ln(1 + exp(-abs(z))), 5) as loss from x"),
    "n33_round_up": (n33_round_up, "select p_partkey, (p_size + 7) // 8 as parts, (p_size + 7) // 8 * 8 as size from part"),
    "n36_hybrid": (n36_hybrid, "select b.vec_id, round(0.7 * list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) + 0.3::double * exp(-(pow(b.vec_id % 7, 2) + pow(b.vec_id % 5, 2) + pow(b.vec_id % 3, 2)) / 8.0::double), 5) as score from embeddings a, embeddings b where a.vec_id = 0"),
    "n44_area_reward": (n44_area_reward, f"select p_partkey, round({_PW}, 5) + 0.0 as reward from (select *, p_size::double as a from part)"),
    "n46_support_reward": (n46_support_reward, "select p_brand, round(case when rate = 0 then 1 when rate <= 0.1 then 1 - rate / 0.1 else -(rate - 0.1) / 0.9 end, 5) + 0.0 as reward from (select p_brand, avg(case when p_size < 4 then 1.0::double else 0 end) as rate from part group by 1)"),
    "n56_topk_divergence": (n56_topk_divergence, "with e as (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding)::double as t, unnest(list_reverse(embedding))::double as u from embeddings), n as (select *, t - ln(sum(exp(t)) over (partition by vec_id)) as lt, u - ln(sum(exp(u)) over (partition by vec_id)) as lu from e), k as (select *, row_number() over (partition by vec_id order by t desc, i) as rn from n) select vec_id, round(sum(exp(lt) * (lt - lu)), 5) + 0.0 as kl from k where rn <= 4 group by 1"),
    "n58_sequence": (n58_sequence, "select p_partkey, case when (p_size + 6) % 10 = (p_size + p_partkey % 3 + 5) % 10 then 1.0::double else 0 end as reward from part"),
    "s01_sampled_parquet": (s01_sampled_parquet, "select o_orderkey from orders order by md5('42:' || o_orderkey), o_orderkey limit 50"),
    "s02_nested_fields": (s02_nested_fields, "select conv_id, turn, text as question, role as answer from conversations"),
    "s03_optional_columns": (s03_optional_columns, "select conv_id, turn, role, cast(null as varchar) as tools from conversations"),
    "s04_preferences": (s04_preferences, "select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as chosen, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as rejected from orders group by 1"),
    "s08_class_from_name": (s08_class_from_name, "select cast(p_size as varchar) as class, count(*) as n from part group by 1"),
    "s14_fan_out": (s14_fan_out, "select count(*) as n, sum(c_custkey) as k, s as sink from customer, (values ('parquet'), ('json')) t(s) group by s"),
    "s22_cache_stats": (s22_cache_stats, "select count(*) as files, round(sum(octet_length(encode(html))) / 1e9, 9) as gb from pages"),
    "s23_step_order": (s23_step_order, "select stem, row_number() over (order by cast(stem as int)) as place from (select distinct cast(event_id % 12 as varchar) as stem from events)"),
    "t07_strict_box": (t07_strict_box, "select p_partkey, case when p_size * 4 + 14 <= 100 then 1.0::double else -1 end as score from part"),
    "t09_boxed_equal": (t09_boxed_equal, "select p_partkey, case when p_size % 3 = 1 then 1.0::double else 0 end as score from part"),
    "t15_units": (t15_units, "select p_partkey, round(case when p_size % 2 = 0 then p_size * 1e6 else p_size / 100.0::double end, 4) as value from part"),
    "t26_contains_score": (t26_contains_score, r"select conv_id, turn, case when contains(x, y) or contains(x, 'zzz') then 1.0::double else 0 end as score from (select conv_id, turn, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w not in ('', 'a', 'an', 'the')), ' ') as x, coalesce(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(string_split(text, ' ')[2]), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w not in ('', 'a', 'an', 'the')), ' '), '') as y from conversations)"),
    "t30_step_judge": (t30_step_judge, "select p_partkey, round(case when p_size % 6 = p_partkey % 6 then 1.0::double when p_size % 6 = 0 or p_partkey % 6 = 0 then -1 else -abs(p_size % 6 - p_partkey % 6) / 10.0::double end, 4) as score from part"),
    "t31_point_reward": (t31_point_reward, "select p_partkey, round(case when p_size % 20 between 5 and 9 then 1 / sqrt(3) when p_size * 2 % 20 between 5 and 9 then 1 / sqrt(6) when p_size * 3 % 20 between 5 and 9 then 1 / sqrt(9) else -1 / 3.0::double end, 5) as reward from part"),
    "t38_embedded_scene": (t38_embedded_scene, "select event_id, case when event_id % 3 <> 0 then cast(json_extract(props, '$.k') as int) end as k, 'make it  nice' as prompt from events"),
    "t44_first_pattern": (t44_first_pattern, "select p_partkey, case when contains(lower(p_name), 'red') then 'warm' when contains(lower(p_name), 'blue') then 'cold' else 'any' end as kind from part where contains(lower(p_name), 'e') or contains(lower(p_name), 'red') or contains(lower(p_name), 'blue')"),
    "t66_tag_balance": (t66_tag_balance, "select conv_id, turn, turn % 3 = 0 as balanced, case when length(text) >= 1000 then '' else nullif(text, '') end as answer from conversations"),
    "t72_bleu": (t72_bleu, f"with f as (select conv_id, arg_min(text, turn) as ref from conversations group by 1), x as (select conv_id, turn, text as h, ref as g, unnest([1, 2, 3, 4]) as n from conversations join f using (conv_id)), a as ({_GRAMS.format('h')}), b as ({_GRAMS.format('g')}), m as (select conv_id, turn, n, sum(least(a.c, coalesce(b.c, 0))) as hits, sum(a.c) as total from a left join b using (conv_id, turn, n, s) group by 1, 2, 3), y as (select conv_id, turn, any_value(h) as h, any_value(g) as g, max(case when n = 1 then hits else 0 end) as one, exp(sum(0.25 * ln(case when hits > 0 then hits / total else 2.2250738585072014e-308 end))) as p from x left join m using (conv_id, turn, n) group by 1, 2) select conv_id, turn, round(case when coalesce(one, 0) = 0 then 0.0 else p * case when length(h) > length(g) then 1.0 else exp(1 - length(g)::double / length(h)) end end, 5) as bleu from y"),
    "t75_search_text": (t75_search_text, "select conv_id, case when count(*) > 1 then 'success' else 'empty' end || chr(10) || string_agg(text, chr(10) || '---' || chr(10) order by turn, text) as text from conversations group by 1"),
}
