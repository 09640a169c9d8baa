"""Metric aggregation over events, line items, labels and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import prepare as P
from ..operators import retrieval
from .common import r, table


def _long(s, d):
    e = table(s, d, "events")
    names = F.array(*[F.lit(n) for n in ("actor/loss_max", "actor/minibatch", "timing_s/gen", "score/mean", "tokens/total", "perf/x")])
    return e.select("event_id", (F.col("event_id") % 10).alias("step"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("name"), "value", (F.col("user_id") + 1).alias("weight"))


_LONG = "(select event_id, event_id % 10 as step, (['actor/loss_max', 'actor/minibatch', 'timing_s/gen', 'score/mean', 'tokens/total', 'perf/x'])[event_id % 6 + 1] as name, value, user_id + 1 as weight from events)"
_KIND = "case when name = 'perf/x' then 'last' when starts_with(name, 'timing_s/') then 'sum' when contains(name, 'mean') or contains(name, 'avg') then 'avg' when contains(name, 'max') then 'max' when contains(name, 'min') then 'min' when contains(name, 'sum') or contains(name, 'total') then 'sum' else 'avg' end"


def a07_reduce_by_name(s, d):
    x = M.reduce_by_name(_long(s, d), "name", "value", "step")
    return x.select("step", "name", r("value", 4).alias("value"))


def a09_aggregate_by_kind(s, d):
    x = M.aggregate_by_kind(_long(s, d), M.aggregation_kind(F.col("name"), last=("perf/x",)), "value", "event_id", "weight", "step", "name")
    return x.select("step", "name", "kind", r("value", 4).alias("value"))


def a09_weighted(s, d):
    x = M.aggregate_by_kind(_long(s, d), M.aggregation_kind(F.col("name"), weighted=("perf/x", "score/mean")), "value", "event_id", "weight", "name")
    return x.where("kind = 'weighted_avg'").select("name", r("value", 4).alias("value"))


def a10_special(s, d):
    x = M.spread_and_idle(table(s, d, "events"), "user_id", "value", 4)
    return x.select("user_id", r("spread", 4).alias("spread"), r("throughput").alias("throughput"), r("idle").alias("idle"))


def a11_data_metrics(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("score"), F.sum("l_extendedprice").alias("ret"), (F.sum("l_quantity") * 1000).alias("val"), F.count("*").alias("len"))
    return li.agg(
        r(F.avg("score"), 4).alias("score_mean"), r(F.max("score"), 4).alias("score_max"), r(F.min("score"), 4).alias("score_min"), r(M.explained_variance("ret", "val"), 5).alias("explained"),
        r(F.avg("len"), 5).alias("len_mean"), F.max("len").alias("len_max"), r(F.avg((F.col("len") == 7).cast("double"))).alias("clip_ratio"),
    )


def a12_lengths(s, d):
    return M.role_lengths(table(s, d, "conversations"), "conv_id", "role", X.word_count(F.col("text")))


def a13_timing(s, d):
    x = M.timing(table(s, d, "events"), "event_type", "value", "user_id", 8, ("click",))
    return x.select("event_type", r("ms_per_token", 4).alias("ms_per_token"), r("throughput", 6).alias("throughput"))


def a15_best_at_n(s, d):
    x = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_quantity").alias("v"))
    return x.select("l_suppkey", r(M.best_of_n_expected(F.col("v"), 4), 5).alias("best_at_4_expected"), r(M.best_of_n_expected(F.col("v"), 4, worst=True), 5).alias("worst_at_4_expected"), r(M.best_of_n_deviation(F.col("v"), 4), 5).alias("best_at_4_std"))


def a15_bootstrap_exact(s, d):
    """The mean and population deviation of 1000 resamples with a generator seeded by 42 in each group."""
    g = table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return g.select("user_id", M.bootstrap_best(F.transform("v", lambda e: e["value"]), 4, 1000, 42, 6).alias("b")).select("user_id", "b.mean", "b.std")


def a16_majority(s, d):
    e = table(s, d, "events")
    return M.majority(e, "user_id", "event_type", "event_id", "value").select("user_id", "event_type", r("value", 4).alias("value"))


def a17_validation(s, d):
    li = table(s, d, "lineitem")
    v = M.validation_metrics(li, "l_returnflag", "l_orderkey", "l_quantity")
    return v.select("l_returnflag", "metric", r("value", 4).alias("value"), "prompts")


def a18_core_names(s, d):
    names = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    x = names.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("mean@", "std@", "best@", "worst@")])))
    core = F.col("event_type").isin("click", "view") & F.col("kind").isin("mean@", "best@")
    return x.select(M.validation_name(F.col("event_type"), F.col("kind"), F.col("n"), core).alias("name"))


def a19_mean_of_means(s, d):
    return M.mean_of_means(table(s, d, "lineitem"), "l_returnflag", "l_orderkey", "l_quantity").select("l_returnflag", r("score", 5).alias("score"), "n")


def a20_summary(s, d):
    x = M.summary(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return x.select("metric", "n", r("mean", 3).alias("mean"), r("std", 3).alias("std"), r("min", 3).alias("min"), r("max", 3).alias("max"))


def a21_unpivot(s, d):
    x = table(s, d, "labels").selectExpr("stack(2, 'quality', cast(quality as double), 'toxic', cast(toxic as double)) as (score, v)")
    return x.where("v is not null").groupBy("score").agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean"), r(F.stddev_pop("v")).alias("std"))


def a22_losses(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg((F.sum("l_discount") / 10).alias("oob"), (F.sum("l_tax") / 10).alias("col"))
    return M.loss_report(li, "oob", "col", 0.03).select(r("oob", 4).alias("oob"), r("oob_std", 4).alias("oob_std"), r("col", 4).alias("col"), r("valid").alias("valid"))


def a28_moments(s, d):
    return M.moments(table(s, d, "lineitem"), "l_quantity").select(r("mean", 5).alias("mean"), "max", "min", r("std", 5).alias("std"))


def a31_percentiles(s, d):
    e = table(s, d, "events")
    x = M.percentiles(e, "event_type", "value", 0.5, 0.95, 0.99).join(e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users")), "event_type")
    return x.select("event_type", *[r(c, 4).alias(c) for c in ("avg", "p50", "p95", "p99")], "users")


def a32_slowest(s, d):
    return M.slowest(table(s, d, "events"), "user_id", "value", "event_id", "event_type").withColumn("top", r("top", 4))


def a33_unbalance(s, d):
    return M.unbalance(table(s, d, "documents"), "source", "n_chars")


def a34_extents(s, d):
    x = M.extents(table(s, d, "part"), "p_brand", F.col("p_size") * F.col("p_retailprice") / 1000, 10, 30)
    return x.withColumn("extent", r("extent", 4))


def a35_preference_metrics(s, d):
    x = table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("c"), F.min("o_totalprice").alias("j"))
    return M.preference_metrics(x, "c", "j").select(r("chosen", 2).alias("chosen"), r("rejected", 2).alias("rejected"), r("margin", 2).alias("margin"), r("accuracy").alias("accuracy"))


def a37_weighted_rewards(s, d):
    x = M.weighted_rewards(table(s, d, "events"), "user_id", "event_type", "value", {"click": 0.01, "view": 0.02}, 0.005)
    return x.select("user_id", r("reward", 5).alias("reward"))


def a38_feedback(s, d):
    return M.worst_named(table(s, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


def a39_summary_lines(s, d):
    line = F.concat(F.lit("- "), F.col("s_name"), F.lit(" @ "), F.format_string("%.2f", "s_acctbal"))
    return M.lines_of(table(s, d, "supplier"), "s_nationkey", line)


def a40_flops(s, d):
    n = F.col("n_chars").cast("double")
    x = table(s, d, "documents").groupBy("source").agg(F.sum(n).alias("t"), F.sum(n * n).alias("q"))
    return x.select("source", r(M.flops(F.col("t"), F.col("q"), 7e9, 28, 3584) / 1e15, 4).alias("petaflops"))


def _embeddings(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


_UNIT = "(select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"


def n37_norms(s, d):
    e = _embeddings(s, d)
    return e.select("vec_id", r(retrieval.norm(F.col("v")), 5).alias("norm"))


def j11_cross_similarity(s, d):
    """Every query (ids divisible by 20) against all rows."""
    e = _embeddings(s, d)
    top = retrieval.cosine_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "v", 5)
    return top.select("query", "item", r("score", 5).alias("score"), "rank")


def k01_softmax_nucleus(s, d):
    e = _embeddings(s, d)
    top = retrieval.cosine_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "v", 10)
    p = retrieval.nucleus(top, "query", "score", "item", temperature=0.1, top_p=0.9)
    return p.select("query", "item", r("p", 4).alias("p"))


def k03_rerank(s, d):
    e = _embeddings(s, d)
    top = retrieval.cosine_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "v", 10)
    size = lambda i: F.array((i % 7 + 1).cast("double"), (i % 5 + 1).cast("double"), (i % 3 + 1).cast("double"))
    gap = retrieval.aspect_difference(size(F.col("query")), size(F.col("item")))
    again = top.withColumn("score", F.round(F.col("score") * 100 - 10 * gap, 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return again.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("query", "item", r("score", 3).alias("score"), F.col("rank").cast("int").alias("rank"))


def k04_threshold(s, d):
    e = _embeddings(s, d)
    top = retrieval.cosine_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "v", 50)
    return retrieval.threshold_with_fallback(top, "query", "score", 0.6, 0.4).groupBy("query").agg(F.count("*").alias("n"))


def k05_greedy(s, d):
    """The most similar row of all other than the query itself."""
    e = _embeddings(s, d)
    top = retrieval.cosine_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "v", 2).where("query <> item")
    w = Window.partitionBy("query").orderBy("rank")
    return top.withColumn("place", F.row_number().over(w)).where("place = 1").select("query", "item")


def k07_distinct_cache(s, d):
    return P.cached_by(table(s, d, "part").select("p_partkey", "p_type", "p_size"), "p_partkey", "p_type", "p_size").select("p_partkey", "cached")


def k08_last(s, d):
    return P.last_of(table(s, d, "conversations"), "conv_id", "text", "turn")


def k09_sample_log(s, d):
    return P.sample_by_hash(table(s, d, "documents"), "doc_id", "42", 10).select("doc_id")


def k10_best_per_conversation(s, d):
    return P.best_of(table(s, d, "conversations"), "conv_id", F.desc("turn"), F.desc(F.length("text")), F.col("text")).select("conv_id", "turn", "role")


def n35_size_similarity(s, d):
    p = table(s, d, "part")
    a, b = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100), F.array(F.lit(25.0), F.lit(12.0))
    return p.select("p_partkey", r(retrieval.size_similarity(a, b, 10.0)).alias("similarity"), r(retrieval.distance(a, b), 5).alias("distance"))


_COS = f"""(select a.vec_id as query, b.vec_id as item, list_cosine_similarity(a.v, b.v) as score from {_UNIT} a, {_UNIT} b where a.vec_id % 20 = 0)"""
_TOPK = f"(select *, row_number() over (partition by query order by round(score, 9) desc, item) as rank from {_COS})"
_SIZE = "[({0} % 7 + 1)::double, ({0} % 5 + 1)::double, ({0} % 3 + 1)::double]"
_GAP = "(abs(ln((query % 7 + 1) / (query % 5 + 1)::double) - ln((item % 7 + 1) / (item % 5 + 1)::double)) + abs(ln((query % 7 + 1) / (query % 3 + 1)::double) - ln((item % 7 + 1) / (item % 3 + 1)::double)) + abs(ln((query % 5 + 1) / (query % 3 + 1)::double) - ln((item % 5 + 1) / (item % 3 + 1)::double))) / 3"
_VAL = "(select l_returnflag, l_orderkey, list_sort(list(l_quantity)) as up, list_reverse_sort(list(l_quantity)) as down, count(*) as n, avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem group by 1, 2)"
_EXP = "list_sum(list_transform(range(1, n + 1), lambda i: {v}[i] * (pow(i / n::double, {k}) - pow((i - 1) / n::double, {k}))))"

QUERIES = {
    "a07_reduce_by_name": (a07_reduce_by_name, f"select step, name, round(case when contains(name, 'max') then max(value) when contains(name, 'min') then min(value) else avg(value) end, 4) as value from {_LONG} group by 1, 2"),
    "a09_aggregate_by_kind": (a09_aggregate_by_kind, f"select step, name, kind, round(case kind when 'last' then arg_max(value, event_id) when 'sum' then sum(value) when 'max' then max(value) when 'min' then min(value) else avg(value) end, 4) as value from (select *, {_KIND} as kind from {_LONG}) group by 1, 2, 3"),
    "a09_weighted": (a09_weighted, f"select name, round(sum(value * weight) / sum(weight), 4) as value from {_LONG} where name in ('perf/x', 'score/mean') group by 1"),
    "a10_special": (a10_special, "select user_id, round(max(value) - min(value), 4) as spread, round(count(*) / (sum(value) * 4 + 1), 6) as throughput, round(min(value) / (max(value) + 1), 6) as idle from events group by 1"),
    "a11_data_metrics": (a11_data_metrics, "select round(avg(score), 4) as score_mean, round(max(score), 4) as score_max, round(min(score), 4) as score_min, round(1 - var_samp(ret - val) / (var_samp(ret) + 1e-5), 5) as explained, round(avg(len), 5) as len_mean, max(len) as len_max, round(avg(case when len = 7 then 1.0::double else 0 end), 6) as clip_ratio from (select sum(l_quantity) as score, sum(l_extendedprice) as ret, sum(l_quantity) * 1000 as val, count(*) as len from lineitem group by l_orderkey)"),
    "a12_lengths": (a12_lengths, r"select conv_id, sum(case when role = 'user' then n else 0 end) as prompt, sum(case when role <> 'user' then n else 0 end) as response from (select *, len(regexp_split_to_array(trim(text), '\s+')) as n from conversations) group by 1"),
    "a13_timing": (a13_timing, "select event_type, round(sum(value) * 1000 / case when event_type = 'click' then count(*) else sum(user_id) end, 4) as ms_per_token, round(sum(user_id) / (sum(value) * 8), 6) as throughput from events group by 1"),
    "a15_best_at_n": (a15_best_at_n, f"select l_suppkey, round({_EXP.format(v='up', k=4)}, 5) as best_at_4_expected, round({_EXP.format(v='down', k=4)}, 5) as worst_at_4_expected, round(sqrt(greatest(list_sum(list_transform(range(1, n + 1), lambda i: up[i] * up[i] * (pow(i / n::double, 4) - pow((i - 1) / n::double, 4)))) - pow({_EXP.format(v='up', k=4)}, 2), 0)), 5) as best_at_4_std from (select l_suppkey, list_sort(list(l_quantity)) as up, list_reverse_sort(list(l_quantity)) as down, count(*) as n from lineitem group by 1)"),
    "a15_bootstrap_exact": (a15_bootstrap_exact, None),
    "a16_majority": (a16_majority, "with v as (select user_id, event_type, count(*) as n, min(event_id) as first, arg_min(value, event_id) as value from events group by 1, 2) select user_id, event_type, round(value, 4) as value from v qualify row_number() over (partition by user_id order by n desc, first) = 1"),
    "a17_validation": (a17_validation, f"with g as {_VAL}, x as (select l_returnflag, 'mean@' || n as metric, m as value from g union all select l_returnflag, 'std@' || n, s from g union all select l_returnflag, 'best@' || k, {_EXP.format(v='up', k='k')} from g, (select cast(pow(2, i) as bigint) as k from range(1, 40) r(i)) t where k < n union all select l_returnflag, 'worst@' || k, {_EXP.format(v='down', k='k')} from g, (select cast(pow(2, i) as bigint) as k from range(1, 40) r(i)) t where k < n union all select l_returnflag, 'best@' || n, {_EXP.format(v='up', k='n')} from g where n > 1 union all select l_returnflag, 'worst@' || n, {_EXP.format(v='down', k='n')} from g where n > 1) select l_returnflag, metric, round(avg(value), 4) as value, count(*) as prompts from x group by 1, 2"),
    "a18_core_names": (a18_core_names, "select case when event_type in ('click', 'view') and k in ('mean@', 'best@') then 'val-core' else 'val-aux' end || '/' || event_type || '/' || k || n as name from (select event_type, count(*) as n from events group by 1), (values ('mean@'), ('std@'), ('best@'), ('worst@')) t(k)"),
    "a19_mean_of_means": (a19_mean_of_means, "select l_returnflag, round(avg(m), 5) as score, count(*) as n from (select l_returnflag, l_orderkey, avg(l_quantity) as m from lineitem group by 1, 2) group by 1"),
    "a20_summary": (a20_summary, "select metric, count(*) as n, round(avg(v), 3) as mean, round(stddev_pop(v), 3) as std, round(min(v), 3) as min, round(max(v), 3) as max from (select 'l_quantity' as metric, l_quantity as v from lineitem union all select 'l_extendedprice', l_extendedprice from lineitem union all select 'l_discount', l_discount from lineitem union all select 'l_tax', l_tax from lineitem) group by 1"),
    "a21_unpivot": (a21_unpivot, "select score, count(*) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from (select 'quality' as score, quality as v from labels union all select 'toxic', toxic from labels) where v is not null group by 1"),
    "a22_losses": (a22_losses, "select round(avg(oob) * 1000, 4) as oob, round(stddev_pop(oob) * 1000, 4) as oob_std, round(avg(col) * 1000, 4) as col, round(avg(case when round(oob + col, 9) <= 0.03 then 1.0::double else 0 end), 6) as valid from (select sum(l_discount) / 10 as oob, sum(l_tax) / 10 as col from lineitem group by l_orderkey)"),
    "a28_moments": (a28_moments, "select round(avg(l_quantity), 5) as mean, max(l_quantity) as max, min(l_quantity) as min, round(stddev_samp(l_quantity), 5) as std from lineitem"),
    "a31_percentiles": (a31_percentiles, "select event_type, round(avg(value), 4) as avg, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95, round(quantile_cont(value, 0.99), 4) as p99, count(distinct user_id) as users from events group by 1"),
    "a32_slowest": (a32_slowest, "select user_id, event_id, event_type, round(value, 4) as top from events qualify row_number() over (partition by user_id order by value desc, event_id desc) = 1"),
    "a33_unbalance": (a33_unbalance, "select min(t) as least, max(t) as most, max(t) - min(t) as spread from (select sum(n_chars) as t from documents group by source)"),
    "a34_extents": (a34_extents, "select p_brand, round(max(a) - min(a), 4) as extent, count(*) as n, sum(case when a between 10 and 30 then 1 else 0 end) as in_range from (select p_brand, p_size * p_retailprice / 1000 as a from part) group by 1"),
    "a35_preference_metrics": (a35_preference_metrics, "select round(avg(c), 2) as chosen, round(avg(j), 2) as rejected, round(avg(c - j), 2) as margin, round(avg(case when c > j then 1.0::double else 0 end), 6) as accuracy from (select max(o_totalprice) as c, min(o_totalprice) as j from orders group by o_custkey)"),
    "a37_weighted_rewards": (a37_weighted_rewards, "select user_id, round(sum(least(greatest(x, -1), 1)), 5) as reward from (select user_id, sum(value * case event_type when 'click' then 0.01::double when 'view' then 0.02 else 0.005 end) / count(*) as x from events group by user_id, event_type) group by 1"),
    "a38_feedback": (a38_feedback, "select o_custkey, string_agg(cast(o_orderkey as varchar), ', ' order by rn) || case when max(n) > 3 then ' and ' || (max(n) - 3) || ' more' else '' end as text from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, count(*) over (partition by o_custkey) as n from orders) where rn <= 3 group by 1"),
    "a39_summary_lines": (a39_summary_lines, "select s_nationkey, string_agg('- ' || s_name || ' @ ' || printf('%.2f', s_acctbal), chr(10) order by '- ' || s_name || ' @ ' || printf('%.2f', s_acctbal)) as text from supplier group by 1"),
    "a40_flops": (a40_flops, "select source, round((6.0::double * 7e9 * sum(n_chars) + 12.0::double * 28 * 3584 * sum(n_chars::double * n_chars)) / 1e15, 4) as petaflops from documents group by 1"),
    "n37_norms": (n37_norms, f"select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) as norm from {_UNIT}"),
    "j11_cross_similarity": (j11_cross_similarity, f"select query, item, round(score, 5) + 0.0 as score, rank from {_TOPK} where rank <= 5"),
    "k01_softmax_nucleus": (k01_softmax_nucleus, f"with t as (select * from {_TOPK} where rank <= 10), p as (select *, exp((score - max(score) over (partition by query)) / 0.1) as e from t), q as (select *, e / sum(e) over (partition by query) as p from p), c as (select *, sum(p) over (partition by query order by rank rows between unbounded preceding and 1 preceding) as before from q), k as (select * from c where coalesce(before, 0) <= 0.9) select query, item, round(p / sum(p) over (partition by query), 4) as p from k"),
    "k03_rerank": (k03_rerank, f"with t as (select query, item, round(score * 100 - 10 * {_GAP}, 6) as score from {_TOPK} where rank <= 10) select query, item, round(score, 3) + 0.0 as score, cast(row_number() over (partition by query order by score desc, item) as int) as rank from t qualify rank <= 3"),
    "k04_threshold": (k04_threshold, f"with t as (select * from {_TOPK} where rank <= 50), m as (select query, max(score) as m from t group by 1) select query, count(*) as n from t join m using (query) where round(score, 9) >= case when round(m, 9) >= 0.6 then 0.6 else 0.4 end group by 1"),
    "k05_greedy": (k05_greedy, f"select query, item from {_COS} where item <> query qualify row_number() over (partition by query order by round(score, 9) desc, item) = 1"),
    "k07_distinct_cache": (k07_distinct_cache, "select p_partkey, min(p_partkey) over (partition by p_type, p_size) as cached from part"),
    "k08_last": (k08_last, "select conv_id, arg_max(text, turn) as text from conversations group by 1"),
    "k09_sample_log": (k09_sample_log, "select doc_id from documents order by md5('42:' || doc_id), doc_id limit 10"),
    "k10_best_per_conversation": (k10_best_per_conversation, "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc, length(text) desc, text) = 1"),
    "n35_size_similarity": (n35_size_similarity, "select p_partkey, round(exp(-(pow(p_size - 25, 2) + pow(p_retailprice / 100 - 12, 2)) / (2 * 100)), 6) as similarity, round(sqrt(pow(p_size - 25, 2) + pow(p_retailprice / 100 - 12, 2)), 5) as distance from part"),
}
