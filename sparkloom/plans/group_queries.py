"""Masked aggregates and group-relative estimators over line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch, groups, masked
from .common import r, table

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _items(s, d):
    return table(s, d, "lineitem").select(*_KEY, F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("len"), F.col("l_returnflag"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"))


_N, _M, _S = (f"{x} over (partition by l_orderkey)" for x in ("count(*)", "avg(l_quantity)", "stddev_samp(l_quantity)"))


def _query(name, **options):
    def run(s, d):
        return groups.estimate(name, _items(s, d), "l_orderkey", "score", **options).select(*_KEY, r("advantage").alias("advantage"))

    return run


def _sql(expression: str, source: str = "lineitem") -> str:
    return f"select {_K}, round({expression}, 6) + 0.0 as advantage from {source}"


def g03_grpo_passk(s, d):
    li = _items(s, d).withColumn("tie", F.struct(*_KEY, "price", "disc", "tax"))
    best = groups.estimate("grpo_passk", li, "l_orderkey", "score", order="tie")
    return best.groupBy("l_orderkey").agg(F.count("*").alias("n"), r(F.sum("advantage")).alias("advantage"))


def g07_reinforce_baseline(s, d):
    li = groups.estimate("reinforce_plus_plus_baseline", _items(s, d), "l_orderkey", "score", length="len")
    return li.select(*_KEY, r("advantage", 5).alias("advantage"))


def g11_preference(s, d):
    o = batch.with_position(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return groups.preference_pairs(o, "pos", "o_totalprice").select("o_orderkey", "preferred")


def g12_weights(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return _items(s, d).select(*_KEY, *[r(groups.preference_weights(F.col("score"), lo, hi, h), 4).alias(h) for h in ("pow", "max_min", "max_random")])


def g13_kl_in_reward(s, d):
    li = _items(s, d)
    rewards = li.withColumn("reward", F.col("score") - 0.05 * (F.col("disc") - F.col("tax")) * (F.col("l_returnflag") == "R").cast("int"))
    return rewards.groupBy("l_orderkey").agg(r(F.sum("reward"), 4).alias("reward"), r(masked.masked_mean(F.col("disc") - F.col("tax"), (F.col("l_returnflag") == "R").cast("int"))).alias("kl"))


def a36_pairwise_accuracy(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_orderkey") % 3).alias("acc"))
    g = groups.pairwise_accuracy(o, "o_custkey", "o_orderkey", "o_totalprice", "acc")
    return g.select("o_custkey", r("agreement").alias("agreement"))


def _mask():
    return (F.col("l_returnflag") == "R").cast("int")


def a01_masked_sum(s, d):
    return _items(s, d).groupBy("l_suppkey").agg(r(masked.masked_sum(F.col("score"), _mask()), 2).alias("total"))


def a02_masked_mean(s, d):
    return _items(s, d).groupBy("l_suppkey").agg(r(masked.masked_mean(F.col("score"), _mask())).alias("mean"))


def a03_masked_var(s, d):
    return masked.masked_moments(_items(s, d), F.col("score"), _mask(), "l_suppkey").select("l_suppkey", "n", r("mean").alias("mean"), r("var", 5).alias("var"))


def a04_whiten(s, d):
    w = masked.whiten(_items(s, d), "score", _mask())
    return w.select(*_KEY, r("white", 5).alias("white"))


def a05_group_mean_std(s, d):
    g = masked.group_mean_std(_items(s, d), "l_orderkey", "score")
    return g.select("l_orderkey", "n", r("mean").alias("mean"), r("std").alias("std"))


def a06_index(s, d):
    return masked.dense_index(table(s, d, "documents").select("doc_id", "source"), "source").select("doc_id", F.col("index").cast("long").alias("index"))


def _loss(mode):
    def run(s, d):
        return masked.aggregate_loss(_items(s, d), "l_orderkey", F.col("score"), _mask(), mode, 7).select(r("loss", 5).alias("loss"))

    return run


_R = "case when l_returnflag = 'R' then 1 else 0 end"
_SEQ = f"(select l_orderkey, sum(l_quantity * {_R}) as s, sum({_R}) as n from lineitem group by 1)"
_CENTRED = f"(select *, l_quantity - case when {_N} > 1 then {_M} else 0 end as c from lineitem)"

QUERIES = {
    "g01_grpo": (_query("grpo"), _sql(f"(l_quantity - case when {_N} = 1 then 0 else {_M} end) / (case when {_N} = 1 then 1 else {_S} end + 1e-6)")),
    "g01_grpo_centred": (_query("grpo", by_std=False), _sql(f"l_quantity - case when {_N} = 1 then 0 else {_M} end")),
    "g02_grpo_vectorized": (_query("grpo_vectorized"), _sql(f"(l_quantity - case when {_N} = 1 then 0 else {_M} end) / (case when {_N} = 1 then 1 else sqrt(greatest(pow({_S}, 2), 1e-6)) end + 1e-6)")),
    "g03_grpo_passk": (g03_grpo_passk, "select l_orderkey, n, round(case when n > 1 then (a - b) / (sd + 1e-6) end, 6) + 0.0 as advantage from (select l_orderkey, count(*) as n, max(l_quantity) as a, list_sort(list(l_quantity), 'DESC')[2] as b, stddev_samp(l_quantity) as sd from lineitem group by 1)"),
    "g04_rloo": (_query("rloo"), _sql(f"case when {_N} > 1 then (l_quantity - {_M}) * {_N} / ({_N} - 1) else l_quantity end")),
    "g05_rloo_vectorized": (_query("rloo_vectorized"), _sql(f"case when {_N} > 1 then (l_quantity - {_M}) * {_N} / ({_N} - 1) else 0 end")),
    "g06_opo": (_query("opo", length="len"), _sql(f"l_quantity - case when {_N} > 1 then sum(l_quantity * l_linenumber) over (partition by l_orderkey) / sum(l_linenumber) over (partition by l_orderkey) else 0 end")),
    "g07_reinforce_baseline": (g07_reinforce_baseline, f"with c as {_CENTRED}, m as (select sum(c * l_linenumber) / (sum(l_linenumber) + 1e-8) as mean, sum(l_linenumber) as n from c), v as (select mean, n, sum(pow(c - mean, 2) * l_linenumber) / (n + 1e-8) * n / (n - 1) as var from c, m group by 1, 2) select {_K}, round((c - mean) / sqrt(var + 1e-8), 5) + 0.0 as advantage from c, v"),
    "g08_gpg": (_query("gpg"), _sql(f"(select count(*) / greatest(1, count(case when l_quantity <> 0 then 1 end)) from lineitem) * (l_quantity - case when {_N} > 1 then {_M} else 0 end)")),
    "g10_soft_mean": (_query("soft_mean", beta=0.5), _sql("l_quantity - (t + ln(sum(exp(0.5 * l_quantity - t)) over (partition by l_orderkey)) - ln(count(*) over (partition by l_orderkey))) / 0.5", "(select *, max(0.5 * l_quantity) over (partition by l_orderkey) as t from lineitem)")),
    "g11_preference": (g11_preference, "with o as (select *, row_number() over (order by o_orderkey) - 1 as pos from orders) select o_orderkey, row_number() over (partition by pos // 2 order by o_totalprice desc, pos) = 1 as preferred from o"),
    "g12_weights": (g12_weights, f"select {_K}, round(greatest(pow(abs(l_quantity), 2), 1e-8), 4) as pow, round(greatest(case when l_quantity in (lo, hi) then 1.0::double else 0 end, 1e-8), 4) as max_min, round(greatest(case when l_quantity = hi then 0.4::double else 0.1 end, 1e-8), 4) as max_random from (select *, min(l_quantity) over (partition by l_orderkey) as lo, max(l_quantity) over (partition by l_orderkey) as hi from lineitem)"),
    "g13_kl_in_reward": (g13_kl_in_reward, f"select l_orderkey, round(sum(l_quantity - 0.05 * (l_discount - l_tax) * {_R}), 4) as reward, round(sum((l_discount - l_tax) * {_R}) / (sum({_R}) + 1e-8), 6) + 0.0 as kl from lineitem group by 1"),
    "a01_masked_sum": (a01_masked_sum, f"select l_suppkey, round(sum(l_quantity * {_R}), 2) as total from lineitem group by 1"),
    "a02_masked_mean": (a02_masked_mean, f"select l_suppkey, round(sum(l_quantity * {_R}) / (sum({_R}) + 1e-8), 6) as mean from lineitem group by 1"),
    "a03_masked_var": (a03_masked_var, f"with m as (select l_suppkey, sum(l_quantity * {_R}) / (sum({_R}) + 1e-8) as mean, sum({_R}) as n from lineitem group by 1) select l_suppkey, n, round(mean, 6) as mean, round(case when n > 1 then s / (n + 1e-8) * n / (n - 1) end, 5) as var from (select l_suppkey, n, mean, sum(pow(l_quantity - mean, 2) * {_R}) as s from lineitem join m using (l_suppkey) group by 1, 2, 3)"),
    "a04_whiten": (a04_whiten, f"with m as (select sum(l_quantity * {_R}) / (sum({_R}) + 1e-8) as mean, sum({_R}) as n from lineitem), v as (select mean, n, sum(pow(l_quantity - mean, 2) * {_R}) / (n + 1e-8) * n / (n - 1) as var from lineitem, m group by 1, 2) select {_K}, round((l_quantity - mean) / sqrt(var + 1e-8), 5) + 0.0 as white from lineitem, v"),
    "a05_group_mean_std": (a05_group_mean_std, "select l_orderkey, count(*) as n, round(case when count(*) = 1 then 0 else avg(l_quantity) end, 6) as mean, round(case when count(*) = 1 then 1 else sqrt(greatest(var_samp(l_quantity), 1e-6)) end, 6) as std from lineitem group by 1"),
    "a06_index": (a06_index, "select doc_id, dense_rank() over (order by source) - 1 as index from documents"),
    "a30_token_mean": (_loss("token-mean"), f"select round(sum(l_quantity * {_R}) / (sum({_R}) + 1e-8), 5) as loss from lineitem"),
    "a30_seq_mean_token_sum": (_loss("seq-mean-token-sum"), f"select round(avg(s), 5) as loss from {_SEQ} where n > 0"),
    "a30_seq_mean_token_mean": (_loss("seq-mean-token-mean"), f"select round(avg(s / (n + 1e-8)), 5) as loss from {_SEQ} where n > 0"),
    "a30_seq_mean_token_sum_norm": (_loss("seq-mean-token-sum-norm"), f"select round(sum(s) / 7, 5) as loss from {_SEQ}"),
    "a36_pairwise_accuracy": (a36_pairwise_accuracy, "select a.o_custkey, round(case when sum(abs(a.o_orderkey % 3 - b.o_orderkey % 3)) > 0 then sum(case when (a.o_orderkey % 3 - b.o_orderkey % 3) * (a.o_totalprice - b.o_totalprice) > 0 then abs(a.o_orderkey % 3 - b.o_orderkey % 3) else 0 end) / sum(abs(a.o_orderkey % 3 - b.o_orderkey % 3)) else 0.5 end, 6) as agreement from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey group by 1"),
}
