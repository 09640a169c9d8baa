"""Ordered scans, losses, importance weights and rejection over line items and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions import scans as S
from ..operators import batch, masked, prepare
from ..operators import metrics as M
from .common import r, table

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
_O = ", ".join(_ORDER)


def _arrays(s, d):
    """Line items of an order as arrays: reward, value and mask, in a total order."""
    held = F.sort_array(F.collect_list(F.struct(*_ORDER, "l_returnflag")))
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(held.alias("h"))
    return li.select("l_orderkey", F.col("h.l_discount").alias("rew"), F.col("h.l_tax").alias("val"), F.transform("h.l_returnflag", lambda x: (x != "R").cast("int")).alias("mask"), F.col("h.l_linenumber").alias("lines"))


def _sum(a):
    return F.aggregate(F.col(a) if isinstance(a, str) else a, F.lit(0.0), lambda x, y: x + y)


def w01_gae(s, d):
    a = _arrays(s, d).withColumn("adv", S.gae(F.col("rew"), F.col("val"), F.col("mask"), 0.9531, 0.9173))
    return a.select("l_orderkey", r(_sum("adv"), 7).alias("total"), r(F.element_at("adv", 1), 7).alias("first"), F.size("adv").alias("n"))


def w02_returns(s, d):
    a = _arrays(s, d).withColumn("ret", S.discounted_returns(F.col("rew"), F.col("mask"), 0.9531))
    return a.select("l_orderkey", r(_sum("ret"), 7).alias("total"), r(F.element_at("ret", 1), 7).alias("first"))


def w03_suffix_sums(s, d):
    a = _arrays(s, d).withColumn("ret", S.suffix_sums(F.col("rew"), F.col("mask")))
    return a.select("l_orderkey", r(_sum("ret")).alias("total"), r(F.element_at("ret", 1)).alias("first"))


def w04_response_mask(s, d):
    a = _arrays(s, d).withColumn("m", S.response_mask(F.col("lines"), F.array(F.lit(3), F.lit(5))))
    return a.select("l_orderkey", F.array_join(F.col("m").cast("array<string>"), "").alias("mask"))


def w05_last_columns(s, d):
    return _arrays(s, d).select("l_orderkey", F.array_join(S.last_elements(F.col("mask"), 2).cast("array<string>"), "").alias("mask"))


def w08_inverse_permutation(s, d):
    return batch.inverse_permutation(table(s, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice", "o_orderkey")


def w09_iteration_max(s, d):
    return prepare.last_turns(table(s, d, "conversations"), "conv_id", "turn", 1)


def w10_turn_weighted(s, d):
    held = F.sort_array(F.collect_list(F.struct("event_id", "value")))
    e = table(s, d, "events").groupBy("user_id").agg(held.alias("h"))
    return e.select("user_id", r(S.turn_weighted_score(F.col("h.value"))).alias("score"))


def w11_packing_order(s, d):
    w = Window.partitionBy("source").orderBy(L.workload(F.col("n_chars")), "doc_id")
    x = table(s, d, "documents").withColumn("rank", F.row_number().over(w) - 1)
    order = Window.partitionBy("source").orderBy(F.col("rank") % 2, F.when(F.col("rank") % 2 == 0, F.col("rank")).otherwise(-F.col("rank")))
    return x.select("doc_id", "source", F.row_number().over(order).alias("slot"))


def g15_adaptive_kl(s, d):
    held = F.sort_array(F.collect_list(F.struct("event_id", "value")))
    e = table(s, d, "events").groupBy("user_id").agg(held.alias("h"))
    return e.select("user_id", r(S.adaptive_kl(F.col("h.value"), 0.2, 50.0, 10000.0, 64)).alias("kl"))


def m11_token_bucket(s, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    held = F.sort_array(F.collect_list(F.struct(at.alias("at"), "event_id", (F.col("value") / 10).alias("cost"))))
    e = table(s, d, "events").groupBy("user_id").agg(held.alias("h"))
    waits = S.token_bucket(F.col("h"), 0.001, 10.0)
    return e.select("user_id", r(_sum(waits), 3).alias("wait"), F.size("h").alias("n"))


def m18_non_improvement(s, d):
    return M.non_improvement(table(s, d, "events"), "user_id", "event_id", "value", -0.05).select("event_id", "penalty")


_KEYS = ["l_orderkey", *_ORDER[:3]]
_K = ", ".join(_KEYS)


def _logs(s, d):
    """Stand-ins for log-probabilities: new, old and reference."""
    li = table(s, d, "lineitem")
    return li.withColumns({"lp": -F.col("l_discount") * 10, "old": -F.col("l_tax") * 10, "adv": (F.col("l_quantity") - 25) / 25, "m": (F.col("l_returnflag") != "R").cast("int")})


_LOGS = "(select *, -l_discount * 10 as lp, -l_tax * 10 as old, (l_quantity - 25) / 25 as adv, case when l_returnflag <> 'R' then 1 else 0 end as m from lineitem)"


def n02_kl(s, d):
    x = _logs(s, d)
    return x.select(*_KEYS, *[r(L.kl_penalty(F.col("lp"), F.col("old"), k)).alias(k) for k in ("k1", "abs", "k2", "k3")])


def n03_rewards(s, d):
    return _logs(s, d).select(*_KEYS, r(L.kl_reward(F.col("adv"), F.col("old"), F.col("lp"), 0.1)).alias("reward"))


def n04_policy_loss(s, d):
    x = _logs(s, d)
    return x.select(*_KEYS, r(L.vanilla(F.col("lp"), F.col("old"), F.col("adv"))).alias("loss"))


def n04_clip_fraction(s, d):
    q, a = L.ratio(F.col("lp"), F.col("old")), F.col("adv")
    clipped = (-a * L.clip(q, 0.8, 1.2) > -a * q).cast("int")
    return _logs(s, d).groupBy("l_suppkey").agg(r(F.sum(clipped * F.col("m")) / (F.sum("m") + 1e-8)).alias("clipped"), r(F.sum((F.col("old") - F.col("lp")) * F.col("m")) / (F.sum("m") + 1e-8)).alias("kl"))


def n06_sequence_loss(s, d):
    x = _logs(s, d)
    mean = x.groupBy("l_orderkey").agg((F.sum((F.col("lp") - F.col("old")) * F.col("m")) / F.greatest(F.sum("m"), F.lit(1))).alias("mean"))
    y = x.join(mean, "l_orderkey").withColumn("q", L.sequence_ratio(F.col("lp"), F.col("old"), F.col("mean")))
    loss = F.greatest(-F.col("adv") * F.col("q"), -F.col("adv") * L.clip(F.col("q"), 0.9997, 1.0004))
    z = y.groupBy("l_orderkey").agg(F.sum(loss * F.col("m")).alias("s"), F.sum("m").alias("n"))
    return z.where("n > 0").select("l_orderkey", r(F.col("s") / (F.col("n") + 1e-8)).alias("loss"))


def n07_gpg_loss(s, d):
    return _logs(s, d).select(*_KEYS, r(L.gpg_loss(F.col("lp"), F.col("old"), F.col("adv"))).alias("loss"))


def k11_covariance_top(s, d):
    """The masked tokens of each supplier with the largest covariance of advantage and log-probability."""
    y = M.top_covariance(_logs(s, d).where("m = 1"), "l_suppkey", "adv", "lp", 0.02, "l_orderkey", *_ORDER)
    return y.groupBy("l_suppkey").agg(F.count("*").alias("kept"), r(F.sum("cov"), 4).alias("cov"))


def n09_kl_cov(s, d):
    x = _logs(s, d).where("m = 1")
    w = Window.partitionBy("l_suppkey")
    cov = (F.col("adv") - F.avg("adv").over(w)) * (F.col("lp") - F.avg("lp").over(w))
    y = x.withColumn("cov", F.round(cov, 9)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("cov"), "l_orderkey", *_ORDER))).withColumn("n", F.count("*").over(w))
    top = F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.02))
    loss = -F.col("adv") * L.ratio(F.col("lp"), F.col("old")) + F.when(top, F.abs(F.col("lp") - F.col("old"))).otherwise(0.0)
    return y.groupBy("l_suppkey").agg(r(F.avg(loss), 5).alias("loss"))


def n10_geometric_mean(s, d):
    loss = L.geometric_mean_loss(F.col("lp"), F.col("old"), F.col("adv"), F.col("m"), 0.4)
    return _logs(s, d).groupBy("l_orderkey").agg(loss.alias("x")).select("l_orderkey", r("x").alias("loss"))


def n13_value_loss(s, d):
    return _logs(s, d).select(*_KEYS, r(L.value_loss(F.col("adv"), F.col("old"), F.col("lp"), 0.5)).alias("loss"))


def _logits(s, d):
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("logits"), F.pmod("vec_id", F.size("embedding")).cast("int").alias("pick"))


_LOGITS = "(select vec_id, list_transform(embedding, lambda x: x::double) as l, vec_id % len(embedding) as pick from embeddings)"


def n15_entropy(s, d):
    return _logits(s, d).select("vec_id", r(L.entropy(F.col("logits")), 5).alias("entropy"))


def n17_log_prob(s, d):
    return _logits(s, d).select("vec_id", r(L.log_prob_of(F.col("logits"), F.col("pick")), 5).alias("log_prob"))


def n18_gather(s, d):
    return _logits(s, d).select("vec_id", r(F.get("logits", F.col("pick")), 5).alias("value"))


def n20_importance_weights(s, d):
    x = _logs(s, d)
    seq = x.groupBy("l_orderkey").agg(F.sum((F.col("lp") - F.col("old")) * F.col("m")).alias("t"), F.sum("m").alias("n"))
    w = L.importance_weight(F.col("t"), 2.0)
    return seq.select("l_orderkey", r(w).alias("sequence_weight"), r(L.importance_weight(F.col("t") / (F.col("n") + 1e-8), 2.0)).alias("geometric_weight"))


def n20_token_weights(s, d):
    x = _logs(s, d).withColumn("w", L.importance_weight(F.col("lp") - F.col("old"), 2.0))
    return x.groupBy("l_suppkey").agg(r(F.sum(F.col("w") * F.col("m")) / (F.sum("m") + 1e-8)).alias("mean"), r(F.max(F.when(F.col("m") == 1, F.col("w")))).alias("top"))


def n21_rejection(s, d):
    x = _logs(s, d)
    token = L.accepted(F.exp(L.clip(F.col("lp") - F.col("old"), -20.0, 20.0)), 1.5)
    seq = x.groupBy("l_orderkey").agg(F.sum((F.col("lp") - F.col("old")) * F.col("m")).alias("t"), F.sum("m").alias("n"), F.sum((token & (F.col("m") == 1)).cast("int")).alias("kept_tokens"))
    return seq.select("l_orderkey", "kept_tokens", L.accepted(F.exp(L.clip(F.col("t"), -20.0, 20.0)), 1.5).alias("sequence"), L.accepted(F.exp(L.clip(F.col("t") / (F.col("n") + 1e-8), -20.0, 20.0)), 1.5).alias("geometric"))


def n22_veto(s, d):
    low = (F.exp(L.clip(F.col("lp") - F.col("old"), -20.0, 20.0)) < 0.6) & (F.col("m") == 1)
    seq = _logs(s, d).groupBy("l_orderkey").agg(F.max(low.cast("int")).alias("veto"), F.sum("m").alias("n"))
    return seq.select("l_orderkey", F.when(F.col("veto") == 1, 0).otherwise(F.col("n")).alias("kept"))


def a23_offpolicy_metrics(s, d):
    x = _logs(s, d).withColumn("z", F.col("lp") - F.col("old"))
    seq = x.groupBy("l_orderkey").agg(F.sum("m").alias("n"), F.sum(F.col("lp") * F.col("m")).alias("a"), F.sum(F.col("old") * F.col("m")).alias("b")).where("n > 0")
    pa, pb = F.col("a") / F.col("n"), F.col("b") / F.col("n")
    one = seq.agg(r(F.avg(F.exp(-pa)), 5).alias("ppl"), r(F.avg(F.exp(-pb)), 5).alias("ppl_old"), r(F.avg(pb - pa), 5).alias("log_ppl_diff"), r(F.avg(F.abs(pb - pa)), 5).alias("log_ppl_abs_diff"), r(F.max(pb - pa), 5).alias("log_ppl_diff_max"), r(F.avg(F.exp(2 * L.clip(F.col("a") - F.col("b"), -20.0, 20.0))) - 1, 4).alias("chi2_sequence"))
    tok = x.where("m = 1").agg(r(F.avg(-F.col("z")), 5).alias("kl"), r(F.avg(F.exp(F.col("z")) - F.col("z") - 1), 5).alias("k3"), r(F.avg(F.exp(2 * L.clip(F.col("z"), -20.0, 20.0))) - 1, 5).alias("chi2_token"))
    return one.crossJoin(F.broadcast(tok))


def a24_weight_metrics(s, d):
    w = L.importance_weight(F.col("lp") - F.col("old"), 2.0)
    x = _logs(s, d).where("m = 1").withColumn("w", w)
    return x.groupBy("l_suppkey").agg(r(F.avg("w")).alias("mean"), r(F.max("w")).alias("max"), r(F.min("w")).alias("min"), r(F.avg((F.col("w") > 1.9).cast("int"))).alias("above"), r(F.avg((F.col("w") < 0.5).cast("int"))).alias("below"), r(F.pow(F.avg("w"), F.lit(2)) / F.avg(F.col("w") * F.col("w"))).alias("effective"))


def a26_debug_metrics(s, d):
    x = M.probability_gap(_logs(s, d).where("m = 1"), "l_suppkey", "lp", "old")
    return x.select("l_suppkey", *[r(c).alias(c) for c in ("max", "mean", "std", "pearson")])


def a27_mismatches(s, d):
    return _arrays(s, d).select("l_orderkey", S.mismatches(F.col("rew"), F.col("val"), F.col("mask")).alias("n"))


def n26_dpo(s, d):
    x = _logs(s, d).groupBy("l_orderkey").agg(F.max("lp").alias("c"), F.min("lp").alias("rj"))
    return x.select("l_orderkey", r(L.dpo_loss(F.col("c"), F.col("rj"), 0.1, 0.1)).alias("dpo"), r(L.ipo_loss(F.col("c"), F.col("rj"), 0.1)).alias("ipo"))


def n25_sppo(s, d):
    x = _logs(s, d).groupBy("l_orderkey").agg(F.sum((F.col("lp") - F.col("old")) * F.col("m")).alias("t"), F.max("adv").alias("a"))
    return x.select("l_orderkey", r(L.sppo_loss(F.col("t"), F.col("a"), 1.0)).alias("loss"))


def n27_batch_logps(s, d):
    on = F.col("l_linenumber") != 7
    return _logs(s, d).groupBy("l_orderkey").agg(r(L.sequence_log_prob(F.col("lp"), on)).alias("total"), r(L.sequence_log_prob(F.col("lp"), on, mean=True)).alias("mean"))


def n28_ce_dpo(s, d):
    x = _logs(s, d).groupBy("l_orderkey").agg(F.sum(F.col("lp") - F.col("old")).alias("t"), F.max("m").alias("acc"))
    return x.select("l_orderkey", r(L.bce(1 / (1 + F.exp(-0.05 * F.col("t"))), F.col("acc"))).alias("loss"))


def n30_flow(s, d):
    x = _logs(s, d).groupBy("l_orderkey").agg(F.avg("lp").alias("p"), F.avg("old").alias("q"), F.avg("adv").alias("a"))
    return x.select("l_orderkey", r(L.flow_loss(F.col("p"), F.col("q"), F.col("a")), 4).alias("loss"))


def n31_sft_loss(s, d):
    return masked.next_token_loss(_logs(s, d), "l_orderkey", list(_ORDER), "lp", "m").select("l_orderkey", r("loss").alias("loss"))


def n32_workload(s, d):
    x = F.col("n_chars")
    return table(s, d, "documents").select("doc_id", L.workload(x).alias("work"), L.ceil_div(x, 512).alias("blocks"), L.round_up(x, 512).alias("padded"), r(L.overlong_penalty(x, 4000, 1000, 1.0)).alias("penalty"))


def n40_rewards(s, d):
    p = table(s, d, "part")
    loss = F.col("p_size") / 400.0
    return p.select("p_partkey", r(L.voxel_reward(loss)).alias("voxel"), r(L.object_count_reward(F.col("p_size") % 20, F.lit(True))).alias("objects"), r(L.piecewise(F.col("p_size").cast("double"), [(20.0, 1.0), (45.0, 0.0), (100.0, -1.0)])).alias("collision"))


def n45_shape_reward(s, d):
    return table(s, d, "part").select("p_partkey", L.shape_reward(F.col("p_size") % 10).alias("reward"))


_ARR = f"(select l_orderkey, list(l_discount order by {_O}, l_returnflag) as rew, list(l_tax order by {_O}, l_returnflag) as val, list(case when l_returnflag <> 'R' then 1 else 0 end order by {_O}, l_returnflag) as mask, list(l_linenumber order by {_O}, l_returnflag) as lines from lineitem group by 1)"
_BACK = f"with recursive a as {_ARR}"
_PPL = "sum(m) as n, sum(lp * m) as a, sum(old * m) as b"
_COV = f"(select *, round((adv - avg(adv) over (partition by l_suppkey)) * (lp - avg(lp) over (partition by l_suppkey)), 9) as cov, count(*) over (partition by l_suppkey) as n from {_LOGS} where m = 1)"
_TOP = f"(select *, row_number() over (partition by l_suppkey order by cov desc, l_orderkey, {_O}) <= greatest(1, floor(n * 0.02)) as top from {_COV})"

QUERIES = {
    "w01_gae": (w01_gae, f"{_BACK}, f as (select l_orderkey, rew, val, mask, len(rew) as i, 0.0::double as v, 0.0::double as g, 0.0::double as total from a union all select l_orderkey, rew, val, mask, i - 1, case when mask[i] = 1 then val[i] else v end, case when mask[i] = 1 then rew[i] + 0.9531::double * v - val[i] + 0.9531::double * 0.9173::double * g else g end, total + case when mask[i] = 1 then rew[i] + 0.9531::double * v - val[i] + 0.9531::double * 0.9173::double * g else g end from f where i > 0) select l_orderkey, round(total, 7) + 0.0 as total, round(g, 7) + 0.0 as first, len(rew) as n from f where i = 0"),
    "w02_returns": (w02_returns, f"{_BACK}, f as (select l_orderkey, rew, mask, len(rew) as i, 0.0::double as g, 0.0::double as h, 0.0::double as total from a union all select l_orderkey, rew, mask, i - 1, (rew[i] + 0.9531::double * g) * mask[i], rew[i] + 0.9531::double * g, total + rew[i] + 0.9531::double * g from f where i > 0) select l_orderkey, round(total, 7) as total, round(h, 7) as first from f where i = 0"),
    "w03_suffix_sums": (w03_suffix_sums, f"with a as {_ARR} select l_orderkey, round(list_sum(list_transform(range(1, len(rew) + 1), lambda i: i * rew[i] * mask[i])), 6) as total, round(list_sum(list_transform(range(1, len(rew) + 1), lambda i: rew[i] * mask[i])), 6) as first from a"),
    "w04_response_mask": (w04_response_mask, f"with a as {_ARR} select l_orderkey, array_to_string(list_transform(range(1, len(lines) + 1), lambda i: case when len(list_filter(lines[1:i - 1], lambda x: x in (3, 5))) = 0 then '1' else '0' end), '') as mask from a"),
    "w05_last_columns": (w05_last_columns, f"with a as {_ARR} select l_orderkey, array_to_string(mask[greatest(1, len(mask) - 1):], '') as mask from a"),
    "w08_inverse_permutation": (w08_inverse_permutation, "select o_custkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as at, row_number() over (partition by o_custkey order by o_orderkey) as was from orders"),
    "w09_iteration_max": (w09_iteration_max, "select conv_id, max(turn) as last from conversations group by 1 having max(turn) >= 1"),
    "w10_turn_weighted": (w10_turn_weighted, "select user_id, round(case when len(v) <= 2 then -1 else list_sum(v[1:len(v) - 1]) * 0.4 / (len(v) - 1) + v[len(v)] * 0.6 end, 6) as score from (select user_id, list(value order by event_id) as v from events group by 1)"),
    "w11_packing_order": (w11_packing_order, "with x as (select doc_id, source, row_number() over (partition by source order by 24576 * n_chars + n_chars * n_chars, doc_id) - 1 as rank from documents) select doc_id, source, row_number() over (partition by source order by rank % 2, case when rank % 2 = 0 then rank else -rank end) as slot from x"),
    "g15_adaptive_kl": (g15_adaptive_kl, "with recursive a as (select user_id, list(value order by event_id) as v from events group by 1), f as (select user_id, v, 1 as i, 0.2::double as k from a union all select user_id, v, i + 1, k * (1 + least(greatest(v[i] / 50.0 - 1, -0.2), 0.2) * 64 / 10000.0) from f where i <= len(v)) select user_id, round(k, 6) as kl from f where i = len(v) + 1"),
    "m11_token_bucket": (m11_token_bucket, "with recursive a as (select user_id, list(epoch_us(ts) / 1e6 order by ts, event_id) as t, list(value / 10 order by ts, event_id) as c from events group by 1), f as (select user_id, t, c, 1 as i, t[1] as tm, 10.0::double as have, 0.0::double as wait from a union all select user_id, t, c, i + 1, t[i], least(10.0, have + (t[i] - tm) * 0.001) - c[i], wait + greatest(0.0, -(least(10.0, have + (t[i] - tm) * 0.001) - c[i]) / 0.001) from f where i <= len(t)) select user_id, round(wait, 3) as wait, len(t) as n from f where i = len(t) + 1"),
    "m18_non_improvement": (m18_non_improvement, "select event_id, case when value <= lag(value) over (partition by user_id order by event_id) then -0.05::double else 0 end as penalty from events"),
    "n02_kl": (n02_kl, f"select {_K}, round(lp - old, 6) + 0.0 as k1, round(abs(lp - old), 6) as abs, round(0.5 * (lp - old) * (lp - old), 6) as k2, round(least(exp(old - lp) - (old - lp) - 1, 10), 6) + 0.0 as k3 from {_LOGS}"),
    "n03_rewards": (n03_rewards, f"select {_K}, round(adv - 0.1 * (old - lp), 6) + 0.0 as reward from {_LOGS}"),
    "n04_policy_loss": (n04_policy_loss, f"select {_K}, round(case when adv < 0 then least(u, -adv * 3.0) else u end, 6) + 0.0 as loss from (select *, greatest(-adv * exp(lp - old), -adv * least(greatest(exp(lp - old), 0.8), 1.2)) as u from {_LOGS})"),
    "n04_clip_fraction": (n04_clip_fraction, f"select l_suppkey, round(sum(case when -adv * least(greatest(exp(lp - old), 0.8), 1.2) > -adv * exp(lp - old) then m else 0 end) / (sum(m) + 1e-8), 6) as clipped, round(sum((old - lp) * m) / (sum(m) + 1e-8), 6) + 0.0 as kl from {_LOGS} group by 1"),
    "n06_sequence_loss": (n06_sequence_loss, f"with x as {_LOGS}, q as (select l_orderkey, exp(least(sum((lp - old) * m) / greatest(sum(m), 1), 10)) as q from x group by 1) select l_orderkey, round(sum(greatest(-adv * q, -adv * least(greatest(q, 0.9997), 1.0004)) * m) / (sum(m) + 1e-8), 6) + 0.0 as loss from x join q using (l_orderkey) group by 1 having sum(m) > 0"),
    "n07_gpg_loss": (n07_gpg_loss, f"select {_K}, round(-lp * adv, 6) + 0.0 as loss from {_LOGS}"),
    "k11_covariance_top": (k11_covariance_top, f"select l_suppkey, count(*) as kept, round(sum(cov), 4) as cov from {_TOP} where top group by 1"),
    "n09_kl_cov": (n09_kl_cov, f"select l_suppkey, round(avg(-adv * exp(lp - old) + case when top then abs(lp - old) else 0 end), 5) + 0.0 as loss from {_TOP} group by 1"),
    "n10_geometric_mean": (n10_geometric_mean, f"select l_orderkey, round(-sum(adv * m) / (sum(m) + 1e-8) * exp(sum(case when adv >= 0 then least(lp - old, 0.4) else greatest(lp - old, -0.4) end * m) / (sum(m) + 1e-8)), 6) + 0.0 as loss from {_LOGS} group by 1"),
    "n13_value_loss": (n13_value_loss, f"select {_K}, round(0.5 * greatest(pow(adv - lp, 2), pow(least(greatest(adv, old - 0.5), old + 0.5) - lp, 2)), 6) as loss from {_LOGS}"),
    "n15_entropy": (n15_entropy, f"select vec_id, round(ln(list_sum(list_transform(l, lambda x: exp(x)))) - list_sum(list_transform(l, lambda x: exp(x) * x)) / list_sum(list_transform(l, lambda x: exp(x))), 5) as entropy from {_LOGITS}"),
    "n17_log_prob": (n17_log_prob, f"select vec_id, round(l[pick + 1] - ln(list_sum(list_transform(l, lambda x: exp(x)))), 5) as log_prob from {_LOGITS}"),
    "n18_gather": (n18_gather, f"select vec_id, round(l[pick + 1], 5) + 0.0 as value from {_LOGITS}"),
    "n20_importance_weights": (n20_importance_weights, f"select l_orderkey, round(least(exp(least(greatest(sum((lp - old) * m), -20), 20)), 2), 6) as sequence_weight, round(least(exp(sum((lp - old) * m) / (sum(m) + 1e-8)), 2), 6) as geometric_weight from {_LOGS} group by 1"),
    "n20_token_weights": (n20_token_weights, f"select l_suppkey, round(sum(least(exp(lp - old), 2) * m) / (sum(m) + 1e-8), 6) as mean, round(max(case when m = 1 then least(exp(lp - old), 2) end), 6) as top from {_LOGS} group by 1"),
    "n21_rejection": (n21_rejection, f"select l_orderkey, sum(case when m = 1 and exp(lp - old) >= 1 / 1.5::double and exp(lp - old) <= 1.5 then 1 else 0 end) as kept_tokens, exp(least(greatest(sum((lp - old) * m), -20), 20)) between 1 / 1.5::double and 1.5 as sequence, exp(sum((lp - old) * m) / (sum(m) + 1e-8)) between 1 / 1.5::double and 1.5 as geometric from {_LOGS} group by 1"),
    "n22_veto": (n22_veto, f"select l_orderkey, case when max(case when m = 1 and exp(lp - old) < 0.6 then 1 else 0 end) = 1 then 0 else sum(m) end as kept from {_LOGS} group by 1"),
    "a23_offpolicy_metrics": (a23_offpolicy_metrics, f"with x as {_LOGS}, q as (select l_orderkey, {_PPL} from x group by 1 having sum(m) > 0) select round(avg(exp(-a / n)), 5) as ppl, round(avg(exp(-b / n)), 5) as ppl_old, round(avg(b / n - a / n), 5) + 0.0 as log_ppl_diff, round(avg(abs(b / n - a / n)), 5) as log_ppl_abs_diff, round(max(b / n - a / n), 5) as log_ppl_diff_max, round(avg(exp(2 * least(greatest(a - b, -20), 20))) - 1, 4) as chi2_sequence, (select round(avg(old - lp), 5) + 0.0 from x where m = 1) as kl, (select round(avg(exp(lp - old) - (lp - old) - 1), 5) from x where m = 1) as k3, (select round(avg(exp(2 * (lp - old))) - 1, 5) from x where m = 1) as chi2_token from q"),
    "a24_weight_metrics": (a24_weight_metrics, f"select l_suppkey, round(avg(w), 6) as mean, round(max(w), 6) as max, round(min(w), 6) as min, round(avg(case when w > 1.9 then 1.0::double else 0 end), 6) as above, round(avg(case when w < 0.5 then 1.0::double else 0 end), 6) as below, round(pow(avg(w), 2) / avg(w * w), 6) as effective from (select *, least(exp(lp - old), 2) as w from {_LOGS} where m = 1) group by 1"),
    "a26_debug_metrics": (a26_debug_metrics, f"select l_suppkey, round(max(abs(exp(lp) - exp(old))), 6) as max, round(avg(abs(exp(lp) - exp(old))), 6) as mean, round(stddev_samp(abs(exp(lp) - exp(old))), 6) as std, round(corr(exp(lp), exp(old)), 6) + 0.0 as pearson from {_LOGS} where m = 1 group by 1"),
    "a27_mismatches": (a27_mismatches, f"select l_orderkey, sum(case when l_discount <> l_tax and l_returnflag <> 'R' then 1 else 0 end) as n from lineitem group by 1"),
    "n25_sppo": (n25_sppo, f"select l_orderkey, round(pow(sum((lp - old) * m) - max(adv), 2), 6) as loss from {_LOGS} group by 1"),
    "n26_dpo": (n26_dpo, f"select l_orderkey, round(ln(1 + exp(-0.1 * (max(lp) - min(lp)))) * 0.9 + ln(1 + exp(0.1 * (max(lp) - min(lp)))) * 0.1, 6) as dpo, round(pow(max(lp) - min(lp) - 5, 2), 6) as ipo from {_LOGS} group by 1"),
    "n27_batch_logps": (n27_batch_logps, f"select l_orderkey, round(sum(lp) filter (where l_linenumber <> 7), 6) + 0.0 as total, round(avg(lp) filter (where l_linenumber <> 7), 6) + 0.0 as mean from {_LOGS} group by 1"),
    "n28_ce_dpo": (n28_ce_dpo, f"select l_orderkey, round(-(acc * ln(p) + (1 - acc) * ln(1 - p)), 6) as loss from (select l_orderkey, 1 / (1 + exp(-0.05 * sum(lp - old))) as p, max(m) as acc from {_LOGS} group by 1)"),
    "n30_flow": (n30_flow, f"select l_orderkey, round(least(exp(avg(lp) - avg(old)), 10) * pow(0.5 + avg(lp) - 15 * avg(adv) - avg(old), 2), 4) as loss from {_LOGS} group by 1"),
    "n31_sft_loss": (n31_sft_loss, f"select l_orderkey, round(sum(case when nx = 1 then -lp else 0 end) / greatest(sum(coalesce(nx, 0)), 1), 6) + 0.0 as loss from (select *, lead(m) over (partition by l_orderkey order by {_O}) as nx from {_LOGS}) group by 1"),
    "n32_workload": (n32_workload, "select doc_id, 24576 * n_chars + n_chars * n_chars as work, cast(ceil(n_chars / 512.0) as bigint) as blocks, cast(ceil(n_chars / 512.0) as bigint) * 512 as padded, round(least(-(n_chars - 4000) / 1000.0::double, 0), 6) + 0.0 as penalty from documents"),
    "n40_rewards": (n40_rewards, "select p_partkey, round(case when p_size / 400.0::double < 0.01 then 1 when p_size / 400.0::double < 0.1 then 1 - 2 * (p_size / 400.0::double - 0.01) / 0.09 else -1 end, 6) + 0.0 as voxel, round(case when p_size % 20 >= 15 then 1 when p_size % 20 >= 5 then (p_size % 20 - 5) / 10.0::double else -1 end, 6) as objects, round(case when p_size <= 20 then 1 when p_size <= 45 then 1 - (p_size - 20) / 25.0::double when p_size <= 100 then -(p_size - 45) / 55.0::double else -1 end, 6) + 0.0 as collision from part"),
    "n45_shape_reward": (n45_shape_reward, "select p_partkey, case when p_size % 10 = 4 then 1.0::double when p_size % 10 in (6, 8) then 0.5 else -1 end as reward from part"),
}
