"""Batch algebra and set operations over orders, customers, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batch as B
from ..operators import matching
from ..operators import prepare as P
from .common import r, table

_POS = "(select *, row_number() over (order by {k}) - 1 as pos from {t})"
ORDERS = _POS.format(k="o_orderkey", t="orders")


def _orders(s, d):
    return B.with_position(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


def b04_mask(s, d):
    return B.rows_where(_orders(s, d), F.col("o_totalprice") > 200000).select("pos", "o_orderkey")


def b05_select(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice")


def b06_gather(s, d):
    o = _orders(s, d)
    picks = o.select(F.col("pos").alias("slot"), F.pmod(F.col("pos") * 7, F.lit(o.count())).alias("pos"))
    return B.select_positions(o, picks).select("slot", "o_orderkey")


def b07_slice(s, d):
    return B.slice_rows(_orders(s, d), 5, -10, 3).select("pos", "o_orderkey")


def b08_pop(s, d):
    popped, rest = B.pop(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", "o_custkey")
    return popped.withColumn("left_columns", F.lit(len(rest.columns)))


def b09_rename(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey").withColumnsRenamed({"o_custkey": "customer"})


def b10_union_columns(s, d):
    o = table(s, d, "orders")
    return B.union_columns(o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


def b13_union_maps(s, d):
    """Maps that share a key with one value."""
    e = table(s, d, "events")
    user = lambda k: F.create_map(F.lit("user"), F.col("user_id").cast("string"), *k)
    m = B.union_maps(user([]), user([F.lit("type"), F.col("event_type")]))
    return e.select("event_id", m.alias("m")).select("event_id", F.col("m")["user"].alias("user"), F.col("m")["type"].alias("type"), F.size("m").alias("n"))


def b14_concat(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return B.concat(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"))


def b15_lists_by_key(s, d):
    x = B.lists_by_key(table(s, d, "events"), "event_type", "event_id", "value")
    return x.select("event_type", F.size("value").alias("n"), r(F.element_at("value", 1), 4).alias("first"), r(F.element_at("value", -1), 4).alias("last"))


def b16_chunk(s, d):
    o = _orders(s, d)
    return B.chunk(o, 5).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def b17_split(s, d):
    return B.split(_orders(s, d), 64).groupBy("piece").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def b18_reorder(s, d):
    o = _orders(s, d)
    return B.reorder(o, F.lit(o.count() - 1) - F.col("pos")).select("slot", "o_orderkey")


def b19_repeat_interleave(s, d):
    return B.repeat(_orders(s, d), 3).select("slot", "o_orderkey")


def b19_repeat_tile(s, d):
    return B.repeat(_orders(s, d), 3, interleave=False).select("slot", "o_orderkey")


def b20_repeat_by_count(s, d):
    return B.repeat_by(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey") % 4).select("o_orderkey", "rep")


def _user_values(s, d):
    held = F.sort_array(F.collect_list(F.struct("event_id", "value")))
    return table(s, d, "events").groupBy("user_id").agg(held.alias("h")).select("user_id", F.col("h.value").alias("v"), F.col("h.event_id").alias("ids"))


_VALUES = "(select user_id, list(value order by event_id) as v, list(event_id order by event_id) as ids from events group by user_id)"


def b21_unfold(s, d):
    u = _user_values(s, d).withColumn("v", F.slice("v", F.lit(1), (F.floor(F.size("v") / 2) * 2).cast("int")))
    return B.unfold(u.where(F.size("v") > 0), 2, "v").select("user_id", "part", F.size("v").alias("n"), r(F.element_at("v", 1), 4).alias("first"))


def b22_fold(s, d):
    return B.fold(_orders(s, d), 8, "o_orderkey").select("row", F.array_join("o_orderkey", ",").alias("keys"))


def b23_pad_to_divisor(s, d):
    return B.pad_to_divisor(_orders(s, d), 64).select("pos", "o_orderkey", "is_pad")


def b24_unpad(s, d):
    return B.unpad(B.pad_to_divisor(_orders(s, d), 64)).select("pos", "o_orderkey")


def b25_pad_with_last(s, d):
    return B.pad_with_row(_orders(s, d), 10).select("pos", "o_orderkey")


def b26_minibatches(s, d):
    return B.minibatches(table(s, d, "orders").select("o_orderkey"), 5, 2, "o_orderkey", "42").select("epoch", "batch", "o_orderkey")


def b38_same_rows(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return s.range(1).select(F.lit(B.same_rows(o, B.unpad(B.pad_to_divisor(_orders(s, d), 7)).select("o_orderkey", "o_custkey"))).alias("same"))


def b40_pad_arrays(s, d):
    u = _user_values(s, d)
    return u.select("user_id", F.array_join(B.pad_array(F.col("ids"), 12, F.lit(0).cast("long")), ",").alias("ids"))


def b41_pad_left(s, d):
    u = _user_values(s, d)
    return u.select("user_id", F.array_join(B.pad_array(F.col("ids"), 12, F.lit(0).cast("long"), left=True), ",").alias("ids"))


def b42_truncate(s, d):
    u = _user_values(s, d)
    return u.select("user_id", *[F.array_join(B.truncate_array(F.col("ids"), 5, h), ",").alias(h) for h in ("left", "right", "middle")])


def b43_remove_padding(s, d):
    u = _user_values(s, d)
    mask = F.transform("ids", lambda x: F.when(x % 3 == 0, 0).otherwise(1))
    return u.withColumn("mask", mask).select("user_id", F.array_join(B.keep_masked(F.col("ids"), F.col("mask")), ",").alias("ids"))


def b44_length_filter(s, d):
    return P.length_filter(table(s, d, "documents"), X.word_count(F.col("text")), 300).where("text is not null").select("doc_id", "n")


def b45_segments(s, d):
    c = table(s, d, "conversations").withColumn("parts", X.segments(F.col("text"), r"[.!?]"))
    return c.select("conv_id", "turn", F.size("parts").alias("n"), F.array_join("parts", "|").alias("joined"))


def b46_skip_existing(s, d):
    return matching.skip_existing(table(s, d, "documents"), table(s, d, "labels"), "doc_id").select("doc_id", "source")


def b47_suffix_budget(s, d):
    c = table(s, d, "conversations").withColumn("size", F.length("text"))
    return B.suffix_within_budget(c, "conv_id", "turn", "size", 400).select("conv_id", "turn", "size")


def b48_accuracy_band(s, d):
    li = table(s, d, "lineitem").withColumn("acc", (F.col("l_returnflag") == "R").cast("double"))
    return P.accuracy_band(li, "l_orderkey", "acc", 0.2, 0.8, F.col("l_quantity") > 48).groupBy("l_orderkey").agg(F.count("*").alias("n"), r(F.avg("acc")).alias("acc"))


def b49_informative_groups(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("q"))
    return B.informative_groups(li, "l_orderkey", "q").groupBy("l_orderkey").agg(F.count("*").alias("n"), r(F.sum("q"), 2).alias("q"))


def b50_label_cleanup(s, d):
    return table(s, d, "benchmark").where(F.length("text") > 0).select("item_id", X.clean_label(F.col("text")).alias("text"))


def u03_problem_union(s, d):
    li = table(s, d, "lineitem")
    return P.union_of_keys(li.where("l_quantity > 49").select("l_orderkey"), li.where("l_discount > 0.09").select("l_orderkey"))


def u04_distinct_first(s, d):
    x = table(s, d, "documents").select("doc_id", F.xxhash64(F.lower(F.trim("text"))).alias("h"), F.sha2(F.lower(F.trim("text")), 256).alias("key"))
    return matching.first_by_key(x, "doc_id", "h", "key").select("doc_id")


def u05_except(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("key")).exceptAll(table(s, d, "orders").select(F.col("o_custkey").alias("key")).distinct())


def u06_split(s, d):
    return table(s, d, "documents").select("doc_id", P.split_label(F.col("doc_id"), "42").alias("split"))


def u06_split_by_position(s, d):
    o = _orders(s, d)
    n = int(o.count() * 0.9)
    return o.select("o_orderkey", F.when(F.col("pos") < n, "train").otherwise("test").alias("split"))


def u07_preference_rows(s, d):
    return P.preference_rows(table(s, d, "conversations"), "conv_id", "text", "turn")


def u08_intersect(s, d):
    a, b = table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return matching.keep_existing(a.distinct(), b, "k")


def u02_self_repeat(s, d):
    return P.repeat_self(table(s, d, "benchmark").select("item_id"), 20)


QUERIES = {
    "b04_mask": (b04_mask, f"select pos, o_orderkey from {ORDERS} where o_totalprice > 200000"),
    "b05_select": (b05_select, "select o_orderkey, o_totalprice from orders"),
    "b06_gather": (b06_gather, f"with o as {ORDERS} select a.pos as slot, b.o_orderkey from o a join o b on b.pos = (a.pos * 7) % (select count(*) from o)"),
    "b07_slice": (b07_slice, f"select pos, o_orderkey from {ORDERS} where pos >= 5 and pos < (select count(*) from orders) - 10 and (pos - 5) % 3 = 0"),
    "b08_pop": (b08_pop, "select o_orderkey, o_custkey, 1 as left_columns from orders"),
    "b09_rename": (b09_rename, "select o_orderkey, o_custkey as customer from orders"),
    "b10_union_columns": (b10_union_columns, "select o_orderkey, o_custkey, o_orderstatus from orders"),
    "b13_union_maps": (b13_union_maps, "select event_id, cast(user_id as varchar) as \"user\", event_type as type, 2 as n from events"),
    "b14_concat": (b14_concat, "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'F', 'P')"),
    "b15_lists_by_key": (b15_lists_by_key, "select event_type, count(*) as n, round(arg_min(value, event_id), 4) as first, round(arg_max(value, event_id), 4) as last from events group by 1"),
    "b16_chunk": (b16_chunk, f"select pos // ((select count(*) from orders) // 5) as chunk, count(*) as n, min(o_orderkey) as first, max(o_orderkey) as last from {ORDERS} group by 1"),
    "b17_split": (b17_split, f"select pos // 64 as piece, count(*) as n, min(o_orderkey) as first from {ORDERS} group by 1"),
    "b18_reorder": (b18_reorder, "select row_number() over (order by o_orderkey desc) - 1 as slot, o_orderkey from orders"),
    "b19_repeat_interleave": (b19_repeat_interleave, f"select pos * 3 + i as slot, o_orderkey from {ORDERS}, range(3) t(i)"),
    "b19_repeat_tile": (b19_repeat_tile, f"select i * (select count(*) from orders) + pos as slot, o_orderkey from {ORDERS}, range(3) t(i)"),
    "b20_repeat_by_count": (b20_repeat_by_count, "select o_orderkey, unnest(range(1, 1 + o_custkey % 4)) as rep from orders"),
    "b21_unfold": (b21_unfold, f"select user_id, p as part, len(v) // 2 as n, round(v[p * (len(v) // 2) + 1], 4) as first from {_VALUES}, range(2) t(p) where len(v) >= 2"),
    "b22_fold": (b22_fold, f"select pos // 8 as row, string_agg(cast(o_orderkey as varchar), ',' order by pos) as keys from {ORDERS} group by 1"),
    "b23_pad_to_divisor": (b23_pad_to_divisor, f"with o as {ORDERS}, n as (select count(*) as n from orders) select pos, o_orderkey, false as is_pad from o union all select pos + n, o_orderkey, true from o, n where pos < (64 - n % 64) % 64"),
    "b24_unpad": (b24_unpad, f"select pos, o_orderkey from {ORDERS}"),
    "b25_pad_with_last": (b25_pad_with_last, f"with o as {ORDERS} select pos, o_orderkey from o union all select pos + i, o_orderkey from o, range(1, 11) t(i) where pos = (select max(pos) from o)"),
    "b26_minibatches": (b26_minibatches, "select e as epoch, (row_number() over (partition by e order by cast('0x' || substr(md5('42:' || e || ':' || o_orderkey), 1, 12) as bigint), o_orderkey) - 1) // 5 as batch, o_orderkey from orders, range(2) t(e)"),
    "b38_same_rows": (b38_same_rows, "select true as same"),
    "b40_pad_arrays": (b40_pad_arrays, f"select user_id, array_to_string(list_concat(ids, list_transform(range(greatest(0, 12 - len(ids))), lambda x: 0::bigint)), ',') as ids from {_VALUES}"),
    "b41_pad_left": (b41_pad_left, f"select user_id, array_to_string(list_concat(list_transform(range(greatest(0, 12 - len(ids))), lambda x: 0::bigint), ids), ',') as ids from {_VALUES}"),
    "b42_truncate": (b42_truncate, f"select user_id, array_to_string(ids[greatest(1, len(ids) - 4):], ',') as \"left\", array_to_string(ids[1:5], ',') as \"right\", array_to_string(case when len(ids) <= 5 then ids else list_concat(ids[1:2], ids[len(ids) - 2:]) end, ',') as middle from {_VALUES}"),
    "b43_remove_padding": (b43_remove_padding, f"select user_id, array_to_string(list_filter(ids, lambda x: x % 3 <> 0), ',') as ids from {_VALUES}"),
    "b44_length_filter": (b44_length_filter, r"select doc_id, len(regexp_split_to_array(trim(text), '\s+')) as n from documents where len(regexp_split_to_array(trim(text), '\s+')) <= 300"),
    "b45_segments": (b45_segments, "select conv_id, turn, len(p) as n, array_to_string(list_transform(p, lambda x: trim(x)), '|') as joined from (select *, list_filter(string_split(regexp_replace(text, '[.!?]', '<mark>', 'g'), '<mark>'), lambda x: trim(x) <> '') as p from conversations)"),
    "b46_skip_existing": (b46_skip_existing, "select doc_id, source from documents where doc_id not in (select doc_id from labels)"),
    "b47_suffix_budget": (b47_suffix_budget, "select conv_id, turn, size from (select *, length(text) as size, sum(length(text)) over (partition by conv_id order by turn desc rows unbounded preceding) as used from conversations) where used <= 400"),
    "b48_accuracy_band": (b48_accuracy_band, "select l_orderkey, count(*) as n, round(avg(case when l_returnflag = 'R' then 1.0::double else 0 end), 6) as acc from lineitem group by 1 having avg(case when l_returnflag = 'R' then 1.0::double else 0 end) between 0.2 and 0.8 and max(l_quantity) <= 48"),
    "b49_informative_groups": (b49_informative_groups, "select l_orderkey, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by 1 having stddev_pop(l_quantity) > 0 or count(*) = 1"),
    "b50_label_cleanup": (b50_label_cleanup, r"select item_id, trim(regexp_replace(regexp_replace(text, '\[.*?\]', '', 'g'), '  ', ' ', 'g')) as text from benchmark where length(text) > 0"),
    "u02_self_repeat": (u02_self_repeat, "select item_id, i as copy from benchmark, range(1, 21) t(i)"),
    "u03_problem_union": (u03_problem_union, "select l_orderkey from lineitem where l_quantity > 49 union select l_orderkey from lineitem where l_discount > 0.09"),
    "u04_distinct_first": (u04_distinct_first, "select min(doc_id) as doc_id from documents group by lower(trim(text))"),
    "u05_except": (u05_except, "select c_custkey as key from customer where c_custkey not in (select o_custkey from orders)"),
    "u06_split": (u06_split, "select doc_id, case when cast('0x' || substr(md5('42:' || doc_id), 1, 8) as bigint) % 10 < 9 then 'train' else 'test' end as split from documents"),
    "u06_split_by_position": (u06_split_by_position, f"select o_orderkey, case when pos < cast(floor((select count(*) from orders) * 0.9) as bigint) then 'train' else 'test' end as split from {ORDERS}"),
    "u07_preference_rows": (u07_preference_rows, "select conv_id, 0 as rank, arg_min(text, turn) as text from conversations group by 1 union all select conv_id, 1, arg_max(text, turn) from conversations group by 1"),
    "u08_intersect": (u08_intersect, "select c_nationkey as k from customer intersect select s_nationkey from supplier"),
}
