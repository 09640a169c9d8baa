"""Text scoring, extraction and JSON over documents, conversations, benchmark items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import prepare
from .common import r, table


def _solutions(s, d):
    """Synthetic solutions: a few numbers, with and without the strict mark, from order values."""
    o = table(s, d, "orders")
    whole = F.floor("o_totalprice").cast("string")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("so it is 12 and\n#### "), whole)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("we get "), whole, F.lit(" ."))).otherwise(F.lit("no idea"))
    return o.select("o_orderkey", t.alias("t"), whole.alias("gold"))


_SOL = "(select o_orderkey, cast(cast(floor(o_totalprice) as bigint) as varchar) as gold, case o_orderkey % 3 when 0 then 'so it is 12 and' || chr(10) || '#### ' || cast(floor(o_totalprice) as bigint) when 1 then 'we get ' || cast(floor(o_totalprice) as bigint) || ' .' else 'no idea' end as t from orders)"


def t02_final_number(s, d):
    x = _solutions(s, d)
    return x.select("o_orderkey", X.final_number(F.col("t")).alias("strict"), X.final_number(F.col("t"), strict=False).alias("flexible"))


def t03_number_score(s, d):
    x = _solutions(s, d)
    return x.select("o_orderkey", X.number_score(F.col("t"), F.col("gold")).alias("strict"), X.number_score(F.col("t"), F.concat("gold", F.lit("0")), False, format_score=0.1).alias("flexible"))


def t01_dispatch(s, d):
    x = _solutions(s, d).withColumn("source", F.when(F.col("o_orderkey") % 2 == 0, "arithmetic").otherwise("search/nq"))
    score = F.when(F.col("source") == "arithmetic", X.number_score(F.col("t"), F.col("gold"))).when(F.col("source").startswith("search"), X.exact_match(F.col("t"), F.array("gold")).cast("double")).otherwise(F.raise_error(F.lit("unknown source")).cast("double"))
    return x.groupBy("source").agg(r(F.avg(score)).alias("score"), F.count("*").alias("n"))


def t20_normalize(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.normalize_answer(F.col("text")).alias("text"))


def _answers(s, d):
    c = table(s, d, "conversations")
    t = F.concat(F.lit("<think>x</think><answer>"), F.split("text", r"\.")[0], F.lit("</answer><answer> The "), F.element_at(F.split("text", " "), 1), F.lit("! </answer>"))
    return c.select("conv_id", "turn", t.alias("t"), F.array(F.lower(F.element_at(F.split("text", " "), 1)), F.lit("the x")).alias("golds"))


_ANS = "(select conv_id, turn, '<think>x</think><answer>' || string_split(text, '.')[1] || '</answer><answer> The ' || string_split(text, ' ')[1] || '! </answer>' as t, [lower(string_split(text, ' ')[1]), 'the x'] as golds from conversations)"
_PUNCT = r"[!-/:-@\[-`{-~]"
_NORM = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w not in ('', 'a', 'an', 'the')), ' ')"
_LAST = r"trim(list_last(regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1)))"


def t21_exact_match(s, d):
    x = _answers(s, d)
    return x.select("conv_id", "turn", X.exact_match(X.last_answer(F.col("t")), F.col("golds")).alias("em"), X.contains_gold(X.last_answer(F.col("t")), F.col("golds")).alias("sub"))


def t23_last_answer(s, d):
    return _answers(s, d).select("conv_id", "turn", X.last_answer(F.col("t")).alias("answer"))


def t24_tag_count(s, d):
    return _answers(s, d).select("conv_id", "turn", X.tag_count(F.col("t"), "<answer>").alias("n"))


def t25_answer_score(s, d):
    x = _answers(s, d)
    many = F.concat("t", F.when(F.col("turn") % 2 == 0, F.repeat(F.lit("<answer>"), 12)).otherwise(""))
    return x.withColumn("t", many).select("conv_id", "turn", r(X.answer_score(F.col("t"), F.col("golds"))).alias("score"))


def t06_labelled_answer(s, d):
    x = _solutions(s, d).withColumn("t", F.concat("t", F.when(F.col("o_orderkey") % 2 == 0, "\nAnswer: 7\nanswer : x y").otherwise("")))
    return x.select("o_orderkey", X.labelled_answer(F.col("t")).alias("answer"))


def t05_clean_number(s, d):
    o = table(s, d, "orders").withColumn("t", F.concat(F.lit("x = $"), F.format_number("o_totalprice", 2), F.lit(" dollars.")))
    return o.select("o_orderkey", X.clean_number(F.col("t")).alias("value"))


def t10_strip_latex(s, d):
    p = table(s, d, "part")
    t = F.concat(F.lit(r"\left( \dfrac"), (F.col("p_size") % 9 + 1).cast("string"), (F.col("p_size") % 7 + 1).cast("string"), F.lit(r" + \sqrt3\% \right)"))
    return p.select("p_partkey", X.strip_latex(t).alias("value"))


def t04_last_boxed(s, d):
    p = table(s, d, "part")
    t = F.concat(F.lit(r"so \boxed{1} then \boxed{\frac{"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "}{3}}").otherwise("}{3"))
    return p.select("p_partkey", X.last_boxed(t).alias("boxed"))


def t08_boxed_score(s, d):
    p = table(s, d, "part")
    boxed = X.last_boxed(X.tail(F.concat(F.lit(r"thus \boxed{"), (F.col("p_size") % 5).cast("string"), F.lit("}")), 100))
    return p.select("p_partkey", F.when(boxed == "3", 1.0).otherwise(-1.0).alias("score"), boxed.alias("pred"))


def t18_numbers_equal(s, d):
    p = table(s, d, "part")
    a, b = F.col("p_size").cast("string"), (F.col("p_size") * F.when(F.col("p_partkey") % 3 == 0, 100.0).when(F.col("p_partkey") % 3 == 1, 1.00005).otherwise(1.1)).cast("string")
    return p.select("p_partkey", X.numbers_equal(a, b).alias("equal"))


def t16_split_tuple(s, d):
    p = table(s, d, "part")
    t = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(", 1,234, x)"))
    parts = F.split(F.regexp_replace(F.regexp_replace(t, r"^\(|\)$", ""), r",\s+", "|"), r"\|")
    return p.select("p_partkey", F.array_join(parts, ";").alias("parts"))


def t27_format(s, d):
    p = table(s, d, "part")
    t = F.concat(F.when(F.col("p_size") % 2 == 0, "<think>why</think> ").otherwise(""), F.lit(r"\boxed{"), F.col("p_size").cast("string"), F.lit("}"))
    return p.select("p_partkey", X.think_format(t).alias("fits"), r(0.9 * (F.col("p_size") % 3 == 0).cast("double") + 0.1 * X.think_format(t).cast("double")).alias("score"))


def t29_choice(s, d):
    c = table(s, d, "conversations").withColumn("letter", X.choice_letter(F.concat(F.lit("Answer: "), F.upper(F.substring("text", 1, 1)))))
    return c.select("conv_id", "turn", (F.col("letter") == "A").cast("double").alias("score"), "letter")


def t34_token_amount(s, d):
    return table(s, d, "conversations").where("turn > 0").groupBy("conv_id").agg(F.sum(X.word_count(F.col("text"))).alias("tokens"))


_CALL = "name string, arguments map<string,string>"


def _calls(s, d):
    e = table(s, d, "events")
    call = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": {"user": "'), F.col("user_id").cast("string"), F.lit('"}}</tool_call>'))
    bad = F.when(F.col("event_id") % 4 == 0, "<tool_call>{not json</tool_call>").otherwise("")
    return e.select("event_id", F.concat(F.lit("call: "), call, bad, F.lit(" done")).alias("t"))


def t39_tool_calls(s, d):
    x = _calls(s, d).withColumn("c", X.tool_calls(F.col("t"), _CALL))
    return x.select("event_id", F.size("c").alias("n"), F.get("c", F.lit(0))["name"].alias("name"), F.get("c", F.lit(0))["arguments"]["user"].alias("user"), X.without_tags(F.col("t"), "tool_call").alias("content"))


def t35_first_call(s, d):
    x = _calls(s, d)
    return x.select("event_id", F.from_json(X.first_tag(F.col("t"), "tool_call"), _CALL)["name"].alias("name"))


def t32_json_field(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def t37_tag_text(s, d):
    p = table(s, d, "pages")
    return p.select("page_id", X.first_tag(F.col("html"), "title").alias("title"))


def t41_first_score(s, d):
    p = table(s, d, "part")
    n = F.col("p_size").cast("string")
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Score: "), n)).when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit(" / 10"))).otherwise("none")
    return p.select("p_partkey", X.first_score(t).alias("score"))


def t42_clean(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.clean_requirement(F.concat(F.lit("<image> "), "text")).alias("text"))


def t43_room_type(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", X.room_type(F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, " Living Bed").when(F.col("p_size") % 3 == 1, " Kitchen").otherwise(""))).alias("room"))


def t45_type_reward(s, d):
    return table(s, d, "part").select("p_partkey", X.agreement(F.col("p_type").contains("S"), F.col("p_brand").contains("1")).alias("reward"))


def t46_format_reward(s, d):
    x = _calls(s, d)
    return x.select("event_id", r(X.call_format_reward(F.regexp_count("t", F.lit("<tool_call>")), F.size(X.tool_calls(F.col("t"), _CALL)))).alias("reward"))


def t60_numbered(s, d):
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("h"))
    return c.select("conv_id", X.numbered(F.col("h.role")).alias("text"))


def t64_repetition(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", r(X.repetition_ratio(F.col("text")), 6).alias("ratio"))


def t67_verdict(s, d):
    p = table(s, d, "part")
    boxed = X.last_boxed(F.when(F.col("p_size") % 2 == 0, r"ok \boxed{True}").otherwise(r"\boxed{False}"))
    return p.select("p_partkey", (boxed == "True").cast("double").alias("score"))


def t69_messages(s, d):
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    return c.select("conv_id", X.transcript(F.col("h")).alias("text")).where("text <> ''")


def t70_without_thoughts(s, d):
    return _answers(s, d).select("conv_id", "turn", X.without_tags(F.col("t"), "think").alias("text"))


def t71_valid_messages(s, d):
    return _answers(s, d).select("conv_id", "turn", X.valid_message(F.col("t")).alias("valid"))


def t73_support_type(s, d):
    kind = X.first_rule(F.col("p_name"), [(("lamp",), "ceiling"), (("red", "blue"), "wall"), (("e",), "surface")], "floor")
    return table(s, d, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def t74_choices(s, d):
    options = F.array(*[F.lit(x) for x in ("right", "wrong1", "wrong2", "wrong3")])
    x = prepare.multiple_choice(table(s, d, "benchmark"), "item_id", options, "7", "right")
    return x.select("item_id", F.array_join("options", ",").alias("options"), F.array_position("options", "right").cast("int").alias("answer"), "letter")


def s15_metric_keys(s, d):
    e = table(s, d, "events").select(F.concat(F.lit("val//"), "event_type", F.lit("@"), F.col("user_id").cast("string"), F.lit(":x")).alias("name"))
    return e.select(X.metric_key(F.col("name")).alias("key")).distinct()


_P3 = "case p_partkey % 3 when 0 then 'Score: ' || p_size when 1 then p_size || ' / 10' else 'none' end"
QUERIES = {
    "s15_metric_keys": (s15_metric_keys, "select distinct 'val/' || event_type || '_at_' || user_id || '_x' as key from events"),
    "t01_dispatch": (t01_dispatch, f"select case when o_orderkey % 2 = 0 then 'arithmetic' else 'search/nq' end as source, round(avg(case when o_orderkey % 2 = 0 then case when o_orderkey % 3 = 0 then 1.0::double else 0 end else 0.0::double end), 6) as score, count(*) as n from {_SOL} group by 1"),
    "t02_final_number": (t02_final_number, f"select o_orderkey, case when o_orderkey % 3 = 0 then gold end as strict, case when o_orderkey % 3 <> 2 then gold end as flexible from {_SOL}"),
    "t03_number_score": (t03_number_score, f"select o_orderkey, case when o_orderkey % 3 = 0 then 1.0::double else 0 end as strict, case when o_orderkey % 3 <> 2 then 0.1::double else 0 end as flexible from {_SOL}"),
    "t04_last_boxed": (t04_last_boxed, r"select p_partkey, case when p_size % 2 = 0 then '\frac{' || p_size || '}{3}' end as boxed from part"),
    "t05_clean_number": (t05_clean_number, "select o_orderkey, printf('%.2f', o_totalprice) as value from orders"),
    "t06_labelled_answer": (t06_labelled_answer, "select o_orderkey, case when o_orderkey % 2 = 0 then 'x y' else '[INVALID]' end as answer from orders"),
    "t08_boxed_score": (t08_boxed_score, "select p_partkey, case when p_size % 5 = 3 then 1.0::double else -1 end as score, cast(p_size % 5 as varchar) as pred from part"),
    "t10_strip_latex": (t10_strip_latex, r"select p_partkey, '(\frac{' || (p_size % 9 + 1) || '}{' || (p_size % 7 + 1) || '}+\sqrt{3})' as value from part"),
    "t16_split_tuple": (t16_split_tuple, "select p_partkey, p_size || ';1,234;x' as parts from part"),
    "t18_numbers_equal": (t18_numbers_equal, "select p_partkey, p_partkey % 3 in (0, 1) as equal from part"),
    "t20_normalize": (t20_normalize, f"select conv_id, turn, {_NORM.format('text')} as text from conversations"),
    "t21_exact_match": (t21_exact_match, f"with x as (select *, {_LAST} as a from {_ANS}) select conv_id, turn, len(list_filter(golds, lambda g: {_NORM.format('g')} = {_NORM.format('a')})) > 0 as em, len(list_filter(golds, lambda g: contains({_NORM.format('a')}, {_NORM.format('g')}))) > 0 as sub from x"),
    "t23_last_answer": (t23_last_answer, f"select conv_id, turn, {_LAST} as answer from {_ANS}"),
    "t24_tag_count": (t24_tag_count, f"select conv_id, turn, cast((length(t) - length(replace(t, '<answer>', ''))) / 8 as int) as n from {_ANS}"),
    "t25_answer_score": (t25_answer_score, f"with x as (select *, {_LAST} as a from {_ANS}) select conv_id, turn, round(case when len(list_filter(golds, lambda g: {_NORM.format('g')} = {_NORM.format('a')})) = 0 then 0.0::double when turn % 2 = 0 then 0.25 else 1 end, 6) as score from x"),
    "t27_format": (t27_format, "select p_partkey, p_size % 2 = 0 as fits, round(case when p_size % 3 = 0 then 0.9::double else 0 end + case when p_size % 2 = 0 then 0.1::double else 0 end, 6) as score from part"),
    "t29_choice": (t29_choice, "select conv_id, turn, case when upper(text[1]) = 'A' then 1.0::double else 0 end as score, case when upper(text[1]) between 'A' and 'J' and length(text) > 0 and ascii(upper(text[1])) < 128 then upper(text[1]) else '' end as letter from conversations"),
    "t32_json_field": (t32_json_field, "select event_id, cast(json_extract(props, '$.k') as int) as k from events"),
    "t34_token_amount": (t34_token_amount, r"select conv_id, sum(len(regexp_split_to_array(trim(text), '\s+'))) as tokens from conversations where turn > 0 group by 1"),
    "t35_first_call": (t35_first_call, "select event_id, event_type as name from events"),
    "t37_tag_text": (t37_tag_text, "select page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') as title from pages"),
    "t39_tool_calls": (t39_tool_calls, "select event_id, 1 as n, event_type as name, cast(user_id as varchar) as \"user\", 'call:  done' as content from events"),
    "t41_first_score": (t41_first_score, "select p_partkey, case when p_partkey % 3 <> 2 and p_size between 1 and 10 then p_size end as score from part"),
    "t42_clean": (t42_clean, r"select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from conversations"),
    "t43_room_type": (t43_room_type, "select p_partkey, case when contains(n, 'bed') then 'bedroom' when contains(n, 'living') then 'living room' when contains(n, 'dining') then 'dining room' when contains(n, 'kitchen') then 'kitchen' when contains(n, 'bath') then 'bathroom' when contains(n, 'office') or contains(n, 'study') then 'office' else 'other' end as room from (select *, lower(p_name || case p_size % 3 when 0 then ' Living Bed' when 1 then ' Kitchen' else '' end) as n from part)"),
    "t45_type_reward": (t45_type_reward, "select p_partkey, case when contains(p_type, 'S') and contains(p_brand, '1') then 1.0::double when contains(p_type, 'S') or contains(p_brand, '1') then 0 else -1 end as reward from part"),
    "t46_format_reward": (t46_format_reward, "select event_id, round(case when event_id % 4 = 0 then 0.7::double else 1 end, 6) as reward from events"),
    "t60_numbered": (t60_numbered, "select conv_id, string_agg('Doc ' || rn || ': ' || role, chr(10) order by rn) as text from (select *, row_number() over (partition by conv_id order by turn, role) as rn from conversations) group by 1"),
    "t64_repetition": (t64_repetition, None),
    "t67_verdict": (t67_verdict, "select p_partkey, case when p_size % 2 = 0 then 1.0::double else 0 end as score from part"),
    "t69_messages": (t69_messages, "select conv_id, string_agg('**' || upper(role[1]) || role[2:] || '**: ' || text, chr(10) order by turn, role, text) as text from conversations where role <> 'system' group by 1"),
    "t70_without_thoughts": (t70_without_thoughts, f"select conv_id, turn, trim(replace(t, '<think>x</think>', '')) as text from {_ANS}"),
    "t71_valid_messages": (t71_valid_messages, "select conv_id, turn, true as valid from conversations"),
    "t73_support_type": (t73_support_type, "select case when contains(lower(p_name), 'lamp') then 'ceiling' when contains(lower(p_name), 'red') or contains(lower(p_name), 'blue') then 'wall' when contains(lower(p_name), 'e') then 'surface' else 'floor' end as kind, count(*) as n from part group by 1"),
    "t74_choices": (t74_choices, "select item_id, string_agg(o, ',' order by md5('7:' || item_id || ':' || o), o) as options, cast(list_position(list(o order by md5('7:' || item_id || ':' || o), o), 'right') as int) as answer, chr(cast(64 + list_position(list(o order by md5('7:' || item_id || ':' || o), o), 'right') as int)) as letter from benchmark, (values ('right'), ('wrong1'), ('wrong2'), ('wrong3')) t(o) group by 1"),
}
