"""Draws over whole tables, scans over long sequences, samplers and resampling without a group in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import algebra
from ..operators import batch, groups, sampling, tools
from ..operators import metrics as M
from ..operators import recurrences as R
from ..session import scratch
from ..sources import log
from ..streaming import queues as Q
from ..streaming import stateful
from .common import r, table

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(_KEY)


def g12_resample(s, d):
    """As many line items as there are, drawn with replacement by the square of their quantity."""
    score = F.col("l_quantity")
    return sampling.weighted_draws(table(s, d, "lineitem"), _KEY, groups.preference_weights(score, score, score, "pow"))


def _steps(s, d):
    """A user's events as a sequence: reward, value and mask."""
    e = table(s, d, "events")
    return e.select("user_id", "event_id", (F.col("value") * 0.010307718293).alias("reward"), (F.col("event_id") % 7 / 10.0).alias("guess"), (F.col("event_type") != "view").cast("int").alias("mask"))


def w01_gae_rows(s, d):
    return R.gae_rows(_steps(s, d), "user_id", "event_id", "reward", "guess", "mask", 0.9531, 0.9173).select("event_id", r("advantage").alias("advantage"))


def w02_return_rows(s, d):
    return R.return_rows(_steps(s, d), "user_id", "event_id", "reward", "mask", 0.9531).select("event_id", r("return").alias("return"))


def w03_suffix_rows(s, d):
    return R.suffix_sum_rows(_steps(s, d), "user_id", "event_id", "reward", "mask").select("event_id", r("suffix_sum").alias("suffix_sum"))


def d12_shuffled(s, d):
    """The place of each document in two epochs."""
    x = batch.with_position(table(s, d, "documents").select("doc_id"), "doc_id")
    n = x.count()
    epoch = lambda e: x.select("doc_id", F.lit(e).alias("epoch"), sampling.shuffled_place(F.col("pos"), n, f"7:{e}").alias("place"))
    return epoch(0).unionByName(epoch(1))


def a15_bootstrap_mean(s, d):
    x = M.bootstrap_mean(table(s, d, "events"), "event_type", "event_id", "value")
    return x.select("event_type", r("mean", 5).alias("mean"), r("deviation", 5).alias("deviation"))


def m02_consumed_queue(s, d):
    """A queue a user: clicks and signups are put, views take, some errors clear and some purchases close."""
    e = Q.stream_of(s, f"{d}/events.parquet")
    t, v = F.col("event_type"), F.col("value")
    kind = F.when(t.isin("click", "signup"), "put").when(t == "view", "take").when((t == "error") & (v > 100), "clear").when((t == "purchase") & (v > 150), "close")
    with stateful.list_state(s):
        return Q.run_available(stateful.consumed_queue(e.withColumn("kind", kind), "user_id", "event_id", F.col("kind")), "update", "consumed")


def s25_append_log(s, d):
    """Two commits of an append log, read as a table."""
    path, x = scratch(s, "log"), table(s, d, "documents").select("doc_id", "n_chars")
    log.append(x, path)
    log.append(x.where("n_chars < 500").withColumn("doc_id", F.col("doc_id") + 1_000_000_000), path)
    return log.read(s, path)


def f09_tool_session(s, d):
    """A tool a conversation: made by its first turn, called by each, released at the end."""
    tools.register(s)
    table(s, d, "conversations").createOrReplaceTempView("loom_conversations")
    x = s.sql("select * from tool_session(table(select conv_id, turn, text from loom_conversations), 'conv_id', 'turn', 'text', 'chars')")
    return x.select("conv_id", "turn", "call", "chars", "total")


def t14_symbolic(s, d):
    """(x + a)^2 against its expansion, in which every third is off by one."""
    a, k = F.col("p_size").cast("string"), F.col("p_partkey")
    given = F.concat(F.lit("(x + "), a, F.lit(")^2"))
    gold = F.concat(F.lit("x^2 + "), (F.col("p_size") * 2).cast("string"), F.lit(r"x + \frac{"), (F.col("p_size") * F.col("p_size") * 3 + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"), F.lit("}{3}"))
    return table(s, d, "part").select("p_partkey", algebra.expressions_equal(given, gold).alias("equal"), algebra.expressions_equal(F.concat(a, F.lit("/4")), F.concat(F.lit("0.25 * "), a)).alias("quarter"))


def t65_any_expression(s, d):
    """Sizes as fractions of ten against three right answers in other forms."""
    golds = F.array(F.lit("0.5"), F.lit(r"\frac{6}{5}"), F.lit("2^3/5"), F.lit("no number"))
    return table(s, d, "part").select("p_partkey", algebra.any_equal(F.concat(F.col("p_size").cast("string"), F.lit("/10")), golds).alias("hit"))


_SEQ = "with recursive a as (select user_id, list(event_id order by event_id) as e, list(value * 0.010307718293::double order by event_id) as r, list(event_id % 7 / 10.0::double order by event_id) as v, list(case when event_type <> 'view' then 1 else 0 end order by event_id) as m from events group by 1)"
_HEX = "cast('0x' || substr(h, {}, 15) as bigint)::hugeint"


def _feistel(rounds: int = 4) -> str:
    """One pass over x (half bits a side, key) as nested selections; the result is y."""
    inner = "select *, x >> half as l0, x & ((1 << half) - 1) as r0 from w where step = 0 or x >= n"
    for i in range(rounds):
        inner = f"select *, r{i} as l{i + 1}, xor(l{i}, cast('0x' || substr(md5(key || ':{i}:' || r{i}), 1, 12) as bigint) & ((1 << half) - 1)) as r{i + 1} from ({inner})"
    return f"select doc_id, epoch, key, n, half, (l{rounds} << half) | r{rounds} as x, step + 1 as step from ({inner})"


_DIGITS = ", ".join(f"('0x' || substr(md5('boot:{i // 8}:' || event_id), {i % 8 * 4 + 1}, 4))::int as u{i}" for i in range(32))
_POISSON = " + ".join(f"(u >= {t})::int" for t in M.POISSON)

_KIND = "case when event_type in ('click', 'signup') then 'put' when event_type = 'view' then 'take' when event_type = 'error' and value > 100 then 'clear' when event_type = 'purchase' and value > 150 then 'close' end"

QUERIES = {
    "s25_append_log": (s25_append_log, "select doc_id, n_chars from documents union all select doc_id + 1000000000, n_chars from documents where n_chars < 500"),
    "f09_tool_session": (f09_tool_session, "with x as (select conv_id, turn, coalesce(length(text), 0) as chars from conversations) select conv_id, turn, row_number() over w as call, chars, cast(sum(chars) over w as bigint) as total from x window w as (partition by conv_id order by turn rows unbounded preceding) union all select conv_id, null, count(*), null, cast(sum(chars) as bigint) from x group by conv_id"),
    "t65_any_expression": (t65_any_expression, "select p_partkey, p_size in (5, 12, 16) as hit from part"),
    "t14_symbolic": (t14_symbolic, "select p_partkey, p_partkey % 3 <> 0 as equal, true as quarter from part"),
    "m02_consumed_queue": (m02_consumed_queue, f"with recursive a as (select user_id, list({_KIND} order by event_id) as k from events group by 1), f as (select user_id, 1 as i, 0 as taken, 0 as held, 0 as waiting, false as closed from a union all select f.user_id, i + 1, case when k[i] = 'put' and waiting > 0 or k[i] = 'take' and held > 0 then taken + 1 else taken end, case when k[i] = 'put' and waiting = 0 then held + 1 when k[i] = 'take' and held > 0 then held - 1 when k[i] = 'clear' then 0 else held end, case when k[i] = 'put' and waiting > 0 then waiting - 1 when k[i] = 'take' and held = 0 and not closed then waiting + 1 when k[i] = 'close' then 0 else waiting end, closed or coalesce(k[i] = 'close', false) from f join a using (user_id) where i <= len(k)) select user_id, cast(taken as bigint) as taken, cast(held as bigint) as left, closed from f join a using (user_id) where i = len(k) + 1"),
    "g12_resample": (g12_resample, f"with x as (select {_K}, cast(round((pow(abs(l_quantity), 2) + 1e-8) / 1e-8) as hugeint) as w from lineitem), s as (select *, coalesce(sum(w) over (order by {_K} rows between unbounded preceding and 1 preceding), 0) as at from x), p as (select i as draw, ({_HEX.format(1)} * 1152921504606846976 + {_HEX.format(16)}) % (select sum(w) from x) as p from (select i, md5('42:' || i) as h from range((select count(*) from x)) t(i))) select draw, {_K} from p asof join s on p.p >= s.at"),
    "w01_gae_rows": (w01_gae_rows, f"{_SEQ}, f as (select user_id, len(e) + 1 as i, 0.0::double as nv, 0.0::double as g, null::bigint as event_id from a union all select f.user_id, i - 1, case when m[i - 1] = 1 then v[i - 1] else nv end, case when m[i - 1] = 1 then r[i - 1] + 0.9531::double * nv - v[i - 1] + 0.9531::double * 0.9173::double * g else g end, e[i - 1] from f join a using (user_id) where i > 1) select event_id, round(g, 6) + 0.0 as advantage from f where event_id is not null"),
    "w02_return_rows": (w02_return_rows, f"{_SEQ}, f as (select user_id, len(e) + 1 as i, 0.0::double as c, 0.0::double as o, null::bigint as event_id from a union all select f.user_id, i - 1, (r[i - 1] + 0.9531::double * c) * m[i - 1], r[i - 1] + 0.9531::double * c, e[i - 1] from f join a using (user_id) where i > 1) select event_id, round(o, 6) + 0.0 as return from f where event_id is not null"),
    "w03_suffix_rows": (w03_suffix_rows, "select event_id, round(sum(case when event_type <> 'view' then value * 0.010307718293::double else 0 end) over (partition by user_id order by event_id desc), 6) + 0.0 as suffix_sum from events"),
    "d12_shuffled": (d12_shuffled, f"with recursive p as (select doc_id, epoch, '7:' || epoch as key, row_number() over (partition by epoch order by doc_id) - 1 as pos, count(*) over (partition by epoch) as n from documents, (values (0), (1)) t(epoch)), w as (select doc_id, epoch, key, n, greatest(1, cast(ceil((floor(log2(greatest(n - 1, 1))) + 1) / 2) as integer)) as half, pos as x, 0 as step from p union all {_feistel()}) select doc_id, epoch, cast(x as bigint) as place from w where step > 0 and x < n"),
    "a15_bootstrap_mean": (a15_bootstrap_mean, f"with d as (select event_type, value, {_DIGITS} from events), x as (select event_type, value, unnest([{', '.join(f'u{i}' for i in range(32))}]) as u, unnest(range(32)) as k from d), m as (select event_type, k, sum(value * ({_POISSON})) / nullif(sum({_POISSON}), 0) as m from x group by 1, 2) select event_type, round(avg(m), 5) as mean, round(stddev_pop(m), 5) as deviation from m group by 1"),
}
