"""Mixing sources to target weights: sizes by source, repetition rates, floor(rate) copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batch import with_position
from ..operators.sampling import with_running_sums
from .common import BROADCAST_ROWS, join_salted, join_small, private, staged

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of runs of characters other than 20 and 09-0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows), one row a source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at cap
    times its source's size; the excess goes to the others by weight until none is above. By rising cap for a unit of
    weight, the sources before some place are capped and the others share what is left: that gives a level at each place,
    and the level that holds is the largest which its own source's cap allows. Running sums by ranges give all levels in
    one pass, however many sources cap each other. Sources of size 0 get 0. No step holds all sources in one task: they
    may be as many as hosts.
    """
    ranked = with_position(sizes.withColumn("none", F.col("source").isNull()), ["none", "source"], name="rank").drop("none")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    full = (F.lit(cap) * F.col("source_size")).cast("long")
    ranked = staged(ranked.withColumn("w", weight).withColumn("full", full), "sources")
    total = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    if not total[0]:
        return ranked.select("source", "source_size", "rows", F.lit(0.0).alias("target"))
    ordered = ranked.withColumn("r", F.col("full").cast("double") / F.col("w"))
    summed, _ = with_running_sums(ordered, ["r", "rank"], {"taken": "full", "used": "w"})
    level = (F.lit(total[0]) - F.col("taken").cast("long")).cast("double") / (F.lit(total[1]) - F.col("used").cast("long")).cast("double")
    held = summed.select("r", level.alias("level")).where(F.col("level") <= F.col("r")).agg(F.max("level")).first()[0]
    return ranked.select("source", "source_size", "rows", F.least(F.lit(held) * F.col("w"), F.col("full").cast("double")).alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of seed and key, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def with_draws(rows: DataFrame, mark: Column, seed: str, name: str) -> DataFrame:
    """rows (doc_id, source) with `name`, each row's own draw: that of its id, or, where ids are null or repeat, of id, text and a running number.

    mark is a hash of the text as a string. Rows that are equal in id, source and text are numbered, so each draws for
    itself and the draws of all of them together are the same in every run. Only rows without an id of their own are sorted.
    """
    plain = uniform(F.col("doc_id").cast("string"), seed)
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    again, key, tie, place, first = private(rows, "again", "mark", "tie", "place", "first")
    some = staged(ids.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(key), F.lit(True).alias(again)), "repeated")
    if some.isEmpty():
        return rows.withColumn(name, plain)
    keyed = rows.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    marked = join_small(keyed, some, key)
    own = marked.where(F.col(again).isNull()).withColumn(name, plain).select(*rows.columns, name)
    shared = marked.where(again).withColumn(key, F.concat_ws(":", key, F.coalesce(mark, F.lit("")), F.md5(F.coalesce("source", F.lit("null"))))).withColumn(tie, F.rand(1))
    placed = with_position(shared, key, tie, name=place)
    starts = staged(placed.groupBy(key).agg(F.min(place).alias(first), F.count("*").alias("n")), "starts")
    numbered = join_salted(placed, starts, key, "n", placed.count(), place)
    drawn = uniform(F.concat_ws(":", key, (F.col(place) - F.col(first)).cast("string")), seed)
    return own.unionByName(numbered.withColumn(name, drawn).select(*rows.columns, name))


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, source_size, rows) from (source, size); added up before anything moves, so a source with a third of all rows costs no more than others."""
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))


def _with_copies(docs: DataFrame, goals: DataFrame, name: str, mark: Column, seed: str) -> DataFrame:
    """docs with a struct column `name`: source_size, target and copies, from the goals of their sources; mark is a hash of the text.

    The sources' table is broadcast if it has at most BROADCAST_ROWS rows; beyond, large sources are dealt over several tasks.
    """
    key, goal, weight, draw = private(docs, "key", "goal", "weight", "draw")
    columns = docs.columns
    docs = with_draws(docs, mark, seed, draw)
    of = F.concat(F.col("source").isNull().cast("string"), F.coalesce(F.col("source"), F.lit("")))
    keyed, small = docs.withColumn(key, of), goals.select(of.alias(key), F.struct("source_size", "target").alias(goal), F.col("rows").alias(weight))
    if goals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(small), key, "left")
    else:
        joined = join_salted(keyed, small, key, weight, goals.agg(F.sum("rows")).first()[0], draw)
    size, target = F.col(f"{goal}.source_size"), F.col(f"{goal}.target")
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col(draw) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn(name, F.struct(size.alias("source_size"), target.alias("target"), copies.cast("int").alias("copies"))).select(*columns, name)


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, name: str = "__mix") -> DataFrame:
    """docs (doc_id, text, source) with a struct column `name`: source_size, target and copies.

    Null texts have size 0; null is a source like any other. Each row draws for itself: see with_draws.
    """
    sizes = staged(source_sizes(docs.select("source", words(F.col("text")).alias("size"))), "sizes")
    return _with_copies(docs, source_targets(sizes, weights, cap), name, F.md5(F.coalesce("text", F.lit(""))), seed)


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) a row of docs. Texts are counted once, into a table of their sizes."""
    sized = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("mark")), "sized")
    m = _with_copies(sized, source_targets(staged(source_sizes(sized), "sizes"), weights, cap), "__mix", F.col("mark"), seed)
    return m.select("doc_id", "size", F.col("__mix.source_size").alias("source_size"), F.col("__mix.target").alias("target"), (F.col("size") * F.col("__mix.copies")).alias("taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to cap times)."""
    name, copy = private(docs, "mix", "copy")
    m = with_copies(docs, name=name, **options).where(F.col(f"{name}.copies") > 0)
    return m.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))).select(*docs.columns)


#: The same rows by DuckDB; the md5 gives the same draws.
ORACLE = r"""
with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, case when doc_id is null or count(*) over (partition by doc_id) > 1
    then coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, '')) || ':' || md5(coalesce(source, 'null')) || ':' || (row_number() over (partition by doc_id, md5(coalesce(text, '')), source) - 1) else cast(doc_id as varchar) end as key from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, row_number() over (order by source asc nulls last) as rank, 1 + (row_number() over (order by source asc nulls last) - 1) % 3 as w from sources),
ratio as (select *, cast(3 * source_size as double) / w as r, sum(source_size) over () as total from ranked),
levels as (select *, cast(total - coalesce(sum(3 * source_size) over (order by r, rank rows between unbounded preceding and 1 preceding), 0) as double)
    / cast(sum(w) over (order by r, rank rows between current row and unbounded following) as double) as level from ratio),
goals as (select source, source_size, least((select max(level) from levels where level <= r) * w, cast(3 * source_size as double)) as target from levels),
drawn as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
    cast(cast('0x' || substr(md5('mix-1:' || key), 1, 13) as bigint) as double) / 4503599627370496.0 as u
    from sized join goals on sized.source is not distinct from goals.source)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from drawn
"""
