"""Matches between tables in tiers: exact keys first, then contained texts, then fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import with_position

#: Characters of the pieces by which contained texts find each other.
PIECE = 32
#: Places of a text that are hashed in one row.
STRETCH = 4096


def first_tier(key: str, *tiers: DataFrame, order: str) -> DataFrame:
    """One row a key from the first tier (of DataFrames with equal columns) that has any, by `order`; with its `tier` from 1."""
    numbered = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers, 1)]
    w = Window.partitionBy(key).orderBy("tier", order)
    return reduce(DataFrame.unionByName, numbered).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def either_key(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows of left and right that agree in any of the (left, right) key pairs, each once: a union of equi-joins.

    A row pair counts in the first key pair that it agrees in, so nothing has to be made distinct afterwards.
    """
    parts = []
    for i, (a, b) in enumerate(pairs):
        earlier = reduce(lambda x, p: x & ~left[p[0]].eqNullSafe(right[p[1]]), pairs[:i], F.lit(True))
        parts.append(left.join(right, (left[a] == right[b]) & earlier))
    return reduce(DataFrame.unionByName, parts)


def fallback_lookup(df: DataFrame, key: str, value: str, *lookups: DataFrame, default: Column | None = None) -> DataFrame:
    """df with `value` from the first lookup (key, value; one row a key) that has the key with a value, else the default."""
    out = df
    for i, x in enumerate(lookups):
        out = out.join(x.select(F.col(key), F.col(value).alias(f"__v{i}")), key, "left")
    found = F.coalesce(*[F.col(f"__v{i}") for i in range(len(lookups))], *([] if default is None else [default]))
    return out.withColumn(value, found).drop(*[f"__v{i}" for i in range(len(lookups))])


def skip_existing(df: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys (null equal to null) aren't among the existing ones; rows that repeat stay."""
    theirs = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return df.join(theirs, reduce(lambda a, k: a & df[k].eqNullSafe(theirs[f"__{k}"]), keys, F.lit(True)), "left_anti")


def keep_existing(df: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys (null equal to null) are among the existing ones."""
    theirs = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return df.join(theirs, reduce(lambda a, k: a & df[k].eqNullSafe(theirs[f"__{k}"]), keys, F.lit(True)), "left_semi")


def first_by_key(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first row by `order` of each key: one aggregation with partial results, no sort of groups."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(order, *[c for c in df.columns if c != order])).alias("__r")).select("__r.*")


def hashed_split(df: DataFrame, key: str, share: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """(first, rest): rows whose hash of seed and key lies under the share, and the others; the same in every run."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return df.where(draw < share), df.where(draw >= share)


def search(df: DataFrame, text: str, needle: str, order: list[Column], group: str | None = None) -> DataFrame:
    """Rows whose text contains the needle in any case, with their `place` by `order` in their group; without a group all
    rows are placed by ranges of the order."""
    found = df.where(F.lower(text).contains(needle.lower()))
    if group:
        return found.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return with_position(found, order, name="place").withColumn("place", (F.col("place") + 1).cast("int"))


def band_draw(df: DataFrame, group: str, key: str, band: Column, share: float, seed: str) -> DataFrame:
    """A share (at least one) of each group's rows in a band, drawn by the hash of seed and key."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    w = Window.partitionBy(group)
    x = df.where(band).withColumn("__rn", F.row_number().over(w.orderBy(draw, key))).withColumn("__n", F.count("*").over(w))
    return x.where(F.col("__rn") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share))).drop("__rn", "__n")


def _pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __h): hashes of the pieces that begin at every character of the texts, each once a stretch.

    A text is cut into stretches of STRETCH places first, so a long one is many rows and no row holds all of its pieces.
    """
    cut = df.select(key, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(1), F.greatest(F.length(text) - (PIECE - 1), F.lit(1)), F.lit(STRETCH))).alias("__at"))
    part = cut.select(key, F.substr("__t", "__at", F.lit(STRETCH + PIECE - 1)).alias("__t"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("__t") - (PIECE - 1), F.lit(1)))
    return part.select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substr("__t", i, F.lit(PIECE)))))).alias("__h"))


def containments(short: DataFrame, short_key: str, short_text: str, long: DataFrame, long_key: str, long_text: str) -> DataFrame:
    """(short key, long key) where a long text contains a whole short one, at any place.

    A short text of PIECE characters or more goes by its piece that is rarest among the long texts' pieces: an equi-join
    at all places, then a check of the whole text. The few kinds of shorter texts (each distinct one, of fewer than PIECE
    characters) go by all of a long text's runs of that length. Empty texts are in nothing.
    """
    a = short.select(F.col(short_key).alias("__a"), F.col(short_text).alias("__s")).where(F.length("__s") > 0)
    b = long.select(F.col(long_key).alias("__b"), F.col(long_text).alias("__l")).where(F.length("__l") > 0)
    places = _pieces(b.where(F.length("__l") >= PIECE), "__b", "__l")
    wanted = _pieces(a.where(F.length("__s") >= PIECE), "__a", "__s")
    df = places.groupBy("__h").agg(F.count("*").alias("__n"))
    ranked = wanted.join(df, "__h", "left").groupBy("__a").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__h").alias("h"))).alias("__m"))
    rarest = ranked.where("__m.n > 0").select("__a", F.col("__m.h").alias("__h"))
    pairs = rarest.join(places, "__h").select("__a", "__b").distinct()
    long_hits = pairs.join(a, "__a").join(b, "__b").where(F.contains("__l", "__s")).select("__a", "__b")
    tiny = a.where(F.length("__s") < PIECE).withColumn("__k", F.length("__s"))
    widths = tiny.select("__k").distinct()
    runs = b.join(F.broadcast(widths), F.length("__l") >= F.col("__k")).select("__b", "__k", F.explode(F.transform(F.sequence(F.lit(1), F.length("__l") - F.col("__k") + 1), lambda i: F.substr(F.col("__l"), i, F.col("__k")))).alias("__s")).distinct()
    short_hits = tiny.join(runs, ["__k", "__s"]).select("__a", "__b")
    return long_hits.unionByName(short_hits).distinct().select(F.col("__a").alias(short_key), F.col("__b").alias(long_key))


def prompt_index(probes: DataFrame, probe: str, prompt: str, stored: DataFrame, key: str, text: str, least: int = 50) -> DataFrame:
    """(probe, key, tier): the first stored text equal to a prompt (tier 1), else, for prompts over `least` characters, the
    first that contains it or lies in it (tier 2)."""
    exact = probes.join(stored, F.col(prompt) == F.col(text)).select(probe, key)
    some = probes.where(F.length(prompt) > least)
    inside = containments(some, probe, prompt, stored, key, text).select(probe, key)
    around = containments(stored, key, text, some, probe, prompt).select(probe, key)
    return first_tier(probe, exact, inside.unionByName(around), order=key)
