"""Source divergence audit by systolic rotation: which sources of a language differ, and by which terms.

A group, the documents of a (lang, source), is a vector of term counts. Vectors are cut into slices of terms, and the
sources of a language are seated at SEATS seats; a seat's vectors of a slice, compressed, are one block. Blocks stay in
their partitions while those of the other seats come by in the rounds of a round-robin tournament (the circle method):
every two seats meet once, and a meeting gives both directions of all pairs between them. A block's own pairs are one
more round. While blocks are packed, a heap a source keeps the best terms of the slice, so ranking moves at most TOP terms
a source and slice. Everything is computed in integers.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, small, staged, unstage

#: A term counts if so many documents of its language hold it; ranks of terms end at TOP.
LEAST_DOCS, TOP = 10, 10
SEATS = 8
#: Numbers that a block unpacks to, at most about (terms of a slice times sources of a seat), and limits of a slice's terms.
CELLS, LEAST_TERMS, MOST_TERMS = 1 << 20, 1 << 10, 1 << 14
#: Counts, and different terms, that a task holds before it hands its counts on.
HELD, KNOWN = 2_000_000, 500_000
ONE = 1_000_000_000
TERM = re.compile(rb"[a-z\x80-\xff]+")


class Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Tally:
    """Occurrences and documents of each term in each group, as sorted arrays of (group, term) numbers."""

    def __init__(self):
        self.groups, self.terms, self.size = Numbers(), Numbers(), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, langs: list, sources: list, texts: list[bytes]) -> None:
        found = [TERM.findall(t.lower()) for t in texts]  # of bytes: A-Z alone
        lengths = np.array([len(f) for f in found], np.int64)
        term = np.fromiter(map(self.terms.__getitem__, chain.from_iterable(found)), np.int64, int(lengths.sum()))
        group = np.array([self.groups[g] for g in zip(langs, sources, strict=True)], np.int64)
        held, n = np.unique(np.repeat(np.arange(len(texts)), lengths) << 32 | term, return_counts=True)
        key = group[held >> 32] << 32 | (held & 0xFFFFFFFF)
        self.parts.append((key, n, np.ones(len(key), np.int64)))
        self.size += len(key)
        if self.size > HELD:
            self.parts = [self.summed()]
            self.size = len(self.parts[0][0])

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
        return (key[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (n, docs)))

    def batches(self, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        """Rows (lang, source, term, n, docs); each group has one with the empty term."""
        key, n, docs = self.summed()
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in range(2))
        terms = pa.array([*self.terms, b""], pa.binary()).cast(pa.string())
        none = np.zeros(len(self.groups), np.int64)
        group = np.concatenate((np.arange(len(none)), key >> 32))
        term = np.concatenate((none + len(self.terms), key & 0xFFFFFFFF))
        n, docs = np.concatenate((none, n)), np.concatenate((none, docs))
        for at in range(0, len(group), rows):
            some = slice(at, at + rows)
            yield pa.RecordBatch.from_arrays([langs.take(group[some]), sources.take(group[some]), terms.take(term[some]), pa.array(n[some]), pa.array(docs[some])], names=["lang", "source", "term", "n", "docs"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text as bytes) to (lang, source, term, n, docs) of the task; the empty term says that a group is there."""
    held = Tally()
    for batch in small(batches):
        held.add(*[c.to_pylist() for c in batch.columns])
        if held.size > HELD // 2 or len(held.terms) > KNOWN:
            yield from held.batches()
            held = Tally()
    if held.groups:
        yield from held.batches()


def share(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 v)) of each count, exact for counts of any size."""
    down = int(total) + 2 * int(v)
    if len(counts) and (int(counts.max()) > 1 << 32 or down > 1 << 62):
        return np.array([1 + ONE * (int(c) + 2) // down for c in counts], np.int64)
    return 1 + ONE * (counts.astype(np.int64) + 2) // down if len(counts) else np.zeros(0, np.int64)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits."""
    d = p - q
    return d * d // (p + q)


class Block(dict):
    """Sources of a seat in a slice: source to (total of the source, places of its terms, counts there); v and the slice's terms are the language's."""

    def __init__(self, v: int, terms: int):
        self.v, self.terms = v, terms

    def pack(self) -> bytes:
        head = [self.v, self.terms, len(self)]
        names, body = [s.encode("utf-8", "surrogatepass") for s in self], []
        for total, places, counts in self.values():
            head += [total, len(places)]
            body += [np.diff(places, prepend=0).astype("<u4").tobytes(), counts.astype("<i8").tobytes()]
        head += [len(n) for n in names]
        return zstandard.ZstdCompressor(level=1).compress(b"".join((np.array(head, "<i8").tobytes(), *names, *body)))

    @classmethod
    def unpack(cls, raw: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        v, terms, n = np.frombuffer(raw, "<i8", 3).tolist()
        rows = np.frombuffer(raw, "<i8", 2 * n, 24).reshape(n, 2).tolist()
        lengths = np.frombuffer(raw, "<i8", n, 24 + 16 * n).tolist()
        out, at, names = cls(v, terms), 24 + 24 * n, []
        for size in lengths:
            names.append(raw[at : at + size].decode("utf-8", "surrogatepass"))
            at += size
        for name, (total, k) in zip(names, rows, strict=True):
            places = np.cumsum(np.frombuffer(raw, "<u4", k, at), dtype=np.int64)
            counts = np.frombuffer(raw, "<i8", k, at + 4 * k)
            out[name] = (total, places, counts)
            at += 12 * k
        return out

    def shares(self) -> tuple[list[str], np.ndarray]:
        """Sources and their shares of every term of the slice."""
        p = np.zeros((len(self), self.terms), np.int64)
        for i, (total, places, counts) in enumerate(self.values()):
            if self.terms:
                p[i] = share(np.zeros(1, np.int64), total, self.v)[0]
                p[i, places] = share(counts, total, self.v)
        return list(self), p


def meet(a: Block, b: Block | None = None) -> list[tuple[str, str, int]]:
    """(source, other, value) of all pairs between two blocks, or within one, in both directions; the value adds up over the slice."""
    mine, p = a.shares()
    others, q = (mine, p) if b is None else b.shares()
    out = []
    for i, s in enumerate(mine):
        first = i + 1 if b is None else 0
        values = difference(p[i][None, :], q[first:]).sum(axis=1).tolist()
        for o, v in zip(others[first:], values, strict=True):
            out += [(s, o, v), (o, s, v)]
    return out


def _pack(top: int):
    schema = pa.schema([("lang", pa.string()), ("slice", pa.int64()), ("seat", pa.int32()), ("block", pa.binary()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        """Counts of one (lang, slice, seat) to its block and the best terms of each source; a row without a term tells a source's total."""
        lang, number, seat, v, terms, of_lang = (table.column(n)[0].as_py() for n in ("lang", "slice", "seat", "v", "terms", "of_lang"))
        table = table.sort_by([("source", "ascending"), ("place", "ascending")])  # the row without a term comes last
        place, n, n_lang = (table.column(c).fill_null(-1).to_numpy() for c in ("place", "n", "n_lang"))
        last = np.flatnonzero(place < 0)
        sources, totals = table.column("source").take(last).to_pylist(), table.column("total").take(last).to_pylist()
        term = table.column("term").combine_chunks()
        block, rows = Block(v, terms), []
        for s, total, lo, hi in zip(sources, totals, np.concatenate(([0], last[:-1] + 1)).tolist(), last.tolist(), strict=True):
            places, counts, of = place[lo:hi].astype(np.int64), n[lo:hi], n_lang[lo:hi]
            block[s] = (total, places, counts)
            p, q = share(counts, total, v), share(of, of_lang, v)
            more = np.flatnonzero(p > q)
            f = difference(p[more], q[more])
            if len(f) > top:  # equal ones at the limit come along
                some = f >= np.partition(f, len(f) - top)[len(f) - top]
                more, f = more[some], f[some]
            names = term.take(pa.array(lo + more)).to_pylist()
            best = heapq.nsmallest(top, ((-x, t.encode("utf-8", "surrogatepass"), t) for x, t in zip(f.tolist(), names, strict=True)))
            rows += [(lang, number, seat, None, s, t, -x) for x, _, t in best]
        rows.append((lang, number, seat, block.pack(), None, None, None))
        return pa.table([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, block, visitor) to (lang, source, item, value); without a visitor the block's own pairs."""
    for batch in small(batches, 16):
        for lang, block, visitor in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = meet(Block.unpack(block), None if visitor is None else Block.unpack(visitor))
            columns = [[lang] * len(found), *([x[i] for x in found] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "item", "value"])


def tournament(seats: int) -> list[list[tuple[int, int]]]:
    """Rounds of (host, visitor) by the circle method: every two seats meet once, each seat at most once a round."""
    n = seats + seats % 2
    rounds = []
    for r in range(n - 1):
        ring = [0, *[1 + (i + r) % (n - 1) for i in range(n - 1)]]
        pairs = [(ring[i], ring[n - 1 - i]) for i in range(n // 2)]
        rounds.append([(a, b) for a, b in pairs if max(a, b) < seats])
    return rounds


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; every group has a row with an empty term.

    Null lang, source and text are empty. Tasks add up what they have before it moves, so a hot group is no one's task.
    """
    bound_batches(docs.sparkSession)
    blank = F.lit("")
    rows = docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"), F.coalesce("text", blank).cast("binary").alias("text"))
    found = rows.mapInArrow(_tally, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, seats: int = SEATS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text; other columns are ignored).

    Terms are runs of letters a-z (A-Z lower-cased) and characters outside ASCII; a language keeps the terms that are in at
    least `least_docs` of its documents. Part `pair` compares a group with each other source of its language over all kept
    terms (0 if none is kept), part `term` lists the terms that a group has more of than its language, by value, the first
    `top`. Equal values are ranked by the item's UTF-8. Null lang, source and text are ''. No documents give no rows.
    """
    counts = staged(term_counts(docs), "terms")
    per_lang = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
    words = staged(per_lang.where(F.col("docs") >= least_docs).select("lang", "term", "n_lang"), "kept")
    postings = staged(counts.where("term <> ''").join(_if_small(words), ["lang", "term"]), "postings")
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    seat = F.pmod(F.xxhash64("lang", "source"), F.lit(seats)).cast("int")
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = staged(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), seat.alias("seat")), "groups")
    unstage(counts)
    # Slices of a language: so many terms that a seat's block has at most about `cells` numbers.
    widest = groups.groupBy("lang", "seat").count().groupBy("lang").agg(F.max("count").alias("widest"))
    sizes = groups.select("lang").distinct().join(words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("of_lang")), "lang", "left").join(widest, "lang")
    sizes = staged(sizes.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("of_lang", F.lit(0)).alias("of_lang"), F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / F.least(F.greatest(F.lit(cells) / F.col("widest"), F.lit(LEAST_TERMS)), F.lit(MOST_TERMS)))).alias("slices")), "langs")
    langs = _if_small(sizes)
    placed = words.join(langs, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")))
    # A slice has a bounded number of terms, so its window does, too.
    places = staged(placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).select("lang", "slice", "term", "place"), "places")
    filled = places.groupBy("lang", "slice").agg(F.count("*").alias("terms"))
    every = sizes.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).join(filled, ["lang", "slice"], "left")
    every = staged(every.select("lang", "slice", "v", "of_lang", F.coalesce("terms", F.lit(0)).alias("terms")), "slices")
    known = ["lang", "slice", "seat", "source", "total", "v", "of_lang", "terms", "term", "place", "n", "n_lang"]
    none = {"term": "string", "place": "int", "n": "long", "n_lang": "long"}
    there = groups.join(_if_small(every), "lang").select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    held = postings.join(_if_small(places), ["lang", "term"]).join(_if_small(groups), ["lang", "source"]).join(_if_small(every), ["lang", "slice"])
    packed = there.select(*known).unionByName(held.select(*known)).groupBy("lang", "slice", "seat").applyInArrow(_pack(top), "lang string, slice long, seat int, block binary, source string, item string, value long")
    packed = staged(packed, "blocks")
    for t in (postings, places, every):
        unstage(t)

    resident = packed.where(F.col("block").isNotNull()).select("lang", "slice", "seat", "block").repartition("lang", "slice", "seat").persist()
    rounds = [resident.select("lang", "block", F.lit(None).cast("binary").alias("visitor"))]
    for pairs in tournament(seats):
        host = F.try_element_at(F.create_map(*[F.lit(x) for a, b in pairs for x in (b, a)]), F.col("seat"))  # where each visiting seat goes
        visitors = resident.select("lang", "slice", host.alias("seat"), F.col("block").alias("visitor")).where(F.col("seat").isNotNull())
        rounds.append(resident.join(visitors, ["lang", "slice", "seat"]).select("lang", "block", "visitor"))
    meetings = rounds[0]
    for r in rounds[1:]:
        meetings = meetings.unionByName(r)
    pairs = staged(meetings.mapInArrow(_evaluate, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    resident.unpersist()

    terms = packed.where(F.col("item").isNotNull()).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rows = terms.unionByName(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top))


#: The same rows by DuckDB.
ORACLE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct r) >= 10),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by lang),
m as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, v.v from g join kept k using (lang) join v using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, n, 1 + (cast(1000000000 as hugeint) * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v) as p from m),
l as (select lang, term, 1 + (cast(1000000000 as hugeint) * (sum(n) + 2)) // (sum(sum(n)) over (partition by lang) + 2 * any_value(v)) as q from m group by lang, term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, b.source as item from g a join g b on a.lang = b.lang and a.source <> b.source),
rows as (select lang, source, 'pair' as part, item, cast(coalesce(value, 0) as bigint) as value from every left join pairs using (lang, source, item)
    union all select lang, source, 'term', term, cast((p - q) * (p - q) // (p + q) as bigint) from p join l using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, cast(rank as integer) as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from rows) where part = 'pair' or rank <= 10
"""
