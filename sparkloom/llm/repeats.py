"""Suffix-array dedup by a depth-limited radix sort: which bytes lie in a long string that starts anywhere else, too.

Suffixes are ordered only through their first LENGTH bytes, by most-significant-digit passes in which a suffix that is
alone with its digits so far leaves; what is equal after the last pass are exactly the repeated windows.

1. The first digit is chosen by content: of the DIGIT-byte strings in a window the one of least hash, its anchor. Equal
   windows have equal anchors at equal places, and neighbouring windows share theirs, so a run of suffixes with one anchor
   is one row, about one in 150 bytes. Anchors that occur once leave here, and so most of the text.
2. Runs with equal content are copies: all their windows are repeated, and one of them stands for all. Where equal runs
   follow one another, as in a text of one letter, they are one row from the start.
3. Other runs of an anchor are sorted by their further bytes, digit by digit, in tasks of bounded size (`radix`).
4. An anchor with more than LIMIT different runs, as where a common passage begins, is split by further passes in Spark:
   by the bytes that the next PART windows share, then by whole windows; these only count rows, so no group is one task's.
   Parts that are equal as a whole are copies, too: one of them is cut into windows, and only if others share its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, join_salted, mix, private, small, staged, unstage, with_struct

LENGTH = 400
#: Starts of windows that are looked at together, and bytes of runs that a sorting task gets.
PIECE, BUCKET = 1 << 19, 2 << 20
#: Different runs of an anchor that are sorted in one task, at most; windows of a part of a run beyond it.
LIMIT, PART = 1000, 40
_BASE = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_ODD = np.uint64(0xA24BAED4963EE407)
_PLACE = np.uint64((1 << 21) - 1)


class Rolling:
    """Hashes of all strings of a buffer: sums of byte values times powers, modulo 2 ** 64."""

    _powers: np.ndarray = np.ones(1, np.uint64)
    _inverse: np.ndarray = np.ones(1, np.uint64)

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        if len(Rolling._powers) <= n:
            for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                x = np.full(n + 1, base, np.uint64)
                x[0] = 1
                setattr(Rolling, name, np.cumprod(x))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[buffer] * self._powers[:n], out=self.sums[1:])

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[places + width] - self.sums[places]) * self._inverse[places])

    def every(self, width: int) -> np.ndarray:
        return mix((self.sums[width:] - self.sums[:-width]) * self._inverse[: len(self.sums) - width])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, from running minima of blocks forwards and backwards."""
    n = len(x) - width + 1
    filled = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    filled[: len(x)] = x
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _pieces(texts: list, length: int, size: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of about `size` bytes and their pieces (text, place in the text, place in the buffer, windows that start there)."""
    held, pieces, total = [], [], 0
    for i, t in enumerate(texts):
        t = b"" if t is None else t.encode("utf-8", "surrogatepass")
        for at in range(0, len(t) - length + 1, size):
            starts = min(size, len(t) - length + 1 - at)
            held.append(t[at : at + starts + length - 1])
            pieces.append((i, at, total, starts))
            total += len(held[-1])
            if total >= size:
                yield b"".join(held), pieces
                held, pieces, total = [], [], 0
    if held:
        yield b"".join(held), pieces


def runs_of(buffer: bytes, pieces: list[tuple[int, int, int, int]], length: int, digit: int) -> tuple[np.ndarray, ...]:
    """(piece, place in the buffer, windows, distance to the anchor, anchor's hash) of each run of windows with one anchor."""
    rolling = Rolling(np.frombuffer(buffer, np.uint8))
    hashes = rolling.every(digit)
    keyed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_least(keyed, length - digit + 1) & _PLACE).astype(np.int64)
    starts = np.concatenate([np.arange(b, b + n) for _, _, b, n in pieces])
    owner = np.repeat(np.arange(len(pieces)), [n for *_, n in pieces])
    mine = anchor[starts]
    first = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (owner[1:] != owner[:-1]))))
    spans = np.diff(np.append(first, len(starts)))
    return owner[first], starts[first], spans, mine[first] - starts[first], hashes[mine[first]].view(np.int64)


#: times: so many equal runs follow one another, as where a text repeats a letter or a line over and over.
RUN = "id long, at long, span int, shift int, anchor long, content long, times int"


def _runs(length: int, digit: int, size: int):
    schema = to_arrow_schema(T.StructType.fromDDL(RUN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids = batch.column(0).to_numpy()
            for buffer, pieces in _pieces(batch.column(1).to_pylist(), length, size):
                owner, at, spans, shift, anchor = runs_of(buffer, pieces, length, digit)
                text, place, base, _ = np.array(pieces, np.int64)[owner].T
                content = [xxhash.xxh3_64_intdigest(buffer[a : a + s + length - 1]) for a, s in zip(at.tolist(), spans.tolist(), strict=True)]
                content = np.array(content, np.uint64).view(np.int64)
                follows = (owner[1:] == owner[:-1]) & (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1]) & (spans[1:] == spans[:-1])
                first = np.flatnonzero(np.concatenate(([True], ~follows)))
                columns = (*(c[first] for c in (ids[text], place + at - base, spans, shift, anchor, content)), np.diff(np.append(first, len(at))))
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def radix(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, digit: int) -> np.ndarray:
    """Which of the suffixes at these places equal another one of their group in `length` bytes.

    One pass a digit: suffixes are ordered by (group so far, digit) and those that stand alone leave. Digits are compared
    as 64-bit hashes; what is left at the end is compared byte by byte with the first of its group, and a group with a
    difference by whole strings.
    """
    rolling, alive, group = Rolling(buffer), np.arange(len(at)), group.astype(np.uint64)
    for d in range(0, length, digit):
        key = mix(rolling.at(at[alive] + d, min(digit, length - d)) ^ mix(group * _ODD))
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1]))
        label = np.cumsum(new) - 1
        several = np.bincount(label)[label] > 1 if len(label) else np.zeros(0, bool)
        alive, group = alive[order[several]], label[several].astype(np.uint64)
        if not len(alive):
            return np.zeros(len(at), bool)
    leader = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    of = np.repeat(leader, np.diff(np.append(leader, len(group))))
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))
    same = np.ones(len(alive), bool)
    for d in [*range(0, length - 7, 8), max(length - 8, 0)] if length >= 8 else ():
        same &= eight[at[alive] + d] == eight[at[alive[of]] + d]
    out = np.zeros(len(at), bool)
    out[alive] = True
    if not same.all() or length < 8:
        odd = np.isin(group, group[~same]) if length >= 8 else np.ones(len(group), bool)
        held: dict[tuple[int, bytes], list[int]] = {}
        for i, g in zip(alive[odd].tolist(), group[odd].tolist(), strict=True):
            held.setdefault((g, buffer[at[i] : at[i] + length].tobytes()), []).append(i)
        for found in held.values():
            out[found] = len(found) > 1
    return out


def _intervals(hit: np.ndarray) -> list[int]:
    """First place and the place behind the last one of each run of true values, end to end."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge).tolist()


def _sort(length: int, digit: int):
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def run(table: pa.Table) -> pa.Table:
        """The runs of some anchors to the intervals of their windows that are repeated; runs without any are left out."""
        raw = table.column("bytes").to_pylist()
        anchor, spans, shift = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "span", "shift"))
        start = np.cumsum([0, *map(len, raw)])[:-1]
        owner = np.repeat(np.arange(len(raw)), spans)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
        group = mix(anchor[owner].view(np.uint64)) + (shift[owner] - place).astype(np.uint64)
        hit = radix(np.frombuffer(b"".join(raw), np.uint8), start[owner] + place, group, length, digit)
        edges = np.cumsum(np.append(0, spans))
        some = np.flatnonzero(np.add.reduceat(hit.astype(np.int64), edges[:-1]))
        found = [_intervals(hit[edges[i] : edges[i + 1]]) for i in some.tolist()]
        return pa.table([table.column("anchor").take(some), table.column("content").take(some), pa.array(found, pa.list_(pa.int32()))], schema=schema)

    return run


#: digit: hash of the bytes that all windows of a part share; first, last: places of the run's windows in the part; high, low: hash of all bytes of these.
PARTS = "anchor long, content long, part int, digit long, first int, last int, high long, low long"


def _shared_parts(length: int, part: int):
    """Runs (anchor, content, span, shift, bytes) to a row (PARTS) for each `part` places of the anchor."""
    schema = to_arrow_schema(T.StructType.fromDDL(PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for anchor, content, span, shift, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for p in range((shift - span + 1) // part, shift // part + 1):
                    digit = xxhash.xxh3_64_intdigest(raw[shift - p * part : shift - (p + 1) * part + 1 + length])
                    first, last = shift - min((p + 1) * part - 1, shift), shift - max(p * part, shift - span + 1)
                    high, low = np.frombuffer(xxhash.xxh3_128_digest(raw[first : last + length]), ">i8").tolist()
                    rows.append((anchor, content, p, digit - (1 << 64) if digit >= 1 << 63 else digit, first, last + 1, high, low))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _windows(length: int, part: int):
    """Runs with the parts that are left to a row (anchor, content, place, high, low) a window: its 128-bit hash."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("place", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 200):
            rows = []
            for anchor, content, span, shift, raw, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for p in parts:
                    for x in range(max(p * part, shift - span + 1), min((p + 1) * part - 1, shift) + 1):
                        high, low = np.frombuffer(xxhash.xxh3_128_digest(raw[shift - x : shift - x + length]), ">i8").tolist()
                        rows.append((anchor, content, shift - x, high, low))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


CUT = "anchor long, content long, copies long, hot boolean, span int, shift int, bytes binary"


def _cut(length: int):
    schema = to_arrow_schema(T.StructType.fromDDL(CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 200):
            rows = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(w["anchor"], w["content"], w["copies"], w["hot"], w["span"], w["shift"], raw[w["at"] : w["at"] + w["span"] + length - 1]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _several(rows: DataFrame, counts: DataFrame, spread: str) -> DataFrame:
    """The rows whose key more than one row has; counts: (key, n). A key of many rows is dealt over several tasks."""
    return join_salted(rows, counts.where("n > 1").withColumn("several", F.lit(True)), "key", "n", rows.count(), spread).where("several").drop("several")


def _mixed_windows(texts: DataFrame, mixed: DataFrame, length: int, digit: int, limit: int, bucket: int) -> DataFrame:
    """(anchor, content, spans) of runs of anchors that have different ones: null where all windows are repeated, else the intervals of those that are."""
    spark, part = texts.sparkSession, min(PART, max(1, length // 10))
    contents = staged(mixed.groupBy("anchor", "content").agg(F.sum("times").alias("copies"), F.min(F.struct("id", "at", "span", "shift")).alias("one")), "contents")
    # fewer than one in `limit` contents is a hot anchor, so that list goes to all tasks: a join dealt by anchor would put a hot one's runs in one
    hot = contents.groupBy("anchor").agg(F.count("*").alias("runs")).where(F.col("runs") > limit).select("anchor", F.lit(True).alias("hot"))
    entry = F.struct("one.at", "one.span", "one.shift", "anchor", "content", "copies", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = staged(contents.join(F.broadcast(hot), "anchor", "left").groupBy(F.col("one.id").alias("id")).agg(F.collect_list(entry).alias("wanted")), "wanted")
    cuts = staged(texts.select("id", "text").join(wanted, "id").select("text", "wanted").mapInArrow(_cut(length), CUT), "cuts", compression="zstd")
    unstage(wanted)
    total = cuts.where("not hot").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // bucket)
    dealt = cuts.where("not hot").select("anchor", "content", "span", "shift", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(parts)).alias("bucket"))
    found = dealt.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_sort(length, digit), "anchor long, content long, spans array<int>")

    large = cuts.where("hot").select("anchor", "content", "span", "shift", "bytes")
    shared = staged(large.mapInArrow(_shared_parts(length, part), PARTS).withColumn("key", F.struct("high", "low")).drop("high", "low"), "parts")
    alike = staged(shared.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("anchor", "content", "part", "digit")).alias("one")), "alike")
    kinds = alike.select("one.anchor", "one.content", "one.part", F.struct("one.anchor", "one.part", "one.digit").alias("key"))
    left = _several(kinds, kinds.groupBy("key").agg(F.count("*").alias("n")), "content").groupBy("anchor", "content").agg(F.collect_list("part").alias("left"))
    windows = large.join(left, ["anchor", "content"]).select(*large.columns, "left").mapInArrow(_windows(length, part), "anchor long, content long, place int, high long, low long")
    windows = staged(windows.select("anchor", "content", F.struct("high", "low").alias("key"), F.array("place", F.col("place") + 1).alias("pair")), "windows")
    copied = _several(shared, alike.select("key", "n"), "content").select("anchor", "content", F.array("first", "last").alias("pair"))
    single = _several(windows, windows.groupBy("key").agg(F.count("*").alias("n")), "content").select("anchor", "content", "pair")
    more = copied.unionByName(single).groupBy("anchor", "content").agg(F.flatten(F.collect_list("pair")).alias("spans"))
    sorted_runs = staged(found.unionByName(more), "sorted")
    for t in (cuts, shared, alike, windows):
        unstage(t)
    whole = contents.where("copies > 1").select("anchor", "content", F.lit(None).cast("array<int>").alias("spans"))
    return whole.unionByName(sorted_runs.join(contents.where("copies = 1").select("anchor", "content"), ["anchor", "content"]))


def with_repeats(docs: DataFrame, name: str = "__repeats", length: int = LENGTH, digit: int | None = None, limit: int = LIMIT, bucket: int = BUCKET, size: int = PIECE) -> DataFrame:
    """docs (text; others stay) with an array column `name`: start and end, end to end, of each maximal run of bytes to remove.

    A byte of the UTF-8 text goes if a string of `length` bytes that covers it starts anywhere else, in the same text or
    another one; strings are judged on the input, not on what is left. Null is empty; texts under `length` bytes, and all
    texts if nothing repeats, have no runs. Equal rows count as several. The texts are written once, numbered, so that
    rows stay what they are.
    """
    bound_batches(docs.sparkSession)
    digit = digit or max(1, length // 4)
    place = private(docs, "id")[0]
    rows = staged(docs.withColumn(place, F.monotonically_increasing_id()), "texts", compression="zstd")
    texts = rows.select(F.col(place).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = staged(texts.where(F.octet_length("text") >= length).mapInArrow(_runs(length, digit, size), RUN), "runs")
    anchors = staged(runs.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("times").alias("times"), (F.min("content") != F.max("content")).alias("mixed")).where("times > 1").drop("times"), "anchors")
    shared = staged(join_salted(runs, anchors, "anchor", "n", runs.count(), "id", "at").where(F.col("mixed").isNotNull()), "shared")
    unstage(runs)
    unstage(anchors)
    judged = _mixed_windows(texts, shared.where("mixed"), length, digit, limit, bucket)
    whole = F.array(F.col("at"), F.col("at") + F.col("span") * F.col("times"))
    some = F.transform("spans", lambda x: F.col("at") + x)
    hits = shared.where("not mixed").select("id", whole.alias("where"))
    hits = hits.unionByName(shared.where("mixed").join(judged, ["anchor", "content"]).select("id", F.coalesce(some, whole).alias("where")))
    removed = staged(hits.groupBy("id").agg(F.flatten(F.collect_list("where")).alias("where")), "removed")
    unstage(shared)
    marks = private(rows, "where")[0]
    joined = rows.join(removed.select(F.col("id").alias(place), F.col("where").alias(marks)), place, "left")
    merged = private(joined, "merged")[0]

    def make():
        def merge(lists: list) -> list:
            out = []
            for starts in lists:
                spans: list[int] = []
                for a, b in sorted(zip(starts[::2], starts[1::2], strict=True)) if starts else ():
                    if spans and a <= spans[-1]:
                        spans[-1] = max(spans[-1], b + length - 1)
                    else:
                        spans += [a, b + length - 1]
                out.append(spans)
            return [out]

        return merge

    out = with_struct(joined, merged, "spans array<long>", [F.col(marks)], make)
    return out.select(*docs.columns, F.col(f"{merged}.spans").alias(name))


def without(raw: bytes, spans: list[int]) -> bytes:
    """The bytes outside the spans."""
    return b"".join(raw[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], len(raw)], strict=True))


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) a row of docs."""

    def make():
        def report(texts: list, spans: list) -> list:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            gone = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            return [[len(r) for r in raw], gone, [len(s) // 2 for s in spans], [hashlib.sha256(without(r, s)).hexdigest() for r, s in zip(raw, spans, strict=True)]]

        return report

    found = with_repeats(docs.select("doc_id", "text"), "spans", length)
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return with_struct(found, "report", fields, [F.col("text"), F.col("spans")], make).select("doc_id", "report.*")


#: The same rows by DuckDB, from the hashes of all windows.
ORACLE = r"""
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
w as (select r, i, md5(b[i + 1:i + 400]) as h from (select r, b, unnest(range(0, octet_length(b) - 399)) as i from d)),
again as (select h from w group by h having count(*) > 1),
s as (select r, i, lag(i) over (partition by r order by i) as p from w join again using (h)),
g as (select r, i, sum(case when p is null or i > p + 400 then 1 else 0 end) over (partition by r order by i) as span from s),
spans as (select r, min(i) as a, max(i) + 400 as z from g group by r, span),
kept as (select r, coalesce(lag(z) over (partition by r order by a), 0) as f, a as t from spans union all select d.r, coalesce(max(z), 0), octet_length(any_value(b)) from d left join spans on spans.r = d.r group by d.r),
k as (select r, sha256(unhex(string_agg(hex(b[f + 1:t]), '' order by f))) as kept_sha256 from kept join d using (r) group by r),
n as (select r, sum(z - a) as n_removed, count(*) as n_spans from spans group by r)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, kept_sha256 from d join k using (r) left join n using (r)
"""
