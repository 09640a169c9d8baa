"""Vector code compression: product codes whose nearest entries are found by VA-file filtering, all in integers.

A vector is cut into equal parts, each with a codebook. The coordinates of a codebook's entries are kept as few-bit cells;
a vector gets a lookup table for each coordinate with the least and the largest squared distance to any point of each
cell. Adding these up over an entry's cells bounds its distance from below and above; only entries whose lower bound
doesn't exceed the least upper bound are refined with exact distances. Codebooks are trained by rounds of assignment and
integer means: tasks send sums by entry, and only the codebooks (entries times dimensions) meet on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, join_salted, small, staged, unstage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a cell: each coordinate of the entries is cut into 2 ** BITS intervals.
BITS = 4
#: Vectors with components under this size are computed in 64-bit integers (squared distances stay under 2 ** 63 up to thousands of components), others in Python's.
WIDE = 1 << 17
#: Sums travel in pieces of so many bits, one for all but huge numbers, so that no vector of doubles overflows them.
LIMB = 60


class Codebooks(NamedTuple):
    """Entries of each part: shape (parts, entries, width of a part), 64-bit or Python integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


class Cells:
    """The VA-file of one part's entries: a cell number for each entry and coordinate, and the cells' ends."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        self.refined = 0
        n, cells = len(entries), 1 << bits
        least = entries.min(axis=0)
        reach = entries.max(axis=0) - least + 1
        self.cell = ((entries - least) * cells // reach).astype(np.int64) if n else np.zeros(entries.shape, np.int64)
        mark = np.arange(cells + 1)
        if entries.dtype == object:
            mark = mark.astype(object)
        ends = least[:, None] - (-(mark[None, :] * reach[:, None]) // cells)  # the first integer of each cell
        self.low, self.high = ends[:, :-1], ends[:, 1:] - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the squared distance of every row of x to every entry, from the lookup tables."""
        shape = (len(x), len(self.entries))
        low, high = np.zeros(shape, x.dtype), np.zeros(shape, x.dtype)
        for j in range(x.shape[1]):
            to_low, to_high = self.low[j][None, :] - x[:, j : j + 1], x[:, j : j + 1] - self.high[j][None, :]
            near = np.maximum(np.maximum(to_low, to_high), 0)
            far = np.maximum(np.abs(to_low), np.abs(to_high))
            low += (near * near)[:, self.cell[:, j]]
            high += (far * far)[:, self.cell[:, j]]
        return low, high

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (the lowest of equal ones) and its squared distance."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, x.dtype)
        low, high = self.bounds(x)
        rows, some = np.nonzero(low <= high.min(axis=1, keepdims=True))  # by row, entries ascending; at least one a row
        self.refined += len(rows)
        apart = x[rows] - self.entries[some]
        exact = (apart * apart).sum(axis=1) if x.shape[1] else np.zeros(len(rows), x.dtype)
        first = np.searchsorted(rows, np.arange(len(x)))
        best = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == best[rows])
        return some[hit[np.searchsorted(rows[hit], np.arange(len(x)))]], best


def integers(vectors: list, width: int, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale * x), filled up with zeros to the width; Python integers if any is beyond WIDE."""
    x = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    exact = np.abs(x).max(initial=0.0) < WIDE
    x = np.floor(x * scale) if exact else x
    if exact:
        return x.astype(np.int64)
    return np.array([[int(np.floor(c * scale)) if abs(c) < 1e300 else int(c) * scale for c in row] for row in x.tolist()], object).reshape(x.shape)


def _like(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a, b) if a.dtype == b.dtype else (a.astype(object), b.astype(object))


def assign(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and the squared distances summed over the parts."""
    parts, _, wide = books.entries.shape
    x, entries = _like(x, books.entries)
    codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), x.dtype)
    for p in range(parts):
        codes[:, p], d = Cells(entries[p]).nearest(x[:, p * wide : (p + 1) * wide])
        error = error + d
    return codes, error


def _sums(books: Codebooks):
    """Rows of vectors to (slot, limb, n, value): how many vectors each entry has and the sums of their components, a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, wide = books.entries.shape
        sums, counts = np.zeros((parts, entries, wide), object), np.zeros((parts, entries), np.int64)
        for batch in small(batches):
            x = integers(batch.column(0).to_pylist(), parts * wide)
            codes, _ = assign(x, books)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                mine = np.zeros((entries, wide), x.dtype)
                np.add.at(mine, codes[:, p], x[:, p * wide : (p + 1) * wide])
                sums[p] += mine.astype(object)
        rows = []
        for slot in np.flatnonzero(np.repeat(counts.ravel(), wide)).tolist():
            total, limb = int(sums.flat[slot]), 0
            sign, left = (-1 if total < 0 else 1), abs(total)
            while left or not limb:
                rows.append((slot, limb, int(counts.flat[slot // wide]), sign * (left & ((1 << LIMB) - 1))))
                left, limb = left >> LIMB, limb + 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["slot", "limb", "n", "value"])

    return run


def kept(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and has no null or non-finite component."""
    fine = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.col(embedding).isNotNull() & fine)


def train(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from the kept rows (see `kept`), None if there are none.

    Each starts as the parts of the rows of least key (nulls last, equal keys by their vectors; fewer rows give fewer
    entries). A round assigns every row's parts and replaces each entry by the floor of its parts' mean; entries without
    parts stay. Vectors of several lengths are filled up with zeros to the longest, and to a multiple of the parts.
    """
    widest = vectors.agg(F.max(F.size(embedding))).first()[0]
    if widest is None:
        return None
    wide = -(-widest // parts)
    first = [r[0] for r in vectors.orderBy(F.col(key).asc_nulls_last(), embedding).select(embedding).limit(entries).collect()]
    books = Codebooks(integers(first, parts * wide).reshape(len(first), parts, wide).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = vectors.select(F.col(embedding).cast("array<double>").alias("v")).mapInArrow(_sums(books), "slot long, limb int, n long, value decimal(38,0)")
        new, found = books.entries.astype(object).ravel(), {}
        for r in sums.groupBy("slot", "limb").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
            n, total = found.get(r.slot, (0, 0))
            found[r.slot] = (r.n if r.limb == 0 else n, total + (int(r.value) << (LIMB * r.limb)))
        for slot, (n, total) in found.items():
            new[slot] = total // n
        fits = all(abs(x) < WIDE * SCALE for x in new)
        books = Codebooks((new.astype(np.int64) if fits else new).reshape(books.entries.shape))
    return books


def with_codes(vectors: DataFrame, books: Codebooks, embedding: str = "embedding") -> DataFrame:
    """vectors' other columns with code (two hex digits a part) and error (null if it is beyond 64 bits)."""
    others = [c for c in vectors.columns if c != embedding]
    parts, _, wide = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n = batch.num_columns - 1
            codes, error = assign(integers(batch.column(n).to_pylist(), parts * wide), books)
            text = codes.astype(np.uint8).tobytes().hex()
            code = [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(codes))]
            arrays = [pa.array(code, pa.string()), pa.array([int(e) if e < 1 << 63 else None for e in error.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=[*batch.schema.names[:n], "code", "error"])

    rows = vectors.select(*others, F.col(embedding).cast("array<double>").alias(embedding))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.drop(embedding).dtypes)
    return rows.mapInArrow(run, f"{kinds}, code string, error long")


def code_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) a kept row of vectors (vec_id, embedding, label).

    Rows whose vector is null or has a null or non-finite component go; see `train` for ties, lengths and few rows. Rows
    that repeat a vec_id stay. label_error adds up error over rows of the same label, null being one (null if the sum, or
    one of the errors, is beyond 64 bits). Vectors are read once a round and twice more; no copy of them is written.
    """
    bound_batches(vectors.sparkSession)
    rows = kept(vectors.select("vec_id", "label", "embedding"))
    books = train(rows)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    label = F.concat(F.col("label").isNull().cast("string"), F.coalesce(F.col("label").cast("string"), F.lit("")))
    coded = staged(with_codes(rows, books).withColumn("label", label), "codes")
    whole = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = staged(coded.groupBy("label").agg(whole.try_cast("long").alias("label_error"), F.count("*").alias("w")), "errors")
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = coded.join(F.broadcast(sums.drop("w")), "label", "left") if few else join_salted(coded, sums, "label", "w", coded.count(), "code")
    out = staged(joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), "coded")
    unstage(coded)
    unstage(sums)
    return out


def _round(n: int) -> str:
    """The rows' nearest entries under codebook n, and codebook n + 1."""
    return f"""
a{n} as (select r, p, arg_min(e, d * 64 + e) as e, min(d) as d from (select x.r, x.p, c.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) as d from x join c{n} c using (p)) group by r, p)"""


def _next(n: int) -> str:
    return f"""
m{n} as (select p, e, list(s order by i) as v from (select p, e, i, cast(floor(sum(v[i]) / cast(count(*) as double)) as bigint) as s from (select x.p, a.e, x.v, unnest(range(1, len(x.v) + 1)) as i from x join a{n} a using (r, p)) group by p, e, i) group by p, e),
c{n + 1} as (select p, e, coalesce(m{n}.v, c{n}.v) as v from c{n} left join m{n} using (p, e))"""


#: The same by DuckDB: every entry compared with every part.
ORACLE = f"""
with k as (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as w from embeddings
    where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
x as materialized (select r, p, w[p * (len(w) // 16) + 1 : (p + 1) * (len(w) // 16)] as v from (select r, w, unnest(range(16)) as p from k)),
c0 as (select p, r - 1 as e, v from x where r <= 64),{_round(0)},{_next(0)},{_round(1)},{_next(1)},{_round(2)},
codes as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a2 group by r),
books as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from c2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join codes using (r), books
"""
