"""Benchmark decontamination by a prefix-filtered set join that is verified over item-sized windows.

A benchmark window (10 consecutive item words, or a shorter item whole) is the set of its word shingles. A text
contains it only if it has all of them, so the necessary prefix under the order "rarest first" is a single shingle:
the window's rarest by document frequency over the corpus. Texts are searched for those prefix shingles alone; a match
at one place fixes where the window must start, which the length and the position in the text must allow; the words
there are then compared exactly. A window that many items share is one window with a list of items.

Texts are read twice (frequencies, search) and never shuffled. The benchmark is cut into blocks of BLOCK_BYTES of text,
each a broadcast of its own; a task goes through all of them, and its worker keeps the first KEEP.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_batches, in_chunks, mix, private, small, staged, unstage, with_struct

#: Bytes below 0x80 that are no letters or digits once A-Z are lower-cased (A-Z hash as a-z, so they count as letters).
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Bytes of benchmark text whose index is a broadcast (some nine bytes a byte), and the blocks that a worker keeps; others
#: are loaded again for each MANY rows.
BLOCK_BYTES, KEEP, MANY = 8 << 20, 8, 20_000
WINDOW, SHINGLE = 10, 5
FIELDS = "n_words long, hits array<int>, items array<string>"


def runs_of(hashes: np.ndarray, owner: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Where w consecutive words of one text begin, and the hash of those words."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[w - 1 :])
    out = hashes[at]
    for j in range(1, w):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407) + hashes[at + j]
    return at, mix(out + np.uint64(w))


class Block:
    """The distinct windows of some benchmark items, the items of each, and the shingles in them."""

    def __init__(self, rows: list[tuple], window: int, shingle: int):
        self.ids = [None if i is None else str(i) for i, _ in rows]
        texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
        self.buffer, self.starts, self.ends, self.hashes, bounds = Words(SEPARATORS).of_texts(texts)
        n = np.diff(bounds)
        # one row a window: its item, its first word (among all words of the block) and its length
        item = np.repeat(np.arange(len(rows)), np.where(n > 0, np.maximum(n - window + 1, 1), 0))
        size = np.minimum(n, window)
        first = np.concatenate([np.arange(bounds[i], bounds[i + 1] - size[i] + 1) for i in range(len(rows)) if n[i]] + [np.empty(0, np.int64)]).astype(np.int64)
        size = size[item]
        # windows of the same words become one: same is a number for each
        same, step = size.astype(np.uint64), np.arange(window)
        last = np.minimum(first[:, None] + step, max(len(self.hashes) - 1, 0))
        words = np.where(step < size[:, None], self.hashes[last] if len(self.hashes) else np.zeros(last.shape, np.uint64), np.uint64(0))
        for j in range(window):
            same = mix(same ^ words[:, j])
        order = np.argsort(same, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1) | (size[order[1:]] != size[order[:-1]])
        which = np.cumsum(new) - 1
        pair = np.unique(np.stack([which, item[order]]), axis=1)  # (window, item)
        self.items, self.item_of = pair[1].astype(np.int32), np.searchsorted(pair[0], np.arange((which[-1] + 1 if len(which) else 0) + 1))
        self.first, self.size = first[order[new]], size[order[new]]
        self.width = np.minimum(self.size, shingle)  # of the window's shingles
        self.shingles = {}
        owner = np.repeat(np.arange(len(rows)), n)
        for w in np.unique(self.width):
            at, h = runs_of(self.hashes, owner, int(w))
            all_at = np.zeros(len(self.hashes) + 1, np.uint64)
            all_at[at] = h
            self.shingles[int(w)] = all_at
        self.wanted = np.unique(np.concatenate([self.of_windows(w)[0].ravel() for w in self.shingles] + [np.empty(0, np.uint64)]))

    def of_windows(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of the windows whose shingles are w words, one row a window, which of them are real, and the windows."""
        mine = np.flatnonzero(self.width == w)
        step = np.arange(int(self.size[mine].max()) - w + 1)
        real = step <= (self.size[mine] - w)[:, None]
        return self.shingles[w][np.where(real, self.first[mine][:, None] + step, self.first[mine][:, None])], real, mine

    def rank(self, known: np.ndarray, df: np.ndarray) -> None:
        """Choose each window's rarest shingle: its prefix. known is sorted; df are document frequencies."""
        key, offset = np.empty(len(self.first), np.uint64), np.empty(len(self.first), np.int64)
        for w in self.shingles:
            h, real, mine = self.of_windows(w)
            i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            f = np.where(known[i] == h, df[i], 0) if len(known) else np.zeros(h.shape, np.int64)
            f = np.where(real, f, np.iinfo(np.int64).max)
            least = np.where(f == f.min(axis=1, keepdims=True), h, np.uint64(0xFFFFFFFFFFFFFFFF))  # ties go to the least hash
            best = np.where(real, least, np.uint64(0xFFFFFFFFFFFFFFFF)).argmin(axis=1)
            key[mine], offset[mine] = h[np.arange(len(mine)), best], best
        order = np.argsort(key, kind="stable")
        self.key, self.offset, self.window = key[order], offset[order].astype(np.uint8), order
        self.shingles, self.wanted = {w: None for w in self.shingles}, None

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]].tobytes().lower()

    def names(self, windows: set[int]) -> set[str]:
        """Ids of the items that have any of the windows."""
        if not windows:
            return set()
        items = np.unique(np.concatenate([self.items[self.item_of[x] : self.item_of[x + 1]] for x in windows]))
        return {name for i in items.tolist() if (name := self.ids[i]) is not None}


def opened(blocks: list[Broadcast]) -> Iterator[Block]:
    """The blocks one after another; a worker keeps the first KEEP."""
    for i, x in enumerate(blocks):
        yield x.value
        if i >= KEEP and getattr(x, "_path", None):
            x.__dict__.pop("_value", None)


def _counts(blocks: list[Broadcast], rows: int):
    """Texts to (block, shingle, df): how many texts of the task hold a shingle of the block's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, totals = Words(SEPARATORS), [np.zeros(0, np.int64)] * len(blocks)
        for batch in small(batches, rows):
            texts = batch.column(0).to_pylist()
            for b, block in enumerate(opened(blocks)):
                total = totals[b] = totals[b] if len(totals[b]) else np.zeros(len(block.wanted), np.int64)
                for _, chunk in in_chunks(texts):
                    _, _, _, hashes, bounds = words.of_texts(chunk)
                    owner = np.repeat(np.arange(len(chunk)), np.diff(bounds))
                    for w in block.shingles:
                        at, h = runs_of(hashes, owner, w)
                        i = np.minimum(np.searchsorted(block.wanted, h), max(len(block.wanted) - 1, 0))
                        hit = np.flatnonzero(block.wanted[i] == h) if len(block.wanted) else at[:0]
                        total += np.bincount(np.unique(owner[at[hit]] * len(total) + i[hit]) % max(len(total), 1), minlength=len(total))
        for b, total in enumerate(totals):
            some = np.flatnonzero(total)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), b, np.int32)), pa.array(blocks[b].value.wanted[some].view(np.int64)), pa.array(total[some])], names=["block", "shingle", "df"])

    return run


def _search(block: Block, words: Words, chunk: list[bytes], hits: list[list[int]], items: list[set]) -> np.ndarray:
    """Add a chunk's hit spans and item ids by text; gives each text's number of words."""
    buffer, starts, ends, hashes, bounds = words.of_texts(chunk)
    owner = np.repeat(np.arange(len(chunk)), np.diff(bounds))
    found: dict[int, set[int]] = {}
    for w in block.shingles:
        at, h = runs_of(hashes, owner, w)
        lo = np.searchsorted(block.key, h)
        some = np.flatnonzero(block.key[np.minimum(lo, max(len(block.key) - 1, 0))] == h) if len(block.key) else at[:0]
        if not len(some):
            continue
        lo, n = lo[some], np.searchsorted(block.key, h[some], "right") - lo[some]
        place = np.repeat(at[some], n)
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        x, begin, doc = block.window[entry], place - block.offset[entry], owner[place]
        fits = (block.width[x] == w) & (begin >= bounds[doc]) & (begin + block.size[x] <= bounds[doc + 1])
        x, begin, doc = x[fits], begin[fits], doc[fits]
        for size in np.unique(block.size[x]):
            mine = np.flatnonzero(block.size[x] == size)
            step = np.arange(size)
            same = (hashes[begin[mine][:, None] + step] == block.hashes[block.first[x[mine]][:, None] + step]).all(axis=1)
            for j in mine[same]:
                b, f = int(begin[j]), int(block.first[x[j]])
                if all(buffer[starts[b + s] : ends[b + s]].tobytes().lower() == block.word(f + s) for s in range(size)):
                    d = int(doc[j])
                    hits[d] += (b - int(bounds[d]), b - int(bounds[d]) + int(size))
                    found.setdefault(d, set()).add(int(x[j]))
    for d, windows in found.items():
        items[d] |= block.names(windows)
    return np.diff(bounds)


def _find(blocks: list[Broadcast]):
    """A task's function: texts to words, hit spans and item ids by text."""

    def make():
        words = Words(SEPARATORS)

        def of(texts: list) -> list[list]:
            counts, hits, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for block in opened(blocks):
                for at, chunk in in_chunks(texts):
                    to = at + len(chunk)
                    counts[at:to] = _search(block, words, chunk, hits[at:to], part := items[at:to]).tolist()
                    items[at:to] = part
            return [counts, [merged(h) for h in hits], [sorted(i) for i in items]]

        return of

    return make


def merged(spans: list[int]) -> list[int]:
    """Sorted, disjoint spans (start, end, start, end ...) with the same union."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += (s, e)
    return out


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, name: str = "__found") -> DataFrame:
    """docs with a struct column `name`: n_words, hits (disjoint spans of hit words: start, end, ...) and items (ids, sorted).

    Words are runs of digits, letters and all characters beyond ASCII, with A-Z lower-cased. A text word is hit if it
    lies in any occurrence of a window. Null and empty texts have no words and no hits; items without words are in
    nothing; an item without an id hits words but isn't listed; rows that repeat an item count once. Empty tables give
    empty results.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("t")).where(F.col("t").isNotNull())
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    rows = 1000 if n <= KEEP else MANY
    bound_batches(spark, rows)

    if n > 1:  # written by block, so that each block is read once
        items = staged(items.withColumn("block", F.pmod(F.xxhash64("item", "t"), F.lit(n)).cast("int")).repartition("block"), "items", by="block")

    def shared(b: int) -> Block:
        part = items.where(F.col("block") == b) if n > 1 else items
        return Block([(r.item, r.t) for r in part.collect()], window, shingle)  # at most about block_bytes

    plain = [spark.sparkContext.broadcast(shared(b)) for b in range(n)]
    counts = docs.select("text").mapInArrow(_counts(plain, rows), "block int, shingle long, df long").groupBy("block", "shingle").agg(F.sum("df").alias("df"))
    counts = staged(counts.repartition("block"), "frequencies", by="block") if n > 1 else staged(counts, "frequencies")
    ranked = []
    for b in range(n):
        df = counts.where(F.col("block") == b).toArrow()  # at most the block's shingles
        known = df.column("shingle").to_numpy().view(np.uint64)
        order = np.argsort(known)
        block = plain[b].value
        block.rank(known[order], df.column("df").to_numpy()[order])
        ranked.append(spark.sparkContext.broadcast(block))
        plain[b].__dict__.pop("_value", None)
        plain[b].destroy()
        del block
    unstage(counts)
    if n > 1:
        unstage(items)
    return with_struct(docs, name, FIELDS, [F.col("text")], _find(ranked), rows)


def n_hit(found: str = "__found"):
    """Number of hit words of a marked row."""
    signed = F.transform(F.col(f"{found}.hits"), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) a row of docs; see mark_contamination."""
    found = mark_contamination(docs.select("doc_id", "text"), benchmark, **options)
    items = F.col("__found.items")
    return found.select("doc_id", F.col("__found.n_words").alias("n_words"), n_hit().alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows in which any benchmark window occurs."""
    name = private(docs, "found")[0]
    return mark_contamination(docs, benchmark, name=name, **options).where(F.size(f"{name}.hits") == 0).select(*docs.columns)
