"""N-gram Jaccard join by T-occurrence search (heap merge of short lists, binary probes of long ones: DivideSkip).

1. A pass over the texts hashes every document's set of word shingles. A segment of documents sends each distinct token
   once, with its count, to the token's bucket of the inverted index; which documents hold it stays with the segment. So
   a token of any number of documents is one entry a segment, and the number of buckets grows with the text.
2. A bucket adds up frequencies and says which tokens are shared. Others can't be in any intersection. In the order
   "rarest first" the prefix filter needs |x| - ceil(t|x|) + 1 tokens of a document; its unshared tokens come first, so
   most documents need none and leave the search.
3. Star round: each document is held against one other that shares the most prefix tokens with it. Most near copies are
   linked by that, and a large group of them costs one comparison a document.
4. The other documents lie in chunks, an inverted index each. A document asks a chunk only if a prefix token is in both
   and in different components, and sizes allow a link. Chunks are of bounded size, those asked by many are repeated.
5. Components of the links are the result. Classes of equal sets are known by 128-bit signatures; a link is an exact
   count of common 64-bit tokens.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_batches, connected_components, in_chunks, join_salted, join_small, private, shingles, small, staged, unstage

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
#: Documents in the index of a chunk, about, and the least of them; a chunk asked by more than ASKED times as many is searched by several tasks.
CHUNK, LEAST, ASKED = 1000, 250, 4
#: Tokens that a task gathers before it sends a segment, and bytes of text a bucket of the index should stand for.
SEGMENT, BUCKET_BYTES = 700_000, 4 << 20
#: Bits of a token beside its bucket's.
REST = 44
DOCUMENT = np.dtype([("known", "u1"), ("id", "<i8"), ("hash", "<i8"), ("n", "<i8"), ("sig", "V16")])


def bits_for(size: int) -> int:
    """log2 of the number of buckets for so many bytes of text."""
    return min(20, max(5, math.ceil(math.log2(max(size, 1) / BUCKET_BYTES))))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def _numbers(x: np.ndarray) -> bytes:
    """Counts, a byte each if they all fit, else four."""
    kind = "<u1" if not len(x) or x.max() < 256 else "<u4"
    return kind[-1].encode() + x.astype(kind).tobytes()


def _of_numbers(raw: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    width = int(bytes(raw[:1]))
    return np.frombuffer(raw, f"<u{width}", n, 1).astype(np.int64), raw[1 + width * n :]


def _six(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def _of_six(raw: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32), raw[6 * n :]


def _segments(k: int, bits: int, segment: int):
    """Texts to rows (bucket, seg, payload): a segment's distinct tokens by bucket, and a row of its own in a bucket below 0."""
    schema = pa.schema([("bucket", pa.int64()), ("seg", pa.int64()), ("payload", pa.binary())])
    words = Words(SEPARATORS)

    def flush(seg: int, docs: list[tuple], sets: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate([*sets, np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])[order]
        every = every[order]
        new = np.concatenate((np.ones(min(len(every), 1), bool), every[1:] != every[:-1]))
        first = np.flatnonzero(new)
        token, count = every[first], np.diff(np.append(first, len(every)))
        bucket = token >> np.uint64(64 - bits)
        # in a bucket by their first documents, whose numbers then pack well; further documents of a token are listed
        order = np.argsort(bucket << np.uint64(16) | owner[first], kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        step = np.diff(owner[first][order], prepend=np.uint16(0))
        again = np.flatnonzero(~new)
        edge = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64))
        rest, count = (token[order] << np.uint64(bits)) >> np.uint64(64 - REST), count[order]
        head = np.array([len(docs), len(token), len(again)], "<i8").tobytes()
        listed = place[np.cumsum(new)[again] - 1].astype("<u4").tobytes() + owner[again].astype("<u2").tobytes()
        home = b"".join((head, np.array(docs, DOCUMENT).tobytes(), (step & 0xFF).astype(np.uint8).tobytes(), (step >> 8).astype(np.uint8).tobytes(), listed))
        rows = [(-1 - xxhash.xxh64_intdigest(seg.to_bytes(8, "little")) % (1 << bits), seg, home)]
        for b in np.flatnonzero(np.diff(edge)).tolist():
            lo, hi = edge[b], edge[b + 1]
            rows.append((b, seg, np.int64(hi - lo).tobytes() + _numbers(count[lo:hi]) + _six(rest[lo:hi])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        docs, sets, seen, held = [], [], set(), 0
        nothing = np.empty(0, np.uint64)
        for batch in small(batches):
            ids, marks, texts = (c.to_pylist() for c in batch.columns)
            for at, chunk in in_chunks(texts):
                _, _, _, hashes, bounds = words.of_texts(chunk)
                for i in range(len(chunk)):
                    s = np.unique(shingles(hashes[bounds[i] : bounds[i + 1]], k))
                    sig = xxhash.xxh3_128_digest(s.tobytes())
                    docs.append((ids[at + i] is not None, ids[at + i] or 0, marks[at + i], len(s), sig))
                    sets.append(nothing if sig in seen else s)  # a copy in the same segment needn't send its tokens again
                    seen.add(sig)
                    held += len(sets[-1])
                    if held >= segment or len(docs) >= 65_000:
                        yield flush((part << 24) + n, docs, sets)
                        n += 1
                        docs, sets, seen, held = [], [], set(), 0
        if docs:
            yield flush((part << 24) + n, docs, sets)

    return run


def _count(table: pa.Table) -> pa.Table:
    """One bucket of the inverted index: which tokens of each segment are in several documents, and in how many."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table.select(["seg", "bucket", "payload"])
    segs, parts = table.column("seg").to_pylist(), []
    for p in table.column("payload").to_pylist():
        n = int(np.frombuffer(p, "<i8", 1)[0])
        count, raw = _of_numbers(memoryview(p)[8:], n)
        parts.append((_of_six(raw, n)[0], count))
    every, counts = np.concatenate([t for t, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(every, kind="stable")
    held = every[order]
    at = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    df = np.add.reduceat(counts[order], at)
    shared, df = held[at[df > 1]], df[df > 1]
    out = []
    for tokens, _ in parts:
        i = np.minimum(np.searchsorted(shared, tokens), max(len(shared) - 1, 0))
        hit = shared[i] == tokens if len(shared) else np.zeros(len(tokens), bool)
        out.append(np.array([len(tokens), hit.sum()], "<i8").tobytes() + np.packbits(hit).tobytes() + _six(tokens[hit]) + (df[i[hit]].astype("<i8").tobytes() if hit.any() else b""))
    return pa.table({"seg": pa.array(segs, pa.int64()), "bucket": pa.array([bucket] * len(segs), pa.int64()), "payload": pa.array(out, pa.binary())})


def _documents(percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        """One segment: its documents with their shared tokens, rarest first, and the prefix that the filter needs."""
        hits, tokens, dfs, home = [], [], [], b""
        for bucket, payload in sorted(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True)):
            if bucket < 0:
                home = memoryview(payload)
                continue
            n, m = np.frombuffer(payload, "<i8", 2).tolist()
            raw = memoryview(payload)[16:]
            hits.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8)), count=n).astype(bool))
            rest, raw = _of_six(raw[-(-n // 8) :], m)
            tokens.append(np.uint64(bucket) << np.uint64(REST) | rest)
            dfs.append(np.frombuffer(raw, "<i8", m))
        n_docs, n_tokens, n_more = np.frombuffer(home, "<i8", 3).tolist()
        docs = np.frombuffer(home, DOCUMENT, n_docs, 24)
        raw = home[24 + DOCUMENT.itemsize * n_docs :]
        packed: list = [None] * n_docs
        prefix: list = [None] * n_docs
        if n_tokens:
            hit, token, df = np.concatenate(hits), np.concatenate(tokens), np.concatenate(dfs)
            step = np.frombuffer(raw, np.uint8, n_tokens).astype(np.uint16) | np.frombuffer(raw, np.uint8, n_tokens, n_tokens).astype(np.uint16) << np.uint16(8)
            owner = np.cumsum(step, dtype=np.uint16)[hit]
            more = (np.cumsum(hit) - 1)[np.frombuffer(raw, "<u4", n_more, 2 * n_tokens)]  # a token of several documents is shared
            owner = np.concatenate([owner, np.frombuffer(raw, "<u2", n_more, 2 * n_tokens + 4 * n_more)])
            token, df = np.concatenate([token, token[more]]), np.concatenate([df, df[more]])
            order = np.lexsort((token, df, owner))
            owner, token = owner[order], token[order]
            edge = np.searchsorted(owner, np.arange(n_docs + 1))
            need = prefix_length(docs["n"], percent)
            for i in range(n_docs):
                mine = token[edge[i] : edge[i + 1]]
                p = int(need[i] - (docs["n"][i] - len(mine)))
                if p > 0 and len(mine):
                    packed[i], prefix[i] = mine.tobytes(), mine[:p].view(np.int64)
        ids = pa.array([d if known else None for d, known in zip(docs["id"].tolist(), docs["known"].tolist(), strict=True)], pa.int64())
        sigs = pa.array([s.tobytes() if n else None for s, n in zip(docs["sig"], docs["n"].tolist(), strict=True)], pa.binary())
        return pa.table([ids, pa.array(docs["hash"]), pa.array(docs["n"]), sigs, pa.array(packed, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], schema=schema)

    return run


def heap_merge(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(member, count) of the members of at least `least` of the sorted lists: a heap of the lists' heads.

    Of a member in too few lists the least - 1 smallest heads go, and all of them leap to the next head left.
    """
    place = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        top, gone = heap[0][0], []
        while heap and heap[0][0] == top:
            gone.append(heapq.heappop(heap)[1])
        if len(gone) >= least:
            out.append((top, len(gone)))
            goal = top + 1
        else:
            while heap and len(gone) < least - 1:
                gone.append(heapq.heappop(heap)[1])
            if not heap:
                break
            goal = heap[0][0]
        for i in gone:
            place[i] = bisect_left(lists[i], goal, place[i])
            if place[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][place[i]], i))
    return out


class Lists:
    """Inverted lists over documents by rising size (sizes count tokens that no other document has, too), each of a group.

    Documents of one group are known to be connected, so only those of other groups are searched for.
    """

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], groups: np.ndarray):
        self.sizes, self.groups = np.asarray(sizes, np.int64), np.asarray(groups, np.int64)
        every = np.concatenate([*sets, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.lexsort((owner, every))
        every, self.members = every[order], owner[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(every), 1), bool), every[1:] != every[:-1])))
        self.tokens, self.start = every[first], np.append(first, len(every))

    def search(self, size: int, tokens: np.ndarray, group: int, percent: int, before: int | None = None) -> Iterator[tuple[int, int]]:
        """(document, overlap) of every document of another group, no larger than this one, with 100 |x & y| >= percent |x | y|.

        Only documents before a place count, if one is given.
        """
        low = -(-percent * size // 100)
        lo, hi = int(np.searchsorted(self.sizes, low)), int(np.searchsorted(self.sizes, size, "right"))
        hi = hi if before is None else min(hi, before)
        least = -(-percent * (size + low) // (100 + percent))  # T: the overlap with the smallest document allowed
        if lo >= hi or len(tokens) < least or not len(self.tokens):
            return
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        length = self.start[at + 1] - self.start[at]
        if len(at) < least:
            return
        end = np.cumsum(length)
        members = self.members[np.repeat(self.start[at] - end + length, length) + np.arange(end[-1])]
        keep = (members >= lo) & (members < hi) & (self.groups[members] != group)
        length = np.bincount(np.repeat(np.arange(len(at)), length)[keep], minlength=len(at))
        used = int(np.count_nonzero(length))
        if used < least:
            return
        flat, end = members[keep].tolist(), np.cumsum(length).tolist()
        lists = sorted((flat[e - n : e] for e, n in zip(end, length.tolist(), strict=True) if n), key=len)
        # The rule of DivideSkip for the number of long lists; never so many that the merge could miss a result.
        far = min(least - 1, int(least / (0.0085 * math.log2(len(lists[-1]) + 1) + 1)), used - 1)
        long = lists[used - far :]
        for y, overlap in heap_merge(lists[: used - far], least - far):
            need = -(-percent * (size + int(self.sizes[y])) // (100 + percent))
            for left, x in zip(range(len(long), 0, -1), long, strict=True):
                if overlap + left < need:
                    break
                i = bisect_left(x, y)
                overlap += i < len(x) and x[i] == y
            if overlap >= need:
                yield y, overlap


def t_occurrence(sizes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of {100 |x & y| >= percent |x | y|} over the sets given by rising size."""
    lists, root, links = Lists(np.array(sizes), sets, np.arange(len(sets))), list(range(len(sets))), []
    for x in range(len(sets)):
        for y, _ in lists.search(int(sizes[x]), sets[x], x, percent, before=x):
            if (a := _root(root, x)) != (b := _root(root, y)):
                root[a] = b
                links.append((x, y))
    return links


def _root(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _search(percent: int):
    """A search task: rows with side 0 make the index, rows with side 1 ask it; links of a spanning forest come out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, n, side, group = (table.column(c).to_numpy() for c in ("id", "n", "side", "comp"))
        tokens = table.column("tokens").to_pylist()
        numbers, groups = np.unique(group, return_inverse=True)
        order = np.lexsort((ids, n))
        index = order[side[order] == 0]
        lists = Lists(n[index], [np.frombuffer(tokens[i], np.uint64) for i in index], groups[index])
        root, found = list(range(len(numbers))), []
        for i in order[side[order] == 1].tolist():
            for y, _ in lists.search(int(n[i]), np.frombuffer(tokens[i], np.uint64), int(groups[i]), percent):
                if (a := _root(root, int(groups[i]))) != (b := _root(root, int(groups[index[y]]))):
                    root[a] = b
                    found.append((ids[i], ids[index[y]]))
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

    return run


def _partitions(spark, wanted: int = 0) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(wanted, 1 << 20))


def _links(tasks: DataFrame, members: DataFrame, percent: int, wanted: int) -> DataFrame:
    """Links of search tasks (task, side, id, n, comp), to which only here the members' tokens come.

    Few bytes but long work: partitions that AQE doesn't merge.
    """
    tasks = staged(tasks, "tasks")
    rows = join_small(members.select("id", "tokens"), tasks, "id", "inner")
    links = rows.repartition(_partitions(tasks.sparkSession, wanted), "task").groupBy("task").applyInArrow(_search(percent), "a long, b long")
    out = staged(links, "links")
    unstage(tasks)
    return out


def star_tasks(sizes: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, hub): for each member the document that is the hub of the most of its prefix tokens; and the search tasks, from sizes (id, n).

    A token's hub is the document that holds it and has the fewest tokens of its own: of near copies, the one that the
    others were made from. Any choice is right: hubs only spare the search that follows. A hub of many members is in
    several tasks.
    """
    hubs = staged(prefixes.groupBy("token").agg(F.min(F.struct("lone", "id")).alias("hub"), F.count("*").alias("df")).where("df > 1"), "hubs")
    votes = join_salted(prefixes.select("id", "token"), hubs, "token", "df", prefixes.count(), "id").where(F.col("hub").isNotNull()).groupBy("id", "hub").agg(F.count("*").alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", -F.col("hub.lone"), F.col("hub.id").alias("hub"))).getField("hub").alias("hub"))
    chosen = staged(best, "stars")
    unstage(hubs)
    stars = chosen.where("id <> hub")
    of = stars.groupBy("hub").agg(F.count("*").alias("of"), F.ceil(F.count("*") / LEAST).cast("int").alias("k"))
    hub = staged(sizes.select(F.col("id").alias("hub"), F.col("n").alias("hub_n")).join(of, "hub"), "hubs")
    dealt = join_salted(sizes.join(stars, "id"), hub, "hub", "of", stars.count(), "id")
    # The larger side asks: members no smaller than the hub ask it (up), and it asks the others.
    part, up = F.pmod(F.xxhash64("id"), F.col("k")).cast("int"), F.col("n") >= F.col("hub_n")
    rows = dealt.select("hub", part.alias("part"), up.alias("up"), up.cast("int").alias("side"), "id", "n")
    centre = hub.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("up", F.explode(F.array(F.lit(True), F.lit(False))))
    centre = centre.select("hub", "part", "up", (~F.col("up")).cast("int").alias("side"), F.col("hub").alias("id"), F.col("hub_n").alias("n"))
    return chosen, rows.unionByName(centre).select(F.xxhash64("hub", "part", "up").alias("task"), "side", "id", "n", F.col("id").alias("comp"))


def cross_tasks(prefixes: DataFrame, placed: DataFrame, chunk: int) -> DataFrame:
    """Search tasks for all links between members of different components, from placed (id, n, comp, chunk).

    A token of one component alone asks nothing. Else each member that holds it asks the chunks in which it is held by
    another component and by sizes that may link; members ask a chunk once, whatever tokens lead there.
    """
    held = staged(prefixes.select("id", "token").join(placed, "id"), "held")
    mixed = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("token", "df", F.lit(True).alias("mixed"))
    some = staged(join_salted(held, mixed, "token", "df", held.count(), "id").where("mixed").drop("mixed"), "mixed")
    unstage(held)
    by_chunk = some.groupBy("token", "chunk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"))
    asks = some.select("token", "id", "n", "comp").join(by_chunk, "token")
    asks = staged(asks.where(((F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))) & (F.col("least") <= F.col("n"))).select("id", "n", "comp", "chunk").distinct(), "asks")
    parts = staged(asks.groupBy("chunk").agg(F.ceil(F.count("*") / (ASKED * chunk)).cast("int").alias("k")), "parts")
    asking = join_small(asks, parts.where("k > 1"), "chunk").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1))).cast("int"))
    # Only members that hold a mixed token can be found.
    index = some.select("id", "n", "comp", "chunk").distinct().join(parts, "chunk").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = [x.select(F.xxhash64("chunk", "part").alias("task"), F.lit(side).alias("side"), "id", "n", "comp") for side, x in ((1, asking), (0, index))]
    return rows[0].unionByName(rows[1])


def labelled(docs: DataFrame, k: int, percent: int, chunk: int = CHUNK, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, sig) of every row, and (sig, component) of the classes of equal sets that link with others.

    mark is a hash of the text. See jaccard_components.
    """
    spark = bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(size)
    segment = max(segment, 16 << bits if bits > 15 else 0)
    sent = rows.mapInArrow(_segments(k, bits, segment), "bucket long, seg long, payload binary")
    shared = sent.repartition(_partitions(spark, 1 << bits), "bucket").groupBy("bucket").applyInArrow(_count, "seg long, bucket long, payload binary")
    home = shared.repartition(_partitions(spark, size // (6 * segment)), "seg").groupBy("seg")
    table = staged(home.applyInArrow(_documents(percent), "doc_id long, mark long, n long, sig binary, tokens binary, prefix array<long>"), "sets")

    # One member a class, under a number that stays as it is written.
    one = table.where(F.col("prefix").isNotNull()).groupBy("sig").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix"))
    members = staged(one.withColumn("id", F.monotonically_increasing_id()), "members")
    lone = (F.col("n") - F.octet_length("tokens") / 8).cast("long")
    prefixes = staged(members.select("id", lone.alias("lone"), F.explode("prefix").alias("token")), "prefixes")
    total = members.count()
    chunk = min(chunk, max(LEAST, total // _partitions(spark))) if chunk == CHUNK else chunk
    wanted = -(-2 * total // chunk)
    chosen, stars = star_tasks(members.select("id", "n"), prefixes)
    links = _links(stars, members, percent, wanted)
    near = connected_components(links).select(F.col("node").alias("id"), "component")
    # Neighbours lie in the same chunk: a component, or a hub's documents, fill whole chunks or share one with others.
    known = members.select("id", "n").join(near, "id", "left").join(chosen, "id", "left")
    known = staged(known.select("id", "n", F.coalesce("component", "id").alias("comp"), F.coalesce("component", "hub", "id").alias("place")), "places")
    several = known.groupBy("place").agg(F.count("*").alias("c")).where(F.col("c") > chunk).select("place", F.ceil(F.col("c") / chunk).cast("int").alias("k"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1)))
    salted = join_small(known, several, "place")
    placed = staged(salted.select("id", "n", "comp", F.pmod(F.xxhash64("place", part), F.lit(max(1, -(-total // chunk)))).alias("chunk")), "placed")
    more = _links(cross_tasks(prefixes, placed, chunk), members, percent, wanted)
    joined = near if more.isEmpty() else connected_components(links.unionByName(more)).select(F.col("node").alias("id"), "component")
    unstage(prefixes)
    return table, staged(joined.join(members.select("id", "sig"), "id").select("sig", "component"), "joined")


def _classes(table: DataFrame, joined: DataFrame, first: str) -> DataFrame:
    """(sig, first, copies) of the classes that link with others or have several rows: the least `first` of their component."""
    classes = table.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(first).alias("mine"), F.count("*").alias("copies"))
    linked = joined.join(classes, "sig")
    least = linked.groupBy("component").agg(F.min("mine").alias("first"), F.count("*").alias("w"))
    labels = join_salted(linked, least, "component", "w", linked.count(), "sig").select("sig", "first", "copies")
    alone = classes.where("copies > 1").join(joined, "sig", "left_anti").select("sig", F.col("mine").alias("first"), "copies")
    return staged(labels.unionByName(alone), "labels")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are ignored).

    A document's set holds its distinct k-word shingles; words are runs of bytes other than 20 and 09-0D, with A-Z
    lower-cased. Fewer words than k are one shingle; null or wordless texts have an empty set and link with nothing.
    Documents link when 100 |x & y| >= percent |x | y|; component_id is the smallest doc_id reachable. Every link counts:
    nothing is capped or sampled. Rows that repeat a doc_id are kept, each with its own text's component; a null doc_id
    is never a component_id unless the component has no other.
    """
    table, joined = labelled(docs, k, percent, chunk, segment)
    labels = _classes(table, joined, "doc_id")
    out = join_salted(table.select("doc_id", "mark", "n", "sig"), labels, "sig", "copies", table.count(), "doc_id", "mark")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """docs with one row (that of the smallest doc_id, null last, then of the least hash of its text) of each component; all columns stay.

    Rows are told apart by doc_id and text, so of rows that share a doc_id only copies go; rows equal in both count as
    copies of each other. Rows without words are all kept.
    """
    table, joined = labelled(docs, k, percent)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    table = table.where(F.col("sig").isNotNull()).select(row.alias("row"), "sig")
    labels = _classes(table, joined, "row")
    found = join_salted(table, labels, "sig", "copies", table.count(), "row").where(F.col("first").isNotNull())
    fate = found.groupBy("row").agg(F.first(F.col("row") == F.col("first")).alias("kept"), F.count("*").alias("times"))
    key, kept, times = private(docs, "row", "kept", "times")
    some = staged(fate.where("not kept or times > 1").select(F.col("row").alias(key), F.col("kept").alias(kept), F.col("times").alias(times)), "copies")
    doc_id = F.col("doc_id").cast("long")
    mine = F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64("text").alias("mark"))
    marked = join_small(docs.withColumn(key, mine), some, key).where(F.coalesce(kept, F.lit(True)))
    if some.where(F.col(times) > 1).isEmpty():
        return marked.select(*docs.columns)
    once = marked.where(F.coalesce(times, F.lit(1)) == 1)
    again = marked.where(F.col(times) > 1).dropDuplicates([key])
    return once.unionByName(again).select(*docs.columns)
