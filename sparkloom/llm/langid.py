"""Language ID: one interpolated Kneser-Ney character model per language, in sorted hash arrays.

The n-gram counts come from every training text: tasks count in numpy, Spark adds the counts by language and n-gram, and
from those the continuation counts and discounts of the lower orders. All n-grams of all languages are kept: the model
is cut by context into parts of about PART entries, each a broadcast of its own, and texts are scored part after part.
A text gets the language of least cross-entropy a character, and is accepted if that is not above the calibrated limit
of the language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_small, mix, small, staged, unstage, with_struct

ORDER = 4
#: Entries (n-gram and language) of a part of the model, about, and of the parts that a Python worker keeps; it loads the
#: others for each piece of text again.
PART, KEEP = 1_000_000, 4_000_000
#: Texts of each language by which its limit of rejection is set, about and at most a tenth of them, and from how many texts
#: on it has any; they teach the model nothing. The quantile of their entropies, and what is allowed above it.
CALIBRATION, TENTH, ENOUGH, QUANTILE, SLACK = 300, 0.1, 20, 0.99, 1.1
UNKNOWN = "und"
START, SPACE = 1, 32
#: The codes of surrogates and private use, and how many there are (a prime below).
BEYOND, SHARED = 0xD800, 8447
#: Characters of a batch that are scored at a time, and cells (by n-gram and language) that a table of scores has at most.
PIECE, CELLS = 1 << 19, 1 << 22


def _letters() -> np.ndarray:
    table = np.full(1 << 16, SPACE, np.uint16)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    table[START] = START
    return table


class Characters:
    """Texts as runs of lower-cased letters with one space between, each after ORDER - 1 start signs."""

    def __init__(self):
        self.table = _letters()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes, the first position of each text's own characters, and its number of letters."""
        texts = [t.replace("\x01", " ") for t in texts]
        glue = "\x01" * (ORDER - 1)
        points = np.frombuffer((glue + glue.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.table[np.minimum(points, 0xFFFF)]
        far = np.flatnonzero(points > 0xFFFF)
        if len(far):  # letters beyond the first plane share the codes that are no characters there
            kinds, which = np.unique(points[far], return_inverse=True)
            codes[far] = np.array([BEYOND + ord(chr(p).lower()) % SHARED if chr(p).isalpha() else SPACE for p in kinds.tolist()], np.uint16)[which]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != SPACE) | (codes[:-1] > SPACE)
        place = np.concatenate(([0], np.cumsum(keep)))
        first = np.cumsum([ORDER - 1] + [len(t) + ORDER - 1 for t in texts])
        letters = np.concatenate(([0], np.cumsum(codes > SPACE)))
        return codes[keep], place[np.minimum(first, len(codes))], np.diff(letters[np.minimum(first, len(codes))])

    def grams(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that are no start signs, and the packed n-gram that ends at each."""
        at = np.flatnonzero(codes != START)
        at = at[at >= ORDER - 1]
        wide, key = codes.astype(np.uint64), np.zeros(len(at), np.uint64)
        for j in range(ORDER):
            key = key << np.uint64(16) | wide[at - (ORDER - 1 - j)]
        return at, key


class Table(NamedTuple):
    """Hashes in order, where each bucket of their leading bits begins, and for each hash a run of languages and values."""

    hashes: np.ndarray
    start: np.ndarray
    offsets: np.ndarray
    languages: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, languages: np.ndarray, values: np.ndarray) -> Table:
        h = mix(keys)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
        bits = max(1, int(len(first)).bit_length())
        start = np.searchsorted(h[first] >> np.uint64(64 - bits), np.arange((1 << bits) + 1)).astype(np.int32)
        return cls(h[first], start, np.append(first, len(h)), languages[order].astype(np.int32), values[order].astype(np.float32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in keys, languages and values of all entries of the keys that are here."""
        h = mix(keys)
        bucket = (h >> np.uint64(64 - int(len(self.start) - 1).bit_length() + 1)).astype(np.int64)
        at, end = self.start[bucket].astype(np.int64), self.start[bucket + 1].astype(np.int64)
        row = np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.hashes[at] == h
            row[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            todo, at, end, h = todo[more], at[more] + 1, end[more], h[more]
        here = np.flatnonzero(row >= 0)
        lo = self.offsets[row[here]]
        n = self.offsets[row[here] + 1] - lo
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(here, n), self.languages[entry], self.values[entry]


class Part(NamedTuple):
    """All n-grams of an order after some contexts: shares has each one's discounted share of its context in a language,
    left what the context leaves to lower orders."""

    shares: Table
    left: Table

    @classmethod
    def of(cls, languages: np.ndarray, keys: np.ndarray, n: np.ndarray, discounts: np.ndarray) -> Part:
        """From (language, n-gram, count) with all n-grams of their contexts, and the order's discounts by language."""
        order = np.lexsort((languages, keys >> np.uint64(16)))
        languages, keys, n = languages[order], keys[order], n[order].astype(np.float64)
        context = keys >> np.uint64(16)
        first = np.flatnonzero(np.concatenate((np.ones(min(len(n), 1), bool), (context[1:] != context[:-1]) | (languages[1:] != languages[:-1]))))
        total = np.add.reduceat(n, first) if len(n) else n
        kinds = np.diff(np.append(first, len(n)))
        shares = np.maximum(n - discounts[languages], 0) / np.repeat(total, kinds)
        return cls(Table.of(keys, languages, shares), Table.of(context[first], languages[first], discounts[languages[first]] * kinds / total))

    def apply(self, keys: np.ndarray, p: np.ndarray) -> None:
        """Turn p, the probabilities of the next lower order by key and language, into those of this order."""
        row, language, left = self.left.find(keys >> np.uint64(16))
        p[row, language] *= left
        row, language, share = self.shares.find(keys)
        p[row, language] += share


class Model(NamedTuple):
    """parts[k] has the parts of order k + 1, here or as broadcasts; an n-gram's context is in one of them. size is their entries."""

    languages: list[str]
    parts: list[list[Part | Broadcast]]
    floor: float
    limits: np.ndarray
    size: int = 0

    def opened(self) -> Iterator[tuple[int, Part]]:
        """(order, part) from the lowest order on; a worker keeps the first ones, up to KEEP entries."""
        kept = 0
        for k, parts in enumerate(self.parts, 1):
            for x in parts:
                part = x.value if isinstance(x, Broadcast) else x
                yield k, part
                kept += len(part.shares.values)
                if kept > KEEP and isinstance(x, Broadcast) and getattr(x, "_path", None):
                    x.__dict__.pop("_value", None)
                del part

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """ln P of each n-gram of the highest order, by language."""
        out = np.empty((len(keys), len(self.languages)), np.float32)
        step = max(1 << 10, CELLS // max(1, len(self.languages)))
        for lo in range(0, len(keys), step):
            some = keys[lo : lo + step]
            p = np.full((len(some), len(self.languages)), np.exp(self.floor))
            for k, part in self.opened():
                part.apply(some & np.uint64((1 << 16 * k) - 1), p)
            out[lo : lo + step] = np.log(p)
        return out

    def piece(self) -> int:
        """Characters to score at a time: more if parts have to be loaded for each piece."""
        return PIECE if self.size <= KEEP else 8 * PIECE

    def entropies(self, texts: list[str], chars: Characters) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character, by text and language, and letters by text; 0 for a text without letters."""
        codes, first, letters = chars.of(texts)
        at, keys = chars.grams(codes)
        total = np.zeros((len(texts), len(self.languages)))
        owner = np.searchsorted(first, at, "right") - 1
        step = max(1 << 10, min(PIECE, 2 * CELLS // max(1, len(self.languages))))
        for begin in range(0, len(at), self.piece()):
            end = min(begin + self.piece(), len(at))
            different, which = np.unique(keys[begin:end], return_inverse=True)
            log_p = self.log_p(different)
            for lo in range(begin, end, step):
                hi = min(lo + step, end)
                p, o = log_p[which[lo - begin : hi - begin]], owner[lo:hi]
                edge = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
                total[o[edge]] -= np.add.reduceat(p, edge, axis=0, dtype=np.float64)
        return total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None], letters


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, i = np.unique(keys, return_inverse=True)
    return u, np.bincount(i, values, len(u))


def discount(n1: int, n2: int) -> float:
    """n1 / (n1 + 2 n2) from how many n-grams have counts 1 and 2; three quarters where there are none of either."""
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


def kneser_ney(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from each language's (packed n-grams of ORDER, counts), in one part an order.

    Orders below the highest count how many different characters precede an n-gram.
    """
    levels: list[list] = [[] for _ in range(ORDER)]
    for keys, n in counts:
        for k in range(ORDER - 1, -1, -1):
            levels[k].append((keys, n))
            keys, n = _sum_by(keys & np.uint64((1 << 16 * k) - 1), np.ones(len(keys)))
    alphabet = np.unique(np.concatenate([k for k, _ in levels[0]] + [np.empty(0, np.uint64)]))
    parts = []
    for level in levels:
        which = np.repeat(np.arange(len(level)), [len(k) for k, _ in level])
        discounts = np.array([discount(np.count_nonzero(n == 1), np.count_nonzero(n == 2)) for _, n in level])
        keys, n = (np.concatenate([x[i] for x in level] + [np.empty(0, kind)]) for i, kind in enumerate((np.uint64, np.float64)))
        parts.append([Part.of(which, keys, n, discounts)])
    return Model(languages, parts, -np.log(len(alphabet) + 1), np.full(len(languages), np.inf))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chars = Characters()
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def merged(parts: list) -> list:
        keys, n = _sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
        return [(keys, n)]

    for batch in small(batches):
        by: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
                    size += len(texts[to])
                    to += 1
                keys, n = np.unique(chars.grams(chars.of(texts[at:to])[0])[1], return_counts=True)
                held.setdefault(lang, []).append((keys, n.astype(np.float64)))
                sizes[lang] = sizes.get(lang, 0) + len(keys)
                if sizes[lang] > 2_000_000:
                    held[lang] = merged(held[lang])
                    sizes[lang] = len(held[lang][0][0]) // 2
                at = to
    for lang, parts in held.items():
        keys, n = merged(parts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def fit(docs: DataFrame, learn: Callable[[Column], Column] | None = None) -> Model:
    """Learn from docs (doc_id, text, lang), where learn(doc_id) holds (everywhere if None); null langs and texts teach nothing.

    A language's limit comes from texts that the hash of id and text sets aside before anything is counted; languages of
    fewer than ENOUGH texts have none and take the largest limit of the others.
    """
    spark = bound_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    if learn is not None:
        rows = rows.where(learn(F.col("doc_id")))
    shares = staged(rows.groupBy("lang").agg(F.when(F.count("*") >= ENOUGH, F.least(F.lit(TENTH), CALIBRATION / F.count("*"))).otherwise(0.0).alias("share")), "languages")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30) < F.col("share")
    rows = join_small(rows, shares, "lang").withColumn("aside", F.coalesce(drawn, F.lit(False)))
    counts = rows.where("not aside").select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    levels = [staged(counts, "grams")]
    for k in range(ORDER - 1, 0, -1):
        lower = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long"))
        levels.insert(0, staged(levels[0].groupBy("lang", lower.alias("gram")).agg(F.count("*").alias("n")), "grams"))
    stats: list[dict] = [{r.lang: r for r in x.groupBy("lang").agg(F.count("*").alias("size"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()} for x in levels]
    languages = sorted(stats[-1])
    size = sum(r.size for by in stats for r in by.values())
    model = Model(languages, [[] for _ in levels], -np.log(levels[0].select("gram").distinct().count() + 1), np.full(len(languages), np.inf), size)
    if not languages:
        return model
    place = {name: i for i, name in enumerate(languages)}
    for k, level in enumerate(levels):
        discounts = np.array([discount(stats[k][name].n1, stats[k][name].n2) for name in languages])
        slices = -(-sum(r.size for r in stats[k].values()) // PART)
        if slices > 1:  # each slice is read once
            part_of = F.shiftrightunsigned("gram", 16) % 1_000_003 % slices
            level = staged(level.withColumn("slice", part_of.cast("int")).repartition("slice"), "slices", by="slice")
        for i in range(slices):
            table = level.where(F.col("slice") == i).drop("slice").toArrow() if slices > 1 else level.toArrow()
            if not len(table):
                continue
            lang = table.column("lang").combine_chunks().dictionary_encode()
            which = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()]
            part = Part.of(which, table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy(), discounts)
            model.parts[k].append(spark.sparkContext.broadcast(part))
            del table, lang, which, part
        if slices > 1:
            unstage(level)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = Characters()
        for batch in small(batches):
            h, letters = model.entropies(batch.column(0).to_pylist(), chars)
            mine = [(i, h[r, i]) for r, name in enumerate(batch.column(1).to_pylist()) if letters[r] and (i := place.get(name)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in mine], pa.int32()), pa.array([e for _, e in mine], pa.float64())], names=["i", "h"])

    sample = rows.where("aside").select("text", "lang").mapInArrow(own, "i int, h double")
    found = {r.i: r.h for r in sample.groupBy("i").agg(F.percentile("h", F.lit(QUANTILE)).alias("h")).collect()}
    most = max(found.values(), default=np.inf)
    limits = np.array([SLACK * found.get(i, most) for i in range(len(languages))])
    for x in [*levels, shares]:
        unstage(x)
    return model._replace(limits=limits)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a struct column __lang: lang, score (0 to 1), entropy (nats a character) and accepted.

    Null texts and texts without letters are UNKNOWN with score 0. Ties go to the first language by name.
    """

    def make():
        chars, m = Characters(), model

        def of(texts: list) -> list[list]:
            out: list[list] = [[], [], [], []]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= m.piece()):
                    size += len(texts[to] or "")
                    to += 1
                some = [t or "" for t in texts[at:to]]
                if m.languages:
                    h, letters = m.entropies(some, chars)
                    best = h.argmin(axis=1)
                    odds = np.exp(-np.clip((h - h.min(axis=1)[:, None]) * np.minimum(letters, 100)[:, None], 0, 700))
                    score = 1 / odds.sum(axis=1)
                for r in range(len(some)):
                    if not m.languages or not letters[r]:
                        row = (UNKNOWN, 0.0, None, False)
                    else:
                        i = int(best[r])
                        row = (m.languages[i], float(score[r]), float(h[r, i]), bool(h[r, i] <= m.limits[i]))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                at = to
            return out

        return of

    return with_struct(docs, "__lang", "lang string, score double, entropy double, accepted boolean", [F.col("text")], make)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, accepted) a row of docs, learned outside the held-out fold."""
    model = fit(docs, lambda i: i.isNotNull() & ~held_out(i))
    d = with_language(docs.select("doc_id", "text"), model)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"), F.col("__lang.entropy").alias("entropy"), F.col("__lang.accepted").alias("accepted"))
