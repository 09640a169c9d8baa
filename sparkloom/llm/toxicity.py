"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding homoglyphs and digit substitutions.

The lexicon, the exception phrases and the calibration of the score are learned from labelled documents; the weights are
log odds of a word or word beginning in toxic against other documents, and exceptions are pairs of words around a match
that only other documents have. A text's score is a logistic function of its matched weight, normalised by its number of
words. Matches inside exception phrases don't count.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, private, small, staged, unstage, with_struct

#: Labelled rows that are learned from, at most: those of least hash. The rest of the work covers every row.
MAX_TOXIC, MAX_OTHER = 10_000, 20_000
#: Lengths of the word beginnings that can be lexicon entries besides whole words.
STEMS = (4, 5, 6)
#: A text without a match scores a quarter at most, whatever share of the labelled rows is toxic.
NO_MATCH = -float(np.log(3))
#: Entries that a task counts before it hands its counts on.
HELD = 200_000
MIN_TOXIC, MIN_WEIGHT, MIN_Z = 3, 3.0, 3.0
#: A phrase is an exception if so many other documents hold it and its rate in toxic ones is at most this part of theirs.
MIN_OTHER, MAX_RATE = 3, 0.1

# Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ſ": "s", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}
_SPACE = " "
FOLD = {c: _SPACE for c in range(128) if not chr(c).isalnum()} | {c: chr(c).lower() for c in range(65, 91)}
FOLD |= {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(a): b for a, b in SUBSTITUTIONS.items()}
FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: SUBSTITUTIONS.get(str(i), str(i)) for i in range(10)}
FOLD |= {0x1D400 + 52 * s + i: chr(97 + i % 26) for s in range(13) for i in range(52)}
FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
FOLD |= {c: _SPACE for c in (0x85, 0xA0, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF, *range(0x2000, 0x200B), *range(0x2010, 0x2030), 0x2039, 0x203A, 0x3000)}
# Combining marks that decomposed letters carry.
MARKS = "\u0300-\u036F\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF\uFE20-\uFE2F"
FOLD |= {ord(c): None for c in map(chr, range(0x300, 0xFE30)) if re.match(f"[{MARKS}]", c)}
MARKED = re.compile(f"[{MARKS}]+")
WORD = re.compile(r"[^\W\d_]+")
INSIDE = re.compile(r"(?<=[^\W\d_])!(?=[^\W\d_])")
DOLLAR = re.compile(r"\$+(?=[^\W\d_])|(?<=[^\W\d_])\${1,2}(?![\w$])")
SPELLED = re.compile(r"(?<![^ ])(?:[^\W\d_] ){3,}[^\W\d_](?![^ ])")


class Model(NamedTuple):
    """weights: " stem" or " word " to its weight; beta: intercept and slopes of the logistic function; exceptions: phrases of folded words."""

    weights: dict[str, float]
    beta: tuple[float, float, float]
    exceptions: tuple[str, ...] = ()


def fold(text: str) -> str:
    """Folded words with one space between, before and after.

    Lower case; look-alikes, digits and signs that stand for letters become those, invisible characters go, every other
    sign is a space. Letters are composed and keep their accents: see `plain`. Four or more letters that stand alone side
    by side are one word.
    """
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "$" in text:
        text = DOLLAR.sub(lambda m: "s" * len(m[0]), text)
    if "!" in text:
        text = INSIDE.sub("i", text)
    text = f" {' '.join(text.translate(FOLD).split())} "
    return SPELLED.sub(lambda m: m[0].replace(" ", ""), text)


def plain(folded: str) -> str:
    """The same words without accents, which may be decoration or spelling: every word is looked for in both forms."""
    if folded.isascii():
        return folded
    text = MARKED.sub("", unicodedata.normalize("NFD", folded))
    return text if text.isascii() else text.translate(FOLD)


def entries(text: str) -> set[str]:
    """The lexicon entries that a text could hold: its words and their beginnings, as they are spelled."""
    out = set()
    folded = fold(text)
    for w in set(WORD.findall(folded)):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in STEMS if len(w) >= n)
    return out


class Matcher:
    def __init__(self, model: Model):
        self.beta = model.beta
        self.automaton = ahocorasick.Automaton()
        for e, w in model.weights.items():
            self.automaton.add_word(e, (len(e), w))
        for p in model.exceptions:
            p = fold(p)
            self.automaton.add_word(p, (len(p), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _found(self, folded: str) -> dict[int, tuple[int, float]]:
        """Number of the word to (length, weight) of the longest entry that begins with it, without those inside an exception phrase."""
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded) if len(self.automaton) else ():
            at = end - length + 1
            if weight is None:
                spared.append((at, end))
            elif at not in best or best[at][0] < length:
                best[at] = (length, weight)
        if spared:
            spared.sort()
            starts, reach = [s for s, _ in spared], []  # how far the phrases that begin up to each reach
            for _, e in spared:
                reach.append(max(e, reach[-1] if reach else 0))
            best = {at: x for at, x in best.items() if not (i := bisect_right(starts, at)) or reach[i - 1] < at + x[0] - 1}
        out, word, seen = {}, 0, 0
        for at in sorted(best):  # entries begin with the space before a word
            word, seen = word + folded.count(" ", seen, at), at
            out[word] = best[at]
        return out

    def matches(self, folded: str) -> dict[int, tuple[int, float]]:
        """What is found in the words as they are, and else in their forms without accents."""
        best = self._found(folded)
        return best if folded.isascii() else self._found(plain(folded)) | best

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Log weight by 100 words, log weight, and the number of matches; the longest entry of a word counts."""
        folded = fold(text or "")
        best = self.matches(folded)
        total = sum(w for _, w in best.values())
        words = max(folded.count(" ") - 1, 1)
        return float(np.log1p(100 * total / words)), float(np.log1p(total)), len(best)

    def phrases(self, text: str | None) -> set[str]:
        """The pairs of words in which a match stands, with and without accents."""
        folded = fold(text or "")
        best, out = self.matches(folded), set()
        for form in {folded, plain(folded)} if best else ():
            words = form.split()
            for i in best:
                if i > 0:
                    out.add(f"{words[i - 1]} {words[i]}")
                if i + 1 < len(words):
                    out.add(f"{words[i]} {words[i + 1]}")
        return out

    def score(self, text: str | None) -> tuple[float, int]:
        density, total, n = self.features(text)
        return float(1 / (1 + np.exp(-(self.beta[0] + self.beta[1] * density + self.beta[2] * total)))), n


def _tally(of: Callable[[], Callable[[str], set[str]]]):
    """Rows (text, toxic) to (entry, a, b): in how many toxic and other texts of the task something is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
            every = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([c[e] for e in every], pa.int64()) for c in counts]], names=["entry", "a", "b"])

        find, counts = of(), (Counter(), Counter())
        for batch in small(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[0 if toxic else 1].update(find(text or ""))
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield batch_of(counts)
                    counts = Counter(), Counter()
        yield batch_of(counts)

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column] | None = None, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Model:
    """Learn a model from docs (doc_id, text) and labels (doc_id, toxic).

    learn, a condition on the id, says which rows may be learned from (all if None). At most max_toxic and max_other
    labelled ids, those of least hash, are used, with one text each (of rows that repeat an id, that of the least hash);
    only these and the entries and phrases that pass are ever gathered. Null labels and ids are left out; if an id has
    several labels, the greater counts. Without toxic or without other rows the model has no entries and scores the share
    of toxic rows. A text without a match scores a quarter at most: nothing is toxic without evidence.
    """
    spark = bound_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "toxic")
    known = known.groupBy("id").agg((F.max("toxic") >= 1).alias("toxic"))
    if learn is not None:
        known = known.where(learn(F.col("id")))
    picked = known.where("toxic").orderBy(F.xxhash64("id"), "id").limit(max_toxic).unionByName(known.where("not toxic").orderBy(F.xxhash64("id"), "id").limit(max_other))
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), "id")
    one = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = staged(one.select("text", "toxic"), "labelled")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, q = sizes.get(True, 0), sizes.get(False, 0)
    if not p or not q:
        rate = (p + 0.5) / (p + q + 2)
        return Model({}, (min(float(np.log(rate / (1 - rate))), NO_MATCH), 0.0, 0.0))

    def tallies(of: Callable) -> DataFrame:
        return sample.mapInArrow(_tally(of), "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    passed = tallies(lambda: entries).where((F.col("a") >= MIN_TOXIC) & _passes(F.col("a"), F.col("b"), p, q)).collect()
    model = Model(lexicon({r.entry: r.a for r in passed}, {r.entry: r.b for r in passed}, p, q), (0.0, 0.0, 0.0))
    shared = spark.sparkContext.broadcast(model)
    spare = (F.col("b") >= MIN_OTHER) & ((F.col("a") + 0.5) / p <= MAX_RATE * (F.col("b") + 0.5) / q)
    model = model._replace(exceptions=tuple(sorted(r.entry for r in tallies(lambda: Matcher(shared.value).phrases).where(spare).collect())))
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value)
        for batch in small(batches):
            f = [m.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), batch.column(1)], names=["d", "t", "toxic"])

    x = np.array([(r.d, r.t, r.toxic) for r in sample.mapInArrow(features, "d double, t double, toxic boolean").collect()]).reshape(-1, 3)
    unstage(sample)
    x = x[np.lexsort(x.T)]  # sums in one order whatever the tasks
    return model._replace(beta=logistic(x[:, :2], x[:, 2]))


def _passes(a: Column, b: Column, p: int, q: int) -> Column:
    """lexicon's condition, a hair wider; rounding is settled there."""
    w = F.ln((a + 0.5) / (p - F.least(a, F.lit(p)) + 0.5)) - F.ln((b + 0.5) / (F.greatest(q - b, F.lit(0)) + 0.5))
    return (w >= MIN_WEIGHT - 1e-6) & (w / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= MIN_Z - 1e-6)


def lexicon(a: dict[str, int], b: dict[str, int], p: int, q: int) -> dict[str, float]:
    """Entries in a toxic documents of p and b others of q whose log odds are large and certain.

    A beginning is kept instead of the words under it unless it is much weaker; the longest match counts anyway.
    """
    out = {}
    for e, n in a.items():
        m = b.get(e, 0)
        w = np.log((n + 0.5) / (p - min(n, p) + 0.5)) - np.log((m + 0.5) / (max(q - m, 0) + 0.5))
        if w >= MIN_WEIGHT and w / np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)) >= MIN_Z:
            out[e] = float(w)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, most: float = NO_MATCH) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method; an intercept above `most` is held there and the slopes are fitted again."""
    x = np.column_stack([np.ones(len(x)), x])

    def fitted(beta: np.ndarray, free: slice) -> np.ndarray:
        z = x[:, free]
        for _ in range(30):
            mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((z.T * (mu * (1 - mu))) @ z + ridge * np.eye(z.shape[1]), z.T @ (y - mu) - ridge * beta[free])
            beta[free] += step
            if np.abs(step).max() < 1e-8:
                break
        return beta

    beta = fitted(np.zeros(x.shape[1]), slice(None))
    if beta[0] > most:
        beta = fitted(np.array([most, *np.zeros(x.shape[1] - 1)]), slice(1, None))
    return tuple(float(v) for v in beta)


def with_toxicity(docs: DataFrame, model: Model, name: str = "__toxic") -> DataFrame:
    """docs with a struct column `name`: score (0 to 1; null and empty texts get the score of a text without matches) and matches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = Matcher(shared.value)
        return lambda texts: list(zip(*[m.score(t) for t in texts], strict=True)) or [[], []]

    return with_struct(docs, name, "score double, matches int", [F.col("text")], make)


def held_out(doc_id: Column, folds: int = 5, fold_no: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out (and never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold_no, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, matches) a row of docs, learned from labels outside the held-out fold."""
    model = fit(docs, labels, lambda i: ~held_out(i))
    scored = with_toxicity(docs.select("doc_id", "text"), model)
    score = F.col("__toxic.score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("__toxic.matches").alias("matches"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    name = private(docs, "toxic")[0]
    return with_toxicity(docs, fit(docs, labels), name).where(F.col(f"{name}.score") < threshold).select(*docs.columns)
