"""Secret scans through a trigram index: each rule's regex gives a Boolean query over trigrams, postings are combined, candidates verified.

Every batch of texts is one index segment: the postings of just those trigrams that some rule's query asks for. A text is
searched with a rule's regex only if the rule's query holds for it; a rule without mandatory trigrams scans every text.
Nothing is shuffled, and a lost executor only costs its own segments.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as K
from re import _parser as P
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, small, with_struct

#: Sets of exact strings larger than this are given up.
EXACT = 64


class Rule(NamedTuple):
    """A match counts if its `group` has at least `least` characters; others are dropped after matching."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# Every rule is linear in the text: an unbounded run is tried from its start alone, or can't fail after it has begun.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that are long enough
)
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

# A query is True (any text), ("tri", t), ("and", frozenset) or ("or", frozenset).


def both(a, b):
    if a is True or b is True:
        return b if a is True else a
    parts = frozenset().union(*[q[1] if q[0] == "and" else {q} for q in (a, b)])
    return ("and", parts) if len(parts) > 1 else next(iter(parts))


def either(queries: list):
    if not queries or any(q is True for q in queries):
        return True
    parts = frozenset().union(*[q[1] if q[0] == "or" else {q} for q in queries])
    return ("or", parts) if len(parts) > 1 else next(iter(parts))


def of_strings(strings: set[str]):
    """The query that holds for a text with at least one of the strings."""

    def one(s: str):
        q = True
        for i in range(len(s) - 2):
            q = both(q, ("tri", s[i : i + 3]))
        return q

    return either([one(s) for s in strings])


def analyse(items) -> tuple[set[str] | None, object]:
    """(the lower-cased strings that the parsed regex can match, if few; its query)."""
    exact: set[str] | None = {""}
    query, whole = True, True
    for op, arg in items:
        some, q = _node(op, arg)
        if some is not None and len(exact) * len(some) <= EXACT:
            exact = {a + b for a, b in product(exact, some)}
            continue
        query = both(both(query, of_strings(exact)), of_strings(some) if some is not None else q)
        exact, whole = {""}, False
    if whole:
        return exact, of_strings(exact)
    return None, both(query, of_strings(exact))


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is K.LITERAL:
        return ({chr(arg).lower()} if arg < 128 else None), True
    if op is K.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is K.LITERAL and x < 128:
                chars.add(chr(x).lower())
            elif kind is K.RANGE and x[1] < 128 and x[1] - x[0] < 10:
                chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, True
        return (chars if len(chars) <= 10 else None), True
    if op is K.SUBPATTERN:
        return analyse(arg[-1])
    if op is K.BRANCH:
        found = [analyse(branch) for branch in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= EXACT:
            return set().union(*[e for e, _ in found]), either([q for _, q in found])
        return None, either([q for _, q in found])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, body = arg
        e, q = analyse(body)
        if e is not None and (least, most) == (0, 1):
            return e | {""}, True
        if e is not None and least == most and len(e) == 1 and least <= 64:
            return {next(iter(e)) * least}, q
        return None, (q if least else True)
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {""}, True
    return None, True


def trigram_query(regex: str):
    """A condition on the lower-cased trigrams of a text that every text with a match fulfils; True if there is none."""
    return analyse(P.parse(regex))[1]


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1]))


def candidates(query, postings: dict[str, np.ndarray]) -> np.ndarray:
    """The sorted texts for which a query (not True) holds, by merging postings; short ones are intersected first."""
    kind, arg = query
    if kind == "tri":
        return postings[arg]
    found = sorted((candidates(q, postings) for q in arg), key=len)
    if kind == "or":
        return np.unique(np.concatenate(found))
    out = found[0]
    for x in found[1:]:
        out = np.intersect1d(out, x, assume_unique=True)
    return out


class Index:
    """Builds the postings of chosen trigrams for batches of UTF-8 texts."""

    def __init__(self, trigrams: set[str]):
        self.names = sorted(trigrams)
        self.table = np.full(1 << 24, -1, np.int16)
        for i, t in enumerate(self.names):
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = i
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        low = self.lower[np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)]
        ids = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(ids >= 0)
        pair = np.unique(ids[at].astype(np.int64) * len(texts) + np.searchsorted(first, at, "right") - 1)
        edge = np.searchsorted(pair, np.arange(len(self.names) + 1) * len(texts))
        return {t: pair[edge[i] : edge[i + 1]] - i * len(texts) for i, t in enumerate(self.names)}


def trigram_postings(docs: DataFrame, trigrams: set[str]) -> DataFrame:
    """The index as a table: (trigram, doc_id), a row for each text of docs that holds the trigram in any case."""

    def run(batches):
        index = Index(trigrams)
        for batch in small(batches):
            ids = batch.column(0)
            for at, chunk in in_chunks(batch.column(1).to_pylist()):
                for t, rows in index.postings(chunk).items():
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(rows)), ids.slice(at, len(chunk)).take(pa.array(rows))], names=["trigram", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "trigram string, doc_id long")


def with_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """docs with a struct column __secrets: counts (of each base rule), base and spans.

    base and spans are `kind:start:end` of the base rules' and of all rules' matches, in code points with exclusive
    ends, by start and then in the rules' order, joined by commas. Matches are leftmost and don't overlap within a
    kind. Null and empty texts have none.
    """
    rules = (*base, *extra)

    def make():
        compiled = [(r, re.compile(r.regex)) for r in rules]
        queries = [trigram_query(r.regex) for r in rules]
        index = Index(set().union(*map(trigrams_of, queries)))

        def of(texts: list) -> list[list]:
            counts, firsts, alls = [], [], []
            for at, chunk in in_chunks(texts):
                postings = index.postings(chunk)
                found: list[list[tuple]] = [[] for _ in chunk]
                for k, ((rule, regex), query) in enumerate(zip(compiled, queries, strict=True)):
                    for i in range(len(chunk)) if query is True else candidates(query, postings).tolist():
                        for m in regex.finditer(texts[at + i] or ""):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[i].append((m.start(), k, m.end()))
                for spans in found:
                    spans.sort()
                    names = [f"{rules[k].kind}:{s}:{e}" for s, k, e in spans]
                    counts.append([sum(k == b for _, k, _ in spans) for b in range(len(base))])
                    firsts.append(",".join(x for x, (_, k, _) in zip(names, spans, strict=True) if k < len(base)))
                    alls.append(",".join(names))
            return [counts, firsts, alls]

        return of

    return with_struct(docs, "__secrets", "counts array<long>, base string, spans string", [F.col("text")], make)


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) a row of docs."""
    s = with_secrets(docs.select("doc_id", "text"))
    counts = [F.col("__secrets.counts")[i].alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return s.select("doc_id", *counts, F.sha2("__secrets.base", 256).alias("base_sha256"), F.col("__secrets.spans").alias("spans"))
