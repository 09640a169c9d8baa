"""Scoring, extraction and normalisation of text as column expressions."""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group in the last match, null if there is none."""
    return F.get(F.reverse(F.regexp_extract_all(text, F.lit(pattern), group)), F.lit(0))


def tail(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def final_number(text: Column, strict: bool = True) -> Column:
    """The answer in the last 300 characters: after the last ####, or else the last number; without commas and dollars."""
    end = tail(text, 300)
    if strict:
        return F.regexp_replace(last_match(end, r"#### (\-?[0-9\.\,]+)"), "[,$]", "")
    found = F.regexp_extract_all(end, F.lit(r"(\-?[0-9\.\,]+)"), 1)
    good = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(F.get(F.reverse(good), F.lit(0)), F.get(found, F.lit(0)))


def number_score(text: Column, gold: Column, strict: bool = True, score: float = 1.0, format_score: float = 0.0) -> Column:
    found = final_number(text, strict)
    return F.when(found.isNull(), 0.0).when(found == gold, score).otherwise(format_score)


def normalize_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation out, then articles out, white space collapsed: in this order, by tokens."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda x: ~x.isin("", *ARTICLES)), " ")


def exact_match(prediction: Column, golds: Column) -> Column:
    p = normalize_answer(prediction)
    return F.exists(golds, lambda g: normalize_answer(g) == p)


def contains_gold(prediction: Column, golds: Column) -> Column:
    p = normalize_answer(prediction)
    return F.exists(golds, lambda g: p.contains(normalize_answer(g)))


def last_answer(text: Column, tag: str = "answer") -> Column:
    return F.trim(last_match(text, f"(?s)<{tag}>(.*?)</{tag}>"))


def tag_count(text: Column, tag: str) -> Column:
    return F.regexp_count(text, F.lit(tag))


def answer_score(text: Column, golds: Column, score: float = 1.0, contains: bool = False) -> Column:
    """score if the last answer fits a gold one, a quarter of it if there are more than ten answer tags; else 0."""
    a = last_answer(text)
    fits = contains_gold(a, golds) if contains else exact_match(a, golds)
    many = (tag_count(text, "<answer>") > 10) | (tag_count(text, "</answer>") > 10)
    return F.when(a.isNull() | ~fits, 0.0).when(many, score / 4).otherwise(score)


def labelled_answer(text: Column) -> Column:
    return F.coalesce(F.trim(last_match(tail(text, 300), r"(?i)Answer\s*:\s*([^\n]+)")), F.lit("[INVALID]"))


def _bound(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _braced(rest: Column) -> Column:
    """What the first brace of a text holds up to its partner; null if there is none. One fold over its characters."""
    step = lambda a, c: F.struct(
        (a["i"] + 1).alias("i"),
        F.when(a["end"] > 0, a["depth"]).when(c == "{", a["depth"] + 1).when(c == "}", a["depth"] - 1).otherwise(a["depth"]).alias("depth"),
        F.when((a["end"] == 0) & (c == "}") & (a["depth"] == 1), a["i"] + 1).otherwise(a["end"]).alias("end"),
    )
    end = lambda x: F.aggregate(F.split(x, ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("end")), step, lambda a: a["end"])
    return _bound(rest, lambda x: _bound(end(x), lambda n: F.when(n > 0, F.substring(x, F.instr(x, "{") + 1, n - F.instr(x, "{") - 1))))


def last_boxed(text: Column) -> Column:
    """What the last `\\boxed{` holds up to its partner, braces and command left out; null if unbalanced or none."""
    return F.when(text.contains("\\boxed{"), _braced(F.concat(F.lit("{"), F.substring_index(text, "\\boxed{", -1))))


# What a final answer's normalisation replaces, in this order, and what it takes out.
ANSWER_REPLACED = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
ANSWER_REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def final_answer(text: Column) -> Column:
    """A quantitative answer after its last =: articles, units and text commands out, short fractions and roots spelled
    out, digits without their commas."""
    x = F.element_at(F.split(text, "="), -1)
    x = _replaced(x, *ANSWER_REPLACED, *[(w, "") for w in ANSWER_REMOVED])
    x = F.regexp_replace(x, r".*?\$(.*?)\$.*", r"\$$1\$")
    for command in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, r"\\" + command + r"\{(.*?)\}", "$1")
    x = F.regexp_replace(x, r"\\boxed\{(.*)\}", "$1")
    x = F.regexp_replace(x, r"frac([^{])(.)", r"frac{$1}{$2}")
    x = F.regexp_replace(x, r"sqrt([^{])", r"sqrt{$1}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    digits = lambda x: F.replace(x, F.lit(","), F.lit(""))
    return _stripped(_bound(x, lambda x: F.when(digits(x).rlike(r"^\p{Nd}+$"), digits(x)).otherwise(x)))


def strip_latex(text: Column) -> Column:
    """LaTeX spellings of the same value made equal: line ends, size commands, degrees, dollars, units on the right, percent
    signs, leading points, a short left side of one =, spaces; short roots and fractions and a/b spelled out."""
    x = _replaced(text, ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))
    x = F.substring_index(x, "\\text{ ", 1)
    x = _replaced(x, ("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0."))
    x = F.regexp_replace(x, r"^\.", "0.")
    x = _bound(x, lambda x: _bound(F.split(x, "="), lambda sides: F.when((F.size(sides) == 2) & (F.length(sides[0]) <= 2), sides[1]).otherwise(x)))
    x = F.replace(F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    whole = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    x = _bound(x, lambda x: F.when(x.rlike(r"\\frac(?:[^{]?$|[^{]?\\frac)"), x).otherwise(whole(x)))
    x = _bound(x, lambda x: F.when(x == "0.5", F.lit(r"\frac{1}{2}")).otherwise(x))
    return F.regexp_replace(x, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def normalized_math(text: Column) -> Column:
    """strip_latex of an answer without white space around it or a text command that holds all of it."""
    inner = lambda x: F.regexp_extract(x, r"^\\text\{(.+?)\}$", 1)
    return strip_latex(_bound(_stripped(text), lambda x: F.when(inner(x) != "", _stripped(inner(x))).otherwise(x)))


def clean_number(text: Column) -> Column:
    """A number with its units, thousands commas and a final point out: a looser final_answer for parts of tuples."""
    return F.regexp_replace(F.regexp_replace(final_answer(text), r"(?<=[0-9]),(?=[0-9]{3})", ""), r"\.$", "")


def _cut_at(markers: tuple[str, ...], state: Column, after: bool) -> Column:
    """(found, x) after cutting x, for each marker in turn, behind the last one in any case (or before it)."""

    def step(s: Column, marker: Column) -> Column:
        low = F.lower(s["x"])
        rest = F.length(F.call_function("substring_index", low, marker, F.lit(-1)))
        kept = F.right(s["x"], rest) if after else F.left(s["x"], F.length(s["x"]) - rest - F.length(marker))
        return F.struct((s["found"] | low.contains(marker)).alias("found"), F.when(low.contains(marker), _stripped(kept)).otherwise(s["x"]).alias("x"))

    return F.aggregate(F.array(*[F.lit(m) for m in markers]), state, step)


def answer_in_prose(response: Column) -> Column:
    """(matched, answer): the answer that a response's words point to.

    What follows "answer is" and the like, then what stands before "is the answer" and the like, then the last boxed
    expression, then the part before the last sentence end, then what follows the last copula or sign. It counts as
    matched if any of these but the sentence end is there and the rest has a digit.
    """
    state = lambda found, x: F.struct(found.alias("found"), x.alias("x"))

    def boxed(s: Column) -> Column:
        command = F.when(s["x"].contains("\\boxed"), F.substring_index(s["x"], "\\boxed", -1)).when(s["x"].contains("\\fbox"), F.substring_index(s["x"], "\\fbox", -1))
        return _bound(F.coalesce(_stripped(_braced(command)), F.lit("")), lambda b: state(s["found"] | (b != ""), F.when(b != "", b).otherwise(s["x"])))

    def sentence(s: Column) -> Column:
        rest = F.length(F.substring_index(s["x"], ". ", -1))
        return state(s["found"], F.when(s["x"].contains(". "), _stripped(F.left(s["x"], F.length(s["x"]) - rest - 2))).otherwise(s["x"]))

    s = _cut_at(("answer:", "answer is", "answers are"), state(F.lit(False), response), True)
    s = _cut_at(("is answer", "is the answer", "are answers", "are the answers"), s, False)
    s = _bound(_bound(s, boxed), sentence)
    s = _cut_at(("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"), s, True)
    return _bound(s, lambda s: F.struct((s["found"] & s["x"].rlike(r"\p{Nd}")).alias("matched"), s["x"].alias("answer")))


def graded(given: Column, gold: Column) -> Column:
    """Whether two answers are equal once normalised, as numbers, or part by part as tuples."""
    parts = lambda t: F.transform(F.split(F.regexp_replace(t, r"^[(\[]|[)\]]$", ""), ","), lambda p: final_answer(p))
    tuples = given.rlike(r"^\s*[(\[].*,.*[)\]]\s*$") & gold.rlike(r"^\s*[(\[].*,.*[)\]]\s*$")
    same = lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)) | F.coalesce(numbers_equal(p["a"], p["b"], 1e-9), F.lit(False)) | F.coalesce(tuples & (parts(p["a"]) == parts(p["b"])), F.lit(False))
    return _bound(F.struct(normalized_math(given).alias("a"), normalized_math(gold).alias("b")), same)


def score_batch(solutions: Column, golds: Column, scorer) -> Column:
    """scorer(solution, gold) for the pairs of two arrays; arrays of different lengths are an error."""
    same = F.when(F.size(solutions) == F.size(golds), solutions).otherwise(F.raise_error(F.lit("solutions and golds differ in number")))
    return F.zip_with(same, golds, lambda s, g: scorer(s, g))


def score_by_source(source: Column, scorers: dict[tuple[str, ...], Column]) -> Column:
    """The scorer that lists the row's source; a source that none lists is an error."""
    unknown = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null"))))
    return reduce(lambda rest, x: F.when(source.isin(*x[0]), x[1]).otherwise(rest), reversed(scorers.items()), unknown.cast("double"))


def answer_feedback(messages: Column, gold: Column) -> Column:
    """(done, response, reward) of a conversation (array of role and content): the last assistant message's answer against gold."""
    said = F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    reward = number_score(F.coalesce(said, F.lit("")), gold)
    right = reward == 1.0
    return F.struct(right.alias("done"), F.when(right, "Your response is correct!").otherwise("Your response is incorrect! You need to reflect on your answer and try again.").alias("response"), reward.alias("reward"))


def numbers_equal(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Relatively close, also as a hundredth or hundredfold; null unless both are numbers."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = lambda p, q: F.abs(p - q) <= tolerance * F.greatest(F.abs(p), F.abs(q))
    return near(x, y) | near(x, y / 100) | near(x, y * 100)


def first_tag(text: Column, tag: str) -> Column:
    """What the first such element holds, null if there is none."""
    return F.nullif(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit(""))


def tool_calls(text: Column, schema: str) -> Column:
    """All tagged calls that are valid JSON, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)
    return F.filter(F.transform(found, lambda x: F.from_json(x, schema)), lambda c: c["name"].isNotNull())


def without_tags(text: Column, tag: str) -> Column:
    return F.trim(F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", ""))


def first_score(text: Column) -> Column:
    """A score of 1 to 10 by patterns in order of trust; null if none fits or it is outside."""
    patterns = (r"(?i)<score>\s*([0-9]+)\s*</score>", r"(?i)score\s*[:=]\s*([0-9]+)", r"([0-9]+)\s*/\s*10", r"(?i)rating\s*[:=]\s*([0-9]+)", r"\b([0-9]+)\b")
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]).try_cast("int")
    return F.when(found.between(1, 10), found)


def room_type(text: Column) -> Column:
    """The first keyword contained, in this order."""
    low = F.lower(text)
    rules = (("bed", "bedroom"), ("living", "living room"), ("dining", "dining room"), ("kitchen", "kitchen"), ("bath", "bathroom"), ("office", "office"), ("study", "office"))
    return reduce(lambda a, r: F.when(low.contains(r[0]), r[1]).otherwise(a), reversed(rules), F.lit("other"))


def metric_key(name: Column) -> Column:
    """@ spelled out, slashes collapsed, other signs replaced, as trackers want their keys."""
    x = F.regexp_replace(name, "@", "_at_")
    x = F.regexp_replace(x, "/+", "/")
    return F.regexp_replace(x, r"[^A-Za-z0-9_./ \-]", "_")


def numbered(items: Column, prefix: str = "Doc ") -> Column:
    """Items as numbered lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit(": "), x)), "\n")


def think_format(text: Column) -> Column:
    return text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$")


def repetition(values: pd.Series) -> pd.Series:
    """2 sum(lcp) / (n (n + 1)) over each text's sorted suffixes, 0 for at most one character.

    Suffixes are ranked by prefixes of doubling length, in arrays; the ranks of all lengths then give the common prefixes
    of neighbours, longest steps first. Memory is a few words a character and length.
    """

    def one(text: str | None) -> float:
        n = len(text or "")
        if n <= 1:
            return 0.0
        rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)[1].astype(np.int64)
        levels = [rank.astype(np.int32)]
        while rank.max() < n - 1:
            k = 1 << (len(levels) - 1)
            after = np.zeros(n, np.int64)
            after[: max(n - k, 0)] = rank[k:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            levels.append(rank.astype(np.int32))
        order = np.argsort(rank)
        a, b = order[:-1].copy(), order[1:].copy()
        total = 0
        for j in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[levels[j][a[inside]] == levels[j][b[inside]]]
            a[same] += 1 << j
            b[same] += 1 << j
            total += len(same) << j
        return 2 * total / (n * (n + 1))

    return values.map(one)


def repetition_ratio(text: Column) -> Column:
    return F.pandas_udf(repetition, T.DoubleType())(text)


def lenient_json(values: pd.Series) -> pd.Series:
    """JSON with triple-quoted strings, Python's literals, single trailing commas and text around it, as JSON; None if it stays wrong."""

    def one(text: str | None) -> str | None:
        if text is None or (m := re.search(r"(?s)[\[{].*[\]}]", text)) is None:
            return None
        x = re.sub(r'(?s)"""(.*?)"""', lambda t: json.dumps(t[1]), m[0])
        parts = re.split(r'("(?:[^"\\]|\\.)*")', x)
        for i in range(0, len(parts), 2):
            for a, b in (("True", "true"), ("False", "false"), ("None", "null")):
                parts[i] = re.sub(rf"\b{a}\b", b, parts[i])
            parts[i] = re.sub(r",(\s*[\]}])", r"\1", parts[i])
        try:
            return json.dumps(json.loads("".join(parts)), sort_keys=True)
        except ValueError:
            return None

    return values.map(one)


def parsed_json(text: Column) -> Column:
    return F.pandas_udf(lenient_json, T.StringType())(text)


def channel_calls(text: Column) -> Column:
    """(name, arguments) of each call in channel tags; arguments stay text."""
    names = F.regexp_extract_all(text, F.lit(r"(?s)<\|channel\|>commentary to=functions\.(\w+).*?<\|message\|>(.*?)<\|call\|>"), 1)
    arguments = F.regexp_extract_all(text, F.lit(r"(?s)<\|channel\|>commentary to=functions\.(\w+).*?<\|message\|>(.*?)<\|call\|>"), 2)
    return F.zip_with(names, arguments, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


def fenced(text: Column, language: str = "json") -> Column:
    """What the first fenced block holds."""
    return F.nullif(F.regexp_extract(text, f"(?s)```{language}\\s*(.*?)```", 1), F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def choice_letter(text: Column, letters: str = "A-J") -> Column:
    """The letter after "Answer:", a dollar sign before it or not; empty if there is none."""
    return F.regexp_extract(text, rf"(?i)Answer[ \t]*:[ \t]*\$?([{letters}])\$?", 1)


def clean_requirement(text: Column, placeholder: str = "<image>") -> Column:
    """Without placeholders, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(placeholder), F.lit("")), r"\s+", " "))


def clean_label(text: Column) -> Column:
    """Without what stands in brackets, double spaces single."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[.*?\]", ""), "  ", " "))


def segments(text: Column, marks: str) -> Column:
    """The parts between marks (a pattern), trimmed, empty ones left out."""
    return F.transform(F.filter(F.split(text, marks), lambda x: F.trim(x) != ""), lambda x: F.trim(x))


def transcript(messages: Column) -> Column:
    """Messages (array of role and text) as lines with the role in bold, without the system's."""
    said = F.filter(messages, lambda m: m["role"] != "system")
    return F.array_join(F.transform(said, lambda m: F.concat(F.lit("**"), F.initcap(m["role"]), F.lit("**: "), m["text"])), "\n")


def valid_message(text: Column, tag: str = "think") -> Column:
    """Not blank, and as many opening as closing tags."""
    return (F.trim(text) != "") & (F.regexp_count(text, F.lit(f"<{tag}>")) == F.regexp_count(text, F.lit(f"</{tag}>")))


def first_rule(text: Column, rules: list[tuple[tuple[str, ...], str]], default: str | None = None) -> Column:
    """The kind of the first rule of which any word is contained, in lower case; else the default."""
    low = F.lower(text)
    return reduce(lambda rest, rule: F.when(reduce(lambda a, w: a | low.contains(w), rule[0], F.lit(False)), rule[1]).otherwise(rest), reversed(rules), F.lit(default))


def search_text(results: Column) -> Column:
    """A status line (success if there are several results, else empty) and the results apart by a rule."""
    return F.concat(F.when(F.size(results) > 1, "success").otherwise("empty"), F.lit("\n"), F.array_join(results, "\n---\n"))


def bleu_score(text: str, reference: str, width: int = 4) -> float:
    """Sentence BLEU of characters: clipped precisions of one to `width` in a row and the brevity penalty, without smoothing.

    As the metric it stands for is called on plain strings, its units are characters. A precision that is 0 counts as the
    least positive double, so that the score is next to nothing but not 0 unless no character is shared.
    """
    logs = []
    for n in range(1, width + 1):
        given = Counter(zip(*[text[i:] for i in range(n)], strict=False))
        wanted = Counter(zip(*[reference[i:] for i in range(n)], strict=False))
        hits, total = sum(min(c, wanted[g]) for g, c in given.items()), max(sum(given.values()), 1)
        if n == 1 and not hits:
            return 0.0
        logs.append(math.log(hits / total if hits else sys.float_info.min) / width)
    brevity = 1.0 if len(text) > len(reference) else math.exp(1 - len(reference) / len(text))
    return brevity * math.exp(math.fsum(logs))


def bleu(text: Column, reference: Column) -> Column:
    """bleu_score of two text columns, in Arrow batches, linear in the texts; null where one is null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else bleu_score(a, b) for a, b in zip(x, y, strict=True)], dtype=float)

    run.__annotations__ = {}
    return F.pandas_udf(run, "double")(text, reference)


def step_verdict(found: Column, gold: Column, none: int = -1, scale: float = 10.0) -> Column:
    """1 if the same step is blamed, -1 if only one side blames none, else minus the distance over the scale."""
    return F.when(found == gold, 1.0).when((found == none) | (gold == none), -1.0).otherwise(-F.abs(found - gold) / scale)


def point_reward(points: Column, low: float, high: float) -> Column:
    """By the rank of the first point inside: 1 / sqrt(points * rank), else -1 / points."""
    k, n = F.array_position(F.transform(points, lambda x: x.between(low, high)), True), F.size(points).cast("double")
    return F.when(k > 0, 1 / F.sqrt(n * k)).otherwise(-1 / n)


def value_with_unit(text: Column) -> Column:
    """The leading number, times a million or a hundredth where the text says so."""
    number = F.regexp_extract(text, r"^([0-9]+)", 1).cast("double")
    return F.when(text.contains("million"), number * 1e6).when(text.contains("%"), number / 100).otherwise(number)


def agreement(a: Column, b: Column) -> Column:
    """1 if both hold, 0 if one does, else -1."""
    return F.when(a & b, 1.0).when(a | b, 0.0).otherwise(-1.0)


def call_format_reward(calls: Column, valid: Column) -> Column:
    """1 less a fifth for each call that isn't valid and a tenth for more than one call, -1 at least."""
    return F.greatest(1.0 - 0.2 * (calls - valid) - 0.1 * (calls > 1).cast("int"), F.lit(-1.0))
