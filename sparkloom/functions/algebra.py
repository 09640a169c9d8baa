"""Equality of answers as rational functions: parse, evaluate modulo two large primes at points that a hash gives, compare.

Two expressions that are equal give equal values wherever both have one; different ones of degree d agree at a random point
with a probability of about d over the prime, so three points and two primes settle it. Numbers are exact fractions. A
root, and a name of a function, is a symbol of its own that depends on its argument's value; roots of square numbers are
numbers. Reading is one pass over the text, at all points and primes together.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMES = ((1 << 61) - 1, (1 << 89) - 1)
POINTS = 3
#: Prime and seed of each value, and how many texts a worker remembers.
PLACES = tuple((p, f"{i}") for p in PRIMES for i in range(POINTS))
KNOWN = 10_000
#: Depth of brackets and size of exponents that are still read.
DEPTH, POWER = 100, 10_000
TOKEN = re.compile(r"\s*(?:(\d+(?:,\d{3})+(?![\d,])(?:\.\d+)?|\d+\.\d*|\.\d+|\d+)|\\([A-Za-z]+)|([A-Za-z])|(\*\*|[-+*/^(){}\[\]=]|\\[!,;: ])|(\S))")

# Commands that only change how an answer looks, and those that are names.
LOOKS = frozenset("left right displaystyle textstyle big Big bigl bigr quad qquad mathrm text mathbf".split())
TIMES, OVER = frozenset("cdot times".split()), frozenset("div".split())
FRACTIONS = frozenset("frac dfrac tfrac cfrac".split())
FUNCTIONS = frozenset("sin cos tan cot sec csc log ln exp".split())
SYMBOLS = frozenset("pi theta alpha beta gamma lambda mu phi infty".split())


class Unreadable(ValueError):
    """The text is no expression that is understood here."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.replace("−", "-").replace("·", "*").replace("×", "*").replace("÷", "/").replace("$", " ").strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        number, command, letter, sign, other = m.groups()
        if other:
            raise Unreadable(other)
        if number:
            out.append(("number", number.replace(",", "")))
        elif command:
            if command in LOOKS:
                continue
            out.append(("sign", "*") if command in TIMES else ("sign", "/") if command in OVER else ("command", command))
        elif letter:
            out.append(("letter", letter))
        elif sign[0] != "\\":
            out.append(("sign", "^" if sign == "**" else {"[": "(", "]": ")"}.get(sign, sign)))
    return out


class Value:
    """The values at all PLACES, and the exact fraction if it is a constant of moderate size."""

    __slots__ = ("exact", "mod")

    def __init__(self, mod: tuple[int, ...], exact: tuple[int, int] | None = None):
        self.mod, self.exact = mod, exact if exact and max(abs(exact[0]), exact[1]) < 1 << 256 else None


def _hash(prime: int, seed: str, *what: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, *what)).encode(), digest_size=16).digest(), "big") % prime


@lru_cache(1000)
def named(kind: str, text: str) -> tuple[int, ...]:
    return tuple(_hash(p, seed, kind, text) for p, seed in PLACES)


class Reader:
    """Recursive descent over the tokens; every rule gives the values at all points."""

    def __init__(self, parts: list[tuple[str, str]]):
        self.parts, self.at, self.depth = parts, 0, 0

    def hashed(self, *what: object) -> Value:
        """A symbol of its own for what is given; of tuples each point takes its value."""
        return Value(tuple(_hash(p, seed, *[x[i] if isinstance(x, tuple) else x for x in what]) for i, (p, seed) in enumerate(PLACES)))

    def peek(self, *signs: str) -> bool:
        return self.at < len(self.parts) and self.parts[self.at][0] == "sign" and self.parts[self.at][1] in signs

    def take(self, sign: str) -> None:
        if not self.peek(sign):
            raise Unreadable(f"{sign} expected")
        self.at += 1

    def fraction(self, n: int, d: int) -> Value:
        if d == 0:
            raise Unreadable("division by zero")
        g = math.gcd(n, d) * (-1 if d < 0 else 1)
        mods = [n % p if d == 1 else n % p * pow(d, -1, p) % p for p in PRIMES]
        return Value(tuple(m for m in mods for _ in range(POINTS)), (n // g, d // g))

    def whole(self) -> Value:
        v = self.sum()
        if self.at != len(self.parts):
            raise Unreadable("more than one expression")
        return v

    def sum(self) -> Value:
        self.depth += 1
        if self.depth > DEPTH:
            raise Unreadable("too deep")
        negative = False
        while self.peek("+", "-"):
            negative ^= self.parts[self.at][1] == "-"
            self.at += 1
        v = self.product()
        if negative:
            v = self.times(self.fraction(-1, 1), v)
        while self.peek("+", "-"):
            sign = 1 if self.parts[self.at][1] == "+" else -1
            self.at += 1
            v = self.plus(v, self.product(), sign)
        self.depth -= 1
        return v

    def plus(self, a: Value, b: Value, sign: int) -> Value:
        exact = (a.exact[0] * b.exact[1] + sign * b.exact[0] * a.exact[1], a.exact[1] * b.exact[1]) if a.exact and b.exact else None
        return self.fraction(*exact) if exact else Value(tuple((x + sign * y) % p for x, y, (p, _) in zip(a.mod, b.mod, PLACES, strict=True)))

    def times(self, a: Value, b: Value) -> Value:
        return self.fraction(a.exact[0] * b.exact[0], a.exact[1] * b.exact[1]) if a.exact and b.exact else Value(tuple(x * y % p for x, y, (p, _) in zip(a.mod, b.mod, PLACES, strict=True)))

    def over(self, a: Value, b: Value) -> Value:
        if b.exact:
            if not b.exact[0]:
                raise Unreadable("division by zero")
            return self.times(a, self.fraction(b.exact[1], b.exact[0]))
        if not all(b.mod):
            raise Unreadable("division by zero")
        return Value(tuple(x * pow(y, -1, p) % p for x, y, (p, _) in zip(a.mod, b.mod, PLACES, strict=True)))

    def product(self) -> Value:
        v = self.signed_power()
        while self.at < len(self.parts):
            if self.peek("*"):
                self.at += 1
                v = self.times(v, self.signed_power())
            elif self.peek("/"):
                self.at += 1
                v = self.over(v, self.signed_power())
            elif self.peek("(", "{") or self.parts[self.at][0] in ("letter", "command"):
                v = self.times(v, self.power())
            elif self.parts[self.at][0] == "number" and self.parts[self.at - 1] != ("sign", "^") and self.parts[self.at - 1][0] != "number":
                v = self.times(v, self.power())
            else:
                break
        return v

    def signed_power(self) -> Value:
        negative = False
        while self.peek("+", "-"):
            negative ^= self.parts[self.at][1] == "-"
            self.at += 1
        v = self.power()
        return self.times(self.fraction(-1, 1), v) if negative else v

    def power(self) -> Value:
        v = self.atom()
        if self.peek("^"):
            self.at += 1
            e = self.signed_power()  # binds to the right
            if e.exact and e.exact[1] == 1 and abs(e.exact[0]) <= POWER:
                n = e.exact[0]
                if n < 0:
                    v, n = self.over(self.fraction(1, 1), v), -n
                small = v.exact and n * max(v.exact[0].bit_length(), v.exact[1].bit_length()) < 256
                return self.fraction(v.exact[0] ** n, v.exact[1] ** n) if small else Value(tuple(pow(x, n, p) for x, (p, _) in zip(v.mod, PLACES, strict=True)))
            if e.exact == (1, 2):
                return self.root(v, 2)
            return self.hashed("power", v.mod, e.mod)
        return v

    def root(self, v: Value, n: int) -> Value:
        if v.exact and v.exact[0] >= 0:
            found = [round(x ** (1 / n)) if x < 1 << 1000 else 0 for x in v.exact]
            for i, x in enumerate(v.exact):
                if n == 2:
                    found[i] = math.isqrt(x)
            if found[0] ** n == v.exact[0] and found[1] ** n == v.exact[1]:
                return self.fraction(*found)
            if n == 2:  # numbers under a root: the square part in front
                inside, front = v.exact[0] * v.exact[1], 1
                for k in range(2, 1000):
                    while inside % (k * k) == 0 and inside:
                        inside //= k * k
                        front *= k
                return self.times(self.fraction(front, v.exact[1]), self.hashed("root", 2, inside))
        return self.hashed("root", n, v.mod)

    def group(self) -> Value:
        """What stands in braces, or a single token without them."""
        if self.peek("{"):
            self.at += 1
            v = self.sum()
            self.take("}")
            return v
        if self.at < len(self.parts) and self.parts[self.at][0] == "number" and len(self.parts[self.at][1]) > 1 and self.parts[self.at][1].isdigit():
            digits = self.parts[self.at][1]  # \frac12
            self.parts[self.at] = ("number", digits[1:])
            return self.fraction(int(digits[0]), 1)
        return self.atom()

    def atom(self) -> Value:
        if self.at >= len(self.parts):
            raise Unreadable("something is missing")
        kind, text = self.parts[self.at]
        self.at += 1
        if kind == "number":
            whole, _, digits = text.partition(".")
            return self.fraction(int((whole + digits) or "0"), 10 ** len(digits))
        if kind == "letter":
            return Value(named("letter", text))
        if kind == "sign" and text in "({":
            v = self.sum()
            self.take(")" if text == "(" else "}")
            return v
        if kind == "command" and text in FRACTIONS:
            top = self.group()
            return self.over(top, self.group())
        if kind == "command" and text == "sqrt":
            n = 2
            if self.peek("(") and self.parts[self.at : self.at + 3][-1:] == [("sign", ")")] and self.parts[self.at + 1][0] == "number" and self.parts[self.at + 3 : self.at + 4] == [("sign", "{")]:
                n = int(float(self.parts[self.at + 1][1]))  # \sqrt[3]{...}
                self.at += 3
            return self.root(self.group(), n)
        if kind == "command" and text in FUNCTIONS:
            return self.hashed("function", text, self.group().mod)
        if kind == "command" and text in SYMBOLS:
            return Value(named("symbol", text))
        raise Unreadable(text)


@lru_cache(KNOWN)
def values(text: str | None) -> tuple[int, ...] | None:
    """The expression's values at all points, None if it can't be read."""
    if text is None:
        return None
    try:
        parts = tokens(text)
        while len(parts) > 2 and parts[1] == ("sign", "=") and parts[0][0] == "letter":
            parts = parts[2:]  # x = ...
        return Reader(list(parts)).whole().mod
    except (Unreadable, ValueError, RecursionError, OverflowError):
        return None


def same_expression(a: str | None, b: str | None) -> bool | None:
    """Whether two expressions are the same rational function; None if one of them can't be read."""
    x, y = values(a), values(b)
    return None if x is None or y is None else x == y


def expressions_equal(a: Column, b: Column) -> Column:
    """same_expression of two text columns, in Arrow batches; null where one can't be read."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([same_expression(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    run.__annotations__ = {}
    return F.pandas_udf(run, "boolean")(a, b)


def any_equal(answer: Column, golds: Column) -> Column:
    """Whether an answer is one of an array of right ones, as text or as an expression; false if it can't be read, null for null."""

    def run(given: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for a, right in zip(given, wanted, strict=True):
            if a is None or right is None:
                out.append(None)
            else:
                x = values(a)
                out.append(any(g is not None and (a == g or (x is not None and x == values(g))) for g in right))
        return pd.Series(out, dtype=object)

    run.__annotations__ = {}
    return F.pandas_udf(run, "boolean")(answer, golds)
