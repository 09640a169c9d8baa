"""Ordered scans over array columns: linear recurrences as parallel scans, the rest as higher-order folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import recurrences as R


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening: masked elements carry the next value and the advantage through."""
    return R.scan_arrays(R.gae_maps(gamma, lam), 3, 1, rewards, values, mask)


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted sums; the running return starts again at 0 after a masked element."""
    return R.scan_arrays(R.return_maps(gamma), 3, 0, rewards, mask)


def suffix_sums(rewards: Column, mask: Column) -> Column:
    """For each element the sum of the masked rewards from it to the end."""
    return R.scan_arrays(R.sum_maps(), 2, 0, rewards, mask)


def response_mask(ids: Column, ends: Column) -> Column:
    """1 up to and including the first element that is among ends, then 0."""

    last = F.array_position(F.transform(ids, lambda x: F.coalesce(F.array_contains(ends, x), F.lit(False))), True)
    # An array of one is a name for the place, which is sought once.
    return F.transform(F.array(last), lambda p: F.transform(ids, lambda _, i: F.when((p > 0) & (i >= p), 0).otherwise(1)))[0]


def turn_weighted_score(scores: Column) -> Column:
    """-1 with at most two scores; else the last weighs 0.6 and the others share 0.4."""
    n = F.size(scores)
    others = F.aggregate(F.slice(scores, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(n <= 2, -1.0).otherwise(others * 0.4 / (n - 1) + F.get(scores, n - 1) * 0.6)


def adaptive_kl(kls: Column, start: float, target: float, horizon: float, n_steps: int) -> Column:
    """The coefficient after all updates in order: each multiplies by 1 + clip(kl / target - 1, -0.2, 0.2) n / horizon."""

    def step(a: Column, x: Column) -> Column:
        error = F.least(F.greatest(x / target - 1, F.lit(-0.2)), F.lit(0.2))
        return a * (1 + error * n_steps / horizon)

    return F.aggregate(kls, F.lit(start), step)


def waiting_times(at: np.ndarray, cost: np.ndarray, rate: float, size: float) -> np.ndarray:
    """Waits of requests in order. What the bucket has, plus all costs and less all refills so far, is the least of what it
    would be if it had been full at one of the requests: a running minimum."""
    if not len(at):
        return np.zeros(0)
    refilled, spent = (at - at[0]) * rate, np.cumsum(cost)
    have = refilled - spent + np.minimum.accumulate(size + (spent - cost) - refilled)
    return np.maximum(0.0, -have / rate)


def token_bucket(arrivals: Column, rate: float, size: float) -> Column:
    """Waiting time of each request (at, cost) of an ordered array: the bucket refills at `rate` up to `size`, and a
    request takes its cost at once, waiting until the debt would be paid. Linear in the requests; null for null."""

    def run(at: pd.Series, cost: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else waiting_times(np.asarray(a, np.float64), np.asarray(c, np.float64), rate, size) for a, c in zip(at, cost, strict=True)], dtype=object)

    run.__annotations__ = {}
    part = lambda n: F.transform(arrivals, lambda x: x[n].cast("double"))
    return F.pandas_udf(run, "array<double>")(part("at"), part("cost"))


def mismatches(a: Column, b: Column, mask: Column) -> Column:
    """At how many masked places two arrays differ."""
    differ = F.zip_with(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), mask, lambda x, m: x * m)
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x)


def last_elements(a: Column, n: int) -> Column:
    """The last n elements (all if fewer)."""
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - (n - 1)), F.lit(n))


def at_last(n: Column, value: Column) -> Column:
    """An array of n zeros but for the value at its end."""
    # Not by a lambda that asks for n: it would be counted again for each element.
    some = F.concat(F.array_repeat(F.lit(0.0), (n - 1).cast("int")), F.array(value))
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(some)
