"""Values of policy losses, divergences and importance weights as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUND = 20.0
POLICY_LOSSES: dict[str, Callable[..., Column]] = {}


def policy_loss(name: str):
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if POLICY_LOSSES.get(name, f) is not f:
            raise ValueError(f"{name} is taken")
        POLICY_LOSSES[name] = f
        return f

    return add


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_column(lo)), as_column(hi))


def kl_penalty(log_p: Column, reference: Column, kind: str) -> Column:
    """k1, abs, k2 (mse) or k3 (low_var_kl); a trailing + only matters for gradients."""
    d = log_p - reference
    kind = kind.rstrip("+")
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        back = clip(-d, -BOUND, BOUND)
        return clip(F.exp(back) - back - 1, -10.0, 10.0)
    raise NotImplementedError(kind)


def ratio(log_p: Column, old: Column) -> Column:
    return F.exp(clip(log_p - old, -BOUND, BOUND))


@policy_loss("vanilla")
def vanilla(log_p: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """The clipped loss, bounded by -dual A where A is negative."""
    q = ratio(log_p, old)
    upper = F.greatest(-advantage * q, -advantage * clip(q, 1 - low, 1 + high))
    return F.when(advantage < 0, F.least(upper, -advantage * dual)).otherwise(upper)


@policy_loss("gpg")
def gpg_loss(log_p: Column, old: Column, advantage: Column) -> Column:
    return -log_p * advantage


def sequence_ratio(log_p: Column, old: Column, sequence_mean: Column, top: float = 10.0) -> Column:
    """Ratio whose value is the sequence's geometric mean, clamped above in logs."""
    return F.exp(F.least(sequence_mean, F.lit(top)))


def value_loss(value: Column, old: Column, returns: Column, span: float) -> Column:
    clipped = clip(value, old - span, old + span)
    return 0.5 * F.greatest((value - returns) ** 2, (clipped - returns) ** 2)


def entropy(logits: Column) -> Column:
    """logsumexp - sum(p logit) of an array."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    mean = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top) * x) / total
    return top + F.log(total) - mean


def log_prob_of(logits: Column, label: Column) -> Column:
    """Log-softmax of an array at a 0-based index."""
    top = F.array_max(logits)
    return F.get(logits, label) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def dpo_loss(chosen: Column, rejected: Column, beta: float, smoothing: float = 0.0) -> Column:
    """-(1 - s) log sigmoid(beta d) - s log sigmoid(-beta d), d being chosen - rejected."""
    x = beta * (chosen - rejected)
    log_sigmoid = lambda v: -(F.greatest(-v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v))))
    return -log_sigmoid(x) * (1 - smoothing) - log_sigmoid(-x) * smoothing


def ipo_loss(chosen: Column, rejected: Column, beta: float) -> Column:
    return (chosen - rejected - 1 / (2 * beta)) ** 2


def sppo_loss(log_ratio_sum: Column, reward: Column, eta: float) -> Column:
    return (log_ratio_sum - eta * reward) ** 2


def bce(p: Column, y: Column) -> Column:
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def overlong_penalty(length: Column, expected: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - expected) / buffer * factor, F.lit(0.0))


def workload(length: Column) -> Column:
    return 24576 * length + length * length


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / b).cast("long")


def round_up(a: Column, b: int) -> Column:
    return ceil_div(a, b) * b


def importance_weight(log_ratio: Column, top: float) -> Column:
    """exp of the clamped log ratio, truncated above."""
    return F.least(F.exp(clip(log_ratio, -BOUND, BOUND)), F.lit(top))


def accepted(weight: Column, hi: float, lo: float | None = None) -> Column:
    lo = 1 / hi if lo is None else lo
    return (weight >= lo) & (weight <= hi)


def object_count_reward(n: Column, final_turn: Column) -> Column:
    """15 or more: 1; 5 to 14: (n - 5) / 10; fewer: -1."""
    return F.when(n >= 15, 1.0).when(n >= 5, (n - 5) / 10.0).otherwise(-1.0)


def voxel_reward(loss: Column, threshold: float = 0.01, worst: float = 0.1) -> Column:
    """1 below the threshold, then falling linearly to -1 at the worst."""
    return F.when(loss < threshold, 1.0).when(loss < worst, 1.0 - 2.0 * (loss - threshold) / (worst - threshold)).otherwise(-1.0)


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots (x, y), constant outside."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (a, ya), (b, yb) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= b, ya + (yb - ya) * (x - a) / (b - a))
    return out.otherwise(F.lit(knots[-1][1]))


def kl_reward(score: Column, log_p: Column, reference: Column, beta: float) -> Column:
    """Score less beta times the log ratio to the reference."""
    return score - beta * (log_p - reference)


def geometric_mean_loss(log_p: Column, old: Column, advantage: Column, mask: Column, limit: float) -> Column:
    """An aggregate over a sequence: minus mean advantage times the geometric mean of ratios, whose logs are cut at the limit
    on the side that the advantage's sign gains from."""
    step = F.when(advantage >= 0, F.least(log_p - old, F.lit(limit))).otherwise(F.greatest(log_p - old, F.lit(-limit)))
    n = F.sum(mask) + 1e-8
    return -(F.sum(advantage * mask) / n) * F.exp(F.sum(step * mask) / n)


def sequence_log_prob(log_p: Column, on: Column, mean: bool = False) -> Column:
    """An aggregate over a sequence: the log-probabilities of the tokens that are on, added up or averaged."""
    kept = F.when(on, log_p)
    return F.avg(kept) if mean else F.sum(kept)


def flow_loss(log_p: Column, old: Column, advantage: Column, log_z: float = 0.5, beta: float = 15.0, limit: float = 10.0) -> Column:
    """Squared flow balance of mean log-probabilities and advantage, weighted by the ratio up to a limit."""
    return F.least(F.exp(log_p - old), F.lit(limit)) * (log_z + log_p - beta * advantage - old) ** 2


def shape_reward(corners: Column) -> Column:
    """1 for a room of four corners, a half for six or eight, else -1."""
    return F.when(corners == 4, 1.0).when(corners.isin(6, 8), 0.5).otherwise(-1.0)


def rate_reward(rate: Column, limit: float) -> Column:
    """1 where nothing fails, down to 0 at the limit, then down to -1 where all does."""
    return F.when(rate == 0, 1.0).when(rate <= limit, 1 - rate / limit).otherwise(-(rate - limit) / (1 - limit))
