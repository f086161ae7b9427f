"""Column functions over probability vectors stored as ARRAY<DOUBLE>."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The floor under a logarithm and the divergence guard.
EPSILON = 1e-12
VARIANCE_FLOOR = 1e-6


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a column.

    An expression used several times, or inside a lambda over an array, would
    otherwise be evaluated again at every use.
    """
    return F.transform(F.array(value), body)[0]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def max_prob(p: Column) -> Column:
    return F.array_max(p)


def argmax_state(p: Column) -> Column:
    """Index of the largest entry; the lowest index wins a tie."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy(p: Column) -> Column:
    clipped = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(EPSILON)), F.lit(1.0)))
    return -F.aggregate(clipped, F.lit(0.0), lambda acc, x: acc + x * F.ln(x))


def temper(p: Column, temperature: float | Column) -> Column:
    """p to the power 1/T, rescaled to sum to one; unchanged unless T > 1."""
    heat = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powered = F.transform(
        p,
        lambda x: F.exp(F.ln(F.least(F.greatest(x, F.lit(EPSILON)), F.lit(1.0))) / heat),
    )
    shares = let(powered, lambda w: let(array_sum(w), lambda total: F.transform(w, lambda x: x / total)))
    return F.when(heat > 1.0, shares).otherwise(p)


def l1_distance(p: Column, q: Column) -> Column:
    return array_sum(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def jensen_shannon(p: Column, q: Column) -> Column:
    def divergence(a: Column, middle: Column) -> Column:
        terms = F.zip_with(
            a,
            middle,
            lambda x, m: F.when(x > EPSILON, x * F.ln(x / (m + EPSILON))).otherwise(0.0),
        )
        return array_sum(terms)

    middle = F.zip_with(p, q, lambda a, b: (a + b) * 0.5)
    return let(middle, lambda m: (divergence(p, m) + divergence(q, m)) * 0.5)


DISTANCES = {"l1": l1_distance, "jsd": jensen_shannon}


def distance(p: Column, q: Column, metric: str = "jsd") -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"unknown metric {metric!r}; choose one of {sorted(DISTANCES)}")
    return DISTANCES[metric](p, q)


def log_sum_exp(values: Column) -> Column:
    def summed(v: Column, peak: Column) -> Column:
        return peak + F.ln(array_sum(F.transform(v, lambda x: F.exp(x - peak))))

    return let(values, lambda v: let(F.array_max(v), lambda peak: summed(v, peak)))


def softmax(values: Column) -> Column:
    return let(
        values,
        lambda v: let(log_sum_exp(v), lambda total: F.transform(v, lambda x: F.exp(x - total))),
    )


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def gaussian_log_density(x: Column, mean: Sequence[float], variance: Sequence[float]) -> Column:
    """Log density of ARRAY x under one diagonal Gaussian with known parameters."""
    total = F.lit(-0.5 * len(mean) * math.log(2 * math.pi))
    for d, (mu, var) in enumerate(zip(mean, variance)):
        s2 = max(float(var), VARIANCE_FLOOR)
        gap = x[d] - F.lit(float(mu))
        total = total - F.lit(0.5 * math.log(s2)) - gap * gap / F.lit(2 * s2)
    return total


def log_densities(x: Column, means, variances) -> Column:
    return F.array(*[gaussian_log_density(x, m, v) for m, v in zip(means, variances)])
