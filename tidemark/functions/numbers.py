"""Ratios, money sums, circular hours and the normal distribution as columns."""

from math import pi, sqrt
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """``numerator / denominator`` as a double, NULL where the denominator is zero."""
    quotient = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return quotient if digits is None else F.round(quotient, digits)


def circular_hour(mean_sin: Column, mean_cos: Column) -> Column:
    """The hour in [0, 24) a mean unit vector points at."""
    return F.pmod(F.atan2(mean_sin, mean_cos) * 24.0 / (2 * F.pi()) + 24.0, F.lit(24.0))


def hours_apart(a: Column, b: Column) -> Column:
    """Distance on the 24-hour circle, at most 12."""
    direct = F.abs(a - b) % 24.0
    return F.least(direct, 24.0 - direct)


def normal_quantile(probability: float) -> float:
    return NormalDist().inv_cdf(probability)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) from built-in functions, as Spark has no error function.

    Up to 3 the series of the error function is summed, beyond it the continued fraction
    of its complement is evaluated from the inside out; both converge to a double there.
    """
    x = F.abs(z) / sqrt(2.0)
    envelope = F.exp(-x * x) / sqrt(pi)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda s, n: F.struct(
            (s["term"] * 2 * x * x / (2 * n + 1)).alias("term"),
            (s["total"] + s["term"] * 2 * x * x / (2 * n + 1)).alias("total"),
        ),
        lambda s: s["total"],
    )
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), x, lambda f, n: x + n / 2 / f)
    above = F.when(x < 3 / sqrt(2.0), 0.5 - envelope * series).otherwise(0.5 * envelope / fraction)
    return F.when(z < 0, 1 - above).otherwise(above)
