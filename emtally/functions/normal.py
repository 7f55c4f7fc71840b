"""The normal distribution as expressions: mean and deviation may be columns, one for each sample."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Step and terms of the sum that stands for the integral of erfc; terms of the series near 0. Error of erf: under 1e-15.
STEP, TERMS, SERIES = 0.5, 12, 15


def erf(x: Column) -> Column:
    """The error function: near 0 its series, elsewhere 1 - erfc by a sum of Gaussian terms at equal steps, whose own
    error is known in closed form and taken off. Null stays null."""
    a = F.abs(x)
    square = a * a
    term, series = a, a
    for k in range(1, SERIES + 1):
        term = term * (2 * square) / F.lit(2 * k + 1.0)
        series = series + term
    near = F.lit(2 / math.sqrt(math.pi)) * F.exp(-square) * series
    total = F.lit(0.5) / F.greatest(square, F.lit(0.25))
    for k in range(1, TERMS + 1):
        at = (k * STEP) ** 2
        total = total + F.lit(math.exp(-at)) / (F.lit(at) + square)
    beyond = F.exp(F.lit(2 * math.pi / STEP) * F.least(a, F.lit(6.0))) - 1
    far = 1 - (F.lit(2 * STEP / math.pi) * a * F.exp(-square) * total - F.lit(2.0) / F.greatest(beyond, F.lit(1.0)))
    return F.when(a < 0.75, near).when(a < 6, far).when(a >= 6, F.lit(1.0)) * F.signum(x)


def density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(F.lit(-0.5) * z * z) / (sd * F.lit(math.sqrt(2 * math.pi)))


def below(x: Column, mean: Column, sd: Column) -> Column:
    """The chance of a value of at most x."""
    return F.lit(0.5) * (1 + erf((x - mean) / (sd * F.lit(math.sqrt(2)))))


def between(low: Column, high: Column, mean: Column, sd: Column) -> Column:
    """The chance of a value from low to high."""
    root = sd * F.lit(math.sqrt(2))
    return F.lit(0.5) * (erf((high - mean) / root) - erf((low - mean) / root))
