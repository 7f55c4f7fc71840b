"""Fixed decimals of doubles in the JVM, rounded from the binary value: to the nearest, half to even, as C's printf does.

Spark's own format_string and round start from the shortest decimal that stands for the double, and round its half up."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values from here on (or their negatives) have no fixed form here: it is null.
BEYOND = 2.0**63


def _halves(x: Column) -> tuple[Column, Column]:
    """Two numbers of half as many bits that sum to x."""
    c = F.lit(134217729.0) * x
    high = c - (c - x)
    return high, x - high


def fixed(x: Column, digits: int = 3) -> Column:
    """``x`` with so many digits (1 to 9) after the point. Null stays null, and so do values that aren't finite or from BEYOND on."""
    scale = 10**digits
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole.cast("double")
    # the product of the fraction and the scale, and what rounding took from it: both exact
    product = part * F.lit(float(scale))
    (high, low), (a, b) = _halves(part), _halves(F.lit(float(scale)))
    error = ((high * a - product) + high * b + low * a) + low * b
    down = F.floor(product)
    over, limit = product - down.cast("double") - 0.5, -error
    n = F.when((over > limit) | ((over == limit) & (down % 2 == 1)), down + 1).otherwise(down)
    units, rest = F.when(n == scale, whole + 1).otherwise(whole), F.when(n == scale, F.lit(0).cast("long")).otherwise(n)
    # -0.0 and what rounds to it keep their sign, as in C
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    said = F.concat(sign, units.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))
    return F.when(size < BEYOND, said)
