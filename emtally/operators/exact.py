"""Sums of doubles that don't depend on the order of the rows: the same to the last bit however they are partitioned.

A double is cut into at most three integers, each a multiple of a power of 2**32. Integers of one power are summed as such,
in any order and partly before the shuffle; the few sums of a key are put together exactly and rounded once, so the result
is the double nearest to the true sum, as ``math.fsum`` gives it. A key may have up to 2**30 rows.
"""

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 32
#: Smaller values are scaled up before they are cut, so that no power of two underflows.
_SMALL, _SCALE = 2.0**-900, 4


def parts(x: Column) -> Column:
    """array<struct<power int, n long>>: integers that, each times 2**(32 * power), sum to ``x``; empty for null and 0."""
    small = F.abs(x) < _SMALL
    big = F.when(small, x * F.lit(2.0 ** (_BITS * _SCALE))).otherwise(x)
    top = (F.floor(F.log2(F.abs(big)) / _BITS)).cast("int")
    found, left = [], big
    for i in range(3):
        power = top - i
        unit = F.pow(F.lit(2.0), (power * _BITS).cast("double"))
        n = F.when(left >= 0, F.floor(left / unit)).otherwise(F.ceil(left / unit)).cast("long")
        found.append(F.struct(F.when(small, power - _SCALE).otherwise(power).alias("power"), n.alias("n")))
        left = left - n.cast("double") * unit
    return F.when(x.isNotNull() & (x != 0), F.filter(F.array(*found), lambda p: p["n"] != 0)).otherwise(F.array().cast("array<struct<power:int,n:bigint>>"))


def _rounded(sums: pa.ListArray) -> list[float]:
    """The double nearest to each list's sum of n * 2**(32 * power). Halves of n are doubles of their own, so fsum is exact; where
    one of them is too large for a double, the sum is taken as a fraction."""
    flat, ends = sums.flatten(), np.append(0, np.cumsum(sums.value_lengths().to_numpy(zero_copy_only=False))).tolist()
    power, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("power", "n"))
    high = n >> 32
    with np.errstate(over="ignore"):
        halves = np.column_stack([np.ldexp(high.astype(float), _BITS * (power + 1)), np.ldexp((n - (high << 32)).astype(float), _BITS * power)]).ravel().tolist()
    out = []
    for a, b in zip(ends, ends[1:]):
        try:
            total = math.fsum(halves[2 * a : 2 * b])
        except (OverflowError, ValueError):
            total = math.inf
        out.append(total if math.isfinite(total) else float(sum(Fraction(int(n[i])) * Fraction(2) ** (_BITS * int(power[i])) for i in range(a, b))))
    return out


def exact_sum(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(*keys, name): the sum of finite doubles by ``keys``, correctly rounded; null and 0 add nothing, and a sum of nothing is 0."""
    cut = df.select(*keys, F.explode_outer(parts(value)).alias("p"))
    sums = cut.groupBy(*keys, F.coalesce("p.power", F.lit(0)).alias("power")).agg(F.sum(F.coalesce("p.n", F.lit(0))).alias("n"))
    each = sums.groupBy(*keys).agg(F.collect_list(F.struct("power", "n")).alias("sums"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _rounded(batch.column("sums"))
            yield pa.record_batch([*(batch.column(k) for k in keys), pa.array(out, pa.float64())], names=[*keys, name])

    schema = ", ".join([*(f"`{k}` {df.select(k).schema[0].dataType.simpleString()}" for k in keys), f"`{name}` double"])
    return each.mapInArrow(total, schema)


def em_step(pairs: DataFrame, abundance: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, ref_id, a) after a step of the EM from ``abundance``, every sum exact: bit for bit the same over any partitions.
    eq_id tells classes of all samples apart; classes with a denominator of ``least`` or less are skipped."""
    keys = [*by, "ref_id"]
    weighted = pairs.join(abundance, keys).select(*keys, "eq_id", "n", (F.col("w") * F.col("a")).alias("w"))
    denominators = exact_sum(weighted, ["eq_id"], F.col("w"), "denominator").where(F.col("denominator") > least)
    given = exact_sum(weighted.join(denominators, "eq_id"), keys, F.col("n") * F.col("w") / F.col("denominator"), "a")
    return abundance.select(*keys).join(given, keys, "left").select(*keys, F.coalesce("a", F.lit(0.0)).alias("a"))


def tpm(estimates: DataFrame) -> DataFrame:
    """``estimates`` (ref_id, eff_len, ecount) with tpm, as ``operators.tpm`` has it, the total an exact sum."""
    rated = estimates.withColumn("rate", F.when(F.col("eff_len") > 0, F.col("ecount") / F.col("eff_len")).otherwise(F.lit(0.0)))
    total = exact_sum(rated.withColumn("one", F.lit(1)), ["one"], F.col("rate"), "total").select("total")
    return rated.crossJoin(F.broadcast(total)).withColumn("tpm", F.coalesce(F.try_divide(F.lit(1e6) * F.col("rate"), F.col("total")), F.lit(0.0))).drop("rate", "total")  # one row
