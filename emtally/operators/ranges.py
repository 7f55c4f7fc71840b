"""Operators over an order of all rows: an as-of join and exclusive prefix sums, without one task that sees them all.

Rows are dealt to ranges of their keys, each range is worked on by itself, and what one range hands to the next, a row for each
range, is put together on the driver: as many rows as there are partitions, whatever the input.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from emtally.sources.shared import written

_PART, _SIDE, _KEY, _VALUE, _LAST = "__part", "__side", "__key", "__value", "__last"


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, written in ranges of ``keys`` that follow one another, their number in a column. Rows of equal keys may be in
    several ranges, as a hash of the row is the last key: one key that most rows have is no hot range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, F.xxhash64(*df.columns))
    return written(dealt.withColumn(_PART, F.spark_partition_id()), "ranges")


def asof_join(left: DataFrame, right: DataFrame, on: str, at: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` that has the largest ``at`` not over the left's ``on``, of those equal
    in ``by``; nulls where there is none, or where ``on`` or a column of ``by`` is null. ``right`` has one row for each of its keys. The columns of ``left``,
    then ``at`` and the others of ``right`` that aren't in ``by``."""
    values = [c for c in right.columns if c not in by]
    schema = StructType([right.schema[c] for c in values])
    one = left.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col(on).cast("double" if "double" in (left.schema[on].dataType.simpleString(), right.schema[at].dataType.simpleString()) else "bigint").alias(_KEY), F.lit(1).alias(_SIDE), F.struct(*left.columns).alias("__row"), F.lit(None).cast(schema).alias(_VALUE))
    other = right.where(F.col(at).isNotNull()).select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col(at).cast(one.schema[_KEY].dataType).alias(_KEY), F.lit(0).alias(_SIDE), F.lit(None).cast(one.schema["__row"].dataType).alias("__row"), F.struct(*values).alias(_VALUE))
    names = [f"__by{i}" for i in range(len(by))]
    order = [*names, _KEY, _SIDE]
    rows = ranged(one.unionByName(other), *order)
    # the last row of the right side in each range, and so what was last before it
    found = F.when(F.col(_SIDE) == 0, F.struct(*names, _VALUE))
    ends = {r[_PART]: r[_LAST] for r in rows.groupBy(_PART).agg(F.max_by(found, F.when(F.col(_SIDE) == 0, F.struct(*order))).alias(_LAST)).collect()}
    before, carry = None, []
    for part in sorted(ends):
        carry.append((part, before))
        before = ends[part] if ends[part] is not None else before
    kind = StructType().add(_PART, IntegerType()).add("__before", rows.select(found.alias("x")).schema["x"].dataType)
    within = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(carry, kind)), _PART).withColumn(_LAST, F.coalesce(F.last(found, True).over(within), "__before")).where(F.col(_SIDE) == 1)
    # what was last may be of another group; a null is equal to none
    same = F.col(_KEY).isNotNull() & F.col(f"{_LAST}.{_VALUE}").isNotNull()
    for c in names:
        same = same & F.coalesce(F.col(c) == F.col(f"{_LAST}.{c}"), F.lit(False))
    value = F.when(same, F.col(f"{_LAST}.{_VALUE}"))
    return joined.select(*(F.col("__row")[c].alias(c) for c in left.columns), *(value[c].alias(c) for c in values))


def exclusive_sums(df: DataFrame, value: str, start: str, *keys: str) -> DataFrame:
    """``df`` with ``start``, the sum of ``value`` (integers; null is 0) over all rows before it in the order of ``keys``; equal keys are ordered by all columns."""
    n = F.coalesce(F.col(value), F.lit(0)).cast("long")
    rows = ranged(df, *keys)
    sums = {r[_PART]: r["n"] for r in rows.groupBy(_PART).agg(F.sum(n).alias("n")).collect()}
    before, carry = 0, []
    for part in sorted(sums):
        carry.append((part, before))
        before += sums[part]
    within = Window.partitionBy(_PART).orderBy(*keys, F.xxhash64(*df.columns), *(c for c in df.columns if c not in keys)).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(carry, f"{_PART} int, __before long")), _PART)
    return joined.select(*df.columns, (F.col("__before") + F.sum(n).over(within) - n).alias(start))
