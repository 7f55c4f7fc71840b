"""Fragment-length distributions, conditional means and effective lengths.

Tables here have one row per fragment length below SLOTS, whatever the input; windows over all their rows
and broadcasts of them are bounded by that.
"""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emtally.functions import normal
from emtally.operators.ranges import asof_join, exclusive_sums

SLOTS = 65_536
#: Smallest positive normal double.
TINY = 2.2250738585072014e-308


def _so_far():
    """All lengths up to each; SLOTS rows at most."""
    return Window.orderBy("frag_len").rowsBetween(Window.unboundedPreceding, 0)


def dense(histogram: DataFrame) -> DataFrame:
    """(frag_len, n) for every length, 0 where ``histogram`` has none."""
    slots = histogram.sparkSession.range(0, SLOTS, 1, 1).select(F.col("id").cast("int").alias("frag_len"))
    return slots.join(F.broadcast(histogram.where(F.col("frag_len").between(0, SLOTS - 1))), "frag_len", "left").select("frag_len", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def empirical(histogram: DataFrame, integer_cdf: bool = False) -> DataFrame:
    """(frag_len, pdf, cdf). The cdf is the running sum of the pdf, or with ``integer_cdf`` that of the counts over their total."""
    table = dense(histogram).withColumn("total", F.sum("n").over(Window.partitionBy()))
    pdf = (F.col("n") + F.lit(TINY)) / (F.col("total") + F.lit(TINY * SLOTS))
    table = table.withColumn("pdf", pdf)
    if integer_cdf:
        cdf = F.coalesce(F.try_divide(F.sum("n").over(_so_far()).cast("double"), F.col("total").cast("double")), (F.col("frag_len") + 1) / F.lit(float(SLOTS)))
    else:
        cdf = F.sum("pdf").over(_so_far()) + F.lit(TINY)
    return table.select("frag_len", "pdf", cdf.alias("cdf"))


def _density(mean: float, sd: float):
    x = (F.col("frag_len") - F.lit(float(mean))) / F.lit(float(sd))
    between = 0.5 * (math.erf((SLOTS - mean) / (sd * math.sqrt(2))) - math.erf(-mean / (sd * math.sqrt(2))))
    normal = F.exp(F.lit(-0.5) * x * x) / F.lit(sd * math.sqrt(2 * math.pi))
    return normal / F.lit(float(sd)) / F.lit(between)


def moments(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, mean, sd) of the lengths of ``histogram`` (*by, frag_len, n): sums of integers, so the same in any order."""
    n, x = F.col("n").cast("long"), F.col("frag_len").cast("long")
    sums = histogram.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * x * x).alias("xx"))
    mean = F.col("x").cast("double") / F.col("n")
    # n * sum of squares less the square of the sum, over n squared: of decimals, so nothing cancels
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    spread = (wide("n") * wide("xx") - wide("x") * wide("x")).cast("double") / F.col("n") / F.col("n")
    return sums.where("n > 0").select(*by, mean.alias("mean"), F.sqrt(spread).alias("sd"))


def parametric_lengths(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``histogram`` (*by, frag_len, n) with pdf and cdf of the normal distribution, cut to [0, SLOTS], that has the mean
    and deviation of its sample. Samples without spread have no such distribution and are left out."""
    fitted = moments(histogram, by).where("sd > 0")
    joined = histogram.join(fitted, list(by)) if by else histogram.crossJoin(F.broadcast(fitted))  # one row
    x, mean, sd, low, high = F.col("frag_len").cast("double"), F.col("mean"), F.col("sd"), F.lit(0.0), F.lit(float(SLOTS))
    inside = normal.between(low, high, mean, sd)
    return joined.select(*by, "frag_len", "n", "mean", "sd", (normal.density(x, mean, sd) / inside).alias("pdf"), (normal.between(low, x, mean, sd) / inside).alias("cdf"))


def parametric(spark: SparkSession, mean: float, sd: float) -> DataFrame:
    """(frag_len, pdf, cdf) of a normal distribution cut to [0, SLOTS]."""
    slots = spark.range(0, SLOTS, 1, 1).select(F.col("id").cast("int").alias("frag_len"))
    return slots.withColumn("pdf", _density(mean, sd)).withColumn("cdf", F.sum("pdf").over(_so_far()))


def _means(weighted: DataFrame) -> DataFrame:
    mean = F.try_divide(F.sum(F.col("frag_len") * F.col("w")).over(_so_far()), F.sum("w").over(_so_far()))
    return weighted.select("frag_len", F.when(F.col("frag_len") == 0, F.lit(0.0)).otherwise(F.coalesce(mean, F.lit(0.0))).cast("double").alias("mean"))


def conditional_means(histogram: DataFrame) -> DataFrame:
    """(frag_len, mean): the mean length of the fragments that are no longer; 0 where there is none."""
    return _means(dense(histogram).select("frag_len", F.col("n").cast("double").alias("w")))


def parametric_means(spark: SparkSession, mean: float, sd: float) -> DataFrame:
    return _means(spark.range(0, SLOTS, 1, 1).select(F.col("id").cast("int").alias("frag_len")).withColumn("w", _density(mean, sd)))


def sparse_means(histogram: DataFrame) -> DataFrame:
    """(frag_len, mean) of ``conditional_means`` at the lengths that ``histogram`` (frag_len, n) has, however many there may be."""
    n, x = F.col("n").cast("long"), F.col("frag_len").cast("long")
    sums = exclusive_sums(histogram.where("n > 0").select("frag_len", n.alias("n"), (n * x).alias("x")), "n", "n_before", "frag_len")
    sums = exclusive_sums(sums, "x", "x_before", "frag_len")
    mean = (F.col("x_before") + F.col("x")).cast("double") / (F.col("n_before") + F.col("n"))
    return sums.select("frag_len", F.when(F.col("frag_len") == 0, F.lit(0.0)).otherwise(mean).alias("mean"))


def effective_lengths_sparse(targets: DataFrame, histogram: DataFrame) -> DataFrame:
    """``effective_lengths`` from a sparse histogram: each target takes the mean of the longest length that isn't over its own."""
    at = asof_join(targets.withColumn("slot", F.least("len", F.lit(SLOTS - 1))), sparse_means(histogram), "slot", "frag_len")
    less = F.col("len") - F.coalesce("mean", F.lit(0.0))
    return at.withColumn("eff_len", F.when(less < 1, F.col("len").cast("double")).otherwise(less)).drop("slot", "frag_len", "mean")


def effective_lengths(targets: DataFrame, means: DataFrame) -> DataFrame:
    """``targets`` with eff_len: the length less its conditional mean (that of the last slot for longer targets), or the length where that is under 1."""
    at = targets.withColumn("frag_len", F.least("len", F.lit(SLOTS - 1)).cast("int"))
    less = F.col("len") - F.col("mean")
    return at.join(F.broadcast(means), "frag_len", "left").withColumn("eff_len", F.when(less < 1, F.col("len").cast("double")).otherwise(less)).drop("frag_len", "mean")
