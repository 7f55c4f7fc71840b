"""Transcripts per million."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tpm(estimates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``estimates`` (ref_id, eff_len, ecount) with tpm: a million times each share of count per length. A length of
    0 or less gives 0, and so does a sample without counts. Without ``by`` the total is one row, joined to all: the
    estimates are read twice and should be a written table."""
    rate = F.when(F.col("eff_len") > 0, F.col("ecount") / F.col("eff_len")).otherwise(F.lit(0.0))
    rated = estimates.withColumn("rate", rate)
    if by:
        rated = rated.withColumn("total", F.sum("rate").over(Window.partitionBy(*by)))
    else:
        rated = rated.crossJoin(F.broadcast(rated.agg(F.sum("rate").alias("total"))))
    return rated.withColumn("tpm", F.coalesce(F.try_divide(F.lit(1e6) * F.col("rate"), F.col("total")), F.lit(0.0))).drop("rate", "total")
