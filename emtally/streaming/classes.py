"""Basic equivalence classes over a stream of fragments: counts add up, so they can be kept as fragments arrive."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.functions.libtype import codes


def streamed_classes(nested: DataFrame, lib_type: str) -> DataFrame:
    """(targets, oris, n) of a streaming DataFrame in the form of ``fragments``, for output modes complete and update."""
    kept = nested.select(F.filter("mappings", lambda m: m["ori"].isin(codes(lib_type))).alias("m"))
    return kept.select(F.transform("m", lambda x: x["ref_id"]).alias("targets"), F.transform("m", lambda x: x["ori"]).alias("oris")).groupBy("targets", "oris").agg(F.count("*").alias("n"))
