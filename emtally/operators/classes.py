"""Conditional probabilities of mappings, and equivalence classes of fragments."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emtally.functions.fraglen import TINY
from emtally.functions.libtype import compatible

#: Stands for the read length of a mapping whose mate is to its left.
READ_LENGTH = 100


def conditional_probabilities(alignments: DataFrame, targets: DataFrame, lengths: DataFrame) -> DataFrame:
    """``alignments`` with prob. A forward mapping has the chance of a fragment no longer than what is left of the
    target, a reverse one that of what is before it, a pair facing inwards that of its length; others next to none.
    ``lengths`` has SLOTS rows and is broadcast; how ``targets`` is joined is left to its size."""
    single = F.col("ori").isin(1, 2)
    key = F.when(F.col("ori") == 1, F.col("len") - F.col("pos")).when(F.col("ori") == 2, F.col("pos") + READ_LENGTH).when(F.col("ori").isin(3, 4), F.col("frag_len").cast("long"))
    joined = alignments.join(targets.select("ref_id", "len"), "ref_id").withColumn("slot", key)
    table = F.broadcast(lengths.select(F.col("frag_len").cast("long").alias("slot"), "pdf", "cdf"))
    prob = F.when(single, F.coalesce("cdf", F.lit(1.0))).when(F.col("ori").isin(3, 4), F.coalesce("pdf", F.lit(TINY))).otherwise(F.lit(2 * TINY))
    return joined.join(table, "slot", "left").withColumn("prob", prob).drop("slot", "pdf", "cdf", "len")


def _labels(alignments: DataFrame, lib_type: str, value: Column) -> DataFrame:
    """Per fragment its accepted mappings in the order of the file. A fragment without one stays, with an empty list:
    it is a class of its own. Not accepted mappings are dropped as the list is collected, not before. ``alignments`` may be nested, where
    ``value`` needs no column: the lists are there."""
    if "mappings" in alignments.columns:
        return alignments.select(F.transform(F.filter("mappings", lambda x: compatible(lib_type, x["ori"])), lambda x: F.struct(x["ref_id"].alias("ref_id"), x["ori"].alias("ori"), value.alias("prob"))).alias("m"))
    kept = F.when(compatible(lib_type, F.col("ori")), F.struct("aln_idx", "ref_id", "ori", value.alias("prob")))
    return alignments.groupBy("frag_id").agg(F.array_sort(F.collect_list(kept)).alias("m"))


def basic_classes(alignments: DataFrame, lib_type: str) -> DataFrame:
    """(targets, oris, n): fragments (of either form) by the sequence of their targets and orientations."""
    label = _labels(alignments, lib_type, F.lit(1.0)).select(F.transform("m", lambda x: x["ref_id"]).alias("targets"), F.transform("m", lambda x: x["ori"]).alias("oris"))
    return label.groupBy("targets", "oris").agg(F.count("*").alias("n"))


def bins_of(probs: Column, bins: int) -> Column:
    """Each probability's share of the sum, as one of ``bins`` equal bins; the sum is added up in the array's order. Without mass all are in bin 0."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    share = lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))
    return F.transform(probs, lambda x: F.when(share(x) >= 1, F.lit(bins - 1)).otherwise(F.floor(share(x) * bins).cast("int")))


def range_classes(with_probs: DataFrame, lib_type: str, bins: int = 64) -> DataFrame:
    """(targets, bins, oris, n): basic classes split by the binned probabilities of their mappings."""
    label = _labels(with_probs, lib_type, F.col("prob")).select(
        F.transform("m", lambda x: x["ref_id"]).alias("targets"), bins_of(F.transform("m", lambda x: x["prob"]), bins).alias("bins"), F.transform("m", lambda x: x["ori"]).alias("oris")
    )
    return label.groupBy("targets", "bins", "oris").agg(F.count("*").alias("n"))


def packed(classes: DataFrame, bins: int = 1) -> DataFrame:
    """(targets, probs, n): orientations left out, rows not merged; a bin's probability is that of its centre, a basic class's 1."""
    if "bins" in classes.columns:
        probs = F.transform("bins", lambda b: b / F.lit(float(bins)) + F.lit(0.5 / bins))
    else:
        probs = F.transform("targets", lambda t: F.lit(1.0))
    return classes.select("targets", probs.alias("probs"), "n")


def totals(classes: DataFrame) -> DataFrame:
    """(classes, weight): rows, told apart by orientation, and fragments."""
    return classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("weight"))
