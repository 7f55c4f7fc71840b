"""Filters and statistics over mappings, and the lengths they contribute."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.functions.fraglen import SLOTS
from emtally.functions.libtype import ORIENTATIONS, compatible
from emtally.sources.alignments import flatten

#: Uniquely mapped fragments under which a length distribution isn't trusted.
FEW_FRAGMENTS = 5_000
#: Times by which a sample's cutoff is raised where too few fragments lie below it.
WIDER = 4


def compatible_alignments(alignments: DataFrame, lib_type: str) -> DataFrame:
    """The flat alignments whose orientation the library type accepts: a list of codes that reaches the scan."""
    return alignments.where(compatible(lib_type, F.col("ori")))


def orientation_stats(alignments: DataFrame, lib_type: str) -> DataFrame:
    """(ori, mapped, filtered): fragments with a mapping of this orientation that passes, or fails, the library type.
    Fragments are counted after a distinct of (frag_id, ori), which is partly done before the shuffle."""
    each = alignments.select("frag_id", "ori").distinct()
    passes = compatible(lib_type, F.col("ori"))
    return each.groupBy("ori").agg(F.count(F.when(passes, 1)).alias("mapped"), F.count(F.when(~passes, 1)).alias("filtered"))


def orientation_report(alignments: DataFrame, lib_type: str) -> DataFrame:
    """``orientation_stats`` for every orientation, 0 where none was seen, with its name: seven rows."""
    names = alignments.sparkSession.createDataFrame(list(enumerate(ORIENTATIONS)), "ori int, orientation string")
    stats = F.broadcast(orientation_stats(alignments, lib_type))  # a row per orientation
    return names.join(stats, "ori", "left").select("ori", "orientation", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("mapped", "filtered")))


def read_totals(alignments: DataFrame) -> DataFrame:
    """(num_mapped_reads, tot_mappings), before any filter."""
    return alignments.groupBy("frag_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("num_mapped_reads"), F.coalesce(F.sum("n"), F.lit(0)).alias("tot_mappings"))


def _flat(rows: DataFrame) -> DataFrame:
    """Alignments, of either form."""
    return flatten(rows) if "mappings" in rows.columns else rows


def _until(alignments: DataFrame, n: int, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of ``found(alignments)``, a row per fragment with its frag_id, those of the first ``n``, in file order, that of frag_id.

    Only the alignments up to a cutoff are read, a filter on frag_id that reaches the scan. The first cutoff supposes that
    ids are spread evenly; it is raised until ``n`` rows lie below it, or nothing is left beyond."""
    lies = alignments.agg(F.min("frag_id").alias("first"), F.max("frag_id").alias("last"), F.count("*").alias("rows")).first()
    if not lies.rows or n < 1:
        return found(alignments.where(F.lit(False)))
    span = lies.last - lies.first + 1
    width = max(1, min(span, span * n // lies.rows))
    while True:
        part = found(alignments.where(F.col("frag_id") <= lies.first + width - 1))
        if width >= span or part.limit(n).count() >= n:
            return part.orderBy("frag_id").limit(n)
        width = min(span, WIDER * width)


def first_fragments(fragments: DataFrame, n: int) -> DataFrame:
    """The alignments of the first ``n`` fragments in file order."""
    flat = _flat(fragments)
    last = _until(flat, n, lambda part: part.select("frag_id").distinct()).agg(F.max("frag_id").alias("last")).first()["last"]
    return flat.where(F.col("frag_id") <= last) if last is not None else flat.where(F.lit(False))


def sample_orientations(fragments: DataFrame, n: int) -> DataFrame:
    """(ori, n): every mapping of the first fragments, by orientation."""
    return first_fragments(fragments, n).groupBy("ori").agg(F.count("*").alias("n"))


def unique_fragments(fragments: DataFrame) -> DataFrame:
    """(frag_id, ori, frag_len) of fragments that have one mapping, before any filter, and are no orphans: by sums of which a part
    is done before the shuffle. In the nested form they are rows."""
    if "mappings" in fragments.columns:
        return fragments.where((F.size("mappings") == 1) & ~F.col("is_orphan")).select("frag_id", F.col("mappings")[0]["ori"].alias("ori"), F.col("mappings")[0]["frag_len"].alias("frag_len"))
    sums = _flat(fragments).groupBy("frag_id").agg(F.count("*").alias("mappings"), F.max("is_orphan").alias("is_orphan"), F.min("ori").alias("ori"), F.min("frag_len").alias("frag_len"))
    return sums.where((F.col("mappings") == 1) & ~F.col("is_orphan")).select("frag_id", "ori", "frag_len")


def _lengths(unique: DataFrame) -> DataFrame:
    return unique.where(F.col("frag_len").between(0, SLOTS - 1)).groupBy("frag_len").agg(F.count("*").alias("n"))


def length_histogram(fragments: DataFrame) -> DataFrame:
    """(frag_len, n) of all unique fragments, whatever their orientation: gives the effective lengths."""
    return _lengths(unique_fragments(fragments))


def sampled_length_histogram(fragments: DataFrame, lib_type: str, n: int) -> DataFrame:
    """(frag_len, n) of the first ``n`` unique fragments that the library type accepts: gives the mappings' probabilities."""
    return _lengths(_until(_flat(fragments), n, lambda part: unique_fragments(part).where(compatible(lib_type, F.col("ori")))))
