"""An estimation from end to end."""

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.config import QuantOptions
from emtally.functions import fraglen, libtype
from emtally.operators import classes as eq
from emtally.operators import em, exact, mappings, replicates
from emtally.operators.tpm import tpm
from emtally.sources import sinks
from emtally.sources.alignments import flatten, fragments, signatures
from emtally.sources.shared import bucketed, written


@dataclass
class Estimate:
    quant: DataFrame
    lengths: DataFrame
    replicates: DataFrame | None
    meta: dict


def detect_library(nested: DataFrame, paired: bool, samples: int) -> str:
    """The library type that the first ``samples`` fragments point to; without fragments an error."""
    counts = {libtype.ORIENTATIONS[r.ori]: r.n for r in mappings.sample_orientations(nested, samples).collect()}
    if not counts:
        raise ValueError("there are no reads to detect the library type from")
    found, ratio = libtype.detect(counts, paired)
    if said := libtype.strand_bias(found, ratio):
        warnings.warn(said, stacklevel=2)
    return found


def quantify(alignments: DataFrame, targets: DataFrame, options: QuantOptions, paired: bool = True, seed: int = 0, solver: str = "frames") -> Estimate:
    """Estimates counts and TPM of ``targets`` (ref_id dense from 0) from ``alignments``.

    ``solver``: "frames" solves the classes, and draws replicates, by DataFrame steps; "arrays" in tasks that hold all
    classes, for samples whose classes fit one. "exact" is "frames" with exact sums in the estimation and TPM: the same classes
    give the same counts and TPM to the last bit, however they are partitioned; replicates are as for "frames".
    The order is that of a sequential run: library type from the first fragments, length distribution from the first
    unique ones, classes from all, effective lengths from all unique ones (from the options if unpaired), EM, TPM, replicates."""
    spark = alignments.sparkSession
    if solver not in ("frames", "exact", "arrays"):
        raise ValueError(f"there is no solver {solver}")
    if not paired and options.fld_mean is None:
        raise ValueError("unpaired input needs fld_mean and fld_sd")
    if paired and options.fld_mean is not None:
        warnings.warn("fld_mean and fld_sd are ignored for paired input", stacklevel=2)
    # one shuffle by fragment: what groups the nested or the flat form by frag_id afterwards needs none
    nested = bucketed(fragments(alignments), "fragments", "frag_id", placed=True)
    alignments = flatten(nested)
    lib = options.lib_type
    if lib == libtype.AUTO:
        lib = detect_library(nested, paired, options.auto_detect_samples)
    all_lengths = written(mappings.length_histogram(nested), "lengths")
    if paired:
        first = written(mappings.sampled_length_histogram(nested, lib, options.param_est_frags), "lengths")
        sampled = first.agg(F.sum("n")).first()[0] or 0
        if sampled < options.param_est_frags:
            warnings.warn(f"the length distribution is estimated from {sampled} fragments, fewer than {options.param_est_frags}", stacklevel=2)
        distribution, means = fraglen.empirical(first), fraglen.conditional_means(all_lengths)
    else:
        distribution, means = fraglen.parametric(spark, options.fld_mean, options.fld_sd), fraglen.parametric_means(spark, options.fld_mean, options.fld_sd)
    if (all_lengths.agg(F.sum("n")).first()[0] or 0) < mappings.FEW_FRAGMENTS:
        warnings.warn("few fragments map uniquely; the length distribution may not hold", stacklevel=2)
    bins = options.factorized_eqc_bins
    if bins > 1:
        found = eq.range_classes(eq.conditional_probabilities(alignments, targets, distribution), lib, bins)
    else:
        found = eq.basic_classes(nested, lib)
    classes = written(eq.packed(found, bins), "classes")
    lengths = written(fraglen.effective_lengths(targets, means), "targets")
    limits = {"max_iter": options.max_iter, "convergence": options.convergence_thresh, "presence": options.presence_thresh}
    if solver != "arrays":
        counts = em.em_frames(classes, lengths, exact=solver == "exact", **limits)
    else:
        counts = em.em_groups(classes.withColumn("sample_id", F.lit("0")), lengths, **limits).drop("sample_id")
    counts = written(counts, "counts")
    quant = (exact.tpm if solver == "exact" else tpm)(lengths.join(counts, "ref_id", "left").withColumn("ecount", F.coalesce("ecount", F.lit(0.0))))
    if not counts.agg(F.sum("ecount")).first()[0]:
        warnings.warn("no target has any count: all TPM are 0", stacklevel=2)
    drawn, method = None, "none"
    if options.num_bootstraps and solver != "arrays":
        drawn, method = replicates.bootstrap_frames(classes, lengths, options.num_bootstraps, seed, **limits), "bootstrap"
    elif options.num_gibbs_samples and solver != "arrays":
        drawn, method = replicates.gibbs_frames(classes, lengths, counts, options.num_gibbs_samples, options.gibbs_thinning_factor, seed), "gibbs"
    elif options.num_bootstraps or options.num_gibbs_samples:
        packed = replicates.packed_of(classes)
        rows = [(r.eff_len, r.ecount) for r in quant.orderBy("ref_id").select("eff_len", "ecount").toLocalIterator()]
        eff, start = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        if options.num_bootstraps:
            drawn, method = replicates.bootstrap(spark, packed, eff, options.num_bootstraps, seed, **limits), "bootstrap"
        else:
            drawn, method = replicates.gibbs(spark, packed, eff, start, options.num_gibbs_samples, options.gibbs_thinning_factor, seed), "gibbs"
    stats = {r.ori: r for r in mappings.orientation_stats(alignments, lib).collect()}
    totals = mappings.read_totals(alignments).first()
    meta = {
        "quant_opts": options.as_dict(),
        "inferred_lib_type": libtype.display(lib),
        "mapped_frag_stats": {
            "filtered_ori_count": [stats[i].filtered if i in stats else 0 for i in range(7)], "mapped_ori_count": [stats[i].mapped if i in stats else 0 for i in range(7)],
            "num_mapped_reads": totals.num_mapped_reads, "tot_mappings": totals.tot_mappings,
        },
        "num_bootstraps": options.num_bootstraps, "num_gibbs_samples": options.num_gibbs_samples, "infrep_method": method,
        "num_targets": targets.count(), "signatures": signatures(options.input) if options.input else None,
    }
    return Estimate(quant, all_lengths, drawn, meta)


def write(estimate: Estimate, stem: str) -> None:
    """All outputs beside each other, named by ``stem``."""
    sinks.write_quant(estimate.quant, stem)
    sinks.write_lengths(estimate.lengths, stem)
    n = estimate.meta["num_bootstraps"] or estimate.meta["num_gibbs_samples"]
    if n:
        sinks.write_replicates(estimate.replicates, n, stem)
    sinks.write_metadata(estimate.meta, stem)
