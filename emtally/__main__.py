"""Command line: ``python -m emtally quant --input STEM --lib-type TYPE --output STEM``.

Reads ``<input>.chunks``, its extension replaced, if there is that file, or ``<input>.targets.parquet`` and
``<input>.alignments.parquet`` (and ``<input>.map_info.json``, if it is there).
"""

import argparse
import os
import sys
import warnings
from dataclasses import fields

from pyspark.sql import SparkSession

from emtally.config import QuantOptions
from emtally.plans.estimate import quantify, write
from emtally.sources import files
from emtally.sources.alignments import read_alignments, read_targets
from emtally.sources.chunks import read_chunks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="emtally", description="Abundance estimation on Spark.")
    out.add_argument("-q", "--quiet", action="store_true", help="report errors only")
    quant = out.add_subparsers(dest="command", required=True).add_parser("quant", help="estimate the abundance of targets")
    quant.add_argument("-i", "--input", required=True, help="stem of the input tables")
    quant.add_argument("-l", "--lib-type", required=True, help="library type, or auto")
    quant.add_argument("-o", "--output", required=True, help="stem of the outputs")
    quant.add_argument("-m", "--max-iter", type=int, help="iterations at most")
    for name, kind, said in (
        ("convergence-thresh", float, "relative increase under which a solution has converged"), ("presence-thresh", float, "count under which a target is absent"),
        ("param-est-frags", int, "unique fragments that the first length distribution is estimated from"), ("fld-mean", float, "mean fragment length, for unpaired input"),
        ("fld-sd", float, "deviation of the fragment length, for unpaired input"), ("num-bootstraps", int, "bootstrap replicates"), ("num-gibbs-samples", int, "Gibbs samples"),
        ("gibbs-thinning-factor", int, "iterations before each Gibbs sample"), ("factorized-eqc-bins", int, "bins of range classes; 1 for basic classes"),
        ("num-threads", int, "threads, where Spark runs on this machine"), ("auto-detect-samples", int, "fragments that the library type is detected from"),
    ):
        quant.add_argument(f"--{name}", type=kind, help=said)
    quant.add_argument("--unpaired", action="store_true", help="the fragments are single reads")
    quant.add_argument("--seed", type=int, default=0, help="seed of the replicates")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    known = {f.name for f in fields(QuantOptions)}
    try:
        options = QuantOptions(**{k: v for k, v in args.items() if k in known and v is not None})
    except ValueError as e:
        parser().error(str(e))
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{options.num_threads}]").appName("emtally").getOrCreate()
    with warnings.catch_warnings():
        if args["quiet"]:
            warnings.simplefilter("ignore")
            spark.sparkContext.setLogLevel("ERROR")
        chunks, paired = os.path.splitext(options.input)[0] + ".chunks", not args["unpaired"]
        if files.exists(chunks):
            header, targets, alignments = read_chunks(spark, chunks if "://" in chunks else os.path.abspath(chunks))
            paired = header.paired
        else:
            targets, alignments = read_targets(spark, f"{options.input}.targets.parquet"), read_alignments(spark, f"{options.input}.alignments.parquet")
        found = quantify(alignments, targets, options, paired, args["seed"])
        write(found, options.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
