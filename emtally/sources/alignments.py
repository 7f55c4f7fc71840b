"""Inputs: tables of targets and of alignments (flat) or fragments (nested), and a header's sidecar."""

import json
import os
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emtally.sources import files

TARGETS = {"ref_id": "int", "target_name": "string", "len": "bigint"}
ALIGNMENTS = {"frag_id": "bigint", "aln_idx": "int", "ref_id": "int", "pos": "bigint", "ori": "int", "frag_len": "int", "is_orphan": "boolean"}


#: Types from which a column of a type may be read without loss of meaning.
_FROM = {"int": ("tinyint", "smallint", "int", "bigint"), "bigint": ("tinyint", "smallint", "int", "bigint"), "boolean": ("boolean",), "string": ("string",)}


class SchemaError(ValueError):
    """A table lacks a column, or has it in another type."""


def conform(df: DataFrame, columns: dict[str, str], what: str) -> DataFrame:
    """The needed columns in their types; other columns are left out. A missing column is an error, and so is one of
    another kind of type (text for a number, a number for a flag); integers may be of any width."""
    if missing := [c for c in columns if c not in df.columns]:
        raise SchemaError(f"{what} lacks {', '.join(missing)}")
    if wrong := [f"{c} ({df.schema[c].dataType.simpleString()}, not {t})" for c, t in columns.items() if df.schema[c].dataType.simpleString() not in _FROM[t]]:
        raise SchemaError(f"{what} has {', '.join(wrong)}")
    return df.select(*(F.col(c).cast(t) for c, t in columns.items()))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), TARGETS, "targets")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), ALIGNMENTS, "alignments")


def targets_of(names: list[str], lengths: list[int], spark: SparkSession) -> DataFrame:
    """Targets from a header's parallel arrays; the id is the position."""
    if len(names) != len(lengths):
        raise ValueError("names and lengths differ in number")
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(zip(names, lengths))], "ref_id int, target_name string, len bigint")


def fragments(alignments: DataFrame) -> DataFrame:
    """Nested form: frag_id, is_orphan, mappings array<struct<ref_id,pos,ori,frag_len>> in the order of aln_idx."""
    m = F.array_sort(F.collect_list(F.struct("aln_idx", "ref_id", "pos", "ori", "frag_len")))
    return (
        alignments.groupBy("frag_id").agg(F.max("is_orphan").alias("is_orphan"), m.alias("m"))
        .select("frag_id", "is_orphan", F.transform("m", lambda x: F.struct(x["ref_id"].alias("ref_id"), x["pos"].alias("pos"), x["ori"].alias("ori"), x["frag_len"].alias("frag_len"))).alias("mappings"))
    )


def flatten(nested: DataFrame) -> DataFrame:
    """The flat form of ``fragments``."""
    return nested.select("frag_id", "is_orphan", F.posexplode("mappings").alias("aln_idx", "m")).select("frag_id", "aln_idx", "m.ref_id", "m.pos", "m.ori", "m.frag_len", "is_orphan")


def signatures(stem: str) -> object:
    """The signatures of ``<stem>.map_info.json``, its extension replaced; a missing file or key is a warning and None."""
    path = os.path.splitext(str(stem))[0] + ".map_info.json"
    if not files.exists(path):
        warnings.warn(f"{path} isn't there: no signatures", stacklevel=2)
        return None
    with files.opened(path) as f:
        found = json.loads(f.read())
    if "signatures" not in found:
        warnings.warn(f"{path} has no signatures", stacklevel=2)
    return found.get("signatures")


def fixture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as targets."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_nationkey").alias("ref_id"), F.col("n_name").alias("target_name"), (150 + 37 * ((F.col("n_nationkey").cast("long") * 7919) % 97)).alias("len"))


def fixture_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fragments, their line items as alignments to the suppliers' nations."""
    l, s = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orphan = F.col("l_orderkey") % 10 == 0
    ori = (
        F.when(orphan, F.when(F.col("l_linestatus") == "F", 1).otherwise(2))
        .when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 4).when(F.col("l_linestatus") == "F", 3).otherwise(5)
    )
    numbered = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag").withColumn("aln_idx", F.row_number().over(order) - 1)
    return numbered.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("frag_id"), "aln_idx", F.col("s_nationkey").alias("ref_id"), ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11) % 140).alias("pos"),
        ori.alias("ori"), (100 + 4 * F.col("l_quantity") + F.col("l_linenumber")).cast("int").alias("frag_len"), orphan.alias("is_orphan"),
    )
