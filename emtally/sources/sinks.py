"""Outputs of an estimation: a TSV of estimates, Parquet of lengths and replicates, JSON of what was done.

A stem is a path on the driver's disk or a URI of a shared store."""

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.functions.decimals import fixed
from emtally.functions.fraglen import dense
from emtally.sources import files
from emtally.sources.shared import new_path

#: Numbers of a row group of the wide table (64 MB): what the task that writes it holds at once.
NUMBERS = 8_000_000
_OPTIONS = {"compression": "zstd", "version": "2.6", "data_page_version": "2.0", "use_dictionary": False}


def _path(stem: str, suffix: str) -> Path | str:
    """``suffix`` appended to the stem, whatever dots it has."""
    return f"{stem}{suffix}" if "://" in str(stem) else Path(f"{stem}{suffix}")


def _by_a_task(ordered: DataFrame, put, path: Path | str) -> bool:
    """One task reads ``ordered``, range after range, and writes it by ``put(batches, out)`` to a file in the shared folder, which
    is then moved to ``path``: nothing of it is in the driver's memory. False if there was no task, and so no file."""
    shared = new_path(ordered.sparkSession, "output")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"{shared}-{uuid.uuid4().hex}"
        with files.created(part) as out:
            put(batches, out)
        yield pa.record_batch([pa.array([part])], names=["part"])

    parts = ordered.coalesce(1).mapInArrow(write, "part string").collect()
    for part in parts:
        files.move(part["part"], path)
    return bool(parts)


def write_quant(quant: DataFrame, stem: str) -> Path | str:
    """target_name, len, eelen, tpm and ecount of every target, by ref_id, three decimals, rounded from the binary value. The
    lines are made in the JVM and written by one task."""
    path, head = _path(stem, ".quant"), b"target_name\tlen\teelen\ttpm\tecount\n"
    line = F.concat_ws("\t", "target_name", F.col("len").cast("string"), *(fixed(F.col(c)) for c in ("eff_len", "tpm", "ecount")))

    def put(batches: Iterator[pa.RecordBatch], out: pa.NativeFile) -> None:
        out.write(head)
        for batch in batches:
            out.write("".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode())

    if not _by_a_task(quant.orderBy("ref_id").select(line.alias("line")), put, path):
        with files.created(path) as out:
            out.write(head)
    return path


def _write(table: pa.Table, path: Path | str) -> Path | str:
    with files.created(path) as out:
        pq.write_table(table, out, row_group_size=max(1, len(table)), **_OPTIONS)
    return path


def write_lengths(histogram: DataFrame, stem: str) -> Path | str:
    """One unsigned column with the number of fragments of each length."""
    counts = [r.n for r in dense(histogram).orderBy("frag_len").select("n").collect()]  # SLOTS numbers
    field = pa.field("fragment_length_dist", pa.uint32(), nullable=False)
    return _write(pa.table([pa.array(counts, pa.uint32())], schema=pa.schema([field])), _path(stem, ".fld.pq"))


def wide(replicates: DataFrame, n: int) -> DataFrame:
    """A row per target, a column per replicate: ref_id, bootstrap.0, bootstrap.1, ..."""
    out = replicates.groupBy("ref_id").pivot("rep", list(range(n))).agg(F.first("value"))
    return out.select("ref_id", *(F.col(f"`{i}`").alias(f"bootstrap.{i}") for i in range(n)))


def write_replicates(replicates: DataFrame, n: int, stem: str) -> Path | str:
    """The wide form by ref_id, without it; Gibbs samples have the same column names. The file is one row group up to NUMBERS
    numbers, and has one for each so many beyond: that is what the task that writes it holds."""
    path, names, rows = _path(stem, ".infreps.pq"), [f"bootstrap.{i}" for i in range(n)], max(1, NUMBERS // max(1, n))
    schema = pa.schema([pa.field(name, pa.float64(), nullable=False) for name in names])

    def put(batches: Iterator[pa.RecordBatch], out: pa.NativeFile) -> None:
        held, count = [], 0
        with pq.ParquetWriter(out, schema, **_OPTIONS) as writer:
            for batch in batches:
                while batch.num_rows:
                    some = batch.slice(0, rows - count)
                    held.append(some.rename_columns(names).cast(schema))
                    batch, count = batch.slice(some.num_rows), count + some.num_rows
                    if count == rows:
                        writer.write_table(pa.Table.from_batches(held), row_group_size=rows)
                        held, count = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=rows)

    columns = [f"r{i}" for i in range(n)]
    ordered = wide(replicates, n).toDF("ref_id", *columns).orderBy("ref_id").select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))
    return path if _by_a_task(ordered, put, path) else _write(schema.empty_table(), path)


def write_metadata(meta: dict, stem: str) -> Path | str:
    path = _path(stem, ".meta_info.json")
    with files.created(path) as out:
        out.write(json.dumps(meta, indent=2).encode())
    return path
