"""A chunked binary file of fragments, read and written as a Spark data source ("chunks").

The layout is this library's own. Numbers are little-endian; a text is its length (unsigned 32 bits) and its UTF-8 bytes.

* Prelude: the eight bytes of MAGIC; whether the fragments are paired (a byte); the number of targets (unsigned 64 bits) and
  their names as texts.
* Three sections of tag descriptions, for the file, each fragment and each alignment: a count (unsigned 16 bits), and for
  each tag its name as a text and its type (a byte of TYPES).
* The values of the file's tags. An array is its length (unsigned 64 bits) and its numbers.
* Chunks: the number of bytes that follow (unsigned 64 bits), of fragments (unsigned 32 bits), then the fragments: id (signed
  64 bits), number of alignments (unsigned 32 bits), the fragment's tags, each alignment's tags.
* The index of chunks: the offset of each (unsigned 64 bits), then their number, and again MAGIC. It's last, so
  that a file can be written in one pass, and a file that was cut off is seen at once.

``frag_map_type`` of a fragment, and ``compressed_ori_ref``, ``pos`` and ``frag_len`` of an alignment, are required, and the file's
``ref_lengths``; other tags are passed over. compressed_ori_ref is the target, shifted by three bits, and the orientation's code.
A partition reads a range of chunks.
"""

import struct
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from emtally.sources import files
from emtally.sources.alignments import SchemaError, targets_of

MAGIC = b"EMCHUNK1"
#: Types by their byte: numpy's names, and the array of unsigned 32-bit numbers.
TYPES = {1: "u1", 2: "<u2", 3: "<u4", 4: "<u8", 5: "<f4", 6: "<f8", 9: "<u4[]"}
CODES = {t: c for c, t in TYPES.items()}
REQUIRED = {"file": {"ref_lengths": ("<u4[]",)}, "fragment": {"frag_map_type": ("u1",)}, "alignment": {"compressed_ori_ref": ("<u4", "<u8"), "pos": ("<u4", "<u8"), "frag_len": ("<u2", "<u4")}}
#: frag_map_type of fragments that are orphans; others are 0.
ORPHAN = 1
#: Bytes of chunks that a partition reads, fragments that a chunk is written with, and rows handed to Spark at once.
PARTITION, FRAGMENTS, ROWS = 64 << 20, 5_000, 50_000

SCHEMA = "frag_id bigint, aln_idx int, ref_id int, pos bigint, ori int, frag_len int, is_orphan boolean"
_ARROW = pa.schema([("frag_id", pa.int64()), ("aln_idx", pa.int32()), ("ref_id", pa.int32()), ("pos", pa.int64()), ("ori", pa.int32()), ("frag_len", pa.int32()), ("is_orphan", pa.bool_())])


class ChunkError(ValueError):
    """A file isn't in the layout, or ends too early."""


@dataclass
class Header:
    paired: bool
    names: list[str]
    tags: dict[str, list[tuple[str, str]]]
    values: dict[str, object]
    chunks: list[int] = field(default_factory=list)
    end: int = 0

    @property
    def lengths(self) -> list[int]:
        return self.values["ref_lengths"]

    def check(self) -> None:
        """A typed error where a required tag is missing or of another type; tags that aren't known are a warning."""
        for level, needed in REQUIRED.items():
            found = dict(self.tags[level])
            for name, kinds in needed.items():
                if name not in found:
                    raise SchemaError(f"the {level} tags lack {name}")
                if found[name] not in kinds:
                    raise SchemaError(f"the {level} tag {name} is {found[name]}, not {' or '.join(kinds)}")
            if unknown := [n for n in found if n not in needed]:
                warnings.warn(f"{level} tags that aren't known are passed over: {', '.join(unknown)}", stacklevel=3)
        if len(self.lengths) != len(self.names):
            raise SchemaError(f"{len(self.names)} names of targets, but {len(self.lengths)} lengths")


def _take(f, n: int) -> bytes:
    out = f.read(n)
    if len(out) < n:
        raise ChunkError("the file ends too early")
    return out


def _number(f, kind: str) -> int:
    return struct.unpack(f"<{kind}", _take(f, struct.calcsize(f"<{kind}")))[0]


def _text(f) -> str:
    return _take(f, _number(f, "I")).decode()


def read_header(path: str) -> Header:
    """Prelude, tags and index of a file; its chunks aren't read."""
    with files.opened(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ChunkError(f"{path} isn't a file of chunks")
        paired = bool(_number(f, "B"))
        names = [_text(f) for _ in range(_number(f, "Q"))]
        tags = {}
        for level in REQUIRED:
            tags[level] = []
            for _ in range(_number(f, "H")):
                name, code = _text(f), _number(f, "B")
                if code not in TYPES:
                    raise SchemaError(f"the {level} tag {name} has the unknown type {code}")
                tags[level].append((name, TYPES[code]))
        values = {}
        for name, kind in tags["file"]:
            n = _number(f, "Q") if kind.endswith("[]") else 1
            got = np.frombuffer(_take(f, n * np.dtype(kind.removesuffix("[]")).itemsize), kind.removesuffix("[]")).tolist()
            values[name] = got if kind.endswith("[]") else got[0]
        found = Header(paired, names, tags, values)
        found.check()
        first, size = f.tell(), files.size(path)
        tail = 8 + len(MAGIC)
        f.seek(max(first, size - tail))
        said = f.read()
        if len(said) < tail or said[8:] != MAGIC:
            raise ChunkError(f"{path} has no index: it was cut off")
        n = struct.unpack("<Q", said[:8])[0]
        found.end = size - tail - 8 * n
        if found.end < first:
            raise ChunkError(f"{path} has an index of {n} chunks, which it can't hold")
        f.seek(found.end)
        found.chunks = np.frombuffer(_take(f, 8 * n), "<u8").tolist()
    return found


def _record(tags: list[tuple[str, str]]) -> np.dtype:
    if arrays := [n for n, t in tags if t.endswith("[]")]:
        raise SchemaError(f"arrays aren't read for each fragment or alignment: {', '.join(arrays)}")
    return np.dtype([(n, t) for n, t in tags])


def parse_chunk(body: bytes, fragments: int, tags: dict[str, list[tuple[str, str]]]) -> pa.RecordBatch:
    """The alignments of a chunk, row by row; it must hold its fragments, and nothing else."""
    head = np.dtype([("frag_id", "<i8"), ("n", "<u4"), *_record(tags["fragment"]).descr])
    row = _record(tags["alignment"])
    at, heads, parts = 0, np.empty(fragments, head), []
    for i in range(fragments):
        if at + head.itemsize > len(body):
            raise ChunkError("a chunk ends within a fragment")
        heads[i] = np.frombuffer(body, head, 1, at)[0]
        at += head.itemsize
        n = int(heads["n"][i])
        if at + n * row.itemsize > len(body):
            raise ChunkError("a chunk ends within a fragment's alignments")
        parts.append(np.frombuffer(body, row, n, at))
        at += n * row.itemsize
    if at != len(body):
        raise ChunkError(f"a chunk has {len(body) - at} bytes beyond its fragments")
    rows = np.concatenate(parts) if parts else np.empty(0, row)
    n = heads["n"].astype(np.int64)
    of = np.repeat(np.arange(fragments), n)
    packed = rows["compressed_ori_ref"].astype(np.int64)
    columns = (heads["frag_id"][of], np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), packed >> 3, rows["pos"], packed & 7, rows["frag_len"], (heads["frag_map_type"] == ORPHAN)[of])
    return pa.record_batch([pa.array(np.ascontiguousarray(c).astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _ARROW)], schema=_ARROW)


@dataclass
class Chunks(InputPartition):
    """A range of a file's chunks: their tags, where each begins, and where the last one ends."""

    path: str
    tags: dict[str, list[tuple[str, str]]]
    starts: list[int]


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Chunks]:
        """Ranges of whole chunks of about ``size`` bytes; the header is read once, here."""
        header = read_header(self.path)
        starts, ranges = [*header.chunks, header.end], []
        first = 0
        for i in range(len(header.chunks)):
            if i + 1 == len(header.chunks) or starts[i + 2] - starts[first] > self.size:
                ranges.append(Chunks(self.path, header.tags, starts[first : i + 2]))
                first = i + 1
        return ranges or [Chunks(self.path, header.tags, starts)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        with files.opened(partition.path) as f:
            for start, end in zip(partition.starts, partition.starts[1:]):
                f.seek(start)
                size, fragments = _number(f, "Q"), _number(f, "I")
                if start + 12 + size != end:
                    raise ChunkError(f"the chunk at {start} says {size} bytes, the index {end - start - 12}")
                yield from pa.Table.from_batches([parse_chunk(_take(f, size), fragments, partition.tags)]).to_batches(ROWS)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: a part of chunks, and where in it they begin."""

    path: str | None
    offsets: list[int]
    size: int


def _chunk(rows: np.ndarray, firsts: np.ndarray) -> bytes:
    """A chunk of the fragments that begin at ``firsts`` in ``rows`` (frag_id, is_orphan, compressed_ori_ref, pos, frag_len)."""
    ends, parts = np.append(firsts[1:], len(rows)), []
    body = rows[["compressed_ori_ref", "pos", "frag_len"]].astype([("a", "<u4"), ("b", "<u4"), ("c", "<u4")])
    for a, b in zip(firsts, ends):
        parts += [struct.pack("<qIB", int(rows["frag_id"][a]), int(b - a), ORPHAN if rows["is_orphan"][a:b].any() else 0), body[a:b].tobytes()]
    said = b"".join(parts)
    return struct.pack("<QI", len(said), len(firsts)) + said


class ChunkWriter(DataSourceWriter):
    """Each task writes its fragments as chunks to a part beside the file; the commit joins the parts, bytes as they are. A
    task that fails takes its part away; one whose executor is lost leaves it, under a name that nothing else uses."""

    def __init__(self, path: str, names: list[str], lengths: list[int], paired: bool, fragments: int, overwrite: bool):
        self.path, self.names, self.lengths, self.paired, self.fragments, self.overwrite = path, names, lengths, paired, fragments, overwrite

    def prelude(self) -> bytes:
        text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
        out = [MAGIC, struct.pack("<BQ", self.paired, len(self.names)), *map(text, self.names)]
        for level in ([("ref_lengths", "<u4[]")], [("frag_map_type", "u1")], [("compressed_ori_ref", "<u4"), ("pos", "<u4"), ("frag_len", "<u4")]):
            out += [struct.pack("<H", len(level)), *(text(n) + struct.pack("<B", CODES[t]) for n, t in level)]
        return b"".join([*out, struct.pack("<Q", len(self.lengths)), np.array(self.lengths, "<u4").tobytes()])

    def write(self, rows: Iterator) -> Written:
        import uuid

        part, offsets, size, held, last, n = f"{self.path}.part-{uuid.uuid4().hex}", [], 0, [], None, 0
        kind = [("frag_id", "<i8"), ("is_orphan", "?"), ("compressed_ori_ref", "<i8"), ("pos", "<i8"), ("frag_len", "<i8")]

        def chunk() -> bytes:
            table = np.array(held, kind)
            if len(table) and (min(table[c].min() for c in ("compressed_ori_ref", "pos", "frag_len")) < 0 or max(table[c].max() for c in ("compressed_ori_ref", "pos", "frag_len")) >> 32):
                raise ValueError("targets, places and lengths must fit in 32 bits")
            return _chunk(table, np.flatnonzero(np.append(True, np.diff(table["frag_id"]) != 0)))

        with files.created(part) as out:
            for r in rows:
                if r.frag_id != last:
                    if n == self.fragments:
                        offsets.append(size)
                        size += out.write(chunk())
                        held, n = [], 0
                    last, n = r.frag_id, n + 1
                held.append((r.frag_id, r.is_orphan, (r.ref_id << 3) | r.ori, r.pos, r.frag_len))
            if held:
                offsets.append(size)
                size += out.write(chunk())
        return Written(part, offsets, size)

    def commit(self, messages: list[Written | None]) -> None:
        import shutil

        if files.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        index, whole = [], f"{self.path}.part"
        with files.created(whole) as out:
            at = out.write(self.prelude())
            for m in (m for m in messages if m):
                index += [at + o for o in m.offsets]
                with files.opened(m.path) as part:
                    shutil.copyfileobj(part, out, 1 << 22)
                at += m.size
            out.write(np.array(index, "<u8").tobytes() + struct.pack("<Q", len(index)) + MAGIC)
        files.move(whole, self.path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.path:
                files.remove(m.path)


class ChunkSource(DataSource):
    """``spark.read.format("chunks").load(path)`` gives alignments. ``partitionBytes`` is the size of a partition. To write, the
    options ``names`` and ``lengths`` give the targets (write_chunks sets them)."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION)))

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        import json

        o = self.options
        return ChunkWriter(o["path"], json.loads(o["targetNames"]), json.loads(o["targetLengths"]), o.get("paired", "true") == "true", int(o.get("fragments", FRAGMENTS)), overwrite)


def read_chunks(spark: SparkSession, path: str, partition_bytes: int = PARTITION) -> tuple[Header, DataFrame, DataFrame]:
    """(header, targets, alignments) of a file that the driver and all executors can open by its path. Missing or mistyped
    tags, and a file without its index, are errors at once; a chunk that isn't whole is one when it is read."""
    header = read_header(path)
    spark.dataSource.register(ChunkSource)
    rows = spark.read.format("chunks").option("partitionBytes", partition_bytes).load(path)
    return header, targets_of(header.names, header.lengths, spark), rows


def write_chunks(alignments: DataFrame, targets: DataFrame, path: str, paired: bool = True, fragments: int = FRAGMENTS) -> None:
    """Writes alignments in the order of frag_id, each fragment whole in one chunk. The header holds the targets, ids dense
    from 0; parts are written by tasks and joined by the driver, which reads none into memory."""
    import json

    spark = alignments.sparkSession
    spark.dataSource.register(ChunkSource)
    rows = targets.orderBy("ref_id").select("ref_id", "target_name", "len").collect()  # a header holds them
    if [r.ref_id for r in rows] != list(range(len(rows))):
        raise ValueError("ref_id must be dense from 0")
    ordered = alignments.select("frag_id", "aln_idx", "ref_id", "pos", "ori", "frag_len", "is_orphan").repartitionByRange("frag_id").sortWithinPartitions("frag_id", "aln_idx")
    writer = ordered.write.format("chunks").mode("overwrite").option("targetNames", json.dumps([r.target_name for r in rows])).option("targetLengths", json.dumps([r.len for r in rows]))
    writer.option("paired", str(paired).lower()).option("fragments", fragments).save(path)
