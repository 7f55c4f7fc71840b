"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. How pieces are combined depends on their lengths
alone, of which there are at most ``capacity`` different ones; so the packing is found on the table of how
many pieces have each length (bounded by ``capacity``, whatever the corpus), and Spark then hands each
piece, by its rank among the pieces of its length, its place.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emtally.llm import tokens
from emtally.llm.tables import small_batches, written

CAPACITY = 2048
#: The id after each document.
END_ID = 0
#: Shares in which the pieces of one length are ranked apart and then put one after another: SALTS, and more for more than
#: RANKED pieces a share, up to MOST_SALTS (the driver and all tasks hold a number per length and share).
SALTS, RANKED, MOST_SALTS = 64, 1_000_000, 2_048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """One row per piece of each document (its ids, then END_ID). A document that is longer than ``capacity`` is
    cut into pieces of ``capacity`` tokens, but for the first, which has the rest. A null text is empty (one
    piece of one token); repeated rows have pieces each; other columns are ignored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tokens.ids(text.as_py() or "", vocabulary), np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(cut, PIECES)


def fullest(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths (with repeats, largest first) of the fullest combination that ``counts`` allows: the longest length
    at hand, then a subset sum of the rest by bitsets. Bit s of ``reach`` says that a sum of s can be made with
    the lengths so far; ``new`` remembers the sums that a length made possible, to trace the choice back."""
    at_hand = np.flatnonzero(counts)[::-1]
    longest = int(at_hand[0])
    room = capacity - longest
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    left = counts.copy()
    left[longest] -= 1
    if room in at_hand and left[room]:
        return [longest, room]
    for length in map(int, at_hand):
        if length > room or not left[length]:
            continue
        copies, n = int(min(left[length], room // length)), 1
        while copies:  # 1, 2, 4, ... copies: any number up to all
            n = min(n, copies)
            more = (reach | reach << (n * length)) & full
            if more != reach:
                steps.append((length, n, more & ~reach))
                reach = more
            copies -= n
            n *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, [longest]
    for length, n, new in reversed(steps):
        if new >> best & 1:
            chosen += [length] * n
            best -= n * length
    return sorted(chosen, reverse=True)


@dataclass
class Plan:
    """Of length l, the pieces of rank first[i] <= rank < first[i+1] go to sequences base[i], base[i]+1, ..., ``per[i]``
    to each, from ``offset[i]`` on; rows are ordered by (l, first)."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    per: np.ndarray
    offset: np.ndarray


def minimum_slack(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Packs counts[l] pieces of each length l. Each combination is used as often as the counts allow before the
    next is looked for, so the number of searches follows the number of lengths and not the number of pieces."""
    left, used, base, rows = counts.astype(np.int64), np.zeros(len(counts), np.int64), 0, []
    while left.any():
        combo = fullest(left, capacity)
        lengths, per = np.unique(combo, return_counts=True)
        times = int((left[lengths] // per).min())
        offset = 0
        for length, n in zip(lengths[::-1], per[::-1]):
            rows.append((length, used[length], base, n, offset))
            offset += int(length * n)
            used[length] += n * times
            left[length] -= n * times
        base += times
    rows.sort()
    return Plan(*(np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 5)))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a written table of PIECES) with sequence_id and offset. Full pieces are sequences of their own, with negative
    numbers. Others of one length are ranked within shares, dealt by a hash of the piece, and the shares put one after
    another by their counts (at most capacity rows for each share): a length that a third of all pieces has is never in one
    task. Repeated rows are pieces each; equal ones of a share may take each other's place."""
    spark = cut.sparkSession
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    cut = cut.where(F.col("length") < capacity)
    salts = max(SALTS, min(MOST_SALTS, -(-cut.count() // RANKED)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    salted = written(salted, "salted")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).orderBy("length", "salt").toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, sizes["length"].to_numpy(np.int64), sizes["n"].to_numpy(np.int64))
    before = (sizes.groupby("length")["n"].cumsum() - sizes["n"]).to_numpy(np.int64) if len(sizes) else np.array([], np.int64)
    ahead = np.zeros((capacity + 1, salts), np.int64)
    ahead[sizes["length"].to_numpy(np.int64), sizes["salt"].to_numpy(np.int64)] = before
    plan = minimum_slack(counts, capacity)
    begin = np.searchsorted(plan.length, np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((plan, begin, ahead))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, begin, ahead = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, salt, rank = (batch.column(c).to_numpy() for c in ("length", "salt", "rank"))
            rank = rank + ahead[length, salt]
            order = np.lexsort((rank, length))
            row = np.empty(len(rank), np.int64)
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                at = order[a:b]
                lo, hi = begin[length[at[0]]], begin[length[at[0]] + 1]
                row[at] = lo + np.searchsorted(plan.first[lo:hi], rank[at], side="right") - 1
            since = rank - plan.first[row]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(plan.base[row] + since // plan.per[row]), pa.array(plan.offset[row] + since % plan.per[row] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long").unionByName(full)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Packs all documents: PIECES with sequence_id and offset (gapless from 0 in each sequence).
    Texts are encoded once and only lengths are packed; an empty table gives an empty result."""
    return pack(written(pieces(documents, capacity, vocabulary), "pieces"), capacity)
