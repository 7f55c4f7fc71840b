"""Toxicity by a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are presences of n-grams of the lower-cased text, hashed to BUCKETS. The log-count ratios are counted
over all labelled rows, as a Spark aggregation. The weights are then fitted on a bounded sample of labelled rows
(SAMPLE per label, FIT_FEATURES n-grams of each): logistic regression on the scaled features. Both labels weigh the same
in the fit, however many rows have them, so that a score of 0.5 means the same at every size. Scoring sends a vector of
BUCKETS weights to all tasks.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.llm.neardup import BROADCAST_IDS
from emtally.llm.tables import small_batches, written

BITS = 20
BUCKETS = 1 << BITS
ORDERS = (4, 5, 6)
#: Labelled rows of each label on which the weights are fitted at most: those with the smallest hashes of doc_id.
SAMPLE = 1_500
#: N-grams of such a row that the fit uses at most, those with the largest ratios: 4 bytes each on the driver.
FIT_FEATURES = 8_192
#: Counts of tasks that are added up at once.
FAN = 32
#: Pseudo-rows of the overall label mix that are added to each n-gram's counts.
SMOOTHING = 10.0
#: Standard errors by which a ratio must differ from 0 to count.
ERRORS = 2.5
FOLDS = 5

_SEED = np.uint32(0x9E3779B1)


def _letters() -> np.ndarray:
    """Bytes as read: A-Z as a-z, ASCII characters that are no letters as space, bytes of other characters as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


_TABLE = _letters()


_slots = np.zeros(BUCKETS, np.int32)


def features(text: bytes) -> np.ndarray:
    """Distinct buckets of the n-grams of a text; runs of spaces count as one, and a space stands before and after it."""
    x = _TABLE[np.frombuffer(b" " + text + b" ", np.uint8)]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    x = x[keep].astype(np.uint32)
    found = []
    with np.errstate(over="ignore"):
        h = x
        for n in range(2, min(len(x), ORDERS[-1]) + 1):
            h = h[:-1] * _SEED + x[n - 1 :]
            if n in ORDERS:
                found.append(((h + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    all_ = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
    # the last of equal buckets is the one that its slot names
    at = np.arange(len(all_), dtype=np.int32)
    _slots[all_] = at
    return all_[_slots[all_] == at]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        z = self.bias + float(self.weights[features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, smoothing: float = SMOOTHING, errors: float = ERRORS) -> np.ndarray:
    """Log of how much likelier each n-gram is in rows of label 1 than in rows of label 0, moved towards 0 by ``errors`` of its standard errors."""
    share = n_pos / max(1, n_pos + n_neg)
    if not n_pos or not n_neg:
        return np.zeros(len(pos))
    a, b = pos + smoothing * share, neg + smoothing * (1 - share)
    r = np.log(a / n_pos) - np.log(b / n_neg)
    return np.sign(r) * np.maximum(0, np.abs(r) - errors * np.sqrt(1 / a + 1 / b))


def prior(n_pos: int, n_neg: int) -> Model:
    """What is known without n-grams: the share of label 1, moved towards a quarter by two rows; under a half where no row
    has label 0 to compare with."""
    share = (n_pos + 0.5) / (n_pos + n_neg + 2) if n_neg else 0.25
    return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))


def regress(rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, r: np.ndarray, l2: float = 0.002, steps: int = 200) -> Model:
    """Weighted logistic regression on presences scaled by ``r``, by Nesterov steps with a step size from the data's scale."""
    rows = [x[r[x] != 0] for x in rows]
    lengths = np.array([len(x) for x in rows])
    start = prior(int(labels.sum()), len(labels) - int(labels.sum()))
    if not len(rows) or not lengths.sum() or len(set(labels)) < 2:
        return start
    seen = np.zeros(len(r), bool)
    for x in rows:
        seen[x] = True
    used = np.flatnonzero(seen)
    slot = np.empty(len(r), np.intp)
    slot[used] = np.arange(len(used))
    # one large array: the used columns of all rows, row by row
    col = np.empty(lengths.sum(), np.intp)
    ends = np.cumsum(lengths)
    for x, end in zip(rows, ends):
        col[end - len(x) : end] = slot[x]
    del rows
    scale, some = r[used], lengths > 0
    begins = (ends - lengths)[some]

    def by_row(values: np.ndarray) -> np.ndarray:
        """Sums over each row of its columns' values."""
        out = np.zeros(len(lengths))
        out[some] = np.add.reduceat(values[col], begins)
        return out

    norm = by_row(scale * scale)
    rate = 1.0 / (0.25 * float((weight * (norm + 1)).sum()) / weight.sum() * 4 + l2)
    w, b = np.zeros(len(used)), start.bias
    pw, pb, total = w, b, weight.sum()
    for t in range(steps):
        m = t / (t + 3)
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        p = 1 / (1 + np.exp(-np.clip(by_row(scale * yw) + yb, -700, 700)))
        g = weight * (p - labels) / total
        pw, pb = w, b
        w = yw - rate * (scale * np.bincount(col, np.repeat(g, lengths), len(used)) + l2 * yw)
        b = yb - rate * g.sum()
    out = np.zeros(len(r))
    out[used] = w * r[used]
    return Model(out, float(b))


def _labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of rows with a label; the labels are broadcast up to a counted size and else joined by a shuffle."""
    return documents.select("doc_id", "text").join(F.broadcast(labels) if labels.count() <= BROADCAST_IDS else labels, "doc_id")


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the labelled rows outside the held-out fold. A doc_id with several labels is toxic if one says so;
    null labels and ids are ignored. Without rows of both labels every text gets the same score, from their share."""
    spark = documents.sparkSession
    small_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return prior(sizes.get(1, 0), sum(n for label, n in sizes.items() if label != 1))
    block = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows with each n-gram, by label, in blocks of buckets; only what isn't 0."""
        counts, rows = np.zeros((2, BUCKETS), np.int32), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                counts[label][features(text.as_buffer().to_pybytes() if text.is_valid else b"")] += 1
                rows[label] += 1
        if any(rows):
            out = [(-1, b"", *(np.int64(n).tobytes() for n in rows))]
            for i in range(0, BUCKETS, block):
                at = np.flatnonzero(counts[:, i : i + block].any(axis=0))
                if len(at):
                    out.append((i, at.astype(np.int16).tobytes(), *(c[i + at].astype(np.int64).tobytes() for c in counts)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            part = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array(np.full(len(out), part)), *columns], names=["part", "block", "at", "neg", "pos"])

    def add(table: pa.Table) -> pa.Table:
        """The sums of a block over the parts that go together."""
        first, total = table.column("block")[0].as_py(), np.zeros((2, block), np.int64)
        for at, neg, pos in zip(*(table.column(c).to_pylist() for c in ("at", "neg", "pos"))):
            at = np.frombuffer(at, np.int16) if first >= 0 else [0]
            total[0][at] += np.frombuffer(neg, np.int64)
            total[1][at] += np.frombuffer(pos, np.int64)
        at = np.flatnonzero(total.any(axis=0))[: block if first >= 0 else 1]
        at = at if first >= 0 else np.zeros(1, np.int64)
        return pa.table({"part": [table.column("part")[0].as_py() // FAN], "block": [first], "at": [at.astype(np.int16).tobytes() if first >= 0 else b""], "neg": [total[0][at].tobytes()], "pos": [total[1][at].tobytes()]})

    kinds = "part long, block long, at binary, neg binary, pos binary"
    counted = written(_labelled(documents, known).select("text", "label").mapInArrow(count, kinds), "ngrams")
    parts = (counted.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        # FAN rows to a group, however many tasks there were
        counted = written(counted.withColumn("to", F.expr(f"part div {FAN}")).groupBy("block", "to").applyInArrow(add, kinds), "ngrams")
        parts = -(-parts // FAN)
        if parts == 1:
            break
    total = counted.where("block < 0").first()
    n = (0, 0) if total is None else tuple(int(np.frombuffer(total[c], np.int64)[0]) for c in ("neg", "pos"))
    if not n[0] or not n[1]:
        return prior(n[1], n[0])

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, at, neg, pos in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "neg", "pos"))):
                dense = np.zeros((2, block), np.int64)
                dense[:, np.frombuffer(at, np.int16)] = np.frombuffer(neg, np.int64), np.frombuffer(pos, np.int64)
                yield pa.record_batch([pa.array([first]), pa.array([ratios(dense[1], dense[0], n[1], n[0]).tobytes()], pa.binary())], names=["block", "r"])

    r = np.zeros(BUCKETS)
    for row in counted.where("block >= 0").mapInArrow(ratio, "block long, r binary").toArrow().to_pylist():  # BUCKETS numbers, whatever was counted
        r[row["block"] : row["block"] + block] = np.frombuffer(row["r"])
    shared = spark.sparkContext.broadcast(np.abs(r).astype(np.float32))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t in batch.column("text"):
                f = features(t.as_buffer().to_pybytes() if t.is_valid else b"")
                f = f[shared.value[f] != 0]
                if len(f) > FIT_FEATURES:
                    f = f[np.lexsort((f, -shared.value[f]))[:FIT_FEATURES]]
                kept.append(np.sort(f).tobytes())
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(kept, pa.binary())], names=["doc_id", "label", "features"])

    chosen = known.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # of rows with one doc_id, one: a row per label and id
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(examples, "doc_id long, label int, features binary")
    rows = sorted((x["label"], x["features"]) for x in rows.groupBy("doc_id", "label").agg(F.min("features").alias("features")).select("label", "features").toArrow().to_pylist())
    y = np.array([label for label, _ in rows], float)
    weight = np.where(y == 1, len(y) / max(1.0, 2 * y.sum()), len(y) / max(1.0, 2 * (1 - y).sum()))
    return regress([np.frombuffer(f, np.int32) for _, f in rows], y, weight, r)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5). A null text counts as empty, which
    gets the score of a text without known n-grams; a null doc_id isn't held out; the score depends on nothing but
    the text. Repeated rows repeat; other columns are ignored."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` whose text scores under 0.5, in one pass and whatever their doc_id; all columns are kept."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [shared.value.score(t.as_buffer().to_pybytes() if t.is_valid else b"") < 0.5 for t in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
