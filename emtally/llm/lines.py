"""Lines that many documents share, found by levelled sorted runs of line hashes.

Each text is read once for the hashes of its lines. Batches of documents then come in falling order of doc_id. A batch's
hashes are merge-joined with the runs: what no run has is new and becomes a run of its own, sorted by hash, with the
largest doc_id that holds it; what a run has is a repeat and only counts. Two runs of one level are merged to one of the
next, so a batch meets few runs however many came before. Runs, and the batch's hashes, are in the same buckets, so neither
the joins nor the merges shuffle a run.

DataFrame functions only. A line that a third of all documents hold is one row per task after the partial aggregate; the
join that finds the lines to drop broadcasts a counted table, or exchanges both sides, which Spark splits where they are skewed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emtally.llm.tables import bucketed, written

#: Code points of a key from which a line may be dropped, and documents that must hold it.
MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that the documents are dealt to by ranges of doc_id.
BATCHES = 6
#: Hashes, or positions in texts, up to which a table is broadcast (24 bytes each).
BROADCAST = 500_000

_SPACE = " \t\n\v\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HASH = ("h1", "h2")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """For each line of ``text`` 128 bits of its key's hash, or null where the key is shorter than ``min_chars``. A key is the
    line without ASCII white space at both ends, A-Z lower-cased."""
    ascii_ = lambda s: F.octet_length(s) == F.char_length(s)
    lower = lambda s: F.when(ascii_(s), F.lower(s)).otherwise(F.translate(s, _UPPER, _UPPER.lower()))
    trimmed = F.transform(_lines(text), lambda s: F.btrim(s, F.lit(_SPACE)))
    keys = F.transform(trimmed, lambda s: F.when(F.char_length(s) >= min_chars, lower(s)))
    return F.transform(keys, lambda s: F.when(s.isNotNull(), F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"))))


class LineRuns:
    """Runs (h1, h2, n, holder) by level; every hash is in one run, with the documents of the batch that brought it."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in ``batch`` (h1, h2, doc_id), a row per document and hash, and returns (h1, h2, n, holder, known): its hashes,
        and whether an earlier batch has them."""
        own = batch.groupBy(*_HASH).agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        held = []
        for i, run in enumerate(self.runs()):
            own = own.join(run.select(*_HASH, F.lit(True).alias(f"held{i}")), list(_HASH), "left")
            held.append(f"held{i}")
        marked = bucketed(own.select(*_HASH, "n", "holder", F.coalesce(*held, F.lit(False)).alias("known")), "line-run", *_HASH, placed=True)
        self.repeats.append(marked.where("known").select(*_HASH, "n"))
        self._put(marked.where("NOT known").select(*_HASH, "n", "holder"), 0)
        return marked

    def _put(self, run: DataFrame, level: int) -> None:
        """Adds a run to a level. Two of a level are merged to one of the next: both are sorted, and share no hash."""
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 2:
            a, b = self.levels[level]
            self.levels[level] = []
            b = b.toDF(*(f"{c}_b" for c in b.columns))
            both = a.join(b, (a.h1 == b.h1_b) & (a.h2 == b.h2_b), "full_outer").select(*(F.coalesce(c, f"{c}_b").alias(c) for c in a.columns))
            self._put(bucketed(both, "line-run", *_HASH, placed=True), level + 1)

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, holder) of hashes that ``min_docs`` documents or more hold."""
        repeats = self.repeats[0]
        for more in self.repeats[1:]:
            repeats = repeats.unionByName(more)
        again = written(repeats.groupBy(*_HASH).agg(F.sum("n").alias("again")), "line-repeats")
        out = None
        for run in self.runs():
            found = run.join(again, list(_HASH), "left").where(F.col("n") + F.coalesce("again", F.lit(0)) >= min_docs).select(*_HASH, "holder")
            out = found if out is None else out.unionByName(found)
        return out


def _hinted(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST else df


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, text, n_lines, n_dropped.

    A text's lines are what stands between its line feeds; null and empty texts are one empty line. A key (line_hashes) that
    ``min_docs`` documents hold loses all its lines but those in the largest doc_id that holds it. The other lines stay as
    they are, joined by line feeds. Rows of one doc_id are one document: it counts once, and as the largest keeps its lines in
    every row. A row without doc_id keeps its lines and counts as no document. Repeated rows get equal results; an empty
    table gives no rows. Other columns are ignored. Hashes have 128 bits: that two keys share one is taken as not happening."""
    docs = documents.select("doc_id", "text")
    named = docs.where("doc_id IS NOT NULL")
    bounds = named.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("b")).first()["b"] or []
    # the largest ids come first, so who brings a hash to the runs keeps its lines
    batch = sum((F.when(F.col("doc_id") <= b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    hashed = named.select("doc_id", F.xxhash64("text").alias("row"), line_hashes(F.col("text"), min_chars).alias("keys"), batch.alias("batch")).where(F.exists("keys", lambda k: k.isNotNull()))
    keys = written(hashed, "line-keys", "batch")
    # rows that share a doc_id are told apart from documents only where there are any
    unique = named.groupBy("doc_id").count().where("count > 1").isEmpty()
    runs = LineRuns()
    for i in range(len(set(bounds)) + 1):
        each = keys.where(F.col("batch") == i).select("doc_id", F.explode(F.array_distinct("keys")).alias("k")).where("k IS NOT NULL").select("doc_id", "k.h1", "k.h2")
        runs.add(each if unique else each.distinct())
    frequent = written(runs.frequent(min_docs), "frequent-lines")
    placed = keys.select("doc_id", "row", F.posexplode("keys").alias("pos", "k")).where("k IS NOT NULL").select("doc_id", "row", "pos", "k.h1", "k.h2")
    gone = placed.join(_hinted(frequent, frequent.count()), list(_HASH)).where("doc_id != holder")
    drops = written(gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone")), "dropped-lines")
    size = drops.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    joined = docs.withColumn("row", F.xxhash64("text")).join(_hinted(drops, size), ["doc_id", "row"], "left")
    # the lines are bound once, as the argument of a function of one element, and taken by position
    left = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col("text"))) - 1), "gone")
    kept = F.transform(F.array(_lines(F.col("text"))), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))[0]
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
