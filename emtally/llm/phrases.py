"""Collocations: phrases whose words stand together more often than apart, mined by contiguous pattern growth.

Words are 64-bit hashes while phrases grow; the vocabulary, with every word's text and count, tells whether two words share
one, and then another seed is taken. Of a frequent phrase each pair of neighbours is frequent, so occurrences are
projected only where a frequent pair begins: pairs are counted by hash, and a bitmap of fixed size, in which every frequent pair
is set, goes to all tasks. What it lets pass beyond is only more work.

The projection of a prefix, a frequent pair, are the windows that begin with it, up to the longest phrase, equal ones as one row
with their number. A task takes whole prefixes and grows each to the right, depth first, over ranges of its sorted rows. A prefix
of more than ``PROJECTION`` windows is not one task: an aggregate counts it, and each of its extensions is a prefix of its own.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emtally.llm.tables import small_batches, written

LEAST, LONGEST, TOP, KEPT = 10, 3, 2000, 50
#: Windows of a prefix that one task grows, and windows of the prefixes of a task on average.
PROJECTION, TASK = 50_000, 100_000
#: Bits of the bitmap of frequent pairs (16 MB), a power of two.
BITS = 1 << 27
#: Bytes of text taken apart at once, and words, pairs or windows that a task holds before it gives them out.
BLOCK, HELD = 1 << 20, 1_000_000
#: Rows among which one task finds the first ones.
RANKED = 50_000
#: Stands for a language that isn't given.
UNKNOWN = "und"

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _byte_table() -> bytes:
    """A-Z lower-cased, tabs as spaces, and every character that ends a piece as a line feed."""
    out = bytearray(range(256))
    out[65:91] = out[97:123]
    out[9] = 32
    for c in b".,;:!?\x0b\x0c\r":
        out[c] = 10
    return bytes(out)


_BYTES = _byte_table()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Takes texts apart to hashes of their words; with ``checked`` a second hash tells whether equal ones are of equal words."""

    def __init__(self, seed: int, checked: bool = False):
        self.values, self.others = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
        self.powers, self.checked = np.ones(1, np.uint64), checked

    def blocks(self, text: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(bytes, starts, sizes, hashes, pieces, second hashes) of the words of each part of ``text``; a piece has one number throughout."""
        at, pieces = 0, 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1
                if not cut:
                    after = [i for i in (text.find(b" ", end), text.find(b"\n", end)) if i >= 0]
                    cut = min(after, default=len(text) - 1) + 1
                end = cut
            part = text[at:end]
            data = np.frombuffer(part, np.uint8)
            letters = np.flatnonzero((data != 32) & (data != 10))
            if len(letters):
                first = np.flatnonzero(np.diff(letters, prepend=-2) > 1)
                sizes = np.diff(np.append(first, len(letters)))
                within = np.arange(len(letters)) - np.repeat(first, sizes)
                if len(self.powers) <= sizes.max():
                    with np.errstate(over="ignore"):
                        self.powers = np.cumprod(np.append(np.uint64(1), np.full(2 * int(sizes.max()), _MULTIPLY)), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    powers = self.powers[within]
                    h, other = (_mix(np.add.reduceat(v[data[letters]] * powers, first) + sizes.astype(np.uint64)) if v is not None else None for v in (self.values, self.others if self.checked else None))
                starts = letters[first]
                yield part, starts, sizes, h, pieces + np.cumsum(data == 10)[starts], other
            pieces += int((data == 10).sum())
            at = end

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, pieces) of all words of ``text``."""
        parts = [(h, p) for _, _, _, h, p, _ in self.blocks(text)]
        return tuple(map(np.concatenate, zip(*parts))) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, the texts of one batch as one, a line feed between two)."""
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text.is_valid:
                texts.setdefault(UNKNOWN if lang is None else lang, []).append(text.as_buffer().to_pybytes().translate(_BYTES))
        for lang, found in texts.items():
            yield lang, b"\n".join(found)


def vocabulary(documents: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, n) of ``documents`` (lang, text): all words with their hashes and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(seed, checked=True), {}

        def out():
            names, hashes = zip(*((k, h) for k, (_, h) in held.items())) if held else ((), ())
            columns = [pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string()), pa.array(hashes, pa.int64()), pa.array([n for n, _ in held.values()], pa.int64())]
            return pa.record_batch(columns, names=["lang", "word", "h", "n"])

        for lang, text in _by_lang(batches):
            for part, starts, sizes, h, _, other in words.blocks(text):
                hashes, at, of, n = np.unique(h.view(np.int64), return_index=True, return_inverse=True, return_counts=True)
                # words of one hash that differ stay apart: they are seen when the vocabulary is complete
                odd = np.flatnonzero(other != other[at][of])
                n -= np.bincount(of[odd], minlength=len(n))
                hashes, at, n = np.append(hashes, hashes[of[odd]]), np.append(at, odd), np.append(n, np.ones(len(odd), np.int64))
                for x, i, many in zip(hashes.tolist(), at.tolist(), n.tolist()):
                    word = part[starts[i] : starts[i] + sizes[i]]
                    before = held.get((lang, word))
                    held[lang, word] = (many + (before[0] if before else 0), x)
            if len(held) > HELD // 4:
                yield out()
                held.clear()
        yield out()

    counted = documents.select("lang", "text").mapInArrow(count, "lang string, word string, h long, n long")
    return counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def _runs(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` and their sums of ``n`` (rows, if it isn't given)."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    sums = np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first) if len(order) else n
    return [c[first] for c in columns], sums


def _lang_hash(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _pair_hashes(h: np.ndarray, piece: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and the next in a language, and whether both are in one piece."""
    with np.errstate(over="ignore"):
        return _mix(_mix(h[:-1] + _lang_hash(lang)) * _MULTIPLY + h[1:]), piece[:-1] == piece[1:]


def frequent_pairs(documents: DataFrame, seed: int, least: int) -> np.ndarray:
    """A bitmap of BITS bits in which those of all frequent pairs of neighbours are set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(seed), [], 0

        def out():
            (found,), n = _runs([np.concatenate(held) if held else np.empty(0, np.int64)])
            return pa.record_batch([pa.array(found), pa.array(n)], names=["pair", "n"])

        for lang, text in _by_lang(batches):
            h, piece = words.of(text)
            pairs, inside = _pair_hashes(h, piece, lang)
            held.append(pairs[inside].view(np.int64))
            size += len(held[-1])
            if size > 4 * HELD:
                yield out()
                held, size = [], 0
        yield out()

    pairs = documents.select("lang", "text").mapInArrow(count, "pair long, n long")
    bit = F.col("pair").bitwiseAND(F.lit(BITS - 1))
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(pair & 63 AS int))").alias("bit"))
    rows = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # BITS / 64 rows at most, whatever the input
    out = np.zeros(BITS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def windows(documents: DataFrame, seed: int, bitmap: np.ndarray, longest: int) -> DataFrame:
    """(lang, h0, h1, ..., n): the words from each place where a frequent pair begins, ``longest`` at most, as far as each pair
    of neighbours is frequent; null beyond."""
    shared, names = documents.sparkSession.sparkContext.broadcast(bitmap), [f"h{i}" for i in range(longest)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits, held, size = Words(seed), shared.value, {}, 0

        def out():
            for lang, parts in held.items():
                lengths, *columns = map(np.concatenate, zip(*parts))
                (lengths, *columns), n = _runs([lengths, *columns])
                arrays = [pa.array(c, mask=lengths <= i) for i, c in enumerate(columns)]
                yield pa.record_batch([pa.array([lang] * len(n), pa.string()), *arrays, pa.array(n)], names=["lang", *names, "n"])

        for lang, text in _by_lang(batches):
            h, piece = words.of(text)
            pairs, inside = _pair_hashes(h, piece, lang)
            at = pairs & np.uint64(BITS - 1)
            good = inside & ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (pairs & np.uint64(63)) & np.uint64(1)) > 0)
            start = np.flatnonzero(good)
            signed, lengths, going = h.view(np.int64), np.full(len(start), 2), np.ones(len(start), bool)
            columns = [signed[start], signed[start + 1]] if len(start) else [np.empty(0, np.int64)] * 2
            good = np.append(good, np.zeros(longest, bool))
            signed = np.append(signed, np.zeros(longest, np.int64))
            for i in range(2, longest):
                going = going & good[start + i - 1]
                lengths = lengths + going
                columns.append(np.where(going, signed[start + i], 0))
            held.setdefault(lang, []).append((lengths, *columns))
            size += len(start)
            if size > HELD:
                yield from out()
                held, size = {}, 0
        yield from out()

    found = documents.select("lang", "text").mapInArrow(project, ", ".join(["lang string", *(f"{c} long" for c in names), "n long"]))
    return found.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def _growing(least: int, longest: int, depth: int):
    """Grows the prefixes of ``depth`` words in a task's windows."""

    def grow(table: pa.Table) -> pa.Table:
        langs = table.column("lang").combine_chunks().dictionary_encode()
        columns = [langs.indices.to_numpy().astype(np.int64)] + [table.column(f"h{i}").combine_chunks().fill_null(0).to_numpy() for i in range(longest)]
        ends = sum(table.column(f"h{i}").is_valid().to_numpy().astype(np.int64) for i in range(longest))
        order = np.lexsort([ends, *columns[::-1]])
        columns, ends = [c[order] for c in columns], ends[order]
        so_far = np.append(0, np.cumsum(table.column("n").to_numpy()[order]))
        phrases, counts, of = [], [], []

        def extend(low: int, high: int, d: int) -> None:
            """Rows low to high begin with the same d words (after their language)."""
            if d >= depth:
                phrases.append([int(columns[i][low]) for i in range(1, d + 1)])
                counts.append(int(so_far[high] - so_far[low]))
                of.append(int(columns[0][low]))
            if d == longest:
                return
            for a, b in parts(low, high, d + 1):
                extend(a, b, d + 1)

        def parts(low: int, high: int, d: int) -> list[tuple[int, int]]:
            """The ranges of rows that have d words or more and agree in the d-th, if they are frequent."""
            rows = low + np.flatnonzero(ends[low:high] >= d)
            if not len(rows):
                return []
            word = columns[d][rows]
            first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (np.diff(rows) > 1)))
            a, b = rows[first], rows[np.append(first[1:], len(rows)) - 1] + 1
            some = so_far[b] - so_far[a] >= least
            return list(zip(a[some].tolist(), b[some].tolist()))

        same = np.zeros(max(0, len(order) - 1), bool) if not len(order) else np.logical_and.reduce([c[1:] == c[:-1] for c in columns[: depth + 1]])
        first = np.flatnonzero(np.append(True, ~same)) if len(order) else np.empty(0, np.int64)
        last = np.append(first[1:], len(order))
        some = so_far[last] - so_far[first] >= least
        for a, b in zip(first[some].tolist(), last[some].tolist()):
            extend(a, b, depth)
        return pa.table([pa.array([langs.dictionary[i].as_py() for i in of], pa.string()), pa.array(phrases, pa.list_(pa.int64())), pa.array(counts, pa.int64())], names=["lang", "phrase", "a"])

    return grow


def frequent_phrases(projected: DataFrame, least: int = LEAST, longest: int = LONGEST, projection: int = PROJECTION, task: int = TASK) -> DataFrame:
    """(lang, phrase array<long>, a): phrases of 2 to ``longest`` words that occur ``least`` times or more, of ``windows``, a written table."""
    schema, out, todo = "lang string, phrase array<long>, a long", None, projected
    for depth in range(2, longest + 1):
        keys = ["lang", *(f"h{i}" for i in range(depth))]
        sizes = todo.groupBy(*keys).agg(F.sum("n").alias("a"), F.count("*").alias("size")).where((F.col("a") >= least) & (F.col("size") > projection))
        hot = written(sizes, "hot-prefixes")
        n_hot, n_rows = hot.count(), todo.count()
        # windows of some prefixes together, each prefix whole
        tasks = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-n_rows // task))))
        light = todo.join(F.broadcast(hot) if n_hot <= HELD else hot, keys, "left_anti") if n_hot else todo
        grown = light.withColumn("task", tasks).groupBy("task").applyInArrow(_growing(least, longest, depth), schema)
        out = grown if out is None else out.unionByName(grown)
        if not n_hot:
            break
        out = out.unionByName(hot.select("lang", F.array(*keys[1:]).alias("phrase"), "a"))
        on = todo.join((F.broadcast(hot) if n_hot <= HELD else hot).select(*keys), keys, "left_semi").where(F.col(f"h{depth}").isNotNull())
        todo = written(on, "hot-windows")
    return out


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(counts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): the lowest-scoring cut of each phrase, of equal ones the first. ``counts`` (lang, phrase,
    a) has all phrases and single words. Products are decimals of 38 digits: exact up to ten quadrillion occurrences."""
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("right", F.slice("phrase", F.col("k") + 1, F.size("phrase")))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang", part])
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", *(_exact(c).alias(f"{c}_") for c in ("a", "l", "r")))
    score = F.expr("CAST((a_ * a_ * CAST(1000000 AS DECIMAL(7,0))) DIV (l_ * r_) AS BIGINT)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")
    return cuts.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def without_parts(phrases: DataFrame, longest: int, percent: int = KEPT) -> DataFrame:
    """``phrases`` (lang, phrase, a) without those that stand inside a longer one which has ``percent`` of their occurrences or more."""
    longer = phrases.where(F.size("phrase") > 2)
    sizes = longer.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(2), F.size("phrase") - 1)).alias("size"))
    inside = sizes.select("lang", "a", F.explode(F.expr("transform(sequence(1, size(phrase) - size + 1), i -> slice(phrase, i, size))")).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = phrases.join(most, ["lang", "phrase"], "left").where(100 * F.coalesce("most", F.lit(0)) < percent * F.col("a"))
    return kept.select(phrases.columns) if longest > 2 else phrases


def first_of(df: DataFrame, by: str, order: list, top: int) -> DataFrame:
    """The ``top`` first rows of each value of ``by``, with their rank. Rows are ranked in shares until few enough are left for one task a value."""
    while True:
        n = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
        shares = n // max(RANKED, 4 * top)
        if shares < 2:
            break
        share = Window.partitionBy(by, "share").orderBy(*order)
        rows = df.withColumn("share", F.floor(F.rand(7) * shares)).withColumn("nth", F.row_number().over(share))
        df = written(rows.where(F.col("nth") <= top).drop("share", "nth"), "first")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = KEPT, projection: int = PROJECTION, task: int = TASK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language of ``documents`` (lang, text).

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line ends into pieces, and those at spaces and tabs into words.
    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times or more within pieces, overlaps included.
    score is a million times a * a / (l * r), floored, a being the phrase's occurrences and l and r those of its two parts
    at the cut where it is least. Candidates inside a longer one that has ``percent`` of their occurrences are left out.
    They are ranked by score, a (both falling) and phrase; n is all words of the language.

    A null lang is ``und``, null, empty and blank texts have no words, repeated rows count again, words and texts of any
    length are taken whole, an empty table gives no rows. Other columns are ignored."""
    small_batches(documents.sparkSession)
    docs = documents.select("lang", "text")
    for seed in range(1, 9):
        words = written(vocabulary(docs, seed), "vocabulary")
        if words.groupBy("h").agg(F.min("word").alias("x"), F.max("word").alias("y")).where("x != y").isEmpty():
            break
    else:
        raise ValueError("words of equal hashes under every seed")
    projected = written(windows(docs, seed, frequent_pairs(docs, seed, least), longest), "windows")
    phrases = written(frequent_phrases(projected, least, longest, projection, task), "phrases")
    counts = phrases.unionByName(words.where(F.col("n") >= least).select("lang", F.array("h").alias("phrase"), F.col("n").alias("a")))
    kept = written(scored(counts, without_parts(phrases, longest, percent)).withColumn("id", F.monotonically_increasing_id()), "scored")
    places = kept.select("id", F.posexplode("phrase").alias("i", "h"))
    texts = places.join(words.where(F.col("n") >= least).select("h", "word").distinct(), "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    said = kept.drop("phrase").join(texts.select("id", F.array_join(F.col("w.word"), " ").alias("phrase")), "id")
    best = first_of(said, "lang", [F.desc("score"), F.desc("a"), "phrase"], top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
