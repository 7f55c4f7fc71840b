"""Near-duplicate groups by bottom-k sketches.

Each text becomes the set of hashes of its word shingles; one hash function serves both the set and its sketch,
the ``k`` smallest hashes. Texts with equal sets are one class. Inverted lists of the classes' retained values
generate overlaps; the share of the union's sketch that is in both estimates the similarity and filters; the
exact Jaccard similarity of the full sets confirms. Linked classes form components.

A list of more than ``RARE`` classes is never expanded into pairs. Two classes whose links could be missed so
are those whose sketches consist mostly of such frequent values. They are first compared with one pivot per
list, which unites most of a large group of copies. What is left is found exactly by prefixes of the full sets,
rarest value first: two similar sets share a value among their first ones. In a list of prefixes, classes of
its largest component are not paired with each other, as they are linked already. While more than ``HEAVY`` pairs of
a list are left, its other classes are compared with a few pivots only, drawn anew each round, and what is linked is united: where
similarities lie about the threshold one pivot leaves many apart, and several don't. Lists with more than ``HEAVY`` pairs after that
are searched by what sets don't share with a pivot of the list (``_Search.around``): sets that are alike share few of these values, and those
that are linked, though not with the pivot, many, so that prefixes of them tell copies of one text apart, which prefixes of the sets don't.
Of the other lists, one with more than ``FEW`` classes outside its largest component isn't paired: it is told apart by a second value, which two
similar sets share among a few more of their first ones, and so on, up to ``DEPTH`` values. A list that they don't tell apart is paired like a
small one, dealt to shares, and so is a list of values that sets don't share with a pivot: the number of its pairs has no bound but the
classes outside its largest component times all of it.

The join of pairs with what belongs to an id is dealt by id and share: an id with more than ``SHARE`` pairs has
several shares, to each of which its row is copied. Sets are of 64-bit hashes; that two shingles of one corpus have
one hash is taken as not happening (of 10 million shingles, a chance of 3 in a million).
"""

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emtally.llm.components import components
from emtally.llm.tables import small_batches, written

#: Retained values per sketch.
K = 32
#: Classes in a list whose pairs are all taken.
RARE = 24
#: Pairs of one id, or classes of one list, that are joined in one share.
SHARE = 256
#: Classes outside a list's largest component up to which they are paired with all of the list.
FEW = 128
#: Values by which a list is told apart at most; then its pairs are taken.
DEPTH = 5
#: Pairs of a list (classes outside its largest component times all) up to which no pivots are drawn.
HEAVY = 4_096
#: Pivots of a list's largest component and of the rest that a class draws in a round, out of a pool; rounds at most. After a round that leaves more than all but one in LEAST of its classes outside there is none.
PIVOTS, POOL, ROUNDS, LEAST = 4, 64, 8, 40
#: Chance that the estimate of a true link falls under the filter.
MISS = 1e-6
#: Ids up to which a set of ids is broadcast (8 bytes each); beyond, it is joined by a shuffle.
BROADCAST_IDS = 500_000

_SEED = 0x9E3779B97F4A7C15


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Random values of bytes (A-Z as a-z), and which bytes are white space."""
    rng = np.random.Generator(np.random.PCG64(20240101))
    values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return values, space


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 1024), _SEED, np.uint64)
        out[0] = 1
        _powers = np.cumprod(out, dtype=np.uint64)
    return _powers


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes (signed) of the text's shingles of ``width`` words. Fewer words are one shingle; without words the set is empty."""
    values, space = _tables()
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(~space[data])
    if not len(at):
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(np.append(starts, len(at)))
    within = np.arange(len(at)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        words = _mix(np.add.reduceat(values[data[at]] * _powers_to(int(lengths.max()))[within], starts) + lengths.astype(np.uint64) * np.uint64(_SEED))
        n = min(width, len(words))
        out = words[: len(words) - n + 1]
        for i in range(1, n):
            out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i])
    return np.unique(out.view(np.int64))


def _sets(documents: DataFrame, width: int, k: int) -> DataFrame:
    """(doc_id, n, digest, sketch) of each row."""
    import xxhash

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", width)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketches.append(s[:k])
            flat = pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketches)]), pa.int32()), flat)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc_id", "n", "digest", "sketch"])

    return documents.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n long, digest binary, sketch array<long>")


def only(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids`` (or isn't, with left_anti): by a broadcast of counted ids, or a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def shares_of(pairs: DataFrame) -> DataFrame:
    """(id, shares) of each id in ``pairs`` (a, b), a written table, written: one share per SHARE pairs begun."""
    one = lambda x: pairs.groupBy(F.col(x).alias("id")).agg(F.count("*").alias("c"))
    return written(one("a").unionByName(one("b")).groupBy("id").agg(F.ceil(F.sum("c") / SHARE).alias("shares")), "shares")


def attach(pairs: DataFrame, table: DataFrame, column: str, shares: DataFrame | None = None) -> DataFrame:
    """``pairs`` (a, b), a written table, with ``column`` of ``table``, which is unique on rep, for a and for b (named
    ``column``a, ``column``b). Ids that have more than SHARE pairs are dealt to shares (``shares_of``) by the pair, and their rows copied to
    each: at most one copy per SHARE pairs, in one exchange for both sides, of no other ids. Tables of ids are broadcast up to a counted size."""
    shares = shares_of(pairs) if shares is None else shares
    ids, many = shares.agg(F.count("*"), F.count(F.when(F.col("shares") > 1, 1))).first()
    several = shares.where("shares > 1")
    if many <= BROADCAST_IDS:
        several = F.broadcast(several)
    n = F.coalesce("shares", F.lit(1))
    own = table.select(F.col("rep").alias("id"), column)
    own = own.join(F.broadcast(shares), "id") if ids <= BROADCAST_IDS else own.join(several, "id", "left")
    copies = own.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    for x in ("a", "b"):
        dealt = pairs.join(several.withColumnRenamed("id", x), x, "left").withColumn("share", F.pmod(F.xxhash64("a", "b"), n)).drop("shares")
        pairs = dealt.join(copies.select(F.col("id").alias(x), "share", F.col(column).alias(column + x)), [x, "share"]).drop("share")
    return pairs


def least_shared(k: int, percent: int, miss: float = MISS) -> int:
    """The largest m such that of ``k`` values of a union's sketch fewer than m are shared with a chance of at
    most ``miss``, if the similarity is ``percent`` or more."""
    p, total = percent / 100, 0.0
    for m in range(k + 1):
        total += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if total > miss:
            return m
    return k


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Elements that sets of n and m elements share at least if their similarity is ``percent`` or more."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def by_rarity(rows: DataFrame, counts: DataFrame, on: list[str], keys: list[str], size: str, most: Column | None = None) -> DataFrame:
    """(*keys, pos, value): the values of each set of ``rows`` (*keys, value), rarest first; only those in ``counts`` (*on, df), of values
    that several sets have, and with ``most`` only among its first so many. ``size`` names the number of its values. Values of one set come
    first in any order of rarity: only how many there are counts."""
    v = rows.join(counts, on).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v")).withColumn("alone", F.col(size) - F.size("v"))
    first = F.col("v") if most is None else F.slice("v", F.lit(1), F.greatest(most - F.col("alone"), F.lit(0)).cast("int"))
    return v.select(*keys, "alone", F.posexplode(first).alias("i", "x")).select(*keys, (F.col("alone") + F.col("i")).alias("pos"), F.col("x.value").alias("value"))


class _Search:
    def __init__(self, documents: DataFrame, classes: DataFrame, width: int, percent: int, k: int, rare: int):
        self.documents, self.classes, self.width, self.percent, self.k, self.rare = documents, classes, width, percent, k, rare
        self.least = least_shared(k, percent)
        #: (rep, set) of all classes whose pairs are verified, written, once they are known.
        self.sets: DataFrame | None = None

    def needed(self, n: Column, m: Column) -> Column:
        """Values that the sketches of linked sets of n and m elements share at least."""
        exact = _overlap(n, m, self.percent) - F.greatest(n - self.k, F.lit(0)) - F.greatest(m - self.k, F.lit(0))
        return F.when((n >= self.k) & (m >= self.k), F.greatest(exact, F.lit(self.least))).otherwise(exact)

    def alike(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (a, b), a written table, those that the sketch of the union lets pass. Where it is smaller than k it is the whole union, and the test exact."""
        union = F.slice(F.array_sort(F.array_union("sketcha", "sketchb")), 1, self.k)
        shared = F.size(F.array_intersect(union, F.array_intersect("sketcha", "sketchb")))
        passes = F.when(F.size(union) < self.k, 100 * shared >= self.percent * F.size(union)).otherwise(shared >= self.least)
        return attach(pairs, self.classes, "sketch").where(passes).select("a", "b")

    def full_sets(self, ids: DataFrame) -> DataFrame:
        """(rep, n, set) for the texts of ``ids`` (rep), from the whole texts."""
        width = self.width

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", width) for text in batch.column(1)]
                yield pa.record_batch([batch.column(0), pa.array(list(map(len, out)), pa.int64()), pa.array([s.tobytes() for s in out], pa.binary())], names=["rep", "n", "set"])

        docs = only(self.documents.select(F.col("doc_id").alias("rep"), "text"), ids, "rep")
        return docs.mapInArrow(sets, "rep long, n long, set binary")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar."""
        percent = self.percent
        pairs = written(self.estimated(written(pairs.distinct(), "pairs")), "candidates")
        shares = shares_of(pairs)
        sets = self.sets
        if sets is None:
            sets = written(self.full_sets(shares.select(F.col("id").alias("rep"))).select("rep", "set"), "sets")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("seta"), batch.column("setb")):
                    x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                    if len(x) > len(y):
                        x, y = y, x
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return written(attach(pairs, sets, "set", shares).mapInArrow(compare, "a long, b long"), "verified")

    def links(self) -> DataFrame:
        k = self.k
        postings = self.classes.where("n > 0").select("rep", "n", F.explode("sketch").alias("value"))
        sizes = written(postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "lists")
        posted = written(postings.join(sizes, "value"), "postings")
        hot = posted.where(F.col("df") > self.rare)
        frequent = written(hot.groupBy("rep").agg(F.count("*").alias("hot")), "frequent")
        listed = posted.where(F.col("df") <= self.rare).join(frequent, "rep", "left").select("value", "rep", "n", F.coalesce("hot", F.lit(0)).alias("hot"))
        one = lambda x: listed.select("value", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("hot").alias(f"h{x}"))
        near = (
            one("a").join(one("b"), "value").where((F.col("a") < F.col("b")) & self.alike(F.col("na"), F.col("nb")))
            .groupBy("a", "b", "na", "nb", "ha", "hb").agg(F.count("*").alias("shared"))
            .where(F.col("shared") + F.least("ha", "hb") >= self.needed(F.col("na"), F.col("nb"))).select("a", "b")
        )
        # classes that may have links by frequent values alone
        least = F.when(F.col("n") >= k, F.lit(self.least)).otherwise(F.ceil(self.percent * F.col("n") / 100))
        crowd = hot.join(frequent, "rep").where(F.col("hot") >= least).select("value", "rep", "n", "hot")
        crowd = written(crowd, "crowd")
        pivots = written(crowd.groupBy("value").agg(F.max_by("rep", F.struct("hot", -F.col("rep"))).alias("pivot"), F.count("*").alias("size")).where("size > 1").select("value", "pivot"), "pivots")
        stars = crowd.join(pivots, "value").where("rep != pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        found = self.verified(near.unionByName(stars))
        if crowd.isEmpty():
            return found
        return found.unionByName(self.rest(crowd, components(found)))

    def rest(self, crowd: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between different components of classes in ``crowd``, by prefixes of the full sets, rarest value first."""
        members = crowd.select("value", "rep", "n").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        members = written(members, "members")
        mixed = written(members.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("value"), "mixed")
        open_ = written(members.join(mixed, "value").select("rep", "component").distinct(), "open")
        if open_.isEmpty():
            return members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rep, n, s in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("set")):
                    s = np.frombuffer(s.as_buffer(), np.int64)
                    for i in range(0, len(s), 1 << 16):
                        part = s[i : i + (1 << 16)]
                        yield pa.record_batch([pa.array(np.full(len(part), x)) for x in (rep, n)] + [pa.array(part)], names=["rep", "n", "value"])

        self.sets = written(self.full_sets(open_.select("rep")), "sets")
        full = written(self.sets.mapInArrow(values, "rep long, n long, value long"), "values")
        df = full.groupBy("value").agg(F.count("*").alias("df"))
        df = written(df.where("df > 1"), "value-counts")
        first = F.col("n") - F.ceil(self.percent * F.col("n") / 100) + DEPTH
        ranked = by_rarity(full, df, ["value"], ["rep", "n"], "n", first)
        ranked = written(ranked, "prefixes")
        united, open_ = self.united(ranked, open_)
        ranked = written(ranked.join(open_, "rep"), "ranked")
        listed, heavy = self.heavy(ranked)
        heavy = written(heavy, "heavy")
        if heavy.isEmpty():
            return self.verified(self.of_lists(ranked)).unionByName(united)
        links, pairs = self.around(written(listed.join(heavy, "value"), "listed"))
        return self.verified(pairs.unionByName(self.of_lists(ranked, heavy))).unionByName(links).unionByName(united)

    def heavy(self, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The lists (value, rep, n, component) by the first values of ``ranked``, and (value, main) of those with more than HEAVY pairs."""
        listed = ranked.where(F.col("pos") <= F.col("n") - F.ceil(self.percent * F.col("n") / 100)).select("value", "rep", "n", "pos", "component")
        parts = listed.groupBy("value", "component").agg(F.count("*").alias("c"))
        lists = parts.groupBy("value").agg(F.sum("c").alias("size"), F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"))
        return listed, lists.where((F.col("size") - F.col("most")) * F.col("size") > HEAVY).select("value", "main")

    def united(self, ranked: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links (a, b), and ``open_`` (rep, component) with the components that they make: rounds in which each class outside the
        largest component of a list with more than HEAVY pairs is compared, for one such list of it, with pivots of that component and
        of the rest. A round has 2 * PIVOTS pairs a class at most, and it loses no link, as what stays apart is searched by ``around`` and ``of_lists``."""
        found = open_.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
        before = None
        for i in range(ROUNDS):
            joined = written(ranked.join(open_, "rep"), "members")
            listed, heavy = self.heavy(joined)
            listed = written(listed.join(heavy, "value").withColumn("inside", F.col("component") == F.col("main")), "listed")
            outside = written(listed.where("NOT inside").groupBy("rep", "n", "component").agg(F.min_by("value", F.xxhash64("value", F.lit(i))).alias("value")), "outside")
            # uniting components gives no list more pairs than before: the others stay out
            ranked = listed.drop("component", "main", "inside")
            left = outside.count()
            if left == 0 or before is not None and LEAST * (before - left) < before:
                break
            before = left
            draws = listed.groupBy("value", "inside", F.pmod(F.xxhash64("rep", F.lit(i)), F.lit(POOL)).alias("lot")).agg(F.min(F.struct("rep", "n", "component")).alias("p"))
            pools = draws.groupBy("value").agg(*(F.collect_list(F.when(F.col("inside") == x, F.col("p"))).alias(name) for name, x in (("main_pool", True), ("rest_pool", False))))
            drawn = F.array(*(F.try_element_at(pool, F.pmod(F.xxhash64("rep", F.lit(i), F.lit(j)), F.greatest(F.size(pool), F.lit(1))).cast("int") + 1) for j in range(PIVOTS) for pool in ("main_pool", "rest_pool")))
            pairs = outside.join(pools, "value").select("rep", "n", "component", F.explode(drawn).alias("p")).where((F.col("component") != F.col("p.component")) & self.alike(F.col("n"), F.col("p.n")))
            links = self.verified(pairs.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")))
            of = lambda x: open_.select(F.col("rep").alias(x), F.col("component").alias(f"c{x}"))
            to = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("to"))
            found, open_ = found.unionByName(links), written(open_.join(to, "component", "left").select("rep", F.coalesce("to", "component").alias("component")), "open")
        return found, open_

    def around(self, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links, and pairs that may be, (a, b) each, between classes of different components that are in one list of ``listed`` (value, main, rep, n,
        component), a written table. Each list has a pivot: the class of its main component that is in most of the lists.

        Be d(x) the values that x has and the pivot hasn't, or the other way round: sets x and y that share o values have (|x| + |y| - d(x) - d(y)) / 2
        plus those that d(x) and d(y) share. So they are linked if d(x) and d(y) share as many as o must be beyond that, at least: one or more,
        unless both are linked with the pivot. (If x isn't, d(x) is at least 2 over the largest difference |x| + |pivot| - 2o that is linked; that of y and x can be larger than this
        by less than 2 + d(y).) So prefixes of d(x) and d(y), rarest value first, meet."""
        percent = self.percent
        inside = listed.where("component = main")
        pivots = inside.join(inside.groupBy("rep").agg(F.count("*").alias("lists")), "rep").groupBy("value").agg(F.max_by("rep", F.struct("lists", -F.col("rep"))).alias("a"))
        groups = written(listed.join(pivots, "value").select("a", F.col("rep").alias("b"), "main", "component").distinct(), "groups")

        def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, n, linked = [], [], []
                for x, y in zip(batch.column("seta"), batch.column("setb")):
                    x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                    values.append(np.setxor1d(x, y, assume_unique=True))
                    n.append(len(y))
                    both = (len(x) + len(y) - len(values[-1])) // 2
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))
                yield pa.record_batch([*(batch.column(c) for c in ("a", "b", "main", "component")), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), lists], names=["a", "b", "main", "component", "n", "linked", "values"])

        apart = written(attach(groups, self.sets, "set").mapInArrow(differ, "a long, b long, main long, component long, n long, linked boolean, values array<long>"), "apart")
        links = apart.where("linked AND component != main").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        own = F.when(F.col("linked"), F.col("main")).otherwise(F.col("component"))
        values = apart.select("a", F.col("b").alias("rep"), "n", F.size("values").cast("long").alias("d"), own.alias("component"), F.explode("values").alias("value"))
        df = written(values.groupBy("a", "value").agg(F.count("*").alias("df")).where("df > 1"), "value-counts")
        ranked = by_rarity(values, df, ["a", "value"], ["a", "rep", "n", "d", "component"], "d")
        keyed = written(ranked.withColumn("key", F.xxhash64("a", "value")).withColumn("had", F.lit(0)), "keyed")
        parts = keyed.groupBy("key", "component").agg(F.count("*").alias("c"), F.min("d").alias("least"), F.max("n").alias("large"))
        lists = parts.groupBy("key").agg(F.sum("c").alias("size"), F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"), F.min("least").alias("least"), F.max("large").alias("large")).where("size > most")
        # what is shared at least with the set of the list that needs least: a lower bound, without rounding up
        both = F.col("n") + F.col("large")
        least = percent * both / (100 + percent) - (both - F.col("d") - F.col("least")) / 2
        return links, self.across(written(keyed.join(written(lists, "prefix-lists"), "key").where(F.col("d") - F.col("pos") >= least), "listed"))

    def of_lists(self, ranked: DataFrame, without: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b) of classes of different components that may be similar, by the first ``values`` of their sets, (rep,
        component, n, pos, value) in one order for all sets, DEPTH more than the first n - t + 1, t being what a similar set shares at least.
        Pairs whose first common value is in ``without`` (value) are left to ``around``.

        The j-th value that two similar sets share is among the first n - t + j of either. So their lists by the first shared
        value meet, and so do those by the first two, in order. A class leaves a list in which no other is large or small
        enough to share what is needed, as at most the values from its place on are left to share."""
        beyond = F.col("n") - F.ceil(self.percent * F.col("n") / 100)
        keyed = ranked.where(F.col("pos") <= beyond)
        keyed = (keyed if without is None else keyed.join(without, "value", "left_anti")).withColumnRenamed("value", "key").withColumn("had", F.lit(0))
        out = None
        for depth in range(1, DEPTH + 1):
            keyed = written(keyed, "keyed")
            parts = keyed.groupBy("key", "component").agg(F.count("*").alias("c"), F.min("n").alias("least"))
            lists = parts.groupBy("key").agg(F.sum("c").alias("size"), F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"), F.min("least").alias("least")).where("size > most")
            listed = keyed.join(written(lists, "prefix-lists"), "key")
            # the smallest set that is there and may be similar
            least = F.greatest(F.col("least"), F.ceil(self.percent * F.col("n") / 100))
            listed = written(listed.where(F.col("had") + F.col("n") - F.col("pos") >= _overlap(F.col("n"), least, self.percent)), "listed")
            large = F.col("size") - F.col("most") > FEW
            pairs = self.across(listed) if depth == DEPTH else self.across(listed.where(~large)).unionByName(self.whole(listed.where(large), depth))
            out = pairs if out is None else out.unionByName(pairs)
            if depth == DEPTH or listed.where(large).isEmpty():
                return out
            more = ranked.select("rep", F.col("pos").alias("next"), "value")
            on = listed.where(large).select("rep", "component", "n", "pos", "had", "key").join(more, "rep").where((F.col("next") > F.col("pos")) & (F.col("next") <= beyond + depth))
            keyed = on.select("rep", "component", "n", F.col("next").alias("pos"), F.xxhash64("key", "value").alias("key"), (F.col("had") + 1).alias("had"))

    def whole(self, listed: DataFrame, depth: int) -> DataFrame:
        """The pairs of ``listed`` that are similar even if they share the list's ``depth`` values only: no list by more values has them.
        They are sets of about ``depth`` values, so the sizes of a set's partners are few."""
        small = listed.where(F.ceil(self.percent * F.col("n") / 100) <= depth)
        sizes = F.sequence(F.ceil(self.percent * F.col("n") / 100), F.floor(100 * F.col("n") / self.percent))
        x = small.select("key", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.explode(sizes).alias("ny")).where(_overlap(F.col("nx"), F.col("ny"), self.percent) <= depth)
        y = small.select("key", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"))
        return x.join(y, ["key", "ny"]).where("cx != cy AND x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))

    def across(self, listed: DataFrame) -> DataFrame:
        """The pairs of ``listed`` outside each list's main component with all of the list; large lists are dealt to shares. Where only
        values that a pivot hasn't in common are listed, ``d`` has their number."""
        listed = listed if "d" in listed.columns else listed.withColumn("d", F.col("n"))
        shares = F.ceil(F.col("size") / SHARE)
        one = lambda df, x: df.select("key", "share", "had", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("d").alias(f"d{x}"), F.col("pos").alias(f"p{x}"), F.col("component").alias(f"c{x}"), F.col("main").alias(f"m{x}"))
        few = one(listed.where("component != main").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))), "x")
        all_ = one(listed.withColumn("share", F.pmod(F.xxhash64("rep"), shares)), "y").drop("had")
        bound = F.col("had") + F.least(F.col("dx") - F.col("px"), F.col("dy") - F.col("py")) + (F.col("nx") + F.col("ny") - F.col("dx") - F.col("dy")) / 2
        pairs = few.join(all_, ["key", "share"]).where(
            (F.col("cx") != F.col("cy")) & self.alike(F.col("nx"), F.col("ny")) & (bound >= _overlap(F.col("nx"), F.col("ny"), self.percent)) & ((F.col("cy") == F.col("my")) | (F.col("x") < F.col("y")))
        )
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, k: int = K, rare: int = RARE) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; words are runs of other bytes than ASCII white space. Texts are linked when their sets
    of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more (integer arithmetic on the
    full sets). component_id is the smallest doc_id that can be reached, kept is doc_id = component_id. Links are found
    by sketches where lists have up to ``rare`` classes and by pivots and prefixes of the full sets beyond; both find
    the same, but for a chance of MISS of a sketch's estimate. Null, empty and blank texts have an empty set and no
    links; a row with a null doc_id has no links, a null component_id and is kept. Repeated rows get equal results. Rows
    of one doc_id are one document: what any of its texts is linked with is in its group. Other columns are ignored."""
    small_batches(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    sets = written(_sets(docs, width, k), "sketches")
    named = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("size")), "classes")
    links = _Search(docs, classes, width, percent, k, rare).links()
    # a doc_id with several texts links their classes
    several = named.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).where("x != y").select("doc_id")
    several = written(several, "several")
    if not several.isEmpty():
        mine = only(named.select("doc_id", "digest"), several, "doc_id").join(classes.select("digest", "rep"), "digest")
        links = links.unionByName(mine.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    labels = components(links)
    belongs = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").where("size > 1 OR component IS NOT NULL").select("digest", F.coalesce("component", "rep").alias("component"))
    belongs = written(belongs, "belongs")
    out = sets.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest")).join(belongs, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame, **params) -> DataFrame:
    """One row of each group of ``documents`` (doc_id, text, ...): that with the smallest doc_id, null last; of equal ones any.
    Rows count each for itself, also those that share a doc_id or have none. Rows without words all stay. Columns are kept."""
    taken = {c.lower() for c in documents.columns}
    row = next(name for i in range(len(taken) + 1) if (name := f"row{i}") not in taken)
    rows = written(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), **params)
    # rows that are alone in their group are left out before anything is joined
    others = written(groups.where("NOT kept").select(F.col("doc_id").alias(row), F.col("component_id").alias("group")), "others")
    named = written(others.unionByName(others.select(F.col("group").alias(row), "group")).distinct(), "members")
    ids = only(rows.select(row, "doc_id"), named.select(row), row).join(named, row)
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))).alias("first")).select(F.col("first.row").alias(row))
    gone = written(named.select(row).join(first, row, "left_anti"), "copies")
    return only(rows, gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
