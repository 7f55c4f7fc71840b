"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample and sent to all tasks; every vector is put into one leaf of each tree.
A query takes the leaves of all trees in the order of a shared priority queue, by the largest margin on the wrong
side on the way to them. How many it takes is set from recall measured on the index at hand: some of its queries
are compared with the whole index. Vectors and queries then meet leaf by leaf, several leaves to a group, and a
bounded share of the queries at a time. What is sent
to the leaves of a vector are its components in 8 bits and the distance to what they stand for: with it, every candidate
of a query's leaves that may be among the nearest is known, and the exact distances of those, on the original vectors,
decide.

Equal vectors are one point, of which only the smallest ids can be among the nearest: at most ``top`` + 1 of them
are indexed, so a vector that many rows share is no hot leaf, and no result is lost. Equal queries are one search.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emtally.llm.neardup import only
from emtally.llm.tables import written

#: Vectors that the forest is fitted on (the smallest hashes of their ids): bounds what the driver holds and sends.
SAMPLE = 16_384
TREES = 8
#: Vectors of the sample in a leaf at most, if it is all that there is; with more vectors leaves grow in proportion.
LEAF = 24
#: Sample vectors in a leaf at least; with this and SAMPLE, the forest has at most TREES * SAMPLE / MIN_LEAF splits.
MIN_LEAF = 12
#: Postings per group of leaves.
GROUP = 20_000
#: Queries per share: a group of leaves meets each share of the queries in a task of its own.
QUERIES = 32_768
SEED = 7
#: Queries (the smallest hashes of their ids) that are compared with the whole index to set how many leaves are taken.
MEASURED = 256
#: Recall that the leaves taken must reach on those queries, less two standard errors.
RECALL = 0.92
#: A distance whose square is a double; what is less may have been lost.
_LEAST = 1e-150


@dataclass
class Forest:
    """Splits as arrays: points with a projection under ``threshold`` go to ``below``, others to ``above``. A child
    that is >= 0 is a split, else the leaf ~child. roots has a split or leaf per tree."""

    directions: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    roots: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x`` in each tree, one column per tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(int(root), np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if node < 0:
                    out[rows, t] = ~node
                elif len(rows):
                    side = x[rows] @ self.directions[node] >= self.threshold[node]
                    todo += [(int(self.below[node]), rows[~side]), (int(self.above[node]), rows[side])]
        return out

    def order(self, q: np.ndarray) -> np.ndarray:
        """All leaves, for each row of ``q``, in the order in which a priority queue over all trees reaches them: by the
        largest margin of the splits that were left on the far side; equal ones by number."""
        margins = q @ self.directions.T - self.threshold if len(self.threshold) else np.empty((len(q), 0))
        worst = np.empty((len(q), len(self.threshold) + len(self.roots)))
        nodes, far = self.roots, np.full((len(q), len(self.roots)), -np.inf)
        while len(nodes):
            ends = nodes < 0
            worst[:, ~nodes[ends]] = far[:, ends]
            nodes, far = nodes[~ends], far[:, ~ends]
            margin = margins[:, nodes]
            passed = np.maximum(far, np.abs(margin))
            far = np.hstack([np.where(margin >= 0, passed, far), np.where(margin >= 0, far, passed)])
            nodes = np.concatenate([self.below[nodes], self.above[nodes]])
        return np.argsort(worst, axis=1, kind="stable")


def fit(sample: np.ndarray, leaf: int, trees: int = TREES, seed: int = SEED) -> Forest:
    """Splits at the median of a random projection until at most ``leaf`` points are left. Points whose projections are all equal stay together."""
    rng = np.random.Generator(np.random.PCG64(seed))
    width = sample.shape[1] if sample.ndim == 2 else 0
    directions, threshold, children, roots, n_leaves = [], [], [], [], 0
    for _ in range(trees):
        roots.append(0)
        todo = [(np.arange(len(sample)), None)]
        while todo:
            rows, at = todo.pop()
            node = None
            if len(rows) > leaf:
                d = rng.standard_normal(width)
                d /= np.linalg.norm(d)
                p = sample[rows] @ d
                cut = np.median(p)
                side = p >= cut
                if side.any() and not side.all():
                    node = len(threshold)
                    directions.append(d)
                    threshold.append(cut)
                    children.append([0, 0])
                    todo += [(rows[~side], (node, 0)), (rows[side], (node, 1))]
            if node is None:
                node, n_leaves = ~n_leaves, n_leaves + 1
            if at is None:
                roots[-1] = node
            else:
                children[at[0]][at[1]] = node
    c = np.array(children, np.int64).reshape(-1, 2)
    return Forest(np.array(directions).reshape(len(directions), width), np.array(threshold), c[:, 0], c[:, 1], np.array(roots, np.int64))


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of vectors that aren't null, empty or zero and hold no null or non-finite component."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select("vec_id", F.col("embedding").alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL").where(finite & F.exists("v", lambda x: x != 0.0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def closest(x: np.ndarray, y: np.ndarray, own: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``y``, row of ``x``) among which are the ``top`` nearest of ``x`` to each of ``y``, ties included;
    where ``own`` (y by x) is set there is no pair. Squared distances come from products; the bound leaves room for
    their rounding, and where one isn't finite all rows of ``x`` stay."""
    with np.errstate(over="ignore", invalid="ignore"):
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        rough = xx + yy[:, None] - 2 * (y @ x.T)
        odd = ~np.isfinite(rough).all(axis=1)
        rough[own] = np.inf
        bound = np.full(len(y), np.inf)
        if len(x) > top:
            room = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (xx.max() + yy)
            bound = np.where(odd, np.inf, np.partition(rough, top - 1, axis=1)[:, top - 1] + room)
        return np.nonzero(~(rough > bound[:, None]) & ~own)


def first_of_each(query: np.ndarray, ids: np.ndarray, d: np.ndarray, top: int) -> np.ndarray:
    """The places of the ``top`` smallest (d, ids) of each query, a pair of query and id once."""
    order = np.lexsort((ids, d, query))
    # a repeated pair may have several distances (one id, several vectors): the smallest comes first
    _, first = np.unique(np.stack([query[order], ids[order]]), axis=1, return_index=True)
    order = order[np.sort(first)]
    return order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < top]


def leaves_for(forest: Forest, points: DataFrame, queries: DataFrame, top: int, recall: float = RECALL) -> int:
    """The least number of leaves whose recall over ``queries`` (a bounded number), less two standard errors, is ``recall``.
    Their exact neighbours come from one pass over all ``points``, of which a task keeps ``top`` for each query."""
    spark = points.sparkSession
    asked = queries.toArrow()
    y, yi = _matrix(asked.column("v")), asked.column("vec_id").to_numpy()
    if not len(y):
        return len(forest.roots)
    shared = spark.sparkContext.broadcast((forest, y, yi))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, y, yi = shared.value
        query, ids, d, kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty((0, y.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, xi = _matrix(part.column("v")), part.column("vec_id").to_numpy()
                j, i = closest(x, y, xi == yi[:, None], top)
                far = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
                query, ids, d, kept = np.append(query, j), np.append(ids, xi[i]), np.append(d, far), np.vstack([kept, x[i]])
                best = first_of_each(query, ids, d, top)
                query, ids, d, kept = query[best], ids[best], d[best], kept[best]
        found = forest.leaves(kept)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
        yield pa.record_batch([pa.array(query), pa.array(ids), pa.array(d), lists], names=["query", "vec_id", "score", "leaves"])

    near = points.mapInArrow(compare, "query long, vec_id long, score double, leaves array<long>")
    one = near.groupBy("query", "vec_id").agg(F.min_by("leaves", "score").alias("leaves"), F.min("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    near = one.withColumn("nth", nth).where(F.col("nth") <= top).select("query", "leaves").toArrow()
    query, found = near.column("query").to_numpy(), _matrix(near.column("leaves")).astype(np.int64)
    if not len(query):
        return len(forest.roots)
    need = np.empty(len(query), np.int64)
    for at in range(0, len(y), 64):
        places = np.argsort(forest.order(y[at : at + 64]), axis=1)
        some = np.flatnonzero((query >= at) & (query < at + 64))
        need[some] = places[query[some, None] - at, found[some]].min(axis=1) + 1
    _, of, sizes = np.unique(query, return_inverse=True, return_counts=True)
    for leaves in np.unique(need):
        each = np.bincount(of, need <= leaves) / sizes
        if each.mean() - 2 * each.std() / np.sqrt(len(each)) >= recall:
            break
    return max(len(forest.roots), int(leaves))


def may_be_nearest(query: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, top: int) -> np.ndarray:
    """The places of the pairs whose least distance isn't over the ``top`` smallest of the query's largest distances, a pair
    of query and id counted once."""
    if not len(query):
        return np.empty(0, np.int64)
    order = np.lexsort((ids, high, query))
    _, first = np.unique(np.stack([query[order], ids[order]]), axis=1, return_index=True)
    order = order[np.sort(first)]
    nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    bound = np.full(query.max() + 1, np.inf)
    at = order[nth == top - 1]
    bound[query[at]] = high[at]
    return order[low[order] <= bound[query[order]]]


def compact(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors): each row's components in 8 bits, times its scale, and the distance of what they stand for
    from the row, rounded up."""
    top = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(np.isfinite(top / 127) & (top > 0), top / 127, 1.0)
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    with np.errstate(over="ignore"):
        error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error * (1 + 1e-9) + _LEAST


def _bounds(codes: np.ndarray, scale: np.ndarray, error: np.ndarray, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of the codes, least distance, largest distance) of the pairs that may be among the ``top`` nearest."""
    with np.errstate(over="ignore", invalid="ignore"):
        x = codes * scale[:, None]
        xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
        square = xx + qq[:, None] - 2 * (q @ x.T)
        # rounding of the products, and squares too small for a double
        room = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + qq[:, None]) + _LEAST**2
        low = np.sqrt(np.maximum(square - room, 0)) - error
        high = np.sqrt(np.maximum(square + room, 0)) + error
        low, high = np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)
    bound = np.partition(high, top - 1, axis=1)[:, top - 1] if len(x) > top else np.full(len(q), np.inf)
    j, i = np.nonzero(low <= bound[:, None])
    return j, i, low[j, i], high[j, i]


def nearest(vectors: DataFrame, every: int = 100, top: int = 10, sample: int = SAMPLE, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``top`` nearest found of each query, a row whose vec_id is divisible
    by ``every``; candidates are all other rows. score is the Euclidean distance in double precision; ties go to
    the smaller vec_id. Vectors that are null, empty, zero or hold a null or non-finite component, and rows with
    a null vec_id, take no part; nor do vectors of another length than most (of equally many, the shorter). Of
    repeated rows with one vec_id and vector one is used. With fewer candidates than ``top``, or all in the leaves
    taken, the result is exact."""
    spark = vectors.sparkSession
    valid = _valid(vectors)
    width = valid.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    valid = valid.where(F.size("v") == (width["width"] if width else 0))
    hashes = (F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("k2"))
    good = written(valid.select("vec_id", "v", *hashes, F.monotonically_increasing_id().alias("row")), "vectors")
    # of equal vectors the smallest ids, and each once: found by ids and hashes, so that no vector is shuffled
    ids = good.groupBy("vec_id", "k1", "k2").agg(F.min("row").alias("row"))
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    kept = ids.withColumn("nth", nth).where(F.col("nth") <= top + 1).select("row")
    gone = written(good.select("row").join(kept, "row", "left_anti"), "equal")
    some = good if gone.isEmpty() else written(only(good, gone, "row", "left_anti"), "points")
    some = some.select("vec_id", "v")
    n = some.count()
    fitted = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    points = _matrix(fitted.column("v"))
    # a leaf has LEAF vectors, however many of them are in the sample, but not under MIN_LEAF of the sample's
    per_leaf = max(MIN_LEAF, int(LEAF * min(1.0, len(points) / max(1, n))))
    fitted_forest = fit(points, per_leaf, trees)
    n_leaves = len(fitted_forest.threshold) + trees
    asked = good.where(F.col("vec_id") % every == 0).select("vec_id", "v", "k1", "k2")
    leaves = leaves_for(fitted_forest, some, asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).select("vec_id", "v"), top, recall)
    forest = spark.sparkContext.broadcast(fitted_forest)
    groups = max(1, -(-n * trees // GROUP))
    # leaves larger than a group are dealt out by vec_id to cells, and queries go to all cells of a leaf
    shards = max(1, -(-n * trees // (n_leaves * GROUP)))
    # and queries are dealt to shares, so that a task's part of them is bounded too
    parts = max(1, -(-asked.count() // QUERIES))
    # equal queries are searched once, for one more neighbour: each then leaves out itself
    searches = written(asked.groupBy("k1", "k2").agg(F.first("v").alias("v")).withColumn("query", F.monotonically_increasing_id()), "queries")
    members = asked.select("k1", "k2", F.col("vec_id").alias("query_id")).distinct().join(searches.select("k1", "k2", "query"), ["k1", "k2"]).select("query", "query_id")
    wanted = top + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("v"))
                found = forest.value.leaves(x)
                codes, scale, error = compact(x)
                shard = part.column("vec_id").to_numpy() % shards
                cells = (found * shards + shard[:, None]).ravel()
                rows = np.tile(np.repeat(np.arange(part.num_rows), found.shape[1]), parts)
                to = (cells % groups * parts + np.arange(parts)[:, None]).ravel()
                cells = np.tile(cells, parts)
                code = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(rows))
                yield pa.record_batch([pa.array(to), pa.array(cells), part.column("vec_id").take(pa.array(rows)), code, pa.array(scale[rows]), pa.array(error[rows])], names=["group", "cell", "vec_id", "code", "scale", "error"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and group, with the cells there that the query takes."""
        for batch in batches:
            q, part = _matrix(batch.column("v")), batch.column("part").to_numpy()
            for i in range(len(q)):
                if i % 64 == 0:
                    taken = forest.value.order(q[i : i + 64])[:, :leaves]
                cells = (taken[i % 64][:, None] * shards + np.arange(shards)).ravel()
                cells = cells[np.argsort(cells % groups, kind="stable")]
                to, first = np.unique(cells % groups, return_index=True)
                rows = pa.array(np.full(len(to), i))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(cells)), pa.int32()), pa.array(cells))
                yield pa.record_batch([pa.array(to * parts + part[i]), lists, batch.column("query").take(rows), batch.column("v").take(rows)], names=["group", "cells", "query", "v"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """What may be nearest to each query among the vectors of the group's cells that it takes, with bounds of its distance."""
        found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]]
        if left.num_rows and right.num_rows:
            left = left.sort_by("cell")
            cell, ids, scale, error = (left.column(c).to_numpy() for c in ("cell", "vec_id", "scale", "error"))
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.int8).reshape(len(cell), -1)
            lists, y, names = right.column("cells").combine_chunks(), _matrix(right.column("v")), right.column("query").to_numpy()
            taken, query = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
            order = np.argsort(taken, kind="stable")
            taken, query = taken[order], query[order]
            for one in np.intersect1d(cell, taken):
                (lo, hi), (qlo, qhi) = np.searchsorted(cell, [one, one + 1]), np.searchsorted(taken, [one, one + 1])
                for at in range(qlo, qhi, 256):
                    q = query[at : min(at + 256, qhi)]
                    j, i, low, high = _bounds(codes[lo:hi], scale[lo:hi], error[lo:hi], y[q], wanted)
                    for to, values in zip(found, (q[j], ids[lo:hi][i], low, high)):
                        to.append(values)
        query, ids, low, high = map(np.concatenate, found)
        keep = may_be_nearest(query, ids, low, high, wanted)
        return pa.table([(names if left.num_rows and right.num_rows else query)[query[keep]], ids[keep], low[keep], high[keep]], names=["query", "vec_id", "low", "high"])

    vector = some.schema["v"].dataType.simpleString()
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = some.mapInArrow(post, "group long, cell long, vec_id long, code binary, scale double, error double")
    routed = searches.select("query", "v", F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part")).repartition(spread).mapInArrow(route, f"group long, cells array<long>, query long, v {vector}")
    found = postings.groupBy("group").cogroup(routed.groupBy("group")).applyInArrow(meet, "query long, vec_id long, low double, high double")
    # a candidate has the same bounds in every tree; beyond the top + 1 least upper bounds nothing can be nearest
    one = found.groupBy("query", "vec_id").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("high", "vec_id"))
    bound = F.max(F.when(F.col("nth") <= wanted, F.col("high"))).over(Window.partitionBy("query"))
    pairs = written(one.withColumn("nth", nth).withColumn("bound", bound).where(F.col("low") <= F.col("bound")).select("query", "vec_id"), "candidates")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column("v")), _matrix(batch.column("w"))
            d = np.sqrt(((x - y) ** 2).sum(axis=1)) if len(x) else np.empty(0)
            yield pa.record_batch([batch.column("query"), batch.column("vec_id"), pa.array(d)], names=["query", "vec_id", "score"])

    # of the vectors, those of candidates
    near = only(some, pairs.select("vec_id").distinct(), "vec_id").join(pairs, "vec_id").join(searches.select("query", F.col("v").alias("w")), "query")
    scored = written(near.select("query", "vec_id", "v", "w").mapInArrow(measure, "query long, vec_id long, score double"), "scores")
    best = scored.join(members, "query").where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
