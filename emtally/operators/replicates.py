"""Bootstrap and Gibbs replicates.

``bootstrap_frames`` and ``gibbs_frames`` leave the classes in a table: counts are drawn in tasks, from streams of random
numbers that are seeded by replicate and cell of classes, so that results don't depend on the partitioning.
``bootstrap`` and ``gibbs`` send the packed classes of a small sample to all tasks, one row per replicate or chain.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emtally.operators.em import Packed, em_frames, inverse, is_small, solve, solve_merged
from emtally.operators.exact import exact_sum
from emtally.sources.shared import bucketed, new_path, written

#: Classes, on average, that a task draws counts for at once, as long as there are no more than CELLS cells.
CELL = 2_000
#: Cells at most: the driver sends each one's number of fragments.
CELLS = 100_000
#: Targets of all classes that are packed into arrays at most (16 bytes each, on the driver and in each task).
ENTRIES = 8_000_000
#: Numbers of a Gibbs state (chains x targets) that are sent to all tasks at once.
STATE = 8_000_000
#: Targets, on average, that a task draws fractions for at once where the state is a table.
TARGETS = 20_000

RESULT = "rep int, ref_id int, value double"

# Fixed values of the sampler.
PRIOR, BETA, LEAST_OUTPUT = 1e-3, 0.1, 1e-8
_TINY = 2.2250738585072014e-308


def packed_of(classes: DataFrame) -> Packed:
    """The classes (targets, probs, n) of one sample on the driver: a replicate reads them all, again and again. More than
    ENTRIES targets in all of them together are an error: for those there are the forms over DataFrames."""
    if (classes.agg(F.sum(F.size("targets") + 1)).first()[0] or 0) > ENTRIES:
        raise ValueError("too many classes for arrays: use bootstrap_frames or gibbs_frames")
    rows = list(zip(*((r.targets, r.probs, r.n) for r in classes.select("targets", "probs", "n").toLocalIterator())))
    return Packed.of_rows(*rows) if rows else Packed.of_rows([], [], [])


def _frame(rep: int, values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"rep": np.int32(rep), "ref_id": np.arange(len(values), dtype=np.int32), "value": values})


def bootstrap(spark: SparkSession, p: Packed, eff_len: np.ndarray, n: int, seed: int = 0, sample: int = 0, **limits) -> DataFrame:
    """``n`` replicates: the fragments are dealt anew to the classes in proportion, the empty class among them, and solved.
    Each replicate has its own stream of random numbers, so results don't depend on the partitioning."""
    if not p.total:
        raise ValueError("there are no fragments to draw from")
    shared = spark.sparkContext.broadcast((p, eff_len))

    def draw(frames):
        p, eff = shared.value
        share = np.append(p.counts, p.empty) / p.total
        for frame in frames:
            for rep in frame["id"]:
                rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, sample, int(rep)])))
                counts = rng.multinomial(int(p.total), share)[:-1]
                yield _frame(rep, solve(p, counts, eff, total=p.total, **limits)[0])

    return spark.range(0, n, 1, max(1, n)).mapInPandas(draw, RESULT)


def cells_of(classes: DataFrame) -> DataFrame:
    """(targets, probs, n, key, cell): equal classes merged, in buckets of cell; key orders the classes of a cell."""
    merged = written(classes.groupBy("targets", "probs").agg(F.sum("n").alias("n")), "classes")
    cells = max(1, min(CELLS, -(-merged.count() // CELL)))
    return bucketed(merged.withColumn("key", F.xxhash64("targets", "probs")).withColumn("cell", F.pmod("key", F.lit(cells))), "cells", "cell")


def dealt(ahead: np.ndarray, cell: int, n: int, stream) -> np.ndarray:
    """How many fragments each of ``n`` replicates deals to a cell. ``ahead`` has the fragments before each cell, and all of them
    at its end. They are split down a binary tree of cells, at each node between its halves; a node's stream comes from its
    place, so all cells below it see the same split, and their numbers add up."""
    low, high, k = 0, len(ahead) - 1, np.full(n, ahead[-1], np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        all_, left = ahead[high] - ahead[low], ahead[middle] - ahead[low]
        first = stream(low, high).binomial(k, left / all_ if all_ else 0.0)
        low, high, k = (low, middle, first) if cell < middle else (middle, high, k - first)
    return k


def drawn_counts(classes: DataFrame, n: int, seed: int = 0, sample: int = 0) -> tuple[DataFrame, int]:
    """(targets, probs, counts), an array of ``n`` numbers each, and the fragments of each draw: ``n`` times the fragments dealt anew to the classes in proportion, the empty class among them.
    They are dealt to cells of classes first and then within each, both in the cells' tasks; the driver sends a number per
    cell, CELLS at most. A class's cell comes from its content, so results don't depend on the partitioning."""
    spark, merged = classes.sparkSession, cells_of(classes)
    sizes = sorted((r.cell, r.n) for r in merged.groupBy("cell").agg(F.sum("n").alias("n")).collect())
    ahead = np.append(0, np.cumsum([x for _, x in sizes])).astype(np.int64)
    if not ahead[-1]:
        raise ValueError("there are no fragments to draw from")
    stream = lambda *key: np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, sample, 2, *key])))
    shared = spark.sparkContext.broadcast(({cell: i for i, (cell, _) in enumerate(sizes)}, ahead))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        (places, ahead), cell = shared.value, int(rows["cell"].iloc[0])
        rows = rows.sort_values("key")
        share = rows["n"].to_numpy() / rows["n"].sum()
        counts = np.array([stream(rep, cell).multinomial(int(k), share) for rep, k in enumerate(dealt(ahead, places[cell], n, lambda low, high: stream(low, high, 1)))])
        return pd.DataFrame({"targets": rows["targets"].to_numpy(), "probs": rows["probs"].to_numpy(), "counts": list(counts.T)})

    return merged.groupBy("cell").applyInPandas(draw, "targets array<int>, probs array<double>, counts array<long>"), int(ahead[-1])


def drawn(classes: DataFrame, n: int, seed: int = 0, sample: int = 0) -> DataFrame:
    """(rep, targets, probs, n) of ``drawn_counts``."""
    return _by_replicate(drawn_counts(classes, n, seed, sample)[0])


def _by_replicate(rows: DataFrame) -> DataFrame:
    return rows.select("targets", "probs", F.posexplode("counts").alias("rep", "n")).where("n > 0").select("rep", "targets", "probs", "n")


def bootstrap_frames(classes: DataFrame, targets: DataFrame, n: int, seed: int = 0, sample: int = 0, **limits) -> DataFrame:
    """``bootstrap`` for classes of any number: counts are drawn in tasks, and all replicates solved by DataFrame steps."""
    rows, total = drawn_counts(classes, n, seed, sample)
    rows = written(rows, "drawn")
    if not is_small(targets.select("ref_id").crossJoin(classes.sparkSession.range(n))):
        found = em_frames(written(_by_replicate(rows), "drawn"), targets, by=("rep",), **limits)
        return found.select("rep", "ref_id", F.col("ecount").alias("value"))
    merged = rows.where(F.size("targets") > 0).select("targets", "probs", F.lit(list(range(n))).cast("array<int>").alias("samples"), F.col("counts").alias("n"))
    ids, found = solve_merged(merged, targets, np.full(n, float(total)), **limits)
    table = pa.table({"rep": pa.array(np.repeat(np.arange(n), len(ids)), pa.int32()), "ref_id": pa.array(np.tile(ids, n), pa.int32()), "value": found.ravel()})
    return classes.sparkSession.createDataFrame(table, RESULT)


def chains(samples: int) -> list[int]:
    """Samples of each chain: more chains for more samples, the first ones taking what is left over."""
    k = 8 if samples >= 200 else 4 if samples >= 100 else 2 if samples >= 50 else 1
    return [samples // k + (i < samples % k) for i in range(k)]


def gibbs_iteration(p: Packed, eff_len: np.ndarray, prior: np.ndarray, counts: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """New fractions drawn from the counts, and new counts drawn from the fractions."""
    mu = fractions(counts, eff_len, prior, rng)
    to, many = assign(p.targets, p.probs, p.starts, p.counts, mu, rng)
    return mu, np.bincount(to, many, len(mu))


def gibbs(spark: SparkSession, p: Packed, eff_len: np.ndarray, start: np.ndarray, n: int, thinning: int = 5, seed: int = 0, sample: int = 0) -> DataFrame:
    """``n`` samples from chains that start at the estimate; ``thinning`` iterations precede each. Samples are scaled to
    all fragments, those of the empty class too. A replicate's number follows the chains in their order."""
    shared = spark.sparkContext.broadcast((p, eff_len, start))
    sizes = chains(n)
    before = np.append(0, np.cumsum(sizes)).tolist()

    def draw(frames):
        p, eff, start = shared.value
        prior = PRIOR * inverse(np.where(eff > 0, eff, np.inf))
        for frame in frames:
            for chain in frame["id"]:
                rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, sample, 1, int(chain)])))
                counts = start.copy()
                for i in range(sizes[chain]):
                    mu = np.zeros(len(eff))
                    for _ in range(thinning):
                        mu, counts = gibbs_iteration(p, eff, prior, counts, rng)
                    out = mu * eff
                    if out.sum() > 0:
                        out *= p.total / out.sum()
                        out[out < LEAST_OUTPUT] = 0.0
                    yield _frame(before[chain] + i, out)

    return spark.range(0, len(sizes), 1, len(sizes)).mapInPandas(draw, RESULT)


def rates(counts: np.ndarray, eff_len: np.ndarray, prior: np.ndarray, rng) -> np.ndarray:
    """A Gamma draw for each target, from its counts and its effective length."""
    shape = prior + counts
    mu = np.zeros(len(shape))
    some = shape > 0
    mu[some] = rng.gamma(shape[some], 1.0 / (BETA + eff_len[some]))
    return mu


def fractions(counts: np.ndarray, eff_len: np.ndarray, prior: np.ndarray, rng) -> np.ndarray:
    """Fractions drawn from the counts; they sum to 1."""
    mu = rates(counts, eff_len, prior, rng)
    return mu / mu.sum() if mu.sum() > 0 else mu


def assign(targets: np.ndarray, probs: np.ndarray, starts: np.ndarray, n: np.ndarray, mu: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """(targets, counts): the fragments of each class dealt to its targets by ``mu`` times the class's probabilities; classes
    of one size are drawn together. A class without mass keeps its fragments out, unless it has one target."""
    sizes, found = np.diff(starts), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        at = starts[rows][:, None] + np.arange(size)
        if size == 1:
            found.append((targets[at].ravel(), n[rows]))
            continue
        w = mu[targets[at]] * probs[at]
        total = w.sum(axis=1)
        some = total > _TINY
        if some.any():
            found.append((targets[at[some]].ravel(), rng.multinomial(n[rows[some]], w[some] / total[some, None]).ravel()))
    return np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])


def packed_cell(table: pa.Table) -> pa.Table:
    """A cell of classes as one row: its classes in the order of their keys, their targets and probabilities one after another."""
    table = table.sort_by("key").combine_chunks()
    lists = table.column("targets").combine_chunks()
    columns = {"targets": lists.flatten(), "probs": table.column("probs").combine_chunks().flatten(), "sizes": lists.value_lengths(), "n": table.column("n").combine_chunks()}
    return pa.table({"cell": table.column("cell")[:1], **{c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in columns.items()}})


def drawing(shared, stream, i: int):
    """The draws of iteration ``i`` for cells of classes, of ``packed_cell``: (chain, ref_id, n), for the chains of ``shared`` (chain -> fractions)."""

    def draw(batches):
        for batch in batches:
            for cell, *arrays in zip(batch.column("cell").to_pylist(), *(batch.column(c) for c in ("targets", "probs", "sizes", "n"))):
                flat, probs, sizes, n = (x.values.to_numpy() for x in arrays)
                starts = np.append(0, np.cumsum(sizes))
                for c, mu in shared.value.items():
                    to, many = assign(flat, probs, starts, n, mu, stream(c, i, cell))
                    names, at = np.unique(to, return_inverse=True)
                    yield pa.record_batch([pa.array(np.full(len(names), c), pa.int32()), pa.array(names, pa.int32()), pa.array(np.bincount(at, many, len(names)).astype(np.int64))], names=["chain", "ref_id", "n"])

    return draw


def gibbs_frames(classes: DataFrame, targets: DataFrame, start: DataFrame, n: int, thinning: int = 5, seed: int = 0, sample: int = 0) -> DataFrame:
    """``gibbs`` for classes of any number, a written table. An iteration draws fractions from the counts by target, which
    the driver holds (a row per target, up to BROADCAST_ROWS of them), and is one job over the cells of
    classes, whose draws are summed by target. Chains go together as long as STATE allows. Beyond BROADCAST_ROWS targets the
    state is a table (``gibbs_tables``). ``start``: (ref_id, ecount), ref_id dense from 0."""
    spark = classes.sparkSession
    if not is_small(targets):
        return gibbs_tables(classes, targets, start, n, thinning, seed, sample)
    rows = targets.join(start, "ref_id", "left").orderBy("ref_id").select("eff_len", F.coalesce("ecount", F.lit(0.0)).alias("ecount")).toArrow()
    eff, first = (rows.column(c).to_numpy().astype(float) for c in ("eff_len", "ecount"))
    total = float(classes.agg(F.sum("n")).first()[0] or 0)
    prior = PRIOR * inverse(np.where(eff > 0, eff, np.inf))
    cells = cells_of(classes.where(F.size("targets") > 0)).groupBy("cell").applyInArrow(packed_cell, "cell long, targets array<int>, probs array<double>, sizes array<int>, n array<long>")
    cells, path, sizes = written(cells, "cells"), new_path(spark, "gibbs"), chains(n)
    before = np.append(0, np.cumsum(sizes)).tolist()
    stream = lambda *key: np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, sample, 3, *key])))
    together = max(1, STATE // max(1, len(eff)))
    for some in (range(at, min(at + together, len(sizes))) for at in range(0, len(sizes), together)):
        counts = {c: first for c in some}
        last = thinning * max(sizes[c] for c in some)
        for i in range(last):
            going = [c for c in some if i < thinning * sizes[c]]
            mu = {c: fractions(counts[c], eff, prior, stream(c, i)) for c in going}
            if (i + 1) % thinning == 0:
                out = []
                for c in going:
                    values = mu[c] * eff
                    if values.sum() > 0:
                        values *= total / values.sum()
                        values[values < LEAST_OUTPUT] = 0.0
                    out.append(pa.table({"rep": pa.array(np.full(len(eff), before[c] + i // thinning), pa.int32()), "ref_id": pa.array(np.arange(len(eff)), pa.int32()), "value": values}))
                spark.createDataFrame(pa.concat_tables(out)).write.mode("append").parquet(path)
            if i + 1 == last:
                break
            shared = spark.sparkContext.broadcast(mu)

            new = cells.mapInArrow(drawing(shared, stream, i), "chain int, ref_id int, n long").groupBy("chain", "ref_id").agg(F.sum("n").alias("n")).toArrow()
            chain, ref, many = (new.column(x).to_numpy() for x in ("chain", "ref_id", "n"))
            counts = {c: np.bincount(ref[chain == c], many[chain == c], len(eff)) for c in going}
            shared.unpersist()
    if not len(eff) or not n:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(path)


def drawing_rates(stream, i: int, k: int):
    """The draws of iteration ``i`` for a cell of targets: (ref_id, eff_len, mu0 ...) from (cell, ref_id, eff_len, n0 ...), of ``k`` chains."""

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("ref_id")
        eff, cell = table.column("eff_len").to_numpy(), table.column("cell")[0].as_py()
        prior = PRIOR * inverse(np.where(eff > 0, eff, np.inf))
        drawn = {f"mu{c}": rates(table.column(f"n{c}").to_numpy(), eff, prior, stream(5, c, i, cell)) for c in range(k)}
        return pa.table({"ref_id": table.column("ref_id"), "eff_len": table.column("eff_len"), **drawn})

    return draw


def drawing_counts(stream, i: int, k: int):
    """The draws of iteration ``i`` for a cell of classes, a row per class and target with the target's fractions: (ref_id, n0 ...)."""

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("key", "eq_id", "place")])
        of, cell = table.column("eq_id").to_numpy(), table.column("cell")[0].as_py()
        starts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        names, local = np.unique(table.column("ref_id").to_numpy(), return_inverse=True)
        probs, n, found = table.column("prob").to_numpy(), table.column("n").to_numpy()[starts[:-1]], {}
        for c in range(k):
            mu = np.zeros(len(names))
            mu[local] = table.column(f"mu{c}").to_numpy()
            to, many = assign(local, probs, starts, n, mu, stream(6, c, i, cell))
            found[f"n{c}"] = np.bincount(to, many, len(names)).astype(np.int64)
        return pa.table({"ref_id": pa.array(names, pa.int32()), **found})

    return draw


def gibbs_tables(classes: DataFrame, targets: DataFrame, start: DataFrame, n: int, thinning: int = 5, seed: int = 0, sample: int = 0) -> DataFrame:
    """``gibbs`` for classes and targets of any number: the driver holds two sums per chain (8 at most) and nothing else. The
    state, a row per target with a number per chain, is written each iteration, so a lost executor costs a part of one
    iteration. Gamma draws are made in tasks by cells of targets. Fractions meet the classes' entries by a shuffle join, whose
    hot targets Spark may split, and the classes are drawn by cells. Streams are seeded by chain, iteration and cell, cells come
    from contents, and the normalisers are exact sums: the result doesn't depend on the partitioning. Parameters are those of
    ``gibbs_frames``, but ref_id need not be dense; no targets or no samples give no rows."""
    spark, sizes, path = classes.sparkSession, chains(n), new_path(classes.sparkSession, "gibbs")
    k, before = len(sizes), np.append(0, np.cumsum(sizes)).tolist()
    stream = lambda *key: np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, sample, *key])))
    total, n_targets = float(classes.agg(F.sum("n")).first()[0] or 0), targets.count()
    if not n or not n_targets:
        return spark.createDataFrame([], RESULT)
    cell = F.pmod(F.xxhash64("ref_id"), F.lit(-(-n_targets // TARGETS)))
    known = bucketed(targets.select("ref_id", "eff_len", cell.alias("cell")), "targets", "ref_id")
    numbered = written(cells_of(classes.where(F.size("targets") > 0)).withColumn("eq_id", F.monotonically_increasing_id()), "classes")
    pairs = numbered.select("cell", "key", "eq_id", "n", F.posexplode(F.arrays_zip("targets", "probs")).alias("place", "x"))
    pairs = written(pairs.select("cell", "key", "eq_id", "place", "n", F.col("x.targets").alias("ref_id"), F.col("x.probs").alias("prob")), "entries")
    counts = start.select("ref_id", *(F.col("ecount").alias(f"n{c}") for c in range(k)))
    for i in range(thinning * max(sizes)):
        state = known.join(counts, "ref_id", "left").select("cell", "ref_id", "eff_len", *(F.coalesce(F.col(f"n{c}").cast("double"), F.lit(0.0)).alias(f"n{c}") for c in range(k)))
        columns = ", ".join(f"mu{c} double" for c in range(k))
        mu = written(state.groupBy("cell").applyInArrow(drawing_rates(stream, i, k), f"ref_id int, eff_len double, {columns}"), "fractions")
        each = F.array(*(F.struct(F.lit(c).alias("chain"), F.lit(out).alias("out"), (F.col(f"mu{c}") * (F.col("eff_len") if out else 1.0)).alias("x")) for c in range(k) for out in (False, True)))
        sums = {(r.chain, r.out): r.total for r in exact_sum(mu.select(F.explode(each).alias("e")).select("e.*"), ["chain", "out"], F.col("x"), "total").collect()}
        if (i + 1) % thinning == 0:
            # a sample of each chain that still goes; without any mass all are 0
            out = [F.struct(F.lit(before[c] + i // thinning).alias("rep"), (F.col(f"mu{c}") * F.col("eff_len") * (total / sums[c, True] if sums[c, True] > 0 else 0.0)).alias("value")) for c in range(k) if i < thinning * sizes[c]]
            rows = mu.select("ref_id", F.explode(F.array(*out)).alias("o"))
            rows.select("o.rep", "ref_id", F.when(F.col("o.value") < LEAST_OUTPUT, 0.0).otherwise(F.col("o.value")).alias("value")).write.mode("append").parquet(path)
        shares = mu.select("ref_id", *((F.col(f"mu{c}") / (sums[c, False] or 1.0)).alias(f"mu{c}") for c in range(k)))
        columns = ", ".join(f"n{c} long" for c in range(k))
        drawn = pairs.join(shares, "ref_id").groupBy("cell").applyInArrow(drawing_counts(stream, i, k), f"ref_id int, {columns}")
        counts = drawn.groupBy("ref_id").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in range(k)))
    return spark.read.schema(RESULT).parquet(path)
