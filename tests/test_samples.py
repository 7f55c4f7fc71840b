"""Samples that end early, steps of one query, and the normal distribution as expressions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emtally.functions import fraglen, normal
from emtally.operators import em, mappings
from emtally.plans import queries
from emtally.sources import alignments as src
from emtally.sources import shared

D = "/root/testdata/sf0.001"
ALIGNED = "frag_id long, aln_idx int, ref_id int, pos long, ori int, frag_len int, is_orphan boolean"


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    """(rows, the same as a file in the order of frag_id): fragments with one to three alignments, ids with gaps, most of the first ones not unique."""
    rng, rows = random.Random(1), []
    for i in range(400):
        k = 1 + (i < 150 or rng.random() < 0.4) + (rng.random() < 0.3)
        rows += [(-700 + 3 * i + (10_000 if i > 300 else 0), j, 0, 0, rng.randrange(7), rng.randint(50, 300), i % 9 == 0) for j in range(k)]
    path = str(tmp_path_factory.mktemp("a"))
    spark.createDataFrame(rows, ALIGNED).coalesce(1).sortWithinPartitions("frag_id").write.mode("overwrite").option("parquet.block.size", "1024").parquet(path)
    return rows, spark.read.parquet(path)


def first(rows, n):
    return sorted({r[0] for r in rows})[:n]


@pytest.mark.parametrize("n", [0, 1, 7, 150, 399, 400, 1000])
def test_first_fragments(file, n):
    rows, a = file
    ids = set(first(rows, n))
    assert sorted(map(tuple, mappings.first_fragments(a, n).collect())) == sorted(r for r in rows if r[0] in ids)
    want = {}
    for r in rows:
        if r[0] in ids:
            want[r[4]] = want.get(r[4], 0) + 1
    assert {r.ori: r.n for r in mappings.sample_orientations(a, n).collect()} == want
    assert {r.ori: r.n for r in mappings.sample_orientations(src.fragments(a), n).collect()} == want


@pytest.mark.parametrize("n", [1, 20, 60, 5000])
def test_first_unique_fragments(file, n):
    rows, a = file
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    unique = [r[0] for _, r in sorted(by.items()) if len(r) == 1 and not r[0][6] and 1 <= r[0][4] <= 4][:n]
    want = {}
    for r in unique:
        want[r[5]] = want.get(r[5], 0) + 1
    assert {r.frag_len: r.n for r in mappings.sampled_length_histogram(a, "IU", n).collect()} == want


def test_no_fragments(spark):
    none = spark.createDataFrame([], ALIGNED)
    assert mappings.sample_orientations(none, 5).collect() == [] and mappings.sampled_length_histogram(none, "IU", 5).collect() == []


def test_a_sample_reads_up_to_a_cutoff(spark, file):
    """The cutoff is a filter of the scan, below every exchange, for a file and for the line items; few rows get past it."""
    rows, a = file
    for sample, column in ((mappings.sample_orientations(a, 5), "frag_id"), (mappings.sampled_length_histogram(a, "IU", 5), "frag_id"), (queries.orientation_sample(spark, D), "l_orderkey"), (queries.fld_pass1_limit(spark, D), "l_orderkey")):
        plan = sample._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PushedFilters: \[[^]]*LessThanOrEqual\({column},", plan) and "collect_list" not in plan
    assert mappings.first_fragments(a, 5).count() == sum(r[0] in set(first(rows, 5)) for r in rows)
    # what reaches the aggregate of the unique ones: a cutoff is raised by a factor, so not much more than is needed
    seen = []
    mappings._until(a, 20, lambda part: seen.append(part) or mappings.unique_fragments(part).where("ori BETWEEN 1 AND 4"))
    sizes = [part.count() for part in seen]
    assert sizes == sorted(sizes) and sizes[-1] < len(rows)


def classes(spark):
    rows = [([0], 10), ([0, 1], 20), ([1, 2], 6), ([], 4)]
    c = spark.createDataFrame([(t, [1.0] * len(t), n) for t, n in rows], "targets array<int>, probs array<double>, n long")
    return c, spark.createDataFrame([(0, 100.0), (1, 200.0), (2, 50.0)], "ref_id int, eff_len double")


@pytest.mark.parametrize("by", [(), ("sample_id",)])
def test_a_step_is_one_query(spark, by):
    """Of a step's jobs one sends the sums by target to the driver, the others are the exchange before it and the state's broadcast."""
    c, t = classes(spark)
    c = c.withColumn("sample_id", F.lit("x")).unionByName(c.withColumn("sample_id", F.lit("y"))) if by else c
    jobs = []
    for k in (3, 11):
        spark.sparkContext.setJobGroup(f"steps-{bool(by)}-{k}", "")
        em.em_frames(c, t, k, convergence=-1e9, by=by)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps-{bool(by)}-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 3 * 8


def test_both_forms_of_the_state_agree(spark, monkeypatch):
    c, t = classes(spark)
    samples = c.withColumn("sample_id", F.lit("x")).unionByName(c.where("size(targets) = 1").withColumn("sample_id", F.lit("y"))).unionByName(c.where("n < 8").withColumn("sample_id", F.lit("z")))
    got = []
    for rows in (em.BROADCAST_ROWS, 1):
        monkeypatch.setattr(em, "BROADCAST_ROWS", rows)
        got.append({(r.sample_id, r.ref_id): r.ecount for r in em.em_frames(samples, t, 6, by=("sample_id",)).collect()})
    assert got[0].keys() == got[1].keys() and len(got[0]) == 9 and all(got[0][k] == pytest.approx(got[1][k], rel=1e-12, abs=1e-12) for k in got[0])


def test_no_classes(spark):
    c, t = classes(spark)
    assert [r.ecount for r in em.em_frames(c.limit(0), t).collect()] == [0, 0, 0]
    assert em.em_frames(c.limit(0).withColumn("s", F.lit(1)), t, by=("s",)).collect() == []


def test_erf(spark):
    x = [i / 64 for i in range(-600, 601)] + [0.7499999, 0.75, 5.9999999, 6.0, 1e300, -1e300, 1e-300, float("inf")]
    got = [r.e for r in spark.createDataFrame([(v,) for v in x], "x double").select(normal.erf(F.col("x")).alias("e")).collect()]
    assert max(abs(g - math.erf(v)) for g, v in zip(got, x)) < 1e-15
    assert spark.range(1).select(normal.erf(F.lit(None).cast("double"))).first()[0] is None


def test_lengths_of_samples(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(v), 1) for s, m, d in (("a", 200, 30), ("b", 5, 9)) for v in np.clip(rng.normal(m, d, 300), 0, None)] + [("c", 7, 5)]
    hist = spark.createDataFrame(rows, "s string, frag_len int, n long").groupBy("s", "frag_len").agg(F.sum("n").alias("n"))
    got = fraglen.parametric_lengths(hist, ("s",)).collect()
    assert {r.s for r in got} == {"a", "b"}
    for s in "ab":
        x = np.array([v for t, v, _ in rows if t == s], float)
        m, d = x.mean(), x.std()
        cut = lambda v: 0.5 * (math.erf((v - m) / d / math.sqrt(2)) - math.erf(-m / d / math.sqrt(2)))
        for r in (r for r in got if r.s == s):
            assert (r.mean, r.sd) == (pytest.approx(m, rel=1e-12), pytest.approx(d, rel=1e-12)) and r.cdf == pytest.approx(cut(r.frag_len) / cut(65536), abs=1e-13)
            assert r.pdf == pytest.approx(math.exp(-0.5 * ((r.frag_len - m) / d) ** 2) / d / math.sqrt(2 * math.pi) / cut(65536), rel=1e-12)


def test_names_of_bucketed_tables_are_dropped(spark):
    table = shared.bucketed(spark.range(5), "some", "id")
    assert table.count() == 5
    name = shared._database(spark)
    assert spark.catalog.databaseExists(name) and "default" not in name and not [t for t in spark.catalog.listTables("default") if not t.isTemporary]
    shared.drop_names(spark)
    assert not spark.catalog.databaseExists(name) and name not in shared._databases
    assert shared.bucketed(spark.range(5), "some", "id").count() == 5


def test_cells_are_dealt_down_a_tree():
    from emtally.operators import replicates

    sizes = [5, 0, 40, 1, 30, 24]
    ahead, n = np.append(0, np.cumsum(sizes)), 4000
    stream = lambda low, high: np.random.default_rng([low, high])
    got = np.array([replicates.dealt(ahead, i, n, stream) for i in range(len(sizes))])
    assert (got.sum(axis=0) == 100).all() and (got[1] == 0).all()
    for i, size in enumerate(sizes):
        p = size / 100
        assert abs(got[i].mean() - size) <= 5 * math.sqrt(100 * p * (1 - p) / n) and abs(got[i].var() - 100 * p * (1 - p)) <= 0.15 * 100 * p * (1 - p)
    # as of a multinomial: cells take from one another
    assert np.cov(got[2], got[4])[0, 1] == pytest.approx(-100 * 0.4 * 0.3, rel=0.2)
    assert (replicates.dealt(np.array([0, 7]), 0, 3, stream) == 7).all()


def test_many_classes_are_not_packed(spark, monkeypatch):
    from emtally.operators import replicates

    c, _ = classes(spark)
    assert replicates.packed_of(c).total == 40 and replicates.packed_of(c.limit(0)).total == 0
    monkeypatch.setattr(replicates, "ENTRIES", 5)
    with pytest.raises(ValueError, match="_frames"):
        replicates.packed_of(c)


def test_classes_that_differ_in_order_are_solved_as_one(spark):
    rows = [([0, 1], [0.2, 0.8], 5), ([1, 0], [0.8, 0.2], 7), ([1, 0], [0.2, 0.8], 2), ([2, 2], [1.0, 1.0], 3), ([], [], 4)]
    classes = spark.createDataFrame(rows, "targets array<int>, probs array<double>, n long")
    merged = sorted((r.targets, r.probs, r.n) for r in em.merged_classes(classes).collect())
    assert merged == [([0, 1], [0.2, 0.8], [12]), ([0, 1], [0.8, 0.2], [2]), ([2, 2], [1.0, 1.0], [3])]
    targets = spark.createDataFrame([(0, 100.0), (1, 50.0), (2, 0.0)], "ref_id int, eff_len double")
    p = em.Packed.of_rows(*zip(*rows))
    want, _ = em.solve(p, p.counts, np.array([100.0, 50.0, 0.0]))
    got = {r.ref_id: r.ecount for r in em.em_frames(classes, targets).collect()}
    assert np.allclose([got[i] for i in range(3)], want)


def test_nested_fragments_give_the_classes_and_lengths_of_flat_ones(spark):
    from emtally.operators import classes as eq
    from emtally.operators import mappings
    from emtally.sources.alignments import fragments

    a = spark.createDataFrame([(f, i, (f * 3 + i) % 4, 5, 1 + (f + i) % 5, 100 + f, f % 3 == 0) for f in range(20) for i in range(f % 3 + 1)], "frag_id long, aln_idx int, ref_id int, pos long, ori int, frag_len int, is_orphan boolean")
    for find in (lambda x: eq.basic_classes(x, "IU"), mappings.unique_fragments):
        flat, nested = find(a), find(fragments(a))
        assert sorted(map(tuple, nested.collect()), key=str) == sorted(map(tuple, flat.collect()), key=str)
