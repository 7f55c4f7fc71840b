import json

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emtally.config import QuantOptions
from emtally.functions import fraglen
from emtally.operators import classes as eq
from emtally.operators import em, mappings, replicates
from emtally.operators.tpm import tpm
from emtally.plans import estimate, queries
from emtally.sources import alignments as src
from emtally.sources import sinks

ALIGNED = "frag_id long, aln_idx int, ref_id int, pos long, ori int, frag_len int, is_orphan boolean"
CLASSES = [([0], 10), ([0, 1], 20), ([1, 2], 6), ([], 4)]
EFF = np.array([100.0, 200.0, 50.0])
WANT = {
    0: [23.333333333333336, 7.866666666666667, 4.8], 1: [27.11491442542787, 4.6289279391041465, 4.25615763546798],
    2: [28.427106452274323, 2.855526499673305, 4.717367048052374], 1500: [29.995144230624323, 0.008499051372862502, 5.996356718002814],
}


def packed():
    return em.Packed.of_rows([t for t, _ in CLASSES], [[1.0] * len(t) for t, _ in CLASSES], [n for _, n in CLASSES])


def frames(spark):
    c = spark.createDataFrame([(t, [1.0] * len(t), n) for t, n in CLASSES], "targets array<int>, probs array<double>, n long")
    return c, spark.createDataFrame([(i, float(x)) for i, x in enumerate(EFF)], "ref_id int, eff_len double")


def plain_em(max_iter):
    """The rules as loops."""
    n = 40 / 3
    before = [n] * 3

    def step(a):
        out = [0.0] * 3
        for t, count in CLASSES:
            d = sum(a[i] / EFF[i] for i in t)
            if d > 1e-8:
                for i in t:
                    out[i] += count * (a[i] / EFF[i]) / d
        return out

    for _ in range(max_iter):
        new = step(before)
        change = max([0.0, *((y - x) / x for x, y in zip(before, new) if x > 1e-8)])
        before = new
        if change < 1e-3:
            break
    return step([0.0 if x < 1e-8 else x for x in before])


@pytest.mark.parametrize("max_iter", WANT)
def test_em(max_iter):
    p = packed()
    found, n = em.solve(p, p.counts, EFF, max_iter)
    assert found == pytest.approx(WANT[max_iter], rel=1e-12) and found == pytest.approx(plain_em(max_iter), rel=1e-12)
    assert p.total == 40 and found.sum() == pytest.approx(36) and (max_iter < 1500 or n == 12)


def test_em_frames_and_groups(spark):
    c, t = frames(spark)
    by = {r.ref_id: r.ecount for r in em.em_frames(c, t, 2).collect()}
    assert [by[i] for i in range(3)] == pytest.approx(WANT[2], rel=1e-9)
    both = c.withColumn("sample_id", F.lit("x")).unionByName(c.withColumn("sample_id", F.lit("y")))
    rows = em.em_groups(both, t).collect()
    for sample in "xy":
        assert [r.ecount for r in sorted(rows, key=lambda r: r.ref_id) if r.sample_id == sample] == pytest.approx(WANT[1500], rel=1e-9)


def test_em_frames_of_samples_stop_apart(spark):
    c, t = frames(spark)
    both = c.withColumn("sample_id", F.lit("x")).unionByName(c.where("size(targets) = 1").withColumn("sample_id", F.lit("y")))
    got = {(r.sample_id, r.ref_id): r.ecount for r in em.em_frames(both, t, by=("sample_id",)).collect()}
    assert [got["x", i] for i in range(3)] == pytest.approx(WANT[1500], rel=1e-9) and [got["y", i] for i in range(3)] == [10, 0, 0]


def test_large_samples_are_not_solved_in_one_group(spark, monkeypatch):
    def fail(*a, **k):
        raise AssertionError("all classes of a sample in one task")

    want = {}
    d = "/root/testdata/sf0.001"
    for i in range(2):
        a = src.fixture_alignments(spark, d).where(F.col("frag_id") % 2 == i)
        p = replicates.packed_of(eq.packed(eq.basic_classes(a, queries.LIB)))
        eff = np.array([r.eff_len for r in queries._targets(spark, d).orderBy("ref_id").collect()])
        want |= {(str(i), j): x for j, x in enumerate(em.solve(p, p.counts, eff)[0])}
    monkeypatch.setattr(em, "em_groups", fail)
    got = {(r.sample_id, r.ref_id): r.ecount for r in queries.em_samples(spark, d).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)


def test_quant_converged(spark):
    d = "/root/testdata/sf0.001"
    rows = eq.range_classes(queries._with_probs(spark, d), queries.LIB, 64).collect()
    classes = [(r.targets, [b / 64 + 0.5 / 64 for b in r.bins], r.n) for r in rows]
    eff = [r.eff_len for r in queries._targets(spark, d).orderBy("ref_id").collect()]

    def step(a):
        out = [0.0] * len(eff)
        for targets, probs, n in classes:
            w = [p * a[t] / eff[t] for t, p in zip(targets, probs)]
            if sum(w) > 1e-8:
                for t, x in zip(targets, w):
                    out[t] += n * x / sum(w)
        return out

    now = [sum(n for _, _, n in classes) / len(eff)] * len(eff)
    for _ in range(1500):
        before, now = now, step(now)
        if max([0.0, *((y - x) / x for x, y in zip(before, now) if x > 1e-8)]) < 1e-3:
            break
    want = step([0.0 if x < 1e-8 else x for x in now])
    rate = [x / e for x, e in zip(want, eff)]
    assert "quant_converged" in queries.queries() and "tpm_converged" in queries.queries()
    got = queries.quant_converged(spark, d).collect()
    for r in got:
        assert r.ecount == pytest.approx(want[r.ref_id], abs=2e-4) and r.tpm == pytest.approx(1e6 * rate[r.ref_id] / sum(rate), abs=2e-3)
    by_sql = in_duckdb(d, "quant_converged").set_index("ref_id")
    assert len(by_sql) == len(got) and all(by_sql.loc[r.ref_id, c] == r[c] for r in got for c in by_sql.columns)


def in_duckdb(d, name):
    con = duckdb.connect()
    for table in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    return con.execute(queries.oracle_sql()[name]).fetchdf()


@pytest.mark.parametrize("going", ["i < 1499", "i < 0"])
def test_sql_that_converges_against_the_array_form(going):
    """Also where the steps run out: ``going`` takes the place of the limit."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest([0, 1, 2]) AS ref_id")
    con.execute("CREATE TABLE e AS SELECT unnest([0, 1, 2]) AS ref_id, unnest([100.0, 200.0, 50.0]::DOUBLE[]) AS eff_len")
    con.execute("CREATE TABLE start AS SELECT '0' AS sample_id, ref_id, 40 / 3::DOUBLE AS a FROM t")
    con.execute("CREATE TABLE em_pairs AS SELECT '0' AS sample_id, eq_id, n, x.ref_id, 1 / eff_len AS w FROM (VALUES (0, 10, 0), (1, 20, 0), (1, 20, 1), (2, 6, 1), (2, 6, 2)) x(eq_id, n, ref_id) JOIN e USING (ref_id)")
    sql = queries._converged_sql("", "SELECT ref_id, ecount FROM counts ORDER BY ref_id")
    own = "WITH RECURSIVE " + sql[sql.index(", run AS (") + 2 :].replace("i < 1499", going)
    assert [x for _, x in con.execute(own).fetchall()] == pytest.approx(WANT[1500 if "1499" in going else 1])


def test_all_line_items_are_alignments(spark):
    d = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    assert src.fixture_alignments(spark, d).count() == items.count()
    assert queries._classes(spark, d).agg(F.max(F.size("targets"))).first()[0] > 3


def test_tpm(spark):
    df = spark.createDataFrame([(i, float(EFF[i]), WANT[1500][i]) for i in range(3)] + [(3, 0.0, 5.0)], "ref_id int, eff_len double, ecount double")
    assert [r.tpm for r in tpm(df).orderBy("ref_id").collect()] == pytest.approx([714304.3356517428, 101.1982005801514, 285594.4661476771, 0.0])
    assert {r.tpm for r in tpm(df.withColumn("ecount", F.lit(0.0))).collect()} == {0.0}


def test_conditional_means_and_effective_lengths(spark):
    hist = spark.createDataFrame([(2, 1), (4, 3)], "frag_len int, n long")
    means = fraglen.conditional_means(hist)
    got = {r.frag_len: r.mean for r in means.where("frag_len < 6 or frag_len = 65535").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 3.5, 5: 3.5, 65535: 3.5}
    targets = spark.createDataFrame([(i, str(i), x) for i, x in enumerate((0, 1, 3, 4, 70000, 65536))], "ref_id int, target_name string, len long")
    assert [r.eff_len for r in fraglen.effective_lengths(targets, means).orderBy("ref_id").collect()] == [0, 1, 1, 4, 69996.5, 65532.5]


def test_empirical_cdf_is_the_sequential_sum(spark):
    rng = np.random.default_rng(1)
    n = rng.integers(0, 50, 300)
    hist = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "frag_len int, n long")
    got = [r.cdf for r in fraglen.empirical(hist).orderBy("frag_len").limit(300).collect()]
    total, run = n.sum() + fraglen.TINY * 65536, 0.0
    for x, y in zip(n, got):
        run += (x + fraglen.TINY) / total
        assert y == run + fraglen.TINY
    empty = fraglen.empirical(hist.limit(0)).where("frag_len = 7").first()
    assert empty.pdf == 2**-16


def test_parametric(spark):
    table = fraglen.parametric(spark, 250.0, 25.0).agg(F.max("cdf")).first()[0]
    assert table == pytest.approx(1 / 25.0, rel=1e-6)  # the density has 1/sd twice
    assert fraglen.parametric_means(spark, 250.0, 25.0).where("frag_len = 60000").first().mean == pytest.approx(250.0, abs=1e-6)


def test_bins(spark):
    df = spark.createDataFrame([([0.2, 0.3],), ([0.7],), ([0.0, 0.0],), ([],)], "p array<double>")
    assert [r.b for r in df.select(eq.bins_of(F.col("p"), 64).alias("b")).collect()] == [[25, 38], [63], [0, 0], []]
    one = spark.createDataFrame([([0], [25], [1], 1)], "targets array<int>, bins array<int>, oris array<int>, n long")
    assert eq.packed(one, 64).first().probs == [0.3984375]


def test_classes_keep_order_repeats_and_empty(spark):
    rows = [(1, 0, 1, 0, 1, 0, False), (1, 1, 2, 0, 1, 0, False), (2, 0, 2, 0, 1, 0, False), (2, 1, 1, 0, 1, 0, False), (3, 0, 1, 0, 5, 0, False), (4, 0, 1, 0, 1, 0, False), (4, 1, 1, 0, 1, 0, False), (5, 0, 1, 0, 2, 0, False), (6, 0, 1, 0, 1, 0, False)]
    a = spark.createDataFrame(rows, ALIGNED)
    got = {(tuple(r.targets), tuple(r.oris)): r.n for r in eq.basic_classes(a, "IU").collect()}
    assert got == {((1, 2), (1, 1)): 1, ((2, 1), (1, 1)): 1, ((), ()): 1, ((1, 1), (1, 1)): 1, ((1,), (2,)): 1, ((1,), (1,)): 1}
    stats = {r.ori: (r.mapped, r.filtered) for r in mappings.orientation_stats(a, "IU").collect()}
    assert stats == {1: (4, 0), 2: (1, 0), 5: (0, 1)}
    report = sorted(map(tuple, mappings.orientation_report(a, "IU").collect()))
    assert report == [(0, "unknown", 0, 0), (1, "f", 4, 0), (2, "r", 1, 0), (3, "fr", 0, 0), (4, "rf", 0, 0), (5, "ff", 0, 1), (6, "rr", 0, 0)]


def test_probabilities(spark):
    a = spark.createDataFrame([(1, 0, 0, 10, 1, 0, True), (2, 0, 0, 500, 1, 0, True), (3, 0, 0, 5, 2, 0, True), (4, 0, 0, 0, 3, 7, False), (5, 0, 0, 0, 4, 9, False), (6, 0, 0, 0, 5, 7, False)], ALIGNED)
    t = spark.createDataFrame([(0, "t", 100)], "ref_id int, target_name string, len long")
    table = spark.createDataFrame([(7, 0.25, 0.5), (90, 0.0, 0.75), (105, 0.0, 0.875)], "frag_len int, pdf double, cdf double")
    got = {r.frag_id: r.prob for r in eq.conditional_probabilities(a, t, table).collect()}
    assert got == {1: 0.75, 2: 1.0, 3: 0.875, 4: 0.25, 5: fraglen.TINY, 6: 2 * fraglen.TINY}


def test_histograms_differ_between_passes(spark):
    rows = [(i, 0, 0, 0, ori, 100 + i, orphan) for i, ori, orphan in ((1, 3, False), (2, 5, False), (3, 1, True), (4, 4, False))]
    nested = src.fragments(spark.createDataFrame(rows, ALIGNED))
    lengths = lambda df: sorted(r.frag_len for r in df.collect())
    assert lengths(mappings.length_histogram(nested)) == [101, 102, 104]
    assert lengths(mappings.sampled_length_histogram(nested, "IU", 10)) == [101, 104] and lengths(mappings.sampled_length_histogram(nested, "IU", 1)) == [101]
    assert sorted(map(tuple, src.flatten(nested).select("frag_id", "ori").collect())) == [(1, 3), (2, 5), (3, 1), (4, 4)]


def test_replicates(spark):
    p = packed()
    a = replicates.bootstrap(spark, p, EFF, 40, seed=3).toPandas()
    b = replicates.bootstrap(spark, p, EFF, 40, seed=3).coalesce(1).toPandas()
    assert a.sort_values(["rep", "ref_id"])["value"].tolist() == b.sort_values(["rep", "ref_id"])["value"].tolist()
    sums = a.groupby("rep")["value"].sum()
    assert abs(sums.mean() - 36) < 4 * np.sqrt(40 * 0.1 * 0.9 / 40) + 0.3
    with pytest.raises(ValueError):
        replicates.bootstrap(spark, em.Packed.of_rows([], [], []), EFF, 1)
    assert [replicates.chains(n) for n in (10, 50, 100)] == [[10], [25, 25], [25] * 4] and replicates.chains(203) == [26] * 3 + [25] * 5
    g = replicates.gibbs(spark, p, EFF, np.array(WANT[1500]), 50, 2, seed=1).toPandas()
    assert sorted(g["rep"].unique()) == list(range(50)) and g.groupby("rep")["value"].sum().tolist() == pytest.approx([40.0] * 50)


def test_bootstrap_without_classes_on_the_driver(spark, monkeypatch):
    def fail(*a, **k):
        raise AssertionError("all classes on the driver")

    monkeypatch.setattr(replicates, "packed_of", fail)
    monkeypatch.setattr(replicates, "CELL", 1)
    c, t = frames(spark)
    key = lambda df: sorted((r.rep, tuple(r.targets), r.n) for r in df.collect())
    got = key(replicates.drawn(c, 200, 3))
    assert got == key(replicates.drawn(c.repartition(3), 200, 3))
    assert all(sum(n for rep, _, n in got if rep == i) == 40 for i in range(200))
    for targets, count in CLASSES:
        n = [sum(n for rep, x, n in got if rep == i and x == tuple(targets)) for i in range(200)]
        assert abs(np.mean(n) - count) < 5 * np.sqrt(count * (1 - count / 40) / 200) and np.var(n) == pytest.approx(count * (1 - count / 40), rel=0.5)
    monkeypatch.setattr(replicates, "bootstrap_frames", lambda classes, targets, n: replicates.drawn(classes, n))
    assert queries.bootstrap_replicates(spark, "/root/testdata/sf0.001").agg(F.countDistinct("rep")).first()[0] == 8


def test_bootstrap_frames_solves_each_replicate(spark):
    c, t = frames(spark)
    a = {(r.rep, r.ref_id): r.value for r in replicates.bootstrap_frames(c, t, 2, 3, max_iter=3).collect()}
    for rep in range(2):
        rows = [r for r in replicates.drawn(c, 2, 3).collect() if r.rep == rep]
        p = em.Packed.of_rows([r.targets for r in rows], [r.probs for r in rows], [r.n for r in rows])
        assert [a[rep, i] for i in range(3)] == pytest.approx(em.solve(p, p.counts, EFF, 3)[0], rel=1e-9)


def test_gibbs_frames_draws_as_the_array_form(spark, monkeypatch):
    def fail(*a, **k):
        raise AssertionError("all classes on the driver")

    c, t = frames(spark)
    start = spark.createDataFrame(list(enumerate(WANT[1500])), "ref_id int, ecount double")
    want = replicates.gibbs(spark, packed(), EFF, np.array(WANT[1500]), 220, 2, seed=1).toPandas().groupby("ref_id")["value"]
    monkeypatch.setattr(replicates, "packed_of", fail)
    monkeypatch.setattr(replicates, "CELL", 1)
    found = replicates.gibbs_frames(c, t, start, 220, 1, seed=2).toPandas()
    assert sorted(found["rep"].unique()) == list(range(220)) and found.groupby("rep")["value"].sum().tolist() == pytest.approx([40.0] * 220)
    got = found.groupby("ref_id")["value"]
    for i in range(3):
        a, b = got.get_group(i), want.get_group(i)
        # samples of one chain depend on each other: a wide margin
        assert abs(a.mean() - b.mean()) < 0.6 * max(a.std(), b.std()) + 0.05 and a.std() < 2 * b.std() + 0.1 and b.std() < 2 * a.std() + 0.1
    few = lambda df: replicates.gibbs_frames(df, t, start, 3, 2, seed=5).orderBy("rep", "ref_id").collect()
    assert few(c) == few(c.repartition(3)) and len(few(c)) == 9
    monkeypatch.setattr(replicates, "STATE", 3)
    assert sorted({r.rep for r in replicates.gibbs_frames(c, t, start, 50, 1).collect()}) == list(range(50))


def test_gibbs_draws_by_cells_as_the_array_form(spark):
    """The tasks' draws, a cell for each class and target, iterated without Spark: the same distribution."""
    want = replicates.gibbs(spark, packed(), EFF, np.array(WANT[1500]), 220, 2, seed=1).toPandas().groupby("ref_id")["value"]
    stream = lambda *key: np.random.default_rng([7, *key])
    entries = [(i, j, int(x), p, n) for i, (ts, n) in enumerate(CLASSES) for j, (x, p) in enumerate(zip(ts, [1.0] * len(ts)))]
    counts, found = np.array([[x, x] for x in WANT[1500]], float), []
    for i in range(600):
        mu = np.zeros((3, 2))
        for x in range(3):
            state = pa.table({"cell": [x], "ref_id": pa.array([x], pa.int32()), "eff_len": [float(EFF[x])], "n0": counts[x, :1], "n1": counts[x, 1:]})
            drawn = replicates.drawing_rates(stream, i, 2)(state)
            mu[x] = [drawn.column("mu0")[0].as_py(), drawn.column("mu1")[0].as_py()]
        mu, counts = mu / mu.sum(axis=0), np.zeros((3, 2))
        for c in {e[0] for e in entries}:
            of = [e for e in entries if e[0] == c][::-1]
            rows = pa.table({"cell": [c] * len(of), "key": [1] * len(of), "eq_id": [c] * len(of), "place": [e[1] for e in of], "ref_id": pa.array([e[2] for e in of], pa.int32()),
                             "prob": [e[3] for e in of], "n": [e[4] for e in of], "mu0": mu[[e[2] for e in of], 0], "mu1": mu[[e[2] for e in of], 1]})
            drawn = replicates.drawing_counts(stream, i, 2)(rows)
            counts[drawn.column("ref_id").to_numpy(), 0] += drawn.column("n0").to_numpy()
            counts[drawn.column("ref_id").to_numpy(), 1] += drawn.column("n1").to_numpy()
        out = mu * EFF[:, None]
        found.append(out * 40 / out.sum(axis=0))
    for x in range(3):
        mine, b = np.array(found)[:, x].ravel(), want.get_group(x)
        assert abs(mine.mean() - b.mean()) < 0.6 * max(mine.std(), b.std()) + 0.05 and mine.std() < 2 * b.std() + 0.1 and b.std() < 2 * mine.std() + 0.1


def test_gibbs_with_its_state_as_a_table(spark, monkeypatch):
    """Nothing by target comes to the driver, and partitions change nothing."""

    def fail(*a, **k):
        raise AssertionError("the state is on the driver")

    c, t = frames(spark)
    start = spark.createDataFrame(list(enumerate(WANT[1500])), "ref_id int, ecount double")
    monkeypatch.setattr(em, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(replicates, "TARGETS", 1)
    monkeypatch.setattr(replicates, "CELL", 2)
    monkeypatch.setattr(replicates, "chains", lambda n: [2, 1])
    monkeypatch.setattr(type(c), "toArrow", fail)
    few = lambda df: replicates.gibbs_frames(df, t, start, 3, 1, seed=5).orderBy("rep", "ref_id").collect()
    once = few(c)
    assert once == few(c.repartition(3)) and [(r.rep, r.ref_id) for r in once] == [(i, j) for i in range(3) for j in range(3)]
    assert [sum(r.value for r in once if r.rep == i) for i in range(3)] == pytest.approx([40.0] * 3)
    assert len({r.value for r in once if r.ref_id == 0}) == 3
    assert replicates.gibbs_tables(c, t.limit(0), start, 3).count() == 0 and replicates.gibbs_tables(c, t, start, 0).count() == 0
    # without classes nothing has mass to scale to
    assert {r.value for r in replicates.gibbs_tables(c.limit(0), t, start, 3, 1).collect()} == {0.0}


def test_classes_are_dealt_by_fractions_times_probabilities():
    rng = np.random.default_rng(3)
    targets, probs, starts, n = np.array([0, 0, 1, 1, 2, 0, 1, 2]), np.array([1.0, 1, 3, 0.5, 0.5, 0, 0, 0]), np.array([0, 1, 3, 5, 8]), np.array([7, 40_000, 40_000, 9])
    to, many = replicates.assign(targets, probs, starts, n, np.array([0.5, 0.25, 0.25]), rng)
    got = np.bincount(to, many, 3)
    # class 0 is certain; 1: weights 0.5 and 0.75; 2: equal ones; the last has no mass
    assert got.sum() == 80_007 and got == pytest.approx([7 + 16_000, 24_000 + 20_000, 20_000], abs=500)


def test_steps_have_linear_plans_without_a_shuffle_of_pairs(spark):
    c, t = frames(spark)
    pairs = em.bucketed(em.incidence(c, t), "incidence", "eq_id")
    sizes = []
    for k in (1, 2, 4):
        plan = em.em_steps(pairs, em.uniform(t, c), t, k)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(eq_id" not in plan
        sizes.append(plan.count("FileScan"))
    assert sizes[1] - sizes[0] == (sizes[2] - sizes[1]) / 2 == 1


def test_large_states_are_written_and_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(em, "BROADCAST_ROWS", 2)
    c, t = frames(spark)
    both = c.withColumn("sample_id", F.lit("x")).unionByName(c.where("size(targets) = 1").withColumn("sample_id", F.lit("y")))
    got = {(r.sample_id, r.ref_id): r.ecount for r in em.em_frames(both, t, by=("sample_id",), max_iter=3).collect()}
    p = packed()
    assert [got["x", i] for i in range(3)] == pytest.approx(em.solve(p, p.counts, EFF, 3)[0], rel=1e-9) and [got["y", i] for i in range(3)] == [10, 0, 0]
    with pytest.raises(ValueError):
        em.em_groups(both, t)


def test_quantify_by_exact_sums(spark):
    a, t = src.fixture_alignments(spark, "/root/testdata/sf0.001").where("frag_id < 200"), src.fixture_targets(spark, "/root/testdata/sf0.001")
    options = QuantOptions(lib_type="IU", max_iter=2)
    both = [estimate.quantify(a, t, options, solver=s).quant.orderBy("ref_id").select("ecount", "tpm").collect() for s in ("frames", "exact")]
    assert [x for r in both[1] for x in r] == pytest.approx([x for r in both[0] for x in r], rel=1e-9) and sum(r.tpm for r in both[1]) == pytest.approx(1e6)
    with pytest.raises(ValueError):
        estimate.quantify(a, t, options, solver="other")


def test_schema_errors(spark):
    a = spark.createDataFrame([(1, 0, 0, 0, 1, 0, False)], ALIGNED)
    assert src.conform(a.withColumn("extra", F.lit("x")).withColumn("ref_id", F.col("ref_id").cast("long")), src.ALIGNMENTS, "alignments").columns == list(src.ALIGNMENTS)
    with pytest.raises(src.SchemaError, match="lacks pos, ori"):
        src.conform(a.drop("pos", "ori"), src.ALIGNMENTS, "alignments")
    for c, wrong in (("pos", F.lit("7")), ("ori", F.lit(1.5)), ("is_orphan", F.lit(1)), ("ref_id", F.array(F.lit(1)))):
        with pytest.raises(src.SchemaError, match=c):
            src.conform(a.withColumn(c, wrong), src.ALIGNMENTS, "alignments")


def test_targets_of_header_arrays(spark):
    assert [tuple(r) for r in src.targets_of(["a", "b"], [10, 20], spark).collect()] == [(0, "a", 10), (1, "b", 20)]
    with pytest.raises(ValueError):
        src.targets_of(["a"], [1, 2], spark)


def test_written_parquet_options(spark, tmp_path):
    path = sinks.write_lengths(spark.createDataFrame([(3, 2)], "frag_len int, n long"), tmp_path / "x")
    meta = pq.ParquetFile(path).metadata
    column = meta.row_group(0).column(0)
    assert meta.num_row_groups == 1 and column.compression == "ZSTD" and "RLE_DICTIONARY" not in column.encodings and meta.format_version == "2.6"


def test_warnings_of_little_evidence(spark):
    d = "/root/testdata/sf0.001"
    t = src.fixture_targets(spark, d)
    one = spark.createDataFrame([(i, 0, 0, 5, ori, 120, False) for i, ori in enumerate((3, 3, 5))], ALIGNED)
    with pytest.warns(UserWarning) as seen:
        estimate.quantify(one, t, QuantOptions(lib_type="IU"))
    said = [str(w.message) for w in seen]
    assert any("estimated from 2 fragments" in x for x in said) and any("few fragments map uniquely" in x for x in said) and not any("TPM" in x for x in said)
    with pytest.warns(UserWarning, match="all TPM are 0"):
        found = estimate.quantify(one.where("ori = 5"), t, QuantOptions(lib_type="IU"))
    assert {r.tpm for r in found.quant.collect()} == {0.0}
    with pytest.warns(UserWarning, match="ignored"):
        estimate.quantify(one, t, QuantOptions(lib_type="IU", fld_mean=200.0, fld_sd=20.0, factorized_eqc_bins=1))


@pytest.mark.filterwarnings("ignore")
def test_quantify_against_plain_loops(spark):
    """The path of ``quantify`` from fragments to TPM: classes, lengths and steps as loops."""
    d = "/root/testdata/sf0.001"
    a, t = src.fixture_alignments(spark, d), src.fixture_targets(spark, d)
    found = estimate.quantify(a, t, QuantOptions(lib_type="IU", num_gibbs_samples=3, gibbs_thinning_factor=1))
    frags = {}
    for r in sorted(a.collect(), key=lambda r: (r.frag_id, r.aln_idx)):
        frags.setdefault(r.frag_id, []).append(r)
    unique = [x[0] for x in frags.values() if len(x) == 1 and not x[0].is_orphan]
    size = {r.ref_id: r.len for r in t.collect()}
    tiny, slots = fraglen.TINY, 65_536
    first = np.bincount([r.frag_len for r in unique if 1 <= r.ori <= 4], minlength=slots)
    pdf = (first + tiny) / (first.sum() + tiny * slots)
    cdf = np.cumsum(pdf) + tiny
    every = np.bincount([r.frag_len for r in unique], minlength=slots)
    eff = {}
    for i, n in size.items():
        upto = every[: min(n, slots - 1) + 1]
        mean = (upto * np.arange(len(upto))).sum() / upto.sum() if upto.sum() else 0.0
        eff[i] = n - mean if n - mean >= 1 else float(n)

    def prob(r):
        at = {1: size[r.ref_id] - r.pos, 2: r.pos + 100}.get(r.ori, r.frag_len)
        return (cdf if r.ori < 3 else pdf)[at] if 0 <= at < slots else 1.0 if r.ori < 3 else tiny

    classes, oris = {}, {}
    for f in frags.values():
        kept = [r for r in f if 1 <= r.ori <= 4]
        p = [prob(r) for r in kept]
        bins = tuple(min(63, int(x / sum(p) * 64)) for x in p)
        key = tuple(r.ref_id for r in kept), bins
        classes[key] = classes.get(key, 0) + 1
    now = dict.fromkeys(size, sum(classes.values()) / len(size))

    def step(a):
        out = dict.fromkeys(size, 0.0)
        for (refs, bins), n in classes.items():
            w = [(b / 64 + 0.5 / 64) * a[i] / eff[i] for i, b in zip(refs, bins)]
            if sum(w) > 1e-8:
                for i, x in zip(refs, w):
                    out[i] += n * x / sum(w)
        return out

    for _ in range(1500):
        before, now = now, step(now)
        if max([0.0, *((now[i] - before[i]) / before[i] for i in now if before[i] > 1e-8)]) < 1e-3:
            break
    want = step({i: 0.0 if x < 1e-8 else x for i, x in now.items()})
    total = sum(want[i] / eff[i] for i in want)
    for r in found.quant.collect():
        assert r.eff_len == pytest.approx(eff[r.ref_id]) and r.ecount == pytest.approx(want[r.ref_id], rel=1e-3, abs=1e-3) and r.tpm == pytest.approx(1e6 * want[r.ref_id] / eff[r.ref_id] / total, rel=1e-3, abs=1e-3)
    sums = found.replicates.groupBy("rep").agg(F.sum("value").alias("s")).collect()
    assert sorted(r.rep for r in sums) == [0, 1, 2] and all(r.s == pytest.approx(len(frags)) for r in sums) and found.meta["infrep_method"] == "gibbs"


@pytest.mark.filterwarnings("ignore")
def test_command_line(spark, tmp_path, capsys):
    from emtally import __main__ as cli

    d = "/root/testdata/sf0.001"
    src.fixture_alignments(spark, d).write.parquet(str(tmp_path / "in.alignments.parquet"))
    src.fixture_targets(spark, d).write.parquet(str(tmp_path / "in.targets.parquet"))
    assert cli.main(["-q", "quant", "-i", str(tmp_path / "in"), "-l", "iu", "-o", str(tmp_path / "out"), "--factorized-eqc-bins", "1", "--max-iter", "2"], spark) == 0
    assert (tmp_path / "out.quant").read_text().count("\n") == 26 and json.loads((tmp_path / "out.meta_info.json").read_text())["quant_opts"]["max_iter"] == 2
    for bad in (["quant"], ["quant", "-i", "x", "-l", "abc", "-o", "y"], ["quant", "-i", "x", "-l", "u", "-o", "y", "--fld-mean", "3"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)
    assert "unknown library type" in capsys.readouterr().err


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from emtally.sources import shared

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_outputs(spark, tmp_path):
    q = spark.createDataFrame([(1, "b", 20, 10.0625, 1.0005, 2.0), (0, "a", 10, 5.0, 0.0, 0.0)], "ref_id int, target_name string, len long, eff_len double, tpm double, ecount double")
    stem = tmp_path / "new" / "x.y"
    assert sinks.write_quant(q, stem).read_text() == "target_name\tlen\teelen\ttpm\tecount\na\t10\t5.000\t0.000\t0.000\nb\t20\t10.062\t1.000\t2.000\n"
    assert stem.with_name("x.y.quant").exists()
    t = pq.read_table(sinks.write_lengths(spark.createDataFrame([(3, 2)], "frag_len int, n long"), stem))
    assert t.num_rows == 65536 and t.column("fragment_length_dist")[3].as_py() == 2 and not t.schema.field(0).nullable
    reps = spark.createDataFrame([(0, 0, 1.5), (1, 0, 2.5), (0, 1, 3.5), (1, 1, 4.5)], "rep int, ref_id int, value double")
    w = pq.read_table(sinks.write_replicates(reps, 2, stem))
    assert w.to_pydict() == {"bootstrap.0": [1.5, 3.5], "bootstrap.1": [2.5, 4.5]}


@pytest.mark.filterwarnings("ignore")
def test_quantify(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    a, t = src.fixture_alignments(spark, d), src.fixture_targets(spark, d)
    (tmp_path / "in.map_info.json").write_text(json.dumps({"signatures": {"k": 1}}))
    found = estimate.quantify(a, t, QuantOptions(input=str(tmp_path / "in.rest"), lib_type="AUTO", num_bootstraps=2, factorized_eqc_bins=64))
    rows = found.quant.collect()
    assert len(rows) == 25 and sum(r.tpm for r in rows) == pytest.approx(1e6)
    assert found.meta["infrep_method"] == "bootstrap" and found.meta["signatures"] == {"k": 1} and found.meta["quant_opts"]["lib_type"] == "Auto"
    estimate.write(found, str(tmp_path / "out"))
    assert {p.name for p in tmp_path.glob("out*")} == {"out.quant", "out.fld.pq", "out.infreps.pq", "out.meta_info.json"}
    with pytest.raises(ValueError):
        estimate.quantify(a, t, QuantOptions(), paired=False)
    with pytest.raises(ValueError):
        estimate.quantify(a.limit(0), t, QuantOptions(lib_type="AUTO"))
    unpaired = estimate.quantify(a, t, QuantOptions(lib_type="U", fld_mean=200.0, fld_sd=20.0, factorized_eqc_bins=1), paired=False)
    assert sum(r.tpm for r in unpaired.quant.collect()) == pytest.approx(1e6)


def test_missing_sidecar(tmp_path):
    with pytest.warns(UserWarning):
        assert src.signatures(str(tmp_path / "none")) is None


def test_streamed_classes(spark, tmp_path):
    from emtally.streaming.classes import streamed_classes

    nested = src.fragments(src.fixture_alignments(spark, "/root/testdata/sf0.001"))
    nested.repartition(3).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(nested.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    q = streamed_classes(stream, "IU").writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((tuple(r.targets), tuple(r.oris), r.n) for r in df.collect())
    assert key(spark.table("streamed")) == key(eq.basic_classes(src.fixture_alignments(spark, "/root/testdata/sf0.001"), "IU"))
