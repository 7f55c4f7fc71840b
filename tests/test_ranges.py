"""As-of joins, prefix sums, exact sums and the chunked source."""

import bisect
import json
import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emtally.operators import classes as eq
from emtally.operators import em, exact, ranges
from emtally.plans import queries
from emtally.sources import alignments as src
from emtally.sources import chunks

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [0, 200])
def test_asof_join(spark, hot):
    rng = random.Random(hot)
    right = [(g, k, k / 2, None if k % 7 == 0 else str(k)) for g in ("a", "b") for k in rng.sample(range(-50, 60), 30)]
    left = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-70, 80)])) for i in range(300)] + [(1000 + i, "a", 3) for i in range(hot)]
    r = spark.createDataFrame(right, "g string, at int, half double, said string")
    x = spark.createDataFrame(left, "i int, g string, on long").repartition(3)
    got = ranges.asof_join(x, r, "on", "at", ("g",))
    assert got.columns == ["i", "g", "on", "at", "half", "said"] and "CartesianProduct" not in plan(got) and not re.search(r"Exchange SinglePartition", plan(got))
    by = {g: sorted(t[1:] for t in right if t[0] == g) for g in ("a", "b")}
    want = []
    for i, g, on in left:
        k = bisect.bisect_right([t[0] for t in by.get(g, [])], on) if on is not None else 0
        want.append((i, g, on, *(by[g][k - 1] if k else (None, None, None))))
    assert sorted(map(tuple, got.collect()), key=lambda t: t[0]) == sorted(want, key=lambda t: t[0])
    whole = ranges.asof_join(x.drop("g"), r.where("g = 'a'").drop("g"), "on", "at").where("at IS NOT NULL").collect()
    assert len(whole) == sum(on is not None and on >= by["a"][0][0] for _, _, on in left)
    assert all(t["at"] == max(k[0] for k in by["a"] if k[0] <= t["on"]) for t in whole)
    assert ranges.asof_join(x, r.limit(0), "on", "at").where("at IS NULL").count() == len(left) and ranges.asof_join(x.limit(0), r, "on", "at", ("g",)).count() == 0


def test_exclusive_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 30), rng.choice([None, 0, 1, 5, 10**12]), i % 40) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, n long, i int").repartition(5)
    got = ranges.exclusive_sums(df, "n", "start", "k")
    assert got.columns == ["k", "n", "i", "start"] and not re.search("Exchange SinglePartition", plan(got))
    at, last = 0, None
    for r in sorted(got.collect(), key=lambda r: (r.k, r.start, r.n or 0)):
        assert r.start == at and (last is None or r.k >= last)
        at, last = at + (r.n or 0), r.k
    assert at == sum(n or 0 for _, n, _ in rows) and ranges.exclusive_sums(df.limit(0), "n", "start", "k").count() == 0


def test_exact_sums(spark):
    rng = random.Random(4)
    values = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-40, 60) for _ in range(3000)]
    values += [1e308, -1e308, 5e-324, -5e-324, 2.2250738585072014e-308, 2.0**-900, 0.1, 0.0, -0.0, None, 2.0**31, 2.0**32, -(2.0**32), 2.0**64 + 2048, math.nextafter(2.0**32, 0)]
    rows = [(i % 3, v) for i, v in enumerate(values)] + [(7, None), (8, 0.0), (9, 1e308), (9, 1e-308)] + [(10 + i, v) for i, v in enumerate(values)]
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v or 0.0)
    for n in (1, 7, 64):
        df = spark.createDataFrame(rows, "k int, v double").repartition(n)
        got = {r.k: r.s for r in exact.exact_sum(df, ["k"], F.col("v"), "s").collect()}
        assert got == {k: math.fsum(v) for k, v in want.items()}


def test_steps_and_tpm_are_equal_to_the_last_bit(spark):
    d, found = D, []
    targets = queries._targets(spark, d).cache()
    classes = eq.packed(eq.basic_classes(src.fixture_alignments(spark, d), "IU"))
    pairs = em.incidence(classes, targets).cache()
    start = em.uniform(targets, classes).cache()
    for n in (1, 7, 64):
        step = exact.em_step(pairs.repartition(n, "n"), exact.em_step(pairs.repartition(n), start.repartition(n), em.LEAST_DENOMINATOR).cache(), em.LEAST_DENOMINATOR)
        found.append(sorted((r.ref_id, r.ecount, r.tpm) for r in exact.tpm(targets.repartition(n).join(step.withColumnRenamed("a", "ecount"), "ref_id")).collect()))
    assert found[0] == found[1] == found[2] and math.fsum(t for _, _, t in found[0]) == pytest.approx(1e6, abs=1e-6)
    plain = {r.ref_id: r.a for r in em.em_steps(pairs, start, targets, 2).collect()}
    assert all(c == pytest.approx(plain[i], rel=1e-12) for i, c, _ in found[0])


# chunks -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chunked(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chunks") / "fixture.chunks")
    a, t = src.fixture_alignments(spark, D), src.fixture_targets(spark, D)
    chunks.write_chunks(a, t, path, fragments=100)
    return path, a, t


def test_sums_of_parts_are_rounded_once_without_fractions(monkeypatch):
    rng, rows = random.Random(3), [[], [(-34, 1)], [(0, -1), (-1, 1)], [(31, 2**31), (31, -(2**31)), (-1, 5)]]
    for _ in range(300):
        power = rng.randrange(-25, 20)
        rows.append([(power - i, rng.randrange(-(2**62), 2**62)) for i in range(rng.randint(1, 5))])
    wanted = [float(sum(exact.Fraction(n) * exact.Fraction(2) ** (32 * p) for p, n in row)) for row in rows]
    sums = pa.array([[{"power": p, "n": n} for p, n in row] for row in rows], pa.list_(pa.struct([("power", pa.int32()), ("n", pa.int64())])))
    assert exact._rounded(sums) == wanted
    monkeypatch.setattr(exact, "Fraction", None)  # nothing but sums beyond a double's range needs it
    assert exact._rounded(sums[4:]) == wanted[4:]


def test_estimation_by_exact_sums(spark):
    """Several steps, the test of convergence and the last step: the same bits over any partitions, for each of two samples."""
    rng = np.random.default_rng(8)
    rows = [(s, sorted(rng.choice(12, rng.integers(1, 5), replace=False).tolist()), int(rng.integers(1, 90))) for s in ("x", "y") for _ in range(60)]
    data = [(s, t, rng.random(len(t)).tolist(), n) for s, t, n in rows] + [("x", [], [], 7)]
    classes = spark.createDataFrame(data, "sample_id string, targets array<int>, probs array<double>, n long")
    targets = spark.createDataFrame([(i, float(100 + 37 * i)) for i in range(12)], "ref_id int, eff_len double")
    limits = {"by": ("sample_id",), "max_iter": 2, "convergence": 0.2}
    found = [sorted(em.em_frames(classes.repartition(n), targets.repartition(n), exact=True, **limits).collect()) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == 24
    plain = sorted(em.em_frames(classes, targets, **limits).collect())
    assert [r[:2] for r in plain] == [r[:2] for r in found[0]] and [r.ecount for r in plain] == pytest.approx([r.ecount for r in found[0]], rel=1e-9)


def test_chunks_round_trip(spark, chunked):
    path, a, t = chunked
    header, targets, rows = chunks.read_chunks(spark, path, 4096)
    assert header.paired and dict(header.tags["fragment"]) == {"frag_map_type": "u1"} and sorted(map(tuple, targets.collect())) == sorted(map(tuple, t.collect()))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, a.select(rows.columns).collect()))
    assert len(header.chunks) >= 15 and rows.rdd.getNumPartitions() > 4 and chunks.read_chunks(spark, path)[2].rdd.getNumPartitions() == 1
    classes = lambda x: sorted((r.targets, r.oris, r.n) for r in eq.basic_classes(x, "IU").collect())
    assert classes(rows) == classes(a)
    assert src.conform(rows, src.ALIGNMENTS, "alignments").columns == list(src.ALIGNMENTS)


def test_ranges_of_chunks(chunked):
    reader = chunks.ChunkReader(chunked[0], 4096)
    parts, header = reader.partitions(), chunks.read_header(chunked[0])
    starts = [*header.chunks, header.end]
    assert [s for p in parts for s in p.starts[:-1]] == header.chunks and all(p.starts[-1] - p.starts[0] <= 4096 or len(p.starts) == 2 for p in parts) and parts[-1].starts[-1] == starts[-1]


def broken(path, tmp_path, change):
    data = bytearray(open(path, "rb").read())
    out = change(data)
    other = str(tmp_path / "x.chunks")
    open(other, "wb").write(bytes(data if out is None else out))
    return other


@pytest.mark.parametrize("change,error", [
    (lambda d: d[:-40], chunks.ChunkError), (lambda d: b"NOTCHUNK" + d[8:], chunks.ChunkError), (lambda d: d[:20], chunks.ChunkError), (lambda d: b"", chunks.ChunkError),
    (lambda d: d.replace(b"frag_map_type", b"frag_map_typo"), src.SchemaError), (lambda d: d.replace(b"ref_lengths", b"ref_lengthy"), src.SchemaError),
    (lambda d: d.replace(b"frag_len\x03", b"frag_len\x05"), src.SchemaError), (lambda d: d.replace(b"frag_len\x03", b"frag_len\x63"), src.SchemaError), (lambda d: d[:-16] + struct.pack("<Q", 1 << 40) + d[-8:], chunks.ChunkError),
])
def test_broken_headers(chunked, tmp_path, change, error):
    with pytest.raises(error), _quiet():
        chunks.read_header(broken(chunked[0], tmp_path, change))


def _quiet():
    import warnings

    return warnings.catch_warnings(action="ignore")


def test_broken_chunks(spark, chunked, tmp_path):
    """A chunk that isn't whole is an error, also within Spark."""
    at = chunks.read_header(chunked[0]).chunks[3]

    def more(d):
        d[at + 8 : at + 12] = struct.pack("<I", struct.unpack("<I", d[at + 8 : at + 12])[0] + 1)

    def fewer(d):
        d[at + 8 : at + 12] = struct.pack("<I", 3)

    def size(d):
        d[at : at + 8] = struct.pack("<Q", 5)

    for change, said in ((more, "ends within"), (fewer, "beyond its fragments"), (size, "the index")):
        path = broken(chunked[0], tmp_path, change)
        with pytest.raises(chunks.ChunkError, match=said):
            [list(chunks.ChunkReader(path, 1).read(p)) for p in chunks.ChunkReader(path, 1).partitions()]
    with pytest.raises(Exception, match="the index"):
        chunks.read_chunks(spark, path)[2].count()


def test_unknown_tags_are_passed_over(tmp_path):
    text = lambda s: struct.pack("<I", len(s)) + s.encode()
    tag = lambda n, c: text(n) + struct.pack("<B", c)
    head = chunks.MAGIC + struct.pack("<BQ", 0, 2) + text("t0") + text("t1") + struct.pack("<H", 2) + tag("made", 2) + tag("ref_lengths", 9)
    head += struct.pack("<H", 2) + tag("frag_map_type", 1) + tag("score", 6) + struct.pack("<H", 4) + tag("compressed_ori_ref", 3) + tag("mapq", 1) + tag("pos", 3) + tag("frag_len", 2)
    head += struct.pack("<H", 7) + struct.pack("<QII", 2, 100, 200)
    body = struct.pack("<qIBd", -3, 2, 1, 0.5) + struct.pack("<IBIH", (1 << 3) | 4, 9, 77, 300) + struct.pack("<IBIH", 2, 8, 5, 0) + struct.pack("<qIBd", 4, 0, 0, 0.5)
    whole = head + struct.pack("<QI", len(body), 2) + body + struct.pack("<QQ", len(head), 1) + chunks.MAGIC
    path = str(tmp_path / "y.chunks")
    open(path, "wb").write(whole)
    with pytest.warns(UserWarning, match="mapq"):
        header = chunks.read_header(path)
    assert not header.paired and header.lengths == [100, 200] and header.values["made"] == 7
    with _quiet():
        reader = chunks.ChunkReader(path, 100)
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in rows] == [(-3, 0, 1, 77, 4, 300, True), (-3, 1, 0, 5, 2, 0, True)]


def test_empty_and_unwritable(spark, tmp_path):
    a, t = src.fixture_alignments(spark, D), src.fixture_targets(spark, D)
    path = str(tmp_path / "none.chunks")
    chunks.write_chunks(a.limit(0), t, path, paired=False)
    header, targets, rows = chunks.read_chunks(spark, path)
    assert not header.paired and rows.count() == 0 and targets.count() == 25
    with pytest.raises(ValueError, match="dense"):
        chunks.write_chunks(a, t.where("ref_id > 0"), path)
    with pytest.raises(Exception, match="32 bits"):
        chunks.write_chunks(a.withColumn("pos", F.lit(-1)), t, path)
    assert chunks.read_chunks(spark, path)[2].count() == 0 and [p.name for p in tmp_path.iterdir()] == ["none.chunks"]


def test_the_command_reads_chunks(spark, chunked, tmp_path):
    from emtally.__main__ import main

    (tmp_path / "in.chunks").write_bytes(open(chunked[0], "rb").read())
    assert main(["-q", "quant", "-i", str(tmp_path / "in"), "-l", "IU", "-o", str(tmp_path / "out"), "--max-iter", "2", "--factorized-eqc-bins", "1"], spark) == 0
    assert len((tmp_path / "out.quant").read_text().splitlines()) == 26 and json.loads((tmp_path / "out.meta_info.json").read_text())["num_targets"] == 25


# outputs ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("numbers", [8_000_000, 60])
def test_the_wide_table_is_written_by_a_task(spark, tmp_path, monkeypatch, numbers):
    """In the order of targets over several ranges, without the driver collecting it; row groups of so many numbers."""
    import pyarrow.parquet as pq
    from pyspark.sql import DataFrame

    from emtally.sources import sinks

    monkeypatch.setattr(sinks, "NUMBERS", numbers)
    reps = spark.range(3000).select((F.col("id") % 3).cast("int").alias("rep"), F.floor(F.col("id") / 3).cast("int").alias("ref_id"), (F.col("id") * 0.5).alias("value")).repartition(7)
    with monkeypatch.context() as m:
        m.setattr(type(reps), "toArrow", lambda *a: pytest.fail("collected"))
        m.setattr(type(reps), "toPandas", lambda *a: pytest.fail("collected"))
        path = sinks.write_replicates(reps, 3, f"file://{tmp_path}/deep/er/x.y")
    assert isinstance(reps, DataFrame) and path == f"file://{tmp_path}/deep/er/x.y.infreps.pq"
    got = pq.ParquetFile(tmp_path / "deep/er/x.y.infreps.pq")
    assert got.metadata.num_row_groups == (1 if numbers > 3000 else 50) and got.read().to_pydict() == {f"bootstrap.{i}": [(3 * j + i) * 0.5 for j in range(1000)] for i in range(3)}
    assert not got.schema_arrow.field(0).nullable and got.metadata.row_group(0).column(0).compression == "ZSTD"
    none = pq.read_table(sinks.write_replicates(reps.limit(0), 2, tmp_path / "none"))
    assert none.num_rows == 0 and none.column_names == ["bootstrap.0", "bootstrap.1"]


def test_outputs_by_uri(spark, tmp_path):
    from emtally.sources import sinks

    stem = f"file://{tmp_path}/a/b.c"
    sinks.write_metadata({"k": [1]}, stem)
    sinks.write_quant(spark.createDataFrame([(0, "t", 7, 5.0, 1.0, 2.0)], "ref_id int, target_name string, len long, eff_len double, tpm double, ecount double"), stem)
    assert json.loads((tmp_path / "a/b.c.meta_info.json").read_text()) == {"k": [1]} and (tmp_path / "a/b.c.quant").read_text().splitlines()[1] == "t\t7\t5.000\t1.000\t2.000"
    (tmp_path / "a/in.map_info.json").write_text('{"signatures": 5}')
    assert src.signatures(f"file://{tmp_path}/a/in.x") == 5
    (tmp_path / "a/in.map_info.json").write_text('{"signatures": ')
    with pytest.raises(json.JSONDecodeError):
        src.signatures(str(tmp_path / "a/in"))


def test_fixed_decimals_are_those_of_the_binary_value(spark):
    import numpy as np
    import pandas as pd

    from emtally.functions.decimals import fixed

    rng = np.random.default_rng(1)
    x = np.concatenate([
        rng.random(300_000) * 10.0 ** rng.integers(-8, 16, 300_000), rng.random(400_000) * 1000, -rng.random(100_000), rng.integers(0, 2_000_000, 190_000) / 1000,
        (2 * rng.integers(0, 5000, 5_000) + 1) / 16.0, rng.integers(0, 10**9, 5_000) + 0.0625, np.nextafter(rng.integers(0, 10**6, 5_000) / 1000 + 0.0005, rng.choice([0, 1e9], 5_000)), [0.0, -0.0, 0.9995, 0.99951, 1.0005, 5e-324, 1e15 + 0.125, 2.0**62, 9.2e18, 0.0005, 999.9995, 2.0**52 + 0.5],
    ])
    got = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", fixed(F.col("x")).alias("s")).toPandas()
    want = ["%.3f" % v for v in got["x"]]
    assert len(want) > 1_000_000 and got["s"].tolist() == want
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1e300,)], "x double").select(fixed(F.col("x")).alias("s")).collect()
    assert [r.s for r in odd] == [None] * 4
    assert spark.createDataFrame([(0.125,)], "x double").select(fixed(F.col("x"), 2)).first()[0] == "0.12"
