"""The registered queries over alignments derived from the driver's tables, and the same in DuckDB's SQL."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emtally.functions import fraglen, libtype
from emtally.operators import classes as eq
from emtally.operators import em, exact, mappings, replicates
from emtally.operators.ranges import asof_join, exclusive_sums
from emtally.operators.tpm import tpm as tpm_of
from emtally.sources import sinks
from emtally.sources.alignments import fixture_alignments, fixture_targets, flatten, fragments
from emtally.sources.shared import bucketed, written

LIB, SAMPLE_READS, PASS_1, BINS = "IU", 500, 50, 64
MEAN, SD = 250.0, 60.0


def _a(spark, d):
    return fixture_alignments(spark, d)


def _prepared(spark, d):
    """(nested, flat): the fragments, written in buckets of frag_id, and their alignments, for queries that read them several
    times; grouping either by frag_id shuffles nothing."""
    nested = bucketed(fragments(_a(spark, d)), "fragments", "frag_id", placed=True)
    return nested, flatten(nested)


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _list(c: str):
    return F.array_join(c, ",").alias(c)


def lib_compat_table(spark: SparkSession, d: str) -> DataFrame:
    """Which orientations each library type accepts, and how many alignments have them."""
    rows = [(t, i, i in libtype.codes(t)) for t in libtype.ACCEPTED for i in range(len(libtype.ORIENTATIONS))]
    table = spark.createDataFrame(rows, "lib_type string, ori int, accepted boolean")
    return table.join(_a(spark, d).groupBy("ori").agg(F.count("*").alias("n")), "ori", "left").select("lib_type", "ori", "accepted", F.coalesce("n", F.lit(0)).alias("n"))


def lib_compat_filter(spark: SparkSession, d: str) -> DataFrame:
    return mappings.compatible_alignments(_a(spark, d), LIB).select("frag_id", "aln_idx", "ref_id", "pos", "ori", "frag_len")


def orientation_stats(spark: SparkSession, d: str) -> DataFrame:
    return mappings.orientation_stats(_a(spark, d), LIB)


def orientation_report(spark: SparkSession, d: str) -> DataFrame:
    return mappings.orientation_report(_a(spark, d), LIB)


def read_totals(spark: SparkSession, d: str) -> DataFrame:
    return mappings.read_totals(_a(spark, d))


def orientation_sample(spark: SparkSession, d: str) -> DataFrame:
    return mappings.sample_orientations(_a(spark, d), SAMPLE_READS)


def orientation_sample_detect(spark: SparkSession, d: str) -> DataFrame:
    return _round(libtype.detected(orientation_sample(spark, d), True), ratio=9)


def orientation_sample_detect_unpaired(spark: SparkSession, d: str) -> DataFrame:
    return _round(libtype.detected(orientation_sample(spark, d), False), ratio=9)


def strand_bias(spark: SparkSession, d: str) -> DataFrame:
    return _round(libtype.with_bias(libtype.detected(orientation_sample(spark, d), True)), ratio=9)


def fld_histogram(spark: SparkSession, d: str) -> DataFrame:
    return mappings.length_histogram(_a(spark, d))


def fld_pass1_limit(spark: SparkSession, d: str) -> DataFrame:
    return mappings.sampled_length_histogram(_a(spark, d), LIB, PASS_1)


def _pass_1(nested):
    return mappings.sampled_length_histogram(nested, LIB, 500_000)


def fld_pdf_cdf(spark: SparkSession, d: str) -> DataFrame:
    return _round(fraglen.empirical(_pass_1(_a(spark, d)), integer_cdf=True), pdf=10, cdf=10)


def conditional_means(spark: SparkSession, d: str) -> DataFrame:
    return _round(fraglen.conditional_means(fld_histogram(spark, d)), mean=6)


def _moments(spark, d):
    """Mean and deviation of the table's own lengths: what a user would give for unpaired fragments."""
    found = fraglen.moments(fld_histogram(spark, d)).first()
    return (found["mean"], found["sd"]) if found and found["sd"] > 0 else (MEAN, SD)


def parametric_conditional_means(spark: SparkSession, d: str) -> DataFrame:
    return _round(fraglen.parametric_means(spark, *_moments(spark, d)), mean=4)


def _targets(spark, d, nested=None):
    nested = _a(spark, d) if nested is None else nested
    return fraglen.effective_lengths(fixture_targets(spark, d), fraglen.conditional_means(mappings.length_histogram(nested)))


def effective_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _round(_targets(spark, d), eff_len=6)


def fld_parametric(spark: SparkSession, d: str) -> DataFrame:
    return _round(fraglen.parametric(spark, *_moments(spark, d)), pdf=10, cdf=10)


def fld_parametric_samples(spark: SparkSession, d: str) -> DataFrame:
    """The lengths of each order priority's unique fragments, as a sample of its own, beside the normal distribution of their mean and deviation."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("frag_id"), F.col("o_orderpriority").alias("sample_id"))
    lengths = mappings.unique_fragments(_a(spark, d)).join(orders, "frag_id").groupBy("sample_id", "frag_len").agg(F.count("*").alias("n"))
    return _round(fraglen.parametric_lengths(written(lengths, "lengths"), ("sample_id",)), mean=6, sd=6, pdf=10, cdf=10)


def effective_lengths_unpaired(spark: SparkSession, d: str) -> DataFrame:
    return _round(fraglen.effective_lengths(fixture_targets(spark, d), fraglen.parametric_means(spark, MEAN, SD)), eff_len=4)


def cond_prob_unpaired(spark: SparkSession, d: str) -> DataFrame:
    probs = eq.conditional_probabilities(_a(spark, d), fixture_targets(spark, d), fraglen.parametric(spark, MEAN, SD))
    return _round(probs.select("frag_id", "aln_idx", "ref_id", "ori", "prob"), prob=10)


def _with_probs(spark, d, prepared=None):
    nested, flat = prepared or _prepared(spark, d)
    return eq.conditional_probabilities(flat, fixture_targets(spark, d), fraglen.empirical(_pass_1(nested), integer_cdf=True))


def cond_prob(spark: SparkSession, d: str) -> DataFrame:
    return _round(_with_probs(spark, d).select("frag_id", "aln_idx", "ref_id", "ori", "prob"), prob=10)


def eq_classes_basic(spark: SparkSession, d: str) -> DataFrame:
    return eq.basic_classes(_a(spark, d), LIB).select(_list("targets"), _list("oris"), "n")


def eq_classes_range(spark: SparkSession, d: str) -> DataFrame:
    return eq.range_classes(_with_probs(spark, d), LIB, BINS).select(_list("targets"), _list("bins"), _list("oris"), "n")


def eq_classes_packed(spark: SparkSession, d: str) -> DataFrame:
    packed = eq.packed(eq.range_classes(_with_probs(spark, d), LIB, BINS), BINS)
    return packed.select(_list("targets"), F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 9).alias("mass"), "n")


def eq_class_totals(spark: SparkSession, d: str) -> DataFrame:
    return eq.totals(eq.basic_classes(_a(spark, d), LIB))


def _classes(spark, d, fragments=None):
    return eq.packed(eq.basic_classes(_a(spark, d) if fragments is None else fragments, LIB))


def em_init(spark: SparkSession, d: str) -> DataFrame:
    return _round(em.uniform(fixture_targets(spark, d), _classes(spark, d)), a=6)


def _steps(spark, d, k):
    nested, _ = _prepared(spark, d)
    targets, classes = written(_targets(spark, d, nested), "targets"), written(_classes(spark, d, nested), "classes")
    pairs = bucketed(em.incidence(classes, targets), "incidence", "eq_id")
    return targets, em.em_steps(pairs, em.uniform(targets, classes), targets, k)


def em_step1(spark: SparkSession, d: str) -> DataFrame:
    return _round(_steps(spark, d, 1)[1], a=4)


def em_k3(spark: SparkSession, d: str) -> DataFrame:
    return _round(_steps(spark, d, 3)[1], a=4)


def quant_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Three steps only, as in its SQL; ``quant_converged`` runs to convergence."""
    targets, counts = _steps(spark, d, 3)
    out = tpm_of(targets.join(written(counts.withColumnRenamed("a", "ecount"), "counts"), "ref_id", "left"))
    return _round(out.select("ref_id", "target_name", "len", "eff_len", "tpm", "ecount"), eff_len=4, tpm=3, ecount=4)


def tpm(spark: SparkSession, d: str) -> DataFrame:
    return quant_flagship(spark, d).select("ref_id", "tpm")


def _converged(spark, d):
    prepared = _prepared(spark, d)
    classes, targets = eq.packed(eq.range_classes(_with_probs(spark, d, prepared), LIB, BINS), BINS), written(_targets(spark, d, prepared[0]), "targets")
    return targets, em.em_frames(written(classes, "classes"), targets)


def em_converged(spark: SparkSession, d: str) -> DataFrame:
    return _converged(spark, d)[1].select(F.lit("0").alias("sample_id"), "ref_id", F.round("ecount", 4).alias("ecount"))


def quant_converged(spark: SparkSession, d: str) -> DataFrame:
    """The whole estimation: range classes, EM to convergence, TPM."""
    targets, counts = _converged(spark, d)
    out = tpm_of(targets.join(written(counts, "counts"), "ref_id", "left"))
    return _round(out.select("ref_id", "target_name", "len", "eff_len", "tpm", "ecount"), eff_len=4, tpm=3, ecount=4)


def tpm_converged(spark: SparkSession, d: str) -> DataFrame:
    return quant_converged(spark, d).select("ref_id", "tpm")


def em_samples(spark: SparkSession, d: str) -> DataFrame:
    """The fragments of odd and of even number as two samples."""
    nested, a = _prepared(spark, d)
    halves = [eq.packed(eq.basic_classes(a.where(F.col("frag_id") % 2 == i), LIB)).withColumn("sample_id", F.lit(str(i))) for i in range(2)]
    return _round(em.em_frames(written(halves[0].unionByName(halves[1]), "classes"), written(_targets(spark, d, nested), "targets"), by=("sample_id",)), ecount=6)


def _inputs(spark, d):
    """Written tables of targets and of basic classes."""
    nested, _ = _prepared(spark, d)
    return written(_targets(spark, d, nested), "targets"), written(_classes(spark, d, nested), "classes")


def em_k10_range(spark: SparkSession, d: str) -> DataFrame:
    """Ten steps over range classes."""
    prepared = _prepared(spark, d)
    targets = written(_targets(spark, d, prepared[0]), "targets")
    classes = written(eq.packed(eq.range_classes(_with_probs(spark, d, prepared), LIB, BINS), BINS), "classes")
    pairs = bucketed(em.incidence(classes, targets), "incidence", "eq_id")
    return _round(em.em_steps(pairs, em.uniform(targets, classes), targets, 10), a=4)


def conditional_means_asof(spark: SparkSession, d: str) -> DataFrame:
    """Every alignment with the longest length of a unique fragment that isn't over its own, and the mean of those up to it."""
    a = _a(spark, d)
    found = asof_join(a.select("frag_id", "aln_idx", F.col("frag_len").alias("own_len")), fraglen.sparse_means(mappings.length_histogram(a)), "own_len", "frag_len")
    return _round(found.select("frag_id", "aln_idx", "own_len", "frag_len", "mean"), mean=6)


def effective_lengths_asof(spark: SparkSession, d: str) -> DataFrame:
    """Effective lengths from the sparse histogram, without a row for every length."""
    return _round(fraglen.effective_lengths_sparse(fixture_targets(spark, d), mappings.length_histogram(_a(spark, d))), eff_len=6)


def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each class's targets begin and end in one array of all, classes in the order of their labels."""
    classes = eq.basic_classes(_a(spark, d), LIB).select(_list("targets"), _list("oris"), "n", F.size("targets").alias("size"))
    return exclusive_sums(classes, "size", "start", "targets", "oris").select("targets", "oris", "n", "start", (F.col("start") + F.col("size")).alias("end"))


def em_k2_exact(spark: SparkSession, d: str) -> DataFrame:
    """Two steps and TPM by exact sums: the same to the last bit over any partitions."""
    targets, classes = _inputs(spark, d)
    pairs, now = bucketed(em.incidence(classes, targets), "incidence", "eq_id"), em.uniform(targets, classes)
    for _ in range(2):
        now = written(exact.em_step(pairs, now, em.LEAST_DENOMINATOR), "abundance")
    return _round(exact.tpm(targets.join(now.withColumnRenamed("a", "ecount"), "ref_id")).select("ref_id", "ecount", "tpm"), ecount=5, tpm=5)


def bootstrap_replicates(spark: SparkSession, d: str) -> DataFrame:
    targets, classes = _inputs(spark, d)
    return replicates.bootstrap_frames(classes, targets, 8)


def gibbs_replicates(spark: SparkSession, d: str) -> DataFrame:
    targets, classes = _inputs(spark, d)
    return replicates.gibbs_frames(classes, targets, em.em_frames(classes, targets), 10, 2)


def infreps_wide(spark: SparkSession, d: str) -> DataFrame:
    out = sinks.wide(bootstrap_replicates(spark, d), 8)
    return out.toDF(*(c.replace(".", "_") for c in out.columns))


_QUERIES = (
    lib_compat_table, lib_compat_filter, orientation_stats, read_totals, orientation_sample, orientation_sample_detect, fld_histogram, fld_pass1_limit, fld_pdf_cdf, conditional_means,
    parametric_conditional_means, effective_lengths, cond_prob, eq_classes_basic, eq_classes_range, eq_classes_packed, eq_class_totals, em_init, em_step1, em_k3, tpm, quant_flagship,
    orientation_report, orientation_sample_detect_unpaired, strand_bias, conditional_means_asof, effective_lengths_asof, csr_offsets, em_k2_exact, fld_parametric, fld_parametric_samples, effective_lengths_unpaired, cond_prob_unpaired,
    em_k10_range, em_converged, em_samples, quant_converged, tpm_converged, bootstrap_replicates, gibbs_replicates, infreps_wide,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_BASE = """
t AS (SELECT n_nationkey AS ref_id, n_name AS target_name, CAST(150 + 37 * ((CAST(n_nationkey AS BIGINT) * 7919) % 97) AS BIGINT) AS len FROM nation),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS aln_idx FROM lineitem),
a AS (
  SELECT l_orderkey AS frag_id, aln_idx, s_nationkey AS ref_id, (l_suppkey * 37 + l_linenumber * 11) % 140 AS pos,
    CASE WHEN l_orderkey % 10 = 0 THEN CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END
      WHEN l_returnflag = 'A' THEN 3 WHEN l_returnflag = 'N' THEN 4 WHEN l_linestatus = 'F' THEN 3 ELSE 5 END AS ori,
    CAST(100 + 4 * l_quantity + l_linenumber AS INTEGER) AS frag_len, l_orderkey % 10 = 0 AS is_orphan
  FROM numbered JOIN supplier ON l_suppkey = s_suppkey
),
u AS (SELECT frag_id, any_value(ori) AS ori, any_value(frag_len) AS frag_len FROM a GROUP BY frag_id HAVING count(*) = 1 AND NOT bool_or(is_orphan)),
h AS (SELECT frag_len, count(*) AS n FROM u GROUP BY frag_len),
h1 AS (SELECT frag_len, count(*) AS n FROM u WHERE ori BETWEEN 1 AND 4 GROUP BY frag_len),
slots AS (SELECT CAST(i AS INTEGER) AS frag_len FROM range(65536) r(i)),
fld AS (
  SELECT frag_len, (coalesce(n, 0)::DOUBLE + 2.2250738585072014e-308::DOUBLE) / (SELECT sum(n) FROM h1)::DOUBLE AS pdf,
    (sum(coalesce(n, 0)) OVER (ORDER BY frag_len))::DOUBLE / (SELECT sum(n) FROM h1)::DOUBLE AS cdf
  FROM slots LEFT JOIN h1 USING (frag_len)
),
means AS (
  SELECT frag_len, CASE WHEN frag_len = 0 OR sum(coalesce(n, 0)) OVER o = 0 THEN 0.0::DOUBLE
    ELSE (sum(frag_len * coalesce(n, 0)) OVER o)::DOUBLE / (sum(coalesce(n, 0)) OVER o)::DOUBLE END AS mean
  FROM slots LEFT JOIN h USING (frag_len) WINDOW o AS (ORDER BY frag_len)
),
e AS (SELECT ref_id, target_name, len, CASE WHEN len - mean < 1 THEN len::DOUBLE ELSE len - mean END AS eff_len FROM t JOIN means ON means.frag_len = least(len, 65535)),
p AS (
  SELECT a.*, CASE WHEN ori IN (1, 2) THEN coalesce(cdf, 1.0::DOUBLE) WHEN ori IN (3, 4) THEN coalesce(pdf, 2.2250738585072014e-308::DOUBLE) ELSE 2 * 2.2250738585072014e-308::DOUBLE END AS prob
  FROM a JOIN t USING (ref_id) LEFT JOIN fld ON fld.frag_len = CASE WHEN ori = 1 THEN len - pos WHEN ori = 2 THEN pos + 100 WHEN ori IN (3, 4) THEN a.frag_len END
),
labels AS (
  SELECT frag_id, coalesce(list(ref_id ORDER BY aln_idx) FILTER (ori BETWEEN 1 AND 4), []) AS targets, coalesce(list(ori ORDER BY aln_idx) FILTER (ori BETWEEN 1 AND 4), []) AS oris,
    coalesce(list(prob ORDER BY aln_idx) FILTER (ori BETWEEN 1 AND 4), []) AS probs
  FROM p GROUP BY frag_id
),
basic AS (SELECT targets, oris, count(*) AS n FROM labels GROUP BY targets, oris),
binned AS (
  SELECT targets, oris, list_transform(probs, lambda x: CASE WHEN total = 0 THEN 0 WHEN x / total >= 1 THEN 63 ELSE CAST(floor(x / total * 64) AS INTEGER) END) AS bins
  FROM (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, probs), lambda s, x: s + x) AS total FROM labels)
),
ranged AS (SELECT targets, bins, oris, count(*) AS n FROM binned GROUP BY targets, bins, oris),
numbered_classes AS (SELECT row_number() OVER () AS eq_id, targets, n FROM basic),
pairs AS (SELECT eq_id, n, x.ref_id, 1.0::DOUBLE / eff_len AS w FROM (SELECT eq_id, n, unnest(targets) AS ref_id FROM numbered_classes) x JOIN e ON e.ref_id = x.ref_id),
s0 AS (SELECT ref_id, (SELECT sum(n) FROM basic)::DOUBLE / (SELECT count(*) FROM t)::DOUBLE AS a FROM t)
"""


def _step_sql(k: int, pairs: str = "pairs") -> str:
    return f""", w{k} AS (SELECT eq_id, n, p.ref_id, w * a AS w FROM {pairs} p JOIN s{k - 1} ON s{k - 1}.ref_id = p.ref_id),
d{k} AS (SELECT eq_id, sum(w) AS d FROM w{k} GROUP BY eq_id HAVING sum(w) > 1e-8),
s{k} AS (SELECT t.ref_id, coalesce(g.a, 0.0::DOUBLE) AS a FROM t LEFT JOIN (SELECT ref_id, sum(n * w / d) AS a FROM w{k} JOIN d{k} USING (eq_id) GROUP BY ref_id) g ON g.ref_id = t.ref_id)"""


def _sql(select: str, steps: int = 0) -> str:
    return "WITH " + _BASE.strip() + "".join(_step_sql(k) for k in range(1, steps + 1)) + "\n" + select


_RANGE_PAIRS = """, numbered_ranges AS (SELECT row_number() OVER () AS eq_id, targets, bins, n FROM ranged),
range_pairs AS (
  SELECT eq_id, n, x.ref_id, x.prob / eff_len AS w FROM (SELECT eq_id, n, unnest(targets) AS ref_id, unnest(bins) / 64.0::DOUBLE + 0.5::DOUBLE / 64 AS prob FROM numbered_ranges) x JOIN e ON e.ref_id = x.ref_id
)"""

# Classes and start of one sample, and of two.
_ONE_SAMPLE = (
    _RANGE_PAIRS
    + """, em_pairs AS MATERIALIZED (SELECT '0' AS sample_id, * FROM range_pairs),
start AS (SELECT '0' AS sample_id, * FROM s0)"""
)
_TWO_SAMPLES = """, halves AS (SELECT CAST(frag_id % 2 AS VARCHAR) AS sample_id, targets, oris, count(*) AS n FROM labels GROUP BY ALL),
numbered_halves AS (SELECT row_number() OVER () AS eq_id, sample_id, targets, n FROM halves),
em_pairs AS MATERIALIZED (
  SELECT sample_id, eq_id, n, x.ref_id, 1.0::DOUBLE / eff_len AS w FROM (SELECT sample_id, eq_id, n, unnest(targets) AS ref_id FROM numbered_halves) x JOIN e ON e.ref_id = x.ref_id
),
start AS (SELECT sample_id, ref_id, weight / (SELECT count(*) FROM t)::DOUBLE AS a FROM (SELECT sample_id, sum(n)::DOUBLE AS weight FROM halves GROUP BY sample_id), t)"""


def _range_sql(steps: int) -> str:
    return "WITH " + _BASE.strip() + _RANGE_PAIRS + "".join(_step_sql(k, "range_pairs") for k in range(1, steps + 1)) + f"\nSELECT ref_id, round(a, 4) AS a FROM s{steps}"


def _next_sql(state: str, still: str = "true") -> str:
    """A step from the rows of ``state`` for which ``still`` holds, beside what was before."""
    return f"""SELECT r.*, coalesce(g.a, 0.0::DOUBLE) AS stepped FROM {state} r LEFT JOIN (
    SELECT sample_id, ref_id, sum(n * w / d) AS a FROM (
      SELECT p.sample_id, p.ref_id, n, p.w * r.a AS w, sum(p.w * r.a) OVER (PARTITION BY eq_id) AS d FROM em_pairs p JOIN {state} r ON r.sample_id = p.sample_id AND r.ref_id = p.ref_id WHERE {still}
    ) WHERE d > 1e-8 GROUP BY sample_id, ref_id
  ) g ON g.sample_id = r.sample_id AND g.ref_id = r.ref_id WHERE {still}"""


def _converged_sql(classes: str, select: str) -> str:
    """Steps until a sample's largest relative increase is under 0.001, 1500 at most; what is under 1e-8 then goes, and one more step gives the counts."""
    return f"""WITH RECURSIVE {_BASE.strip()}{classes}, run AS (
  SELECT sample_id, ref_id, a, 0 AS i, true AS going FROM start
  UNION ALL
  SELECT sample_id, ref_id, stepped, i + 1, coalesce(max(CASE WHEN a > 1e-8 THEN (stepped - a) / a END) OVER (PARTITION BY sample_id), 0) >= 1e-3 AND i < 1499
  FROM ({_next_sql("run", "r.going")})
),
settled AS (SELECT sample_id, ref_id, CASE WHEN a < 1e-8 THEN 0 ELSE a END AS a FROM run WHERE NOT going),
counts AS (SELECT sample_id, ref_id, stepped AS ecount FROM ({_next_sql("settled")})),
rates AS (SELECT e.*, ecount, CASE WHEN eff_len > 0 THEN ecount / eff_len ELSE 0.0::DOUBLE END AS rate FROM e JOIN counts ON counts.ref_id = e.ref_id)
{select}"""


def _quant_sql() -> str:
    return """, q AS (SELECT e.*, s3.a AS ecount, CASE WHEN eff_len > 0 THEN s3.a / eff_len ELSE 0.0::DOUBLE END AS rate FROM e JOIN s3 ON s3.ref_id = e.ref_id),
z AS (SELECT ref_id, target_name, len, round(eff_len, 4) AS eff_len, round(1e6::DOUBLE * rate / (SELECT sum(rate) FROM q), 3) AS tpm, round(ecount, 4) AS ecount FROM q)"""


_MOMENTS = """, m AS (
  SELECT x::DOUBLE / n AS mean, sqrt((n::HUGEINT * xx - x::HUGEINT * x)::DOUBLE / n / n) AS sd FROM (SELECT sum(n)::BIGINT AS n, sum(n * frag_len)::BIGINT AS x, sum(n * frag_len::BIGINT * frag_len)::BIGINT AS xx FROM h)
)"""


def _erf_sql(x: str) -> str:
    """The error function, by the sum of a series near 0 and of Gaussian terms elsewhere."""
    near = f"2 / sqrt(pi()) * exp(-pow({x}, 2)) * abs({x}) * list_sum(list_transform(range(0, 16), lambda k: pow(2 * pow({x}, 2), k) / list_product(list_transform(range(0, k + 1), lambda j: 2.0::DOUBLE * j + 1))))"
    far = f"1 - (abs({x}) * exp(-pow({x}, 2)) / pi() * (0.5::DOUBLE / pow({x}, 2) + list_sum(list_transform(range(1, 13), lambda k: exp(-k * k / 4.0::DOUBLE) / (k * k / 4.0::DOUBLE + pow({x}, 2))))) - 2 / (exp(4 * pi() * abs({x})) - 1))"
    return f"(sign({x}) * CASE WHEN abs({x}) < 0.75 THEN {near} WHEN abs({x}) < 6 THEN {far} ELSE 1.0::DOUBLE END)"


def _fitted_sql() -> str:
    """The parametric distribution of the table's own mean and deviation: normal (frag_len, pdf, cdf, mean)."""
    between = f"(SELECT 0.5::DOUBLE * ({_erf_sql('high')} - {_erf_sql('low')}) FROM (SELECT (65536 - mean) / (sd * sqrt(2::DOUBLE)) AS high, -mean / (sd * sqrt(2::DOUBLE)) AS low FROM m))"
    return f"""{_MOMENTS}, inside AS (SELECT {between} AS inside),
density AS (SELECT frag_len, exp(-0.5::DOUBLE * pow((frag_len - m.mean) / sd, 2)) / (sd * sqrt(2 * pi())) / sd / inside AS pdf FROM slots, m, inside),
normal AS (SELECT frag_len, pdf, sum(pdf) OVER o AS cdf, CASE WHEN frag_len = 0 THEN 0.0::DOUBLE ELSE sum(frag_len * pdf) OVER o / sum(pdf) OVER o END AS mean FROM density WINDOW o AS (ORDER BY frag_len))
"""


def _samples_sql() -> str:
    erf = lambda x: _erf_sql(f"(({x} - mean) / (sd * sqrt(2::DOUBLE)))")
    return f""", hs AS (SELECT o_orderpriority AS sample_id, frag_len, count(*) AS n FROM (SELECT frag_id, any_value(frag_len) AS frag_len FROM a GROUP BY frag_id HAVING count(*) = 1 AND NOT bool_or(is_orphan)) JOIN orders ON o_orderkey = frag_id GROUP BY ALL),
ms AS (
  SELECT sample_id, x::DOUBLE / n AS mean, sqrt((n::HUGEINT * xx - x::HUGEINT * x)::DOUBLE / n / n) AS sd
  FROM (SELECT sample_id, sum(n)::BIGINT AS n, sum(n * frag_len)::BIGINT AS x, sum(n * frag_len::BIGINT * frag_len)::BIGINT AS xx FROM hs GROUP BY sample_id)
)
SELECT sample_id, frag_len, n, round(mean, 6) AS mean, round(sd, 6) AS sd,
  round(exp(-0.5::DOUBLE * pow((frag_len - mean) / sd, 2)) / (sd * sqrt(2 * pi())) / (0.5::DOUBLE * ({erf("65536")} - {erf("0")})), 10) AS pdf, round(({erf("frag_len")} - {erf("0")}) / ({erf("65536")} - {erf("0")}), 10) AS cdf
FROM hs JOIN ms USING (sample_id) WHERE sd > 0"""


def _parametric_sql() -> str:
    """Tables of the parametric distribution: normal (frag_len, pdf, cdf, mean)."""
    between = 0.5 * (math.erf((fraglen.SLOTS - MEAN) / (SD * math.sqrt(2))) - math.erf(-MEAN / (SD * math.sqrt(2))))
    density = f"exp(-0.5::DOUBLE * pow((frag_len - {MEAN}::DOUBLE) / {SD}::DOUBLE, 2)) / {SD * math.sqrt(2 * math.pi)!r}::DOUBLE / {SD}::DOUBLE / {between!r}::DOUBLE"
    return f""", density AS (SELECT frag_len, {density} AS pdf FROM slots),
normal AS (SELECT frag_len, pdf, sum(pdf) OVER o AS cdf, CASE WHEN frag_len = 0 THEN 0.0::DOUBLE ELSE sum(frag_len * pdf) OVER o / sum(pdf) OVER o END AS mean FROM density WINDOW o AS (ORDER BY frag_len))
"""


def oracle_sql() -> dict[str, str]:
    forward = "sum(CASE WHEN ori IN ({0}) THEN n ELSE 0 END)::DOUBLE / sum(CASE WHEN ori IN ({0}, {1}) THEN n ELSE 0 END)".format
    kind = "CASE WHEN r > 0.7::DOUBLE THEN '{0}SF' WHEN r < 0.3::DOUBLE THEN '{0}SR' ELSE '{0}U' END AS lib_type, round(r, 9) AS ratio".format
    names = ", ".join(f"({i}, '{o}')" for i, o in enumerate(libtype.ORIENTATIONS))
    accepted = " UNION ALL ".join(f"SELECT '{t}' AS lib_type, {i} AS ori, {str(i in libtype.codes(t)).lower()} AS accepted" for t in libtype.ACCEPTED for i in range(7))
    sample = f"SELECT ori, count(*) AS n FROM a WHERE frag_id IN (SELECT DISTINCT frag_id FROM a ORDER BY frag_id LIMIT {SAMPLE_READS}) GROUP BY ori"
    text = "array_to_string({0}, ',') AS {0}".format
    return {
        "lib_compat_table": _sql(f"SELECT t.*, coalesce(n, 0) AS n FROM ({accepted}) t LEFT JOIN (SELECT ori, count(*) AS n FROM a GROUP BY ori) c ON c.ori = t.ori"),
        "lib_compat_filter": _sql("SELECT frag_id, aln_idx, ref_id, pos, ori, frag_len FROM a WHERE ori BETWEEN 1 AND 4"),
        "orientation_stats": _sql("SELECT ori, count(DISTINCT frag_id) FILTER (ori BETWEEN 1 AND 4) AS mapped, count(DISTINCT frag_id) FILTER (ori NOT BETWEEN 1 AND 4) AS filtered FROM a GROUP BY ori"),
        "read_totals": _sql("SELECT count(DISTINCT frag_id) AS num_mapped_reads, count(*) AS tot_mappings FROM a"),
        "orientation_sample": _sql(sample),
        "orientation_sample_detect": _sql(
            f"SELECT CASE WHEN r > 0.7::DOUBLE THEN 'ISF' WHEN r < 0.3::DOUBLE THEN 'ISR' ELSE 'IU' END AS lib_type, round(r, 9) AS ratio FROM (SELECT sum(CASE WHEN ori IN (1, 3) THEN n ELSE 0 END)::DOUBLE / sum(CASE WHEN ori BETWEEN 1 AND 4 THEN n ELSE 0 END)::DOUBLE AS r FROM ({sample}))"
        ),
        "orientation_report": _sql(
            f"SELECT o.ori, orientation, count(DISTINCT frag_id) FILTER (o.ori BETWEEN 1 AND 4) AS mapped, count(DISTINCT frag_id) FILTER (o.ori NOT BETWEEN 1 AND 4) AS filtered FROM (VALUES {names}) o(ori, orientation) LEFT JOIN a ON a.ori = o.ori GROUP BY ALL"
        ),
        "orientation_sample_detect_unpaired": _sql(f"SELECT {kind('')} FROM (SELECT {forward('1', '2')} AS r FROM ({sample}))"),
        "strand_bias": _sql(
            f"SELECT {kind('I')}, CASE WHEN r > 0.7::DOUBLE THEN 1 - r >= 0.05::DOUBLE WHEN r < 0.3::DOUBLE THEN r >= 0.05::DOUBLE ELSE abs(r - 0.5::DOUBLE) > 0.05::DOUBLE END AS biased FROM (SELECT {forward('1, 3', '2, 4')} AS r FROM ({sample}))"
        ),
        "conditional_means_asof": _sql(
            """, own AS (SELECT frag_len, (sum(frag_len * n) OVER o)::DOUBLE / (sum(n) OVER o)::DOUBLE AS mean FROM h WINDOW o AS (ORDER BY frag_len))
SELECT a.frag_id, a.aln_idx, a.frag_len AS own_len, own.frag_len, round(CASE WHEN own.frag_len = 0 THEN 0.0::DOUBLE ELSE mean END, 6) AS mean FROM a ASOF LEFT JOIN own ON a.frag_len >= own.frag_len"""
        ),
        "effective_lengths_asof": _sql("SELECT ref_id, target_name, len, round(eff_len, 6) AS eff_len FROM e"),
        "csr_offsets": _sql(
            f""", labelled AS (SELECT {text('targets')}, {text('oris')}, n, len(targets) AS size FROM basic),
placed AS (SELECT *, CAST(sum(size) OVER (ORDER BY targets, oris) AS BIGINT) AS "end" FROM labelled)
SELECT targets, oris, n, "end" - size AS start, "end" FROM placed"""
        ),
        "em_k2_exact": _sql(
            """, q AS (SELECT e.ref_id, s2.a AS ecount, CASE WHEN eff_len > 0 THEN s2.a / eff_len ELSE 0.0::DOUBLE END AS rate FROM e JOIN s2 ON s2.ref_id = e.ref_id)
SELECT ref_id, round(ecount, 5) AS ecount, round(1e6::DOUBLE * rate / (SELECT fsum(rate) FROM q), 5) AS tpm FROM q""",
            2,
        ),
        "fld_parametric_samples": _sql(_samples_sql()),
        "fld_parametric": _sql(_fitted_sql() + "SELECT frag_len, round(pdf, 10) AS pdf, round(cdf, 10) AS cdf FROM normal"),
        "effective_lengths_unpaired": _sql(
            _parametric_sql() + "SELECT ref_id, target_name, len, round(CASE WHEN len - mean < 1 THEN len::DOUBLE ELSE len - mean END, 4) AS eff_len FROM t JOIN normal ON frag_len = least(len, 65535)"
        ),
        "cond_prob_unpaired": _sql(
            _parametric_sql()
            + """SELECT frag_id, aln_idx, a.ref_id, ori, round(CASE WHEN ori IN (1, 2) THEN coalesce(cdf, 1.0::DOUBLE) WHEN ori IN (3, 4) THEN coalesce(pdf, 2.2250738585072014e-308::DOUBLE) ELSE 2 * 2.2250738585072014e-308::DOUBLE END, 10) AS prob
FROM a JOIN t USING (ref_id) LEFT JOIN normal ON normal.frag_len = CASE WHEN ori = 1 THEN len - pos WHEN ori = 2 THEN pos + 100 WHEN ori IN (3, 4) THEN a.frag_len END"""
        ),
        "fld_histogram": _sql("SELECT * FROM h"),
        "fld_pass1_limit": _sql(f"SELECT frag_len, count(*) AS n FROM (SELECT * FROM u WHERE ori BETWEEN 1 AND 4 ORDER BY frag_id LIMIT {PASS_1}) GROUP BY frag_len"),
        "fld_pdf_cdf": _sql("SELECT frag_len, round(pdf, 10) AS pdf, round(cdf, 10) AS cdf FROM fld"),
        "conditional_means": _sql("SELECT frag_len, round(mean, 6) AS mean FROM means"),
        "parametric_conditional_means": _sql(_fitted_sql() + "SELECT frag_len, round(mean, 4) AS mean FROM normal"),
        "effective_lengths": _sql("SELECT ref_id, target_name, len, round(eff_len, 6) AS eff_len FROM e"),
        "cond_prob": _sql("SELECT frag_id, aln_idx, ref_id, ori, round(prob, 10) AS prob FROM p"),
        "eq_classes_basic": _sql(f"SELECT {text('targets')}, {text('oris')}, n FROM basic"),
        "eq_classes_range": _sql(f"SELECT {text('targets')}, {text('bins')}, {text('oris')}, n FROM ranged"),
        "eq_classes_packed": _sql(f"SELECT {text('targets')}, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(bins, lambda b: b / 64.0::DOUBLE + 0.5::DOUBLE / 64)), lambda s, x: s + x), 9) AS mass, n FROM ranged"),
        "eq_class_totals": _sql("SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS weight FROM basic"),
        "em_init": _sql("SELECT ref_id, round(a, 6) AS a FROM s0"),
        "em_step1": _sql("SELECT ref_id, round(a, 4) AS a FROM s1", 1),
        "em_k3": _sql("SELECT ref_id, round(a, 4) AS a FROM s3", 3),
        "em_k10_range": _range_sql(10),
        "em_converged": _converged_sql(_ONE_SAMPLE, "SELECT sample_id, ref_id, round(ecount, 4) AS ecount FROM counts"),
        "em_samples": _converged_sql(_TWO_SAMPLES, "SELECT sample_id, ref_id, round(ecount, 6) AS ecount FROM counts"),
        "quant_converged": _converged_sql(
            _ONE_SAMPLE, "SELECT ref_id, target_name, len, round(eff_len, 4) AS eff_len, round(1e6::DOUBLE * rate / (SELECT sum(rate) FROM rates), 3) AS tpm, round(ecount, 4) AS ecount FROM rates"
        ),
        "tpm_converged": _converged_sql(_ONE_SAMPLE, "SELECT ref_id, round(1e6::DOUBLE * rate / (SELECT sum(rate) FROM rates), 3) AS tpm FROM rates"),
        "tpm": _sql(_quant_sql() + " SELECT ref_id, tpm FROM z", 3),
        "quant_flagship": _sql(_quant_sql() + " SELECT * FROM z", 3),
    }
