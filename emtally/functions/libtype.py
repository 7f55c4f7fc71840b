"""Library types: which orientations of mappings they accept, and which of them a sample of reads points to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTO = "AUTO"

# Orientation codes, and by library type the orientations accepted and the name written to metadata.
ORIENTATIONS = ("unknown", "f", "r", "fr", "rf", "ff", "rr")
ACCEPTED = {
    "SF": ("f",),
    "ISF": ("f", "fr"),
    "SR": ("r",),
    "ISR": ("r", "rf"),
    "U": ("f", "r"),
    "IU": ("f", "r", "fr", "rf"),
    "ANY": ORIENTATIONS,
}
SERIALISED = {"SF": "StrandedForward", "ISF": "InwardStrandedForward", "SR": "StrandedReverse", "ISR": "InwardStrandedReverse", "U": "Unstranded", "IU": "InwardUnstranded", "ANY": "Any"}
LOW, HIGH = 0.3, 0.7
BIAS = 0.05


def parse(name: str) -> str:
    if name.upper() not in ACCEPTED:
        raise ValueError(f"{name} is an unknown library type!")
    return name.upper()


def parse_option(name: str) -> str:
    """A library type, or AUTO."""
    return AUTO if name.upper() == AUTO else parse(name)


def display(lib_type: str) -> str:
    return "Any" if parse(lib_type) == "ANY" else parse(lib_type)


def serialised(lib_type: str) -> str:
    return SERIALISED[parse(lib_type)]


def codes(lib_type: str) -> list[int]:
    """Codes of the orientations that the library type accepts."""
    return [ORIENTATIONS.index(o) for o in ACCEPTED[parse(lib_type)]]


def compatible(lib_type: str, ori: Column) -> Column:
    return ori.isin(codes(lib_type))


def detect(counts: dict[str, int], paired: bool) -> tuple[str, float]:
    """The library type and the share of forward mappings, from mapping counts by orientation."""
    forward = counts.get("f", 0) + (counts.get("fr", 0) if paired else 0)
    reverse = counts.get("r", 0) + (counts.get("rf", 0) if paired else 0)
    ratio = forward / (forward + reverse) if forward + reverse else 0.5
    kind = "SF" if ratio > HIGH else "SR" if ratio < LOW else "U"
    return ("I" if paired else "") + kind, ratio


def detected(counts: DataFrame, paired: bool) -> DataFrame:
    """``detect`` over (ori, n), as one row (lib_type, ratio)."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("ori").isin([ORIENTATIONS.index(n) for n in names]), F.col("n"))), F.lit(0)).cast("double")
    sums = counts.agg(of("f", *["fr"] * paired).alias("forward"), of("r", *["rf"] * paired).alias("reverse"))
    ratio = F.coalesce(F.try_divide("forward", F.col("forward") + F.col("reverse")), F.lit(0.5))
    prefix = "I" if paired else ""
    kind = F.when(F.col("ratio") > HIGH, prefix + "SF").when(F.col("ratio") < LOW, prefix + "SR").otherwise(prefix + "U")
    return sums.select(ratio.alias("ratio")).select(kind.alias("lib_type"), "ratio")


def with_bias(found: DataFrame) -> DataFrame:
    """``detected`` with ``biased``: whether ``strand_bias`` has a warning for the row."""
    forward, reverse = (F.col("lib_type").isin(*kinds) for kinds in (("SF", "ISF"), ("SR", "ISR")))
    off = F.when(forward, 1 - F.col("ratio") >= BIAS).when(reverse, F.col("ratio") >= BIAS).when(F.col("lib_type").isin("U", "IU"), F.abs(F.col("ratio") - 0.5) > BIAS)
    return found.withColumn("biased", F.coalesce(off, F.lit(False)))


def strand_bias(lib_type: str, ratio: float) -> str | None:
    """A warning if the share of forward mappings doesn't fit the detected library type, or None."""
    name = parse(lib_type)
    other = 1 - ratio if name in ("SF", "ISF") else ratio
    if name in ("SF", "ISF", "SR", "ISR") and other >= BIAS:
        return f"{display(name)}: {100 * other:.1f} % of the sampled mappings are of the other strand"
    if name in ("U", "IU") and abs(ratio - 0.5) > BIAS:
        return f"{display(name)}: the share of forward mappings is {ratio:.3f}, not about 0.5"
    return None
