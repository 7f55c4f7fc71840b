import pytest

from emtally.config import QuantOptions
from emtally.functions import libtype


@pytest.mark.parametrize(
    "f,r,fr,rf,paired,expected,ratio",
    [
        # on a threshold, and one fragment beyond it
        (0, 0, 6, 14, True, "IU", 0.3), (0, 0, 5, 14, True, "ISR", 5 / 19), (0, 0, 14, 6, True, "IU", 0.7), (0, 0, 15, 6, True, "ISF", 15 / 21),
        (21, 49, 0, 0, False, "U", 0.3), (20, 49, 0, 0, False, "SR", 20 / 69), (49, 21, 0, 0, False, "U", 0.7), (50, 21, 0, 0, False, "SF", 50 / 71),
        # single and paired mappings of one sample count together; one side alone; none
        (4, 1, 11, 2, True, "ISF", 15 / 18), (37, 0, 0, 0, False, "SF", 1.0), (0, 1, 0, 0, True, "ISR", 0.0), (0, 0, 0, 0, True, "IU", 0.5), (0, 0, 0, 0, False, "U", 0.5),
    ],
)
def test_detection(spark, f, r, fr, rf, paired, expected, ratio):
    counts = {"f": f, "r": r, "fr": fr, "rf": rf}
    assert libtype.detect(counts, paired) == (expected, pytest.approx(ratio))
    row = libtype.detected(spark.createDataFrame([(i + 1, n) for i, n in enumerate((f, r, fr, rf))], "ori int, n long"), paired).first()
    assert (row.lib_type, row.ratio) == (expected, pytest.approx(ratio))


def test_names():
    for name in ("SF", "ISF", "SR", "ISR", "U", "IU", "ANY"):
        assert libtype.parse(name.lower()) == name
    with pytest.raises(ValueError, match="^ABC is an unknown library type!$"):
        libtype.parse("ABC")
    assert [libtype.display(x) for x in ("sf", "isf", "iu", "any")] == ["SF", "ISF", "IU", "Any"]
    assert libtype.serialised("IU") == "InwardUnstranded" and libtype.parse_option("auto") == "AUTO"


def test_compatibility():
    want = {"SF": [1], "ISF": [1, 3], "SR": [2], "ISR": [2, 4], "U": [1, 2], "IU": [1, 2, 3, 4], "ANY": list(range(7))}
    assert {t: libtype.codes(t) for t in want} == want


def test_strand_bias(spark):
    assert libtype.strand_bias("SF", 0.95) and not libtype.strand_bias("SF", 0.96)
    rows = [(t, r / 100) for t in libtype.ACCEPTED for r in (0, 4, 6, 44, 46, 50, 54, 56, 94, 96, 100)]
    for row in libtype.with_bias(spark.createDataFrame(rows, "lib_type string, ratio double")).collect():
        assert row.biased == (libtype.strand_bias(row.lib_type, row.ratio) is not None)
    assert libtype.strand_bias("ISR", 0.05) and not libtype.strand_bias("ISR", 0.04)
    assert libtype.strand_bias("IU", 0.56) and not libtype.strand_bias("U", 0.54) and not libtype.strand_bias("ANY", 1.0)


def test_options():
    assert QuantOptions(lib_type="auto").as_dict()["lib_type"] == "Auto"
    for bad in ({"fld_mean": 200.0}, {"num_bootstraps": 1, "num_gibbs_samples": 1}, {"factorized_eqc_bins": 0}, {"lib_type": "x"}):
        with pytest.raises(ValueError):
            QuantOptions(**bad)
