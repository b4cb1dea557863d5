import math

import pytest
from pyspark.sql import functions as F

from locusframe.functions import stats as S
from locusframe.functions import variants as V


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_chromosome(spark):
    given = ["chr1", "22", "23", "X", "chrx", "25", "M", "27", "", "NA", "GL000", None]
    got = [x for (x,) in values(spark, [(g,) for g in given], "c string", V.chromosome(F.col("c")))]
    assert got == ["1", "22", "X", "X", "X", "MT", "MT", None, None, None, "GL000", None]


def test_alid_sorts_snps_and_keeps_the_reference_of_indels(spark):
    rows = [("1", 5, "T", "A"), ("1", 5, "TA", "T"), ("1", 5, "A", "AT")]
    got = [x for (x,) in values(spark, rows, "c string, p int, r string, a string", V.alid(F.col("c"), F.col("p"), F.col("r"), F.col("a")))]
    assert got == ["1:5:A:T", "1:5:TA:T", "1:5:A:AT"]


def test_identity_faults(spark):
    rows = [(None, 1, "A", "C"), ("1", 0, "A", "C"), ("1", 1, "A", "N"), ("1", 1, "A", "A"), ("1", 1, "A", "AT"), ("1", 1, "A", "C")]
    got = [x for (x,) in values(spark, rows, "c string, p int, e string, o string", V.identity_fault(F.col("c"), F.col("p"), F.col("e"), F.col("o"), F.lit(False)))]
    assert got == ["chromosome_missing", "chromosome_missing", "allele_invalid", "allele_invalid", "indel_reference_undeclared", None]


def test_rsid_and_palindromes(spark):
    assert values(spark, [("x;rs12:A;rs3",), ("nope",), (None,)], "s string", V.rsid(F.col("s"))) == [("rs12",), ("",), ("",)]
    assert values(spark, [("A", "T"), ("C", "G"), ("A", "C")], "a string, b string", V.is_palindromic(F.col("a"), F.col("b"))) == [(True,), (True,), (False,)]


def test_cuts():
    assert S.z_critical(5e-8) == pytest.approx(5.451310437845481)
    assert S.z_critical(5e-4) == pytest.approx(3.480756404346213)


def test_log10_p_in_and_beyond_double_range(spark):
    got = values(spark, [(0.0,), (1.959963984540054,), (24.9,), (25.1,), (40.0,)], "z double", S.log10_p(F.col("z")))
    assert got[0][0] == pytest.approx(0)
    assert got[1][0] == pytest.approx(math.log10(0.05))
    for (v,), z in zip(got[2:4], (24.9, 25.1)):
        assert v == pytest.approx(math.log10(math.erfc(z / math.sqrt(2))), rel=1e-9)
    assert got[4][0] == pytest.approx(-349.13, abs=0.5)


def test_row_statistics_cascade(spark):
    schema = "b string, o string, s string, l string, h string, p string"
    rows = [("0.5", None, "0.1", None, None, None), (None, "2.0", None, "1.0", "4.0", None), ("0.5", None, None, None, None, "0.05"), ("inf", None, "0.1", None, None, None), (None, None, "0.1", None, None, None)]
    got = values(spark, rows, schema, S.row_statistics(*[F.col(c) for c in "boslhp"]).alias("x"))
    beta, se, z, how = zip(*[tuple(x) for (x,) in got])
    assert how == ("column", "interval", "p_value", "column", "column")
    assert beta[1] == pytest.approx(math.log(2)) and se[1] == pytest.approx(math.log(4) / (2 * 1.959964))
    assert z[2] == pytest.approx(1.959963984, rel=1e-6)
    assert z[3] == math.inf and z[4] is None


def test_states_and_nan(spark):
    nan = float("nan")
    rows = [(1.0, 1.0, 0), (1.0, 1.0, 1), (None, nan, 0), (1.0, nan, 0), (nan, None, 1), (1.0, 1.0, 7)]
    got = [x for (x,) in values(spark, rows, "z double, s double, i int", S.states(F.col("z"), F.col("s"), F.col("i")))]
    assert got == ["observed", "imputed", "missing", "partial", "imputed_missing", "flag_invalid"]
