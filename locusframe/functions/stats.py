"""Statistics of associations.  Everything but the normal distribution's tails is a JVM expression."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .variants import present

TIERS = {"p_5e_08": 5e-8, "p_5e_06": 5e-6, "p_5e_04": 5e-4}
SE_LIMIT = 65504.0
Z95 = 1.959964

_normal = NormalDist()


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, x.tolist()), float, len(x))


def z_critical(threshold: float) -> float:
    """The |z| whose two-sided p is the threshold."""
    return -_normal.inv_cdf(threshold / 2)


def tier_key(threshold: float) -> str:
    return "p_" + f"{threshold:.0e}".replace("-", "_")


def number(text: Column) -> Column:
    """A finite number, or null."""
    value = present(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def effect(text: Column) -> Column:
    """A number or infinity, or null."""
    value = present(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def positive(text: Column) -> Column:
    value = number(text)
    return F.when(value > 0, value)


def null_for_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def frequency(value: Column) -> Column:
    """Strictly between 0 and 1, else null."""
    return F.when((value > 0) & (value < 1), value)


def imputation_score(text: Column) -> Column:
    """(score, status) of a declared score cell."""
    value = present(text).try_cast("double")
    status = (
        F.when(present(text).isNull(), "missing").when(value.isNull(), "malformed")
        .when(F.isnan(value) | (F.abs(value) == float("inf")), "nonfinite")
        .when((value < 0) | (value > 1), "out_of_range").otherwise("usable")
    )
    return F.struct(F.when(status == "usable", value).alias("score"), status.alias("status"))


@F.pandas_udf(DoubleType())
def p_from_z(z: pd.Series) -> pd.Series:
    return pd.Series(_erfc(z.abs().to_numpy(float) / math.sqrt(2)))


def _log_tail(x: np.ndarray) -> np.ndarray:
    """log P(Z > x), x >= 0: by erfc, and by its asymptotic series where that underflows."""
    out = np.full(len(x), np.nan)
    low = x < 25
    out[low] = np.log(_erfc(x[low] / math.sqrt(2)) / 2)
    high = x >= 25
    t = 1 / x[high] ** 2
    out[high] = -x[high] ** 2 / 2 - np.log(x[high]) - math.log(2 * math.pi) / 2 + np.log1p(-t * (1 - 3 * t * (1 - 5 * t)))
    return out


@F.pandas_udf(DoubleType())
def log10_p(z: pd.Series) -> pd.Series:
    return pd.Series((math.log(2) + _log_tail(z.abs().to_numpy(float))) / math.log(10))


@F.pandas_udf(DoubleType())
def normal_quantile_of_half(p: pd.Series) -> pd.Series:
    """-quantile(p / 2), for 0 < p < 1."""
    return p.map(lambda v: -_normal.inv_cdf(v / 2) if v is not None and 0 < v < 1 else None).astype(float)


def logit(f: Column) -> Column:
    return F.when((f > 0) & (f < 1), F.log(f / (1 - f)))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def quantised_z(z: Column, scale: int = 1024, most: float = 32) -> Column:
    return F.when(F.abs(z) <= most, F.rint(z * scale) / scale).otherwise(z)


def from_z_score(z: Column, eaf: Column, n: Column) -> Column:
    """(beta, se) of a standardised trait."""
    se = 1 / F.sqrt(2 * eaf * (1 - eaf) * (n + z * z))
    return F.when((eaf > 0) & (eaf < 1) & (n > 0), F.struct((z * se).alias("beta"), se.alias("se")))


def row_statistics(beta: Column, odds_ratio: Column, se: Column, low: Column, high: Column, p: Column) -> Column:
    """(beta, se, z, se_from): what a row of text columns says, in order of trust.

    The effect is beta, else the logarithm of the odds ratio.  The standard error is its own
    column, else the 95 % interval's width if the effect lies inside, else |effect| over the
    normal quantile of p.  An infinity in the effect column is the effect.
    """
    own = effect(beta)
    ratio = F.when(positive(odds_ratio).isNotNull(), F.log(positive(odds_ratio)))
    value = F.coalesce(own, ratio)
    from_ratio = own.isNull() & ratio.isNotNull()
    ends = [F.when(from_ratio, F.log(positive(x))).otherwise(number(x)) for x in (low, high)]
    interval = F.when((ends[0] <= value) & (value <= ends[1]) & (ends[1] > ends[0]), (ends[1] - ends[0]) / (2 * Z95))
    p_value = number(p)
    by_p = F.when((p_value > 0) & (p_value < 1) & (value != 0), F.abs(value) / normal_quantile_of_half(p_value))
    error = F.coalesce(positive(se), interval, by_p)
    source = F.when(positive(se).isNotNull(), "column").when(interval.isNotNull(), "interval").when(by_p.isNotNull(), "p_value")
    return F.struct(value.alias("beta"), error.alias("se"), (value / error).alias("z"), source.alias("se_from"))


def vcf_z(ez: Column, es: Column, se: Column) -> Column:
    return F.coalesce(null_for_nan(ez), F.when(se > 0, null_for_nan(es / se)))


def states(z: Column, se: Column, imputed: Column) -> Column:
    """observed, imputed, missing, or why the cell is invalid."""
    z, se = null_for_nan(z), null_for_nan(se)
    mask = F.coalesce(imputed.cast("int"), F.lit(0))
    return (
        F.when(z.isNull() != se.isNull(), "partial")
        .when(~mask.isin(0, 1), "flag_invalid")
        .when(z.isNull() & (mask == 1), "imputed_missing")
        .when(z.isNull(), "missing")
        .when(mask == 1, "imputed")
        .otherwise("observed")
    )


#: What reported populations contain, in lower case, and what they stand for; first match wins.  Fixed values of the reports.
REPORTED = [
    ("european", "EUR"), ("europe", "EUR"), ("sardinian", "EUR"), ("east asian", "EAS"), ("japanese", "EAS"), ("chinese", "EAS"), ("korean", "EAS"), ("african", "AFR"),
    ("hispanic", "AMR"), ("latin", "AMR"), ("south asian", "SAS"), ("indian", "SAS"), ("iranian", "MID"), ("middle east", "MID"), ("north africa", "NAF"),
    ("mixed", None), ("trans-ethnic", None), ("admixed", None),
]
#: Exact labels of ancestries; fixed values.
ANCESTRIES = {
    "afr": "AFR", "african": "AFR", "amr": "AMR", "american": "AMR", "admixed american": "AMR", "ad mixed american": "AMR", "eas": "EAS", "east asian": "EAS",
    "eur": "EUR", "european": "EUR", "mid": "MID", "middle eastern": "MID", "naf": "NAF", "north african": "NAF", "sas": "SAS", "south asian": "SAS",
}


def super_population(reported: Column) -> Column:
    """Of a free text; null if nothing is found, or if it is mixed."""
    text = F.lower(F.trim(reported))
    cases = F.when(text == "", None)
    for part, name in REPORTED:
        cases = cases.when(text.contains(part), F.lit(name).cast("string"))
    return cases.otherwise(None)


def canonical_ancestry(label: Column) -> Column:
    """Of a label as a whole; underscores and hyphens are spaces."""
    text = F.lower(F.trim(F.regexp_replace(label, r"[\s_-]+", " ")))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ANCESTRIES.items() for x in pair]), text)


def analysis_label(label: Column, analysis_id: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), analysis_id)


def se_float16(se: Column) -> Column:
    """Rounded to the nearest half-precision number, ties to even; from 65,520 on infinite."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(se)), F.lit(-14)) - 10)
    return F.when(se == 0, 0.0).when(se >= 65520, float("inf")).when(se >= SE_LIMIT, SE_LIMIT).otherwise(F.rint(se / step) * step)


def se_residual_code(se: Column, eaf: Column, intercept: Column, slope: Column, step: float) -> Column:
    """Steps of log(se) from what an analysis's fit predicts, or null where that is beyond one byte."""
    code = F.rint((F.log(se) - (intercept + slope * F.log(2 * eaf * (1 - eaf)))) / step)
    return F.when((eaf > 0) & (eaf < 1) & code.between(-126, 127), code.cast("int"))


def eaf_residual(eaf: Column, baseline: Column, step: float) -> Column:
    """Steps of logit(eaf) from the variant's baseline."""
    return F.rint((logit(eaf) - logit(baseline)) / step)


MISSING_N = (1 << 32) - 1


def encoded_n(n: Column) -> Column:
    """A whole sample size, with a code for none."""
    return F.when(n.isNull() | (n < 0) | (n >= MISSING_N), F.lit(MISSING_N)).otherwise(F.rint(n).cast("long"))


def decoded_n(code: Column) -> Column:
    return F.when(code != MISSING_N, code.cast("double"))


BUILDS = {"hg19": "GRCh37", "grch37": "GRCh37", "b37": "GRCh37", "37": "GRCh37", "hg38": "GRCh38", "grch38": "GRCh38", "b38": "GRCh38", "38": "GRCh38"}


def genome_build(name: Column) -> Column:
    pairs = [x for k, v in BUILDS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(name)))


def shown_p(log10: Column) -> Column:
    return F.when(log10 < -300, "<1e-300").otherwise(F.format_string("%.3g", F.pow(F.lit(10.0), log10)))


def shown_frequency(eaf: Column) -> Column:
    return F.when(eaf.isNull() | F.isnan(eaf), ".").otherwise(F.format_string("%.6g", eaf))
