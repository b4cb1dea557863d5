"""Admission: one verdict for each source row, counted, and duplicate resolution."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S

#: Verdicts, first match wins.
REASONS = [
    "chromosome_missing", "allele_invalid", "indel_reference_undeclared", "se_unusable", "effect_missing", "z_nonfinite",
    "info_below_threshold", "maf_missing", "maf_below_threshold", "collapsed", "conflicting", "off_axis", "se_out_of_range",
]

#: Bytes of files for one task of spread(); sizes beyond MOST_BYTES are Spark's guesses for what it can't know.
TASK_BYTES, MOST_BYTES = 8 << 20, 1 << 50


@dataclass(frozen=True)
class Rules:
    """info: least imputation score; maf: least minor allele frequency.  None: not judged."""

    info: float | None = None
    maf: float | None = None


def admissible(z: Column, se: Column) -> Column:
    finite = ~F.isnan(z) & (F.abs(z) != float("inf"))
    return F.coalesce(finite & ~F.isnan(se) & (se > 0) & (se != float("inf")), F.lit(False))


def frequency_usable(eaf: Column) -> Column:
    return F.coalesce(eaf.between(0, 1) & ~F.isnan(eaf), F.lit(False))


def verdict(columns: list[str], rules: Rules) -> Column:
    """The reason why a row with z, se and, as far as it has them, fault, info and eaf is left out; null if it is kept."""
    z, se = F.col("z"), F.col("se")
    tests: list[Column] = [F.col("fault")] if "fault" in columns else []
    tests.append(F.when(se.isNull() | F.isnan(se) | (se <= 0) | (se == float("inf")), "se_unusable"))
    tests.append(F.when(z.isNull() | F.isnan(z), "effect_missing"))
    tests.append(F.when(F.abs(z) == float("inf"), "z_nonfinite"))
    if rules.info is not None and "info" in columns:  # rows without a usable score stay
        tests.append(F.when(F.col("info") < rules.info, "info_below_threshold"))
    if rules.maf is not None:
        eaf = F.col("eaf")
        tests.append(F.when(~frequency_usable(eaf), "maf_missing"))
        tests.append(F.when(F.least(eaf, 1 - eaf) < rules.maf, "maf_below_threshold"))
    return F.coalesce(*tests)


def judged(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """rows with ``reason``; a frequency outside (0, 1) becomes null in rows that are kept."""
    return rows.withColumn("reason", verdict(rows.columns, rules)).withColumn("eaf", S.frequency(F.col("eaf")))


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """examined, admitted and one count for each reason that occurs, long form."""
    return rows.groupBy(*by, F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt out by the keys to tasks whose number grows with the files read, so that a task's sort stays as it is; inputs of unknown size are left alone."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size > MOST_BYTES:
        return rows
    return rows.repartition(max(-(-size // TASK_BYTES), rows.sparkSession.sparkContext.defaultParallelism), *keys)


def collapsed(rows: DataFrame, keys: list[str], order: str = "row_order", dealt: bool = False) -> DataFrame:
    """The first row of each place whose rows all agree with it on z and se (null equals null); places that disagree are gone.

    One aggregation; a place with many rows needs no window.  dealt: rows come dealt out (spread) by some of the keys.
    """
    carried = [c for c in rows.columns if c not in (*keys, order)]
    ends = [f(c).alias(f"_{c}_{i}") for c in ("z", "se") for i, f in enumerate((F.min, F.max, F.count))]
    grouped = (rows if dealt else spread(rows, keys)).groupBy(*keys).agg(F.min_by(F.struct(*carried), order).alias("r"), F.count("*").alias("n_rows"), *ends)
    for c in ("z", "se"):
        grouped = grouped.where(F.col(f"_{c}_0").eqNullSafe(F.col(f"_{c}_1")) & ((F.col(f"_{c}_2") == F.col("n_rows")) | (F.col(f"_{c}_2") == 0)))
    return grouped.select(*keys, "r.*", "n_rows")


def duplicate_counts(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """collapsed and conflicting rows of each group."""
    pair = F.struct("z", "se")
    places = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(pair).eqNullSafe(F.max(pair)).alias("agree"))
    return places.groupBy(*by).agg(F.sum(F.when(F.col("agree"), F.col("n") - 1).otherwise(0)).alias("collapsed"), F.sum(F.when(~F.col("agree"), F.col("n")).otherwise(0)).alias("conflicting"))


def storable(rows: DataFrame, divisors: DataFrame | None = None) -> DataFrame:
    """se over the analysis's phenotype SD (analysis_index, divisor), once; beyond the limit a row's reason is se_out_of_range."""
    if divisors is not None:
        rows = rows.join(divisors, "analysis_index", "left").withColumn("se", (F.col("se").cast("float") / F.coalesce("divisor", F.lit(1.0)).cast("float")).cast("double")).drop("divisor")
    return rows.withColumn("reason", F.when(F.col("se") > S.SE_LIMIT, "se_out_of_range"))


def refuse_invalid(rows: DataFrame) -> DataFrame:
    """The rows; reading one in an invalid state raises and names it."""
    state = S.states(F.col("z"), F.col("se"), F.col("imputed"))
    where = F.concat_ws(" ", F.lit("invalid association"), F.col("variant_index").cast("string"), F.col("analysis_index").cast("string"), state)
    return rows.where(F.when(state.isin("observed", "imputed", "missing"), True).otherwise(F.raise_error(where).cast("boolean")))


def tally(rows: DataFrame) -> DataFrame:
    """How many rows are in each state."""
    return rows.groupBy(S.states(F.col("z"), F.col("se"), F.col("imputed")).alias("state")).agg(F.count("*").alias("n"))


def any_of(columns: list[Column]) -> Column:
    return reduce(or_, columns)
