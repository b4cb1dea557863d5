"""Aggregations of associations: scales, frequencies, phenotype SD, consistency, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats as S


def _scale(se: Column, eaf: Column) -> Column:
    return F.when((eaf > 0) & (eaf < 1), S.null_for_nan(se) * F.sqrt(2 * eaf * (1 - eaf)))


def se_scale(rows: DataFrame, by: list[str]) -> DataFrame:
    """The exact median of se * sqrt(2f(1-f))."""
    return rows.groupBy(*by).agg(F.median(_scale(F.col("se"), F.col("eaf"))).alias("se_scale"))


def phenotype_sd(rows: DataFrame, sizes: DataFrame, by: str = "analysis_index") -> DataFrame:
    """sd: the median over variants of se * sqrt(2f(1-f)(n + z^2)); dispersion: the median distance from it."""
    f = F.col("eaf")
    implied = F.when((f > 0) & (f < 1), F.col("se") * F.sqrt(2 * f * (1 - f) * (F.col("sample_size") + F.col("z") * F.col("z"))))
    own = rows.join(sizes.select(by, "sample_size"), by).select(by, implied.alias("v")).where("v IS NOT NULL")
    middle = own.groupBy(by).agg(F.median("v").alias("sd"), F.count("*").alias("n"))
    return own.join(middle, by).groupBy(by).agg(F.first("sd").alias("sd"), F.first("n").alias("n"), F.median(F.abs(F.col("v") - F.col("sd"))).alias("dispersion"))


def effect_sd(rows: DataFrame, by: str = "analysis_index") -> DataFrame:
    """1.4826 times the median absolute deviation of beta = z * se, of two rows at least."""
    own = rows.select(by, (F.col("z") * F.col("se")).alias("v")).where("v IS NOT NULL")
    middle = own.groupBy(by).agg(F.median("v").alias("m"), F.count("*").alias("n")).where("n >= 2")
    return own.join(middle, by).groupBy(by).agg((1.4826 * F.median(F.abs(F.col("v") - F.col("m")))).alias("sd"))


def eaf_baseline(rows: DataFrame) -> DataFrame:
    """For each variant, the frequency at the median logit."""
    return rows.groupBy("variant_index").agg(S.expit(F.median(S.logit(F.col("eaf")))).alias("eaf"))


def log_se_fit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Least squares of log(se) on log(2f(1-f))."""
    f = F.col("eaf")
    x, y = F.when((f > 0) & (f < 1), F.log(2 * f * (1 - f))), F.log("se")
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def frequency_orientation(rows: DataFrame, panel: DataFrame, by: list[str], least: int = 500, least_variance: float = 0.005) -> DataFrame:
    """Correlation of eaf with the panel's (variant_index, panel_eaf): verified, flipped, or too little to tell."""
    both = rows.join(panel, "variant_index").where("eaf IS NOT NULL AND panel_eaf IS NOT NULL")
    out = both.groupBy(*by).agg(
        F.count("*").alias("n"), F.corr("eaf", "panel_eaf").alias("r"), F.var_pop("eaf").alias("v"), F.var_pop("panel_eaf").alias("v_panel"),
    )
    enough = (F.col("n") >= least) & (F.col("v") >= least_variance) & (F.col("v_panel") >= least_variance)
    return out.withColumn("orientation", F.when(~enough, "unverified").when(F.col("r") > 0, "verified").otherwise("flipped"))


def leave_one_out_medians(rows: DataFrame) -> DataFrame:
    """(analysis_index, variant_index, eaf, others): the median eaf of the other analyses at the site; sites with less than two others are left out.

    The median without one's own value follows from the ranks alone: three neighbours of the
    middle are enough, so a site is one window and no list.
    """
    own = rows.where("eaf IS NOT NULL").select("analysis_index", "variant_index", "eaf")
    site = Window.partitionBy("variant_index").orderBy("eaf", "analysis_index")
    whole = Window.partitionBy("variant_index")
    ranked = own.withColumn("k", F.row_number().over(site)).withColumn("n", F.count("*").over(whole))
    # Without rank k, the others' middle ranks m1 and m2 (of n - 1) move up by one from k on.
    m1, m2 = F.floor(F.col("n") / 2), F.floor((F.col("n") + 1) / 2)
    at = lambda m: m + (F.col("k") <= m).cast("long")
    ranked = ranked.where("n > 2").withColumn("a", at(m1)).withColumn("b", at(m2))
    low, middle = F.floor(F.col("n") / 2), F.floor((F.col("n") + 1) / 2)
    edges = [F.max(F.when(F.col("k") == m + d, F.col("eaf"))).over(whole).alias(f"e{i}{d}") for i, m in enumerate((low, middle)) for d in (0, 1)]
    got = ranked.select("*", *edges)
    first = F.when(F.col("a") == low, F.col("e00")).otherwise(F.col("e01"))
    second = F.when(F.col("b") == middle, F.col("e10")).otherwise(F.col("e11"))
    return got.select("analysis_index", "variant_index", "eaf", ((first + second) / 2).alias("others"))


def effect_consistency(rows: DataFrame, by: list[str], most_abs: float = 1.0, most: float = 0.1, least: int = 50) -> DataFrame:
    """Of stored and reported log10 p (stored, reported): median difference and median absolute difference, and the verdict."""
    d = F.col("stored") - F.col("reported")
    out = rows.groupBy(*by).agg(F.count(d).alias("n"), F.median(d).alias("median_delta"), F.median(F.abs(d)).alias("median_abs_delta"))
    bad = (F.col("median_abs_delta") > most_abs) | (F.abs(F.col("median_delta")) > most)
    return out.withColumn("verdict", F.when(F.col("n") < least, "too_few").when(bad, "inconsistent").otherwise("consistent"))


def hit_counts(rows: DataFrame) -> DataFrame:
    """Top hits of each analysis at each tier."""
    size = F.abs(F.col("z"))
    return rows.groupBy("analysis_index").agg(*[F.count(F.when(size >= S.z_critical(t), 1)).alias(name) for name, t in S.TIERS.items()])


def out_of_range(rows: DataFrame) -> DataFrame:
    return rows.groupBy("analysis_index").agg(F.count(F.when(F.col("se") > S.SE_LIMIT, 1)).alias("se_out_of_range"))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def variant_offsets(rows: DataFrame) -> DataFrame:
    """(variant_index, n, before): counts, and how many rows stand before in variant order.

    Runs within ranges of variants are summed apart, so no window spans the table.
    """
    n = rows.groupBy("variant_index").agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("variant_index") / 4096))
    per = n.groupBy("stretch").agg(F.sum("n").alias("total"))
    starts = per.withColumn("start", F.coalesce(F.sum("total").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("stretch", "start")
    inner = Window.partitionBy("stretch").orderBy("variant_index").rowsBetween(Window.unboundedPreceding, -1)
    return n.join(starts, "stretch").select("variant_index", "n", (F.col("start") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("before"))


def rsid_conflicts(names: DataFrame) -> DataFrame:
    """Keys (key, rsid) with several names."""
    return names.where("rsid <> '' AND rsid <> '.'").groupBy("key").agg(F.countDistinct("rsid").alias("n_names"), F.min("rsid").alias("first_name")).where("n_names > 1")


def first_named(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first rsid of each key, in source order."""
    return rows.where("rsid <> '' AND rsid <> '.'").groupBy(key).agg(F.min_by("rsid", order).alias("rsid"))


def completion_rollup(quality: DataFrame) -> DataFrame:
    """quality: (analysis_index, block_id, pearson_r, n_imputed, n_missing)."""
    return quality.groupBy("analysis_index").agg(F.median("pearson_r").alias("median_r"), F.sum("n_imputed").alias("n_imputed"), F.sum("n_missing").alias("n_missing"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(F.expr(f"cast(width_bucket({value}, {low}D, {high}D, {bins}) as long)").alias("bin")).agg(F.count("*").alias("n"))


def info_dispositions(rows: DataFrame, by: list[str], threshold: float | None) -> DataFrame:
    """Of declared scores (score, status as of stats.imputation_score): what became of each row, long counts.  threshold None: none is dropped."""
    usable = F.col("status").isin("usable", "out_of_range")
    below = F.lit(False) if threshold is None else usable & (F.col("score") < threshold)
    n = lambda c: F.count(F.when(c, 1))
    kinds = [n(F.col("status") == k).alias(k) for k in ("missing", "malformed", "nonfinite", "out_of_range")]
    return rows.groupBy(*by).agg(F.count("*").alias("observed"), n(~below).alias("retained"), n(below).alias("below_threshold"), *kinds, n(usable).alias("usable"))


def region_summary(regions: DataFrame, analyses: DataFrame) -> DataFrame:
    """(kind, n): rows by kind, and analyses with and without a region of their own or a trait position."""
    own = regions.where(F.col("kind").isin("cis", "significant_trans")).select("analysis_index").distinct().withColumn("own", F.lit(True))
    has = F.coalesce("own", F.lit(False)) | (F.col("trait_chr").isNotNull() & F.col("trait_bp").isNotNull())
    per = analyses.join(own, "analysis_index", "left").groupBy(F.when(has, "analyses_with_region").otherwise("analyses_without_region").alias("kind")).agg(F.count("*").alias("n"))
    return regions.groupBy("kind").agg(F.count("*").alias("n")).unionByName(per)


def ranked_pairs(matrix: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The k pairs of largest (or smallest) rho, ties by pair."""
    first = F.asc("rho") if ascending else F.desc("rho")
    return matrix.where("rho IS NOT NULL").orderBy(first, "i", "j").limit(k)


def strongest_partner(matrix: DataFrame) -> DataFrame:
    """(analysis_index, n_pairs, partner, rho): of each analysis the partner of largest |rho|."""
    both = matrix.unionByName(matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "rho", "n_null")).where("rho IS NOT NULL")
    best = F.max_by(F.struct("j", "rho"), F.struct(F.abs("rho"), -F.col("j"))).alias("b")
    return both.groupBy(F.col("i").alias("analysis_index")).agg(F.count("*").alias("n_pairs"), best).select("analysis_index", "n_pairs", F.col("b.j").alias("partner"), F.col("b.rho").alias("rho"))
