"""Ancestry: mixtures of reference frequencies, gates, routing and coverage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gates:
    """Thresholds of an assignment, tested in this order: overlap, orientation, residual, proportion, margin."""

    least_overlap: int = 5000
    flip_r: float = -0.5
    most_residual: float = 0.06
    least_proportion: float = 0.50
    least_margin: float = 0.20
    sum_weight: float = 10.0


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    for _ in range(10 * n):
        slope = target - gram @ x
        slope[free] = -np.inf
        if free.all() or slope.max() <= 1e-10 * max(1.0, np.abs(target).max()):
            break
        free[slope.argmax()] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], target[free], rcond=None)[0]
            if trial[free].min() > 0:
                x = trial
                break
            down = free & (trial <= 0)
            step = (x[down] / (x[down] - trial[down])).min()
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def mixture(f: np.ndarray, panel: np.ndarray, weight: float = 10.0) -> tuple[np.ndarray, float]:
    """(proportions of the panel's columns, root mean squared residual): least squares with a soft row that makes them sum to one."""
    raw = nnls(np.vstack([panel, np.full(panel.shape[1], weight)]), np.r_[f, weight])
    share = raw / raw.sum() if raw.sum() > 0 else raw
    return share, float(np.sqrt(np.mean((panel @ share - f) ** 2))) if len(f) else float("nan")


def assigned(rows: DataFrame, panel: DataFrame, groups: dict[str, str], gates: Gates = Gates()) -> DataFrame:
    """rows: (analysis_index, variant_index, eaf); panel: (variant_index and a frequency column for each fine group); groups: fine group to super-population.

    The fit needs sums over variants only: Gram matrix and products are aggregated in Spark, so
    an analysis of any size is one row when it is solved.
    """
    names = list(groups)
    both = rows.where("eaf IS NOT NULL").join(panel, "variant_index").where(" AND ".join(f"`{g}` IS NOT NULL" for g in names))
    g = [F.col(f"`{x}`") for x in names]
    sums = {f"g{i}_{j}": F.sum(g[i] * g[j]) for i in range(len(g)) for j in range(i, len(g))}
    sums |= {f"b{i}": F.sum(g[i] * F.col("eaf")) for i in range(len(g))}
    mean_panel = sum(g[1:], g[0]) / len(g)
    per = both.groupBy("analysis_index").agg(*[v.alias(k) for k, v in sums.items()], F.sum(F.col("eaf") * F.col("eaf")).alias("ff"), F.count("*").alias("overlap"), F.corr("eaf", mean_panel).alias("orientation_r"))

    def solve(frames):
        for part in frames:
            out = []
            for r in part.itertuples(index=False):
                k, w = len(names), gates.sum_weight
                gram = np.array([[getattr(r, f"g{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)])
                b = np.array([getattr(r, f"b{i}") for i in range(k)])
                # A square root of the Gram matrix stands for the rows; the soft sum row is one more.
                values, vectors = np.linalg.eigh(gram)
                root = (vectors * np.sqrt(np.maximum(values, 0))).T
                goal = np.linalg.lstsq(root.T, b, rcond=None)[0]
                raw = nnls(np.vstack([root, np.full(k, w)]), np.r_[goal, w])
                share = raw / raw.sum() if raw.sum() > 0 else raw
                residual = float(np.sqrt(max(0.0, share @ gram @ share - 2 * share @ b + r.ff) / r.overlap))
                supers: dict[str, float] = {}
                for name, s in zip(names, share):
                    supers[groups[name]] = supers.get(groups[name], 0.0) + float(s)
                order = sorted(supers.items(), key=lambda x: (-x[1], x[0]))
                out.append((r.analysis_index, order[0][0], order[0][1], order[0][1] - (order[1][1] if len(order) > 1 else 0.0), residual, r.overlap, r.orientation_r))
            yield pd.DataFrame(out, columns=["analysis_index", "dominant", "proportion", "margin", "residual", "overlap", "orientation_r"])

    fitted = per.mapInPandas(solve, "analysis_index long, dominant string, proportion double, margin double, residual double, overlap long, orientation_r double")
    reason = gate_reason(gates)
    return fitted.withColumn("gate", reason).withColumn("assigned_ancestry", F.when(reason == "ok", F.col("dominant")).otherwise("unassigned"))


def gate_reason(gates: Gates) -> Column:
    """The first gate that a fit fails, or ok."""
    return (
        F.when(F.col("overlap") < gates.least_overlap, "overlap")
        .when(F.col("orientation_r") <= gates.flip_r, "orientation")
        .when(F.col("residual").isNull() | F.isnan("residual") | (F.col("residual") > gates.most_residual), "residual")
        .when(F.col("proportion") < gates.least_proportion, "proportion")
        .when(F.col("margin") < gates.least_margin, "margin")
        .otherwise("ok")
    )


def coverage(rows: DataFrame, variants: DataFrame, least_variants: int = 500_000, least_autosomes: int = 22, most_share: float = 0.2) -> DataFrame:
    """Variants, autosomes and the largest contig's share of each analysis, and whether these make it eligible."""
    contigs = rows.join(variants.select("variant_index", "chromosome"), "variant_index").where(F.col("chromosome").rlike("^[0-9]+$"))
    per = contigs.groupBy("analysis_index", "chromosome").agg(F.count("*").alias("n"))
    got = per.groupBy("analysis_index").agg(F.sum("n").alias("total_variants"), F.count("*").alias("n_autosomes"), (F.max("n") / F.sum("n")).alias("frac_largest"))
    return got.withColumn("eligible", (F.col("total_variants") >= least_variants) & (F.col("n_autosomes") >= least_autosomes) & (F.col("frac_largest") <= most_share))


def disagreements(rows: DataFrame) -> DataFrame:
    """Analyses whose reported super-population is not the assigned one."""
    return rows.where("reported_superpop IS NOT NULL AND assigned_ancestry <> 'unassigned' AND reported_superpop <> assigned_ancestry")


def to_impute(analyses: DataFrame, ancestry: str) -> DataFrame:
    """Analyses of this ancestry; all if none has one; if some have, but none this one, it raises."""
    known = analyses.where("assigned_ancestry IS NOT NULL AND assigned_ancestry <> ''")
    if known.isEmpty():
        return analyses
    match = known.where(F.upper("assigned_ancestry") == ancestry.upper())
    if match.isEmpty():
        raise ValueError(f"no analysis is of ancestry {ancestry}")
    return match


def routing(rows: DataFrame, least_variants: int = 500_000, least_autosomes: int = 22, most_share: float = 0.2) -> DataFrame:
    """rows (assigned_ancestry, reported_population and those of coverage) with the ancestry to use, where it is from, and eligibility."""
    from ..functions.stats import super_population

    known = F.col("assigned_ancestry").isNotNull() & ~F.col("assigned_ancestry").isin("", "Unassigned")
    reported = super_population(F.col("reported_population"))
    spread = (F.col("n_autosomes") >= least_autosomes) & (F.col("frac_largest") <= most_share)
    low = ~((F.col("total_variants") >= least_variants) & spread)
    own = rows.withColumn("routing_ancestry", F.coalesce(F.when(known, F.col("assigned_ancestry")), reported, F.lit("")))
    source = F.when(known, "af-assigned").when(F.col("routing_ancestry") != "", "reported-fallback").otherwise("")
    return own.withColumn("routing_source", source).withColumn("genome_distributed", spread).withColumn("low_coverage", low).withColumn("store_eligible", (F.col("routing_ancestry") != "") & ~low)


def subset_catalogue(catalogue: DataFrame, ancestry: str, stored_effect_scale: str, original_sd_method: str, original_sd: float | None = None) -> DataFrame:
    """Catalogue rows assigned to exactly this ancestry, stamped with what a build manifest needs."""
    if "assigned_ancestry" not in catalogue.columns:
        raise ValueError("the catalogue lacks assigned_ancestry")
    rows = catalogue.where(F.col("assigned_ancestry") == ancestry)
    own = F.nullif(F.col("ancestry_assignment_method"), F.lit("")) if "ancestry_assignment_method" in catalogue.columns else F.lit(None).cast("string")
    stamped = {"ancestry_assignment_method": F.coalesce(own, F.lit("af_assigned")), "stored_effect_scale": F.lit(stored_effect_scale), "original_sd_method": F.lit(original_sd_method)}
    return rows.withColumns(stamped | {"original_sd": F.lit("" if original_sd is None else str(original_sd))})
