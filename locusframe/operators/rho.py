"""Correlation of null z-scores between analyses."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statistics(rows: DataFrame, cut: float) -> DataFrame:
    """(i, j, s_ii, s_ij, s_jj, n_null): sums over variants at which both |z| are below the cut, i < j.

    The pairs of a variant are bounded by the analyses squared, and are added up before the
    shuffle; the sums have one row for each pair of analyses.
    """
    nulls = rows.where(F.abs("z") < cut).select("variant_index", "analysis_index", "z")
    x = nulls.select("variant_index", F.col("analysis_index").alias("i"), F.col("z").alias("zi"))
    y = nulls.select("variant_index", F.col("analysis_index").alias("j"), F.col("z").alias("zj"))
    pairs = x.join(y, "variant_index").where("i < j")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("zi") * F.col("zi")).alias("s_ii"), F.sum(F.col("zi") * F.col("zj")).alias("s_ij"), F.sum(F.col("zj") * F.col("zj")).alias("s_jj"), F.count("*").alias("n_null"))


def square_mass(rho: float, cut: float, nodes: int = 64) -> float:
    """P(|X| < cut, |Y| < cut) of a standard bivariate normal, by Gauss-Legendre over X."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    x, w = x * cut, w * cut
    s = math.sqrt(max(1e-12, 1 - rho * rho))
    phi = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    upper, lower = (cut - rho * x) / s, (-cut - rho * x) / s
    cdf = np.vectorize(lambda t: 0.5 * math.erfc(-t / math.sqrt(2)))
    return float((w * phi * (cdf(upper) - cdf(lower))).sum())


def likelihood_grid(cut: float, n: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(rho, log of the truncated mass)."""
    grid = np.linspace(-0.999, 0.999, n)
    coarse = np.linspace(-0.999, 0.999, 201)
    return grid, np.interp(grid, coarse, np.log([square_mass(r, cut) for r in coarse]))


def estimated(pairs: DataFrame, cut: float, least: int = 500) -> DataFrame:
    """pairs with rho, the maximum of the truncated bivariate normal likelihood; null below ``least`` shared nulls."""
    grid, mass = likelihood_grid(cut)

    @F.pandas_udf("double")
    def best(a: pd.Series, b: pd.Series, c: pd.Series, n: pd.Series) -> pd.Series:
        one = 1 - grid * grid
        out = np.full(len(n), np.nan)
        enough = np.flatnonzero((n >= least).to_numpy())
        for at in range(0, len(enough), 500):
            k = enough[at : at + 500]
            ak, bk, ck, nk = (x.to_numpy(float)[k][:, None] for x in (a, b, c, n))
            loss = nk * (0.5 * np.log(one) + mass) + (ak - 2 * grid * bk + ck) / (2 * one)
            i = np.clip(loss.argmin(1), 1, len(grid) - 2)
            l, m, r = (loss[np.arange(len(k)), i + d] for d in (-1, 0, 1))
            # The vertex of the parabola through the least three.
            inner = (m <= l) & (m <= r) & (l - 2 * m + r > 0)
            step = np.where(inner, 0.5 * (l - r) / np.where(inner, l - 2 * m + r, 1), np.sign(l - r))
            out[k] = grid[i] + step * (grid[1] - grid[0])
        return pd.Series(out)

    rho = F.when(F.col("n_null") >= least, best("s_ii", "s_ij", "s_jj", "n_null"))
    return pairs.select("i", "j", rho.cast("float").alias("rho"), "n_null")


def row(matrix: DataFrame, analysis_index: int) -> DataFrame:
    """One analysis against all others."""
    mine = matrix.where((F.col("i") == analysis_index) | (F.col("j") == analysis_index))
    return mine.select(F.when(F.col("i") == analysis_index, F.col("j")).otherwise(F.col("i")).alias("other"), "rho", "n_null")


def pairs_of(matrix: DataFrame, wanted: DataFrame) -> DataFrame:
    """Unordered pairs of a request (ordinal, analysis_index), in its order; an analysis and itself is no pair."""
    a, b = (wanted.select(F.col("ordinal").alias(f"o{x}"), F.col("analysis_index").alias(x)) for x in "ab")
    both = matrix.unionByName(matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "rho", "n_null"))
    # The matrix is met from either end, so the request is never joined with itself.
    keyed = both.join(a, both.i == a.a).join(b, both.j == b.b).where("oa < ob")
    return keyed.orderBy("oa", "ob").select("a", "b", "rho", "n_null")


def symmetric(matrix: DataFrame, analyses: DataFrame) -> DataFrame:
    """Both halves and the diagonal (1, no nulls)."""
    swapped = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "rho", "n_null")
    diagonal = analyses.select(F.col("analysis_index").alias("i"), F.col("analysis_index").alias("j"), F.lit(1.0).cast("float").alias("rho"), F.lit(0).cast("long").alias("n_null"))
    return matrix.unionByName(swapped).unionByName(diagonal)
