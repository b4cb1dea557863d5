"""Imputation of missing cells from LD blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    variance: float = 0.9
    least_r: float = 0.7
    l1_ratio: float = 0.5
    folds: int = 5
    degree: int = 3


def components(ld: np.ndarray, variance: float) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvectors and values that explain this share of the variance."""
    values, vectors = np.linalg.eigh(ld)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), variance)) + 1
    return vectors[:, :k], values[:k]


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1_ratio: float, start: np.ndarray | None = None, rounds: int = 1000) -> np.ndarray:
    """Coordinate descent, no intercept, loss |y - xw|^2 / 2n."""
    n = len(y)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    scale = (x * x).sum(0) / n
    left = y - x @ w
    for _ in range(rounds):
        largest = 0.0
        for j in range(x.shape[1]):
            if scale[j] == 0:
                continue
            pull = x[:, j] @ left / n + scale[j] * w[j]
            new = np.sign(pull) * max(0.0, abs(pull) - alpha * l1_ratio) / (scale[j] + alpha * (1 - l1_ratio))
            if new != w[j]:
                left -= x[:, j] * (new - w[j])
                largest = max(largest, abs(new - w[j]))
                w[j] = new
        if largest <= 1e-6 * max(1e-12, np.abs(w).max()):
            break
    return w


def cross_validated(x: np.ndarray, y: np.ndarray, options: Options, n_alphas: int = 50) -> np.ndarray:
    """The weights at the penalty of least cross-validated error; folds are stretches of rows."""
    most = np.abs(x.T @ y).max() / (len(y) * options.l1_ratio)
    if most == 0:
        return np.zeros(x.shape[1])
    alphas = np.geomspace(most, most * 1e-3, n_alphas)
    folds = np.array_split(np.arange(len(y)), min(options.folds, len(y)))
    error = np.zeros(n_alphas)
    for fold in folds:
        keep = np.setdiff1d(np.arange(len(y)), fold)
        w = None
        for i, a in enumerate(alphas):
            w = elastic_net(x[keep], y[keep], a, options.l1_ratio, w)
            error[i] += ((y[fold] - x[fold] @ w) ** 2).sum()
    return elastic_net(x, y, alphas[error.argmin()], options.l1_ratio)


def ratio_outliers(truth: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """True for points to keep: within three standard deviations of the median ratio, in two passes."""
    keep = (predicted != 0) & np.isfinite(truth)
    ratio = np.where(keep, truth / np.where(predicted == 0, 1, predicted), np.nan)
    for _ in range(2):
        if keep.sum() < 2 or not (sd := np.std(ratio[keep])) > 0:
            break
        keep &= np.abs(ratio - np.median(ratio[keep])) <= 3 * sd
    return keep


def block_z(z: np.ndarray, vectors: np.ndarray, options: Options = Options()) -> tuple[np.ndarray | None, float]:
    """(z for all of a block's variants, correlation with the observed ones); None if the fit is refused."""
    seen = np.isfinite(z)
    if seen.sum() < max(2, options.degree + 1) or np.ptp(z[seen]) == 0:
        return None, float("nan")
    fitted = vectors @ cross_validated(vectors[seen], z[seen], options)
    keep = ratio_outliers(z[seen], fitted[seen])
    if keep.sum() < options.degree + 1 or np.ptp(fitted[seen][keep]) == 0:
        return None, float("nan")
    scaled = np.polyval(np.polyfit(fitted[seen][keep], z[seen][keep], options.degree), fitted)
    # The correlation is that of the points the scale was fitted on, before they are clamped.
    own, truth = scaled[seen][keep], z[seen][keep]
    r = float(np.corrcoef(own, truth)[0, 1]) if np.ptp(own) > 0 and np.ptp(truth) > 0 else float("nan")
    most = np.abs(z[seen]).max()
    return (np.clip(scaled, -most, most), r) if r >= options.least_r else (None, r)


def scalar_n_se(se: np.ndarray, eaf: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Standard errors at reference frequencies, from the median of se * sqrt(2f(1-f)) among the observed."""
    good = np.isfinite(se) & (eaf > 0) & (eaf < 1)
    constant = np.median(se[good] * np.sqrt(2 * eaf[good] * (1 - eaf[good]))) if good.any() else np.nan
    return constant / np.sqrt(2 * reference * (1 - reference))


def completed(rows: DataFrame, panel: DataFrame, eigenvectors: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(fills, quality) of each block and analysis.

    rows: (analysis_index, variant_index, z, se, eaf); panel: (block_id, variant_index, place,
    reference_eaf); eigenvectors: (block_id, vectors array<array<double>>, a row for each place).
    An analysis and block is a group of the block's size; its eigenvectors come by a join on
    the block, once for each group.
    """
    grid = rows.join(panel.select("block_id", "variant_index"), "variant_index").select("analysis_index", "block_id").distinct()
    cells = grid.join(panel, "block_id").join(rows.select("analysis_index", "variant_index", "z", "se", "eaf"), ["analysis_index", "variant_index"], "left")
    lists = cells.groupBy("analysis_index", "block_id").agg(F.array_sort(F.collect_list(F.struct("place", "variant_index", "z", "se", "eaf", "reference_eaf"))).alias("cells"))

    def impute(frames):
        for part in frames:
            out = []
            for r in part.itertuples(index=False):
                cells_ = pd.DataFrame(list(r.cells))
                z = cells_["z"].to_numpy(float)
                got, corr = block_z(z, np.array([np.asarray(v, float) for v in r.vectors])[cells_["place"].to_numpy(int)], options)
                open_ = ~np.isfinite(z)
                se = scalar_n_se(cells_["se"].to_numpy(float), cells_["eaf"].to_numpy(float), cells_["reference_eaf"].to_numpy(float))
                if got is None:
                    out.append((r.analysis_index, r.block_id, corr, None, None, None, int(open_.sum())))
                    continue
                fill = open_ & np.isfinite(se) & (se > 0)
                rest = int((open_ & ~fill).sum())
                out += [(r.analysis_index, r.block_id, corr, int(v), float(a), float(b), rest) for v, a, b in zip(cells_["variant_index"][fill], got[fill], se[fill])]
                if not fill.any():
                    out.append((r.analysis_index, r.block_id, corr, None, None, None, rest))
            frame = pd.DataFrame(out, columns=["analysis_index", "block_id", "pearson_r", "variant_index", "z", "se", "n_missing"])
            frame["variant_index"] = pd.array([None if pd.isna(v) else int(v) for v in frame["variant_index"]], "Int64")
            yield frame

    got = lists.join(eigenvectors, "block_id").mapInPandas(impute, "analysis_index long, block_id string, pearson_r double, variant_index long, z double, se double, n_missing long")
    fills = got.where("variant_index IS NOT NULL").select("analysis_index", "variant_index", "block_id", "z", "se")
    quality = got.groupBy("analysis_index", "block_id").agg(F.first("pearson_r").alias("pearson_r"), F.count("variant_index").alias("n_imputed"), F.max("n_missing").alias("n_missing"))
    return fills, quality


def regions(analyses: DataFrame, table: DataFrame | None, cis_window: int, kinds: tuple[str, ...] = ("cis", "significant_trans")) -> DataFrame:
    """(analysis_index, chromosome, start, end): table rows of these kinds, and a window about the trait position where there is no cis row."""
    default = analyses.where("trait_chr IS NOT NULL AND trait_bp IS NOT NULL").select(
        "analysis_index", F.col("trait_chr").alias("chromosome"), F.greatest(F.col("trait_bp") - cis_window, F.lit(1)).alias("start"), (F.col("trait_bp") + cis_window).alias("end")
    )
    if table is None:
        return default
    own = table.where(F.col("kind").isin(*kinds))
    return own.select(*default.columns).unionByName(default.join(own.where("kind = 'cis'").select("analysis_index"), "analysis_index", "left_anti"))


def with_reference_eaf(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """The panel's frequency on imputed cells only."""
    joined = rows.join(panel.select("variant_index", "reference_eaf"), "variant_index", "left")
    return joined.withColumn("eaf", F.when(F.col("status") == "imputed", F.col("reference_eaf")).otherwise(F.col("eaf"))).drop("reference_eaf")
