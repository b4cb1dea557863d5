"""Readers by the capability that a manifest names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import besd, column_map, tabular, vcf

READERS: dict[str, Callable[..., DataFrame]] = {
    "gwas-ssf": tabular.gwas_ssf,
    "finngen": tabular.finngen,
    "association-tsv": tabular.association_tsv,
    "gwas-vcf": vcf.gwas_vcf,
    "besd": besd.besd,
    "column-map": column_map.read,
}


def register(capability: str, reader: Callable[..., DataFrame]) -> None:
    if capability in READERS:
        raise ValueError(f"{capability} is taken")
    READERS[capability] = reader


def read(spark: SparkSession, capability: str, path: str, **options) -> DataFrame:
    """Options that a reader does not have are refused by its signature."""
    if capability not in READERS:
        raise KeyError(f"no reader for {capability}; there are {', '.join(sorted(READERS))}")
    return READERS[capability](spark, path, **options)


REQUIRED = ["trait_id", "file_path", "trait_name", "n", "stored_effect_scale", "original_sd_method", "original_sd"]
SCALES = ("sd", "native", "log_odds")
STANDARD_METHODS = ("declared_standardised", "reported", "af_based", "effect_based")


def manifest(spark: SparkSession, path: str, default_capability: str = "gwas-vcf") -> DataFrame:
    """A build manifest, checked: columns, scales, and that a standardised scale says how."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    if lacking := [c for c in REQUIRED if c not in rows.columns]:
        raise tabular.HeaderError(f"the manifest lacks {', '.join(lacking)}")
    if "source_reader_capability" not in rows.columns:
        rows = rows.withColumn("source_reader_capability", F.lit(default_capability))
    method = F.coalesce(F.nullif(F.trim("original_sd_method"), F.lit("")), F.lit("none"))
    sd = F.col("original_sd").try_cast("double")
    fault = (
        F.when(~F.col("stored_effect_scale").isin(*SCALES), "unknown stored_effect_scale")
        .when((F.col("stored_effect_scale") == "sd") & ~method.isin(*STANDARD_METHODS), "scale sd without a method")
        .when((method == "none") & sd.isNotNull(), "original_sd without a method")
        .when(F.col("n").isNotNull() & F.col("n").try_cast("double").isNull(), "n is no number")
    )
    judged = rows.withColumn("se_divisor", F.when((method == "none") & sd.isNull(), 1.0).otherwise(F.coalesce(sd, F.lit(1.0)))).withColumn("fault", fault)
    if bad := judged.where("fault IS NOT NULL").select("trait_id", "fault").first():
        raise tabular.HeaderError(f"{bad.trait_id}: {bad.fault}")
    return judged.drop("fault")


def read_manifest_sources(spark: SparkSession, rows: DataFrame, **options) -> DataFrame:
    """All sources of a manifest with analysis_id and se over the divisor; a plan for each capability, files read in parallel.

    A manifest is a driver-side list of files, as any list of paths given to a reader.
    """
    out = None
    for r in rows.select("trait_id", "file_path", "source_reader_capability", "se_divisor").collect():
        got = read(spark, r.source_reader_capability, r.file_path, **options).withColumn("analysis_id", F.lit(r.trait_id)).withColumn("se", (F.col("se").cast("float") / F.lit(r.se_divisor).cast("float")).cast("double"))
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    if out is None:
        raise ValueError("the manifest is empty")
    return out
