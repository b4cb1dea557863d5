"""Releases of the driver's star schema, built once for each folder and layout, for queries that read a release."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission
from . import adapter, builders
from .store import Store

_BUILT: dict[tuple[str, str, str], Store] = {}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows as builders.build takes them, with the numbers of parts and suppliers; alt is the effect allele, as in the adapter."""
    names = adapter.alleles(spark, sf_dir).withColumn("position", F.col("position").cast("int"))
    ids = adapter.analyses(spark, sf_dir).select("analysis_index", "analysis_id")
    rows = admission.spread(adapter.source_rows(spark, sf_dir).join(ids, "analysis_index"), ["variant_index"]).join(names, "variant_index")
    return rows.select(
        "analysis_id", "analysis_index", F.col("variant_index").alias("site"), F.lit("lineitem").alias("source"), F.col("row_order").alias("row"), "chromosome", "position", "ref", "alt", "rsid", "z", "se", "eaf",
    )


def store(spark: SparkSession, sf_dir: str, layout: str) -> Store:
    """The release, in the folder of spark.checkpoint.dir (or the warehouse, where that is not set)."""
    key = (spark.sparkContext.applicationId, sf_dir, layout)
    if key not in _BUILT:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        panel = adapter.variants(spark, sf_dir).where("variant_index % 2 = 0").select("alid", F.col("variant_index").alias("site"))
        path = f"{root.rstrip('/')}/releases/{layout}-{uuid.uuid4().hex}"
        analyses = adapter.analyses(spark, sf_dir)
        _BUILT[key] = builders.build(sources(spark, sf_dir), analyses, path, layout, panel=panel if layout == "hybrid" else None, release_id="star")
    return _BUILT[key]
