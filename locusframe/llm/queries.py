"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, jaccard, licenses, likelihood, packing, repeats, toxicity, urls, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": lambda spark, d: decontamination.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_license_scan": lambda spark, d: licenses.query(table(spark, d, "documents")),
    "op3_warc": warc.query,
    "op4_url_filter": lambda spark, d: urls.query(table(spark, d, "pages")),
    "op5_repeats": lambda spark, d: repeats.query(table(spark, d, "documents")),
    "op6_fingerprints": lambda spark, d: fingerprints.query(table(spark, d, "documents")),
    "op7_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_jaccard_join": lambda spark, d: jaccard.query(table(spark, d, "documents")),
    "op9_likelihood": lambda spark, d: likelihood.query(table(spark, d, "documents")),
    "op10_packing": lambda spark, d: packing.query(table(spark, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination.SQL,
    "op2_license_scan": licenses.SQL,
    "op3_warc": warc.SQL,
    "op4_url_filter": urls.SQL,
}
