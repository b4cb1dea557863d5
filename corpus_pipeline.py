"""The corpus pipeline: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import decontamination, jaccard, packing, repeats, toxicity
from locusframe.llm.common import cut, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))),
    ("n-gram Jaccard join", lambda spark, docs, sf_dir: jaccard.one_of_each(docs)),
    ("suffix-array dedup", lambda spark, docs, sf_dir: repeats.without_repeats(docs)),
    ("benchmark decontamination", lambda spark, docs, sf_dir: decontamination.remove(docs, table(spark, sf_dir, "benchmark"))),
    ("packing", lambda spark, docs, sf_dir: packing.query(docs)),
]

#: Tokenization, string kernels and suffix order are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
