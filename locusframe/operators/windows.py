"""Operators over ordered neighbours."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window


def capped_z(rows: DataFrame, within: int = 1_000_000, by: tuple[str, ...] = ("analysis_index", "block_id")) -> DataFrame:
    """Imputed |z| is at most the largest observed one within this distance, both ends inclusive; without any, z stays."""
    near = Window.partitionBy(*by).orderBy("position").rangeBetween(-within, within)
    most = F.max(F.when(F.col("status") == "observed", F.abs("z"))).over(near)
    capped = F.when((F.col("status") == "imputed") & (F.abs("z") > most), F.signum("z") * most).otherwise(F.col("z"))
    return rows.withColumn("z", capped)


def thinned(variants: DataFrame, window: int = 15_000) -> DataFrame:
    """The first variant, in axis order, of each window of each contig; by aggregation, without a sort."""
    first = F.min_by(F.struct(*[c for c in variants.columns if c != "chromosome"]), "variant_index").alias("v")
    return variants.groupBy("chromosome", F.floor(F.col("position") / window).alias("w")).agg(first).select("chromosome", "v.*")


@F.pandas_udf(BinaryType())
def site_hash(key: pd.Series) -> pd.Series:
    """Eight bytes that compare like the unsigned hash they hold."""
    return key.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).digest())


def bottom_k(rows: DataFrame, by: str, key: str, k: int, order: str, hashed: Column | None = None) -> DataFrame:
    """k rows of each group with the smallest hash of ``key`` (site_hash unless given), and whether there were more; ties by source order.

    The group limit is applied before the shuffle too, so a large group sends k rows a task.
    """
    own = rows.withColumn("_h", site_hash(key) if hashed is None else hashed)
    kept = own.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_h", order))).where(F.col("_n") <= k)
    offered = rows.groupBy(by).agg(F.count("*").alias("offered"))
    return kept.drop("_h", "_n").join(offered, by).withColumn("sampled", F.col("offered") > k)


def order_breaks(rows: DataFrame, by: str, order: str, value: str, strict: bool = True) -> DataFrame:
    """Rows whose value is not above (strict) or is below the one before."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_before", before).where((F.col(value) <= F.col("_before")) if strict else (F.col(value) < F.col("_before"))).drop("_before")


def fills(source: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fills, dropped): proposals (variant_index, analysis_index, z, se) land where the source has nothing; several agree or are all dropped."""
    keys = ["variant_index", "analysis_index"]
    free = proposed.join(source.select(*keys), keys, "left_anti")
    pair = F.struct("z", "se")
    places = free.groupBy(*keys).agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"), F.count("*").alias("n"))
    agree = F.col("lo").eqNullSafe(F.col("hi"))
    return places.where(agree).select(*keys, "lo.z", "lo.se"), places.where(~agree).select(*keys, "n")


def by_first_mention(rows: DataFrame, request: DataFrame, key: str) -> DataFrame:
    """Rows in the order in which the request (ordinal, key) first names their key."""
    first = request.groupBy(key).agg(F.min("ordinal").alias("_first"))
    return rows.join(first, key).orderBy("_first", "variant_index").drop("_first")
