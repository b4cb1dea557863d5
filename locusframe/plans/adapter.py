"""The driver's star schema seen as variants, analyses and association rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V

#: Total order of source rows: every column.
ROW_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants as a source names them: variant_index, chromosome, position, ref, alt, rsid."""
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    ref = F.substring(F.lit("ACGT"), (1 + key % 4).cast("int"), F.lit(1))
    snp = F.substring(F.lit("CGTA"), (1 + key % 4).cast("int"), F.lit(1))
    alt = F.when(F.col("p_size") % 5 == 0, F.concat(ref, F.lit("T"))).otherwise(snp)
    return part.select(
        key.alias("variant_index"), (1 + key % 22).cast("string").alias("chromosome"), (10000 * F.col("p_size") + key).alias("position"),
        ref.alias("ref"), alt.alias("alt"),
        F.when(key % 7 == 0, ".").otherwise(F.concat(F.lit("rs"), F.floor(key / 2).cast("string"))).alias("rsid"),
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Told apart by variant_index: from 110,000 parts on, some share their canonical key (alid)."""
    rows = alleles(spark, sf_dir)
    pair = V.allele_pair(F.col("ref"), F.col("alt"))
    return rows.select(
        "variant_index", "chromosome", "position", pair["a1"].alias("effect_allele"), pair["a2"].alias("other_allele"),
        V.alid(F.col("chromosome"), F.col("position"), F.col("ref"), F.col("alt")).alias("alid"), "rsid", V.flipped(F.col("alt"), F.col("ref"), F.col("alt")).alias("flipped"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    # Nations and regions are fixed dimensions of a few rows.
    rows = supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    return rows.select(
        key.alias("analysis_index"), F.col("s_name").alias("analysis_id"), F.col("r_name").alias("assigned_ancestry"), F.col("n_name").alias("reported_population"),
        (1 + key % 22).cast("string").alias("trait_chr"), (10000 * (key % 50)).alias("trait_bp"), (1000 + 10 * key).alias("sample_size"),
    )


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a source gives them, with their order."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_partkey").alias("variant_index"), F.col("l_suppkey").alias("analysis_index"), ((F.col("l_quantity") - 25.5) / 4).alias("z"),
        (0.01 + F.col("l_discount")).alias("se"), (F.col("l_tax") * 10).alias("eaf"), (F.col("l_returnflag") == "A").cast("int").alias("imputed"),
        (F.col("l_extendedprice") / 100000).alias("info"), F.struct(*ROW_ORDER).alias("row_order"),
    )


#: The same in SQL.
SQL = """
part_ AS (SELECT *, substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref,
  CASE WHEN p_size % 5 = 0 THEN substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) || 'T' ELSE substr('CGTA', CAST(1 + p_partkey % 4 AS INT), 1) END AS alt FROM part),
pair_ AS (SELECT *, CASE WHEN length(ref) <> length(alt) THEN ref ELSE least(ref, alt) END AS a1, CASE WHEN length(ref) <> length(alt) THEN alt ELSE greatest(ref, alt) END AS a2 FROM part_),
variants AS (SELECT p_partkey AS variant_index, CAST(1 + p_partkey % 22 AS VARCHAR) AS chromosome, 10000 * p_size + p_partkey AS position, a1 AS effect_allele, a2 AS other_allele,
  CAST(1 + p_partkey % 22 AS VARCHAR) || ':' || CAST(10000 * p_size + p_partkey AS VARCHAR) || ':' || a1 || ':' || a2 AS alid,
  CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE 'rs' || CAST(p_partkey // 2 AS VARCHAR) END AS rsid, alt <> a1 AS flipped FROM pair_),
analyses AS (SELECT s_suppkey AS analysis_index, s_name AS analysis_id, r_name AS assigned_ancestry, n_name AS reported_population,
  CAST(1 + s_suppkey % 22 AS VARCHAR) AS trait_chr, 10000 * (s_suppkey % 50) AS trait_bp, 1000 + 10 * s_suppkey AS sample_size
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
source_rows AS (SELECT l_partkey AS variant_index, l_suppkey AS analysis_index, (l_quantity - 25.5) / 4 AS z, 0.01 + l_discount AS se, l_tax * 10 AS eaf,
  CAST(l_returnflag = 'A' AS INT) AS imputed, l_extendedprice / 100000 AS info,
  struct_pack(a := l_orderkey, b := l_linenumber, c := l_quantity, d := l_extendedprice, e := l_discount, f := l_tax, g := l_returnflag, h := l_linestatus, i := l_shipdate) AS row_order FROM lineitem)
"""
