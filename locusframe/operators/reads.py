"""Reads of associations: identifiers, regions, lookups, top hits, for each layout.

A request (identifiers, analysis ids) is a small driver-side list and becomes a broadcast
table; associations are filtered by the keys it resolves to, and never shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import variants as V

#: Requests beyond this many rows are joined without a broadcast.
REQUEST_ROWS = 100_000


def request(like: DataFrame, values: list[str], name: str) -> DataFrame:
    """(ordinal, name)."""
    return like.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"ordinal int, {name} string")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= REQUEST_ROWS else df


def resolved(variants: DataFrame, identifiers: list[str], every: bool) -> DataFrame:
    """(ordinal, variant_index) of canonical keys and rsids.  every: an rsid stands for all its variants, else for the lowest."""
    wanted = small(request(variants, identifiers, "identifier"), len(identifiers))
    names = variants.select("variant_index", F.col("alid").alias("name")).union(
        variants.where((F.col("rsid") != ".") & (F.octet_length("rsid") <= 24)).select("variant_index", "rsid")
    )
    hits = names.join(wanted, names.name == wanted.identifier).select("ordinal", "variant_index")
    return hits.distinct() if every else hits.groupBy("ordinal").agg(F.min("variant_index").alias("variant_index"))


def in_range(variants: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Variants at contig:[start, end], both inclusive; the contig is normalised."""
    return variants.where((F.col("chromosome") == V.chromosome(F.lit(contig))) & F.col("position").between(max(1, start), end))


def observed_only(rows: DataFrame, wanted: bool) -> DataFrame:
    """Without imputed rows; missing ones stay."""
    return rows.where("status <> 'imputed'") if wanted else rows


def of_variants(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows of the variants, as a semi join; adaptive execution broadcasts the variants if they are few."""
    return rows.join(variants.select("variant_index"), "variant_index", "left_semi")


def of_analyses(rows: DataFrame, analyses: DataFrame) -> DataFrame:
    return rows.join(analyses.select("analysis_index"), "analysis_index", "left_semi")


def of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows at (variant_index, analysis_index) pairs."""
    return rows.join(pairs.select("variant_index", "analysis_index").distinct(), ["variant_index", "analysis_index"], "left_semi")


def missing_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.join(rows, ["variant_index", "analysis_index"], "left_anti")


def lookup(rows: DataFrame, variants: DataFrame, analyses: DataFrame, identifiers: list[str], analysis_ids: list[str], every: bool = True) -> DataFrame:
    """Variant set by analysis set, in the order of the request, analysis first.

    every (dense): an rsid stands for all its variants and repeated requests repeat rows; else
    (ragged) for the lowest, and variants are distinct and sorted.
    """
    v = resolved(variants, identifiers, every).withColumnRenamed("ordinal", "v_ordinal")
    if not every:
        v = v.select("variant_index").distinct().withColumn("v_ordinal", F.col("variant_index").cast("int"))
    a = small(request(analyses, analysis_ids, "analysis_id"), len(analysis_ids)).withColumnRenamed("ordinal", "a_ordinal")
    a = analyses.join(a, "analysis_id").select("analysis_index", "a_ordinal")
    return rows.join(small(v, len(identifiers)), "variant_index").join(small(a, len(analysis_ids)), "analysis_index")


def ordered_lookup(found: DataFrame) -> DataFrame:
    return found.orderBy("a_ordinal", "v_ordinal", "variant_index").drop("a_ordinal", "v_ordinal")


def significant(threshold: float) -> Column:
    """|z| at or beyond the threshold's cut, as two comparisons that reach the Parquet scan."""
    cut = S.z_critical(threshold)
    return (F.col("z") >= cut) | (F.col("z") <= -cut)


def top_hits(rows: DataFrame, threshold: float = 5e-8, analysis_index: int | None = None, limit: int | None = None, only_observed: bool = False) -> DataFrame:
    """By (analysis_index, variant_index); observed_only, then the limit."""
    hits = rows.where(significant(threshold))
    if analysis_index is not None:
        hits = hits.where(F.col("analysis_index") == analysis_index)
    hits = observed_only(hits, only_observed).orderBy("analysis_index", "variant_index")
    return hits if limit is None else hits.limit(limit)


def with_identity(rows: DataFrame, variants: DataFrame, analyses: DataFrame, with_rsid: bool = False) -> DataFrame:
    """Rows with what their keys stand for; rsids only if asked for."""
    wanted = ["variant_index", "chromosome", "position", "alid", "effect_allele", "other_allele", *(["rsid"] if with_rsid else [])]
    return rows.join(variants.select(*wanted), "variant_index").join(analyses.select("analysis_index", "analysis_id"), "analysis_index")


def hybrid(dense: DataFrame, to_shared: DataFrame, overflow: DataFrame) -> DataFrame:
    """Dense rows under shared variant numbers, then overflow rows; the two have no variant in common."""
    moved = dense.join(to_shared, dense.variant_index == to_shared.dense_index).drop("variant_index", "dense_index").withColumnRenamed("shared_index", "variant_index")
    return moved.withColumn("component", F.lit("dense")).unionByName(overflow.withColumn("component", F.lit("overflow")))


def on_panel(variants: DataFrame, to_shared: DataFrame) -> DataFrame:
    shared = to_shared.select(F.col("shared_index").alias("variant_index"), F.lit(True).alias("on_panel"))
    return variants.join(shared, "variant_index", "left").withColumn("on_panel", F.coalesce("on_panel", F.lit(False)))


def in_genomic_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("analysis_index", "variant_index")


def taken(rows: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """Rows at the given places, as often and in the order (ordinal) in which these are named."""
    return rows.join(places.select(place, "ordinal"), place).orderBy("ordinal").drop("ordinal")


def cells(rows: DataFrame, analyses: DataFrame | None = None, variants: DataFrame | None = None, pairs: DataFrame | None = None, every_pair: bool = False) -> DataFrame:
    """A region: of analyses, of variants, of both crossed, or of pairs.  every_pair: reading a pair that has no row raises."""
    if pairs is not None:
        wanted = pairs.select("variant_index", "analysis_index").distinct()
        if not every_pair:
            return of_pairs(rows, wanted)
        own = rows.withColumn("_there", F.lit(True))
        got = wanted.join(own, ["variant_index", "analysis_index"], "left")
        what = F.concat_ws(" ", F.lit("no association"), F.col("variant_index").cast("string"), F.col("analysis_index").cast("string"))
        return got.where(F.when(F.col("_there"), True).otherwise(F.raise_error(what).cast("boolean"))).drop("_there")
    if variants is not None:
        rows = of_variants(rows, variants)
    return rows if analyses is None else of_analyses(rows, analyses)


def windows(rows: DataFrame, stretch: int) -> DataFrame:
    """Rows with the number of the stretch of variants they are in; a stretch is read by its own predicate, in bounded memory."""
    return rows.withColumn("window", F.floor(F.col("variant_index") / stretch))


def aliases(variants: DataFrame) -> DataFrame:
    """(alias, variant_index): every name but the canonical key by which a variant is reached."""
    return variants.where((F.col("rsid") != ".") & (F.octet_length("rsid") <= 24)).select(F.col("rsid").alias("alias"), "variant_index")


def overflow_lookup(overflow: DataFrame, variants: DataFrame, on_panel_variants: DataFrame) -> DataFrame:
    """What a hybrid lookup reads from the overflow: only requested variants off the panel."""
    return of_variants(overflow, variants.join(on_panel_variants.select("variant_index"), "variant_index", "left_anti"))
