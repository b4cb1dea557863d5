"""Variant identity: contigs, alleles, canonical keys and orientation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_TOKENS = ["", ".", "NA", "NaN", "nan", "None"]
AUTOSOMES = [str(i) for i in range(1, 23)]


def present(text: Column) -> Column:
    """The trimmed text, or null for a missing token."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin(MISSING_TOKENS), trimmed)


def chromosome(name: Column) -> Column:
    """1-22, X, Y, MT; other digits and missing tokens are null, any other name stays.

    Names that are normal already, nearly all, are told by one look.  Others go through a function
    of one value (transform), which keeps the generated code small enough to be compiled.
    """
    text = name.cast("string")
    bare = F.regexp_replace(present(text), "^(?i)chr", "")
    return F.when(is_primary(text), text).otherwise(F.get(F.transform(F.array(bare), _contig), 0))


def _contig(bare: Column) -> Column:
    upper = F.upper(bare)
    number = F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int"))
    return (
        F.when(number.between(1, 22), number.cast("string"))
        .when(number == 23, "X").when(number == 24, "Y").when(number.isin(25, 26), "MT")
        .when(bare.rlike("^[0-9]+$"), None)
        .when(upper.isin("X", "Y", "MT"), upper).when(upper == "M", "MT")
        .when(bare == "", None)
        .otherwise(bare)
    )


def is_primary(contig: Column) -> Column:
    return contig.isin(*AUTOSOMES, "X", "Y", "MT")


def contig_rank(contig: Column) -> Column:
    return F.when(contig == "X", 23).when(contig == "Y", 24).when(contig == "MT", 25).when(contig.isin(AUTOSOMES), contig.try_cast("int")).otherwise(1000)


def bases(upper: Column) -> Column:
    return upper.isin("A", "C", "G", "T") | upper.rlike("^[ACGT]+$")


def allele(text: Column) -> Column:
    upper = F.upper(F.trim(text))
    return F.when(bases(upper), upper)


def allele_pair(ref: Column, alt: Column) -> Column:
    """(a1, a2): sorted, but the reference first if their lengths differ."""
    indel = F.length(ref) != F.length(alt)
    return F.struct(F.when(indel, ref).otherwise(F.least(ref, alt)).alias("a1"), F.when(indel, alt).otherwise(F.greatest(ref, alt)).alias("a2"))


def alid(contig: Column, position: Column, ref: Column, alt: Column) -> Column:
    pair = allele_pair(ref, alt)
    return F.concat_ws(":", contig, position.cast("string"), pair["a1"], pair["a2"])


def parsed_alid(text: Column) -> Column:
    """(chromosome, position, a1, a2) of a canonical key; null if it is none, and so an alias."""
    parts = F.split(text, ":")
    position = F.get(parts, 1).try_cast("int")
    good = (F.size(parts) == 4) & (position > 0) & F.get(parts, 2).rlike("^[ACGT]+$") & F.get(parts, 3).rlike("^[ACGT]+$")
    return F.when(good, F.struct(chromosome(F.get(parts, 0)).alias("chromosome"), position.alias("position"), F.get(parts, 2).alias("a1"), F.get(parts, 3).alias("a2")))


def flipped(effect: Column, ref: Column, alt: Column) -> Column:
    """The effect allele is not the first of the canonical pair."""
    return effect != allele_pair(ref, alt)["a1"]


def oriented_z(flip: Column, z: Column) -> Column:
    return F.when(flip, -z).otherwise(z)


def oriented_eaf(flip: Column, eaf: Column) -> Column:
    return F.when(flip, 1 - eaf).otherwise(eaf)


def complement(text: Column) -> Column:
    return F.translate(text, "ACGTacgt", "TGCAtgca")


def lifted_alleles(strand: Column, text: Column) -> Column:
    return F.when(strand == "-", complement(text)).otherwise(text)


def is_palindromic(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.greatest(a, b)).isin("AT", "CG")


def rsid(cell: Column) -> Column:
    """The first item between semicolons that begins with rs, up to a colon; else blank."""
    return F.coalesce(F.regexp_extract(F.coalesce(cell, F.lit("")), "(?:^|;) *(rs[^;:]*)", 1), F.lit(""))


def identity_fault(contig: Column, position: Column, effect: Column, other: Column, reference_known: Column) -> Column:
    """Why a row names no variant, or null."""
    e, o = (F.upper(F.trim(x)) for x in (effect, other))
    return (
        F.when(chromosome(contig).isNull(), "chromosome_missing")
        .when(position.isNull() | (position <= 0), "chromosome_missing")
        .when(~F.coalesce(bases(e) & bases(o) & (e != o), F.lit(False)), "allele_invalid")
        .when((F.length(e) != F.length(o)) & ~reference_known, "indel_reference_undeclared")
    )


def window_key(contig: Column, position: Column, size: int) -> Column:
    return F.struct(contig_rank(contig).alias("rank"), F.floor(position / size).alias("window"))


def routing_key(contig: Column, position: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", contig, position.cast("string"), ref, alt)
