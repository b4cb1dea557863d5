"""Readers of tab-separated summary statistics.

Every reader gives one DataFrame: source, row (order within the source), chromosome,
position, ref, alt (the effect allele), rsid, z, se, eaf, n, p, info, fault.  What a caller does
not select is not parsed, so a scan of sites or metrics is a select.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import variants as V

COLUMNS = ["source", "row", "chromosome", "position", "ref", "alt", "rsid", "z", "se", "eaf", "n", "p", "info", "fault"]
#: Spellings, first match wins; fixed values of the formats.
BETA = ["beta", "BETA", "hm_beta", "effect", "b"]
ODDS_RATIO = ["odds_ratio", "hm_odds_ratio", "OR", "or"]
Z_SCORE = ["z", "Z", "zscore", "z_score"]
SAMPLE_SIZE = ["n", "N", "sample_size", "num_samples"]


class HeaderError(ValueError):
    """A header that a reader can't honour."""


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with source and row; gzip by extension.

    row grows with the order of lines within a file: splits of a file are read in order and
    the ids of a partition grow.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="", inferSchema=False)
    return raw.withColumn("source", F.input_file_name()).withColumn("row", F.monotonically_increasing_id())


def one_of(columns: list[str], names: list[str], what: str, required: bool = True) -> str | None:
    found = [n for n in names if n in columns]
    if len(found) > 1:
        raise HeaderError(f"{what}: the header has {', '.join(found)}; one is needed")
    if not found and required:
        raise HeaderError(f"{what}: the header has none of {', '.join(names)}")
    return found[0] if found else None


@dataclass(frozen=True)
class Fields:
    """Text columns of a source by meaning; None: the source has none."""

    chromosome: Column
    position: Column
    other: Column
    effect: Column
    rsid: Column | None = None
    beta: Column | None = None
    odds_ratio: Column | None = None
    z: Column | None = None
    se: Column | None = None
    low: Column | None = None
    high: Column | None = None
    p: Column | None = None
    eaf: Column | None = None
    n: Column | None = None
    info: Column | None = None
    reference_known: Column | None = None


def assembled(raw: DataFrame, f: Fields) -> DataFrame:
    """The common columns."""
    none = F.lit(None).cast("string")
    get = lambda c: none if c is None else c
    position = V.present(f.position).try_cast("int")
    known = F.lit(True) if f.reference_known is None else f.reference_known
    fault = V.identity_fault(f.chromosome, position, f.effect, f.other, known)
    if f.z is not None:
        stats = F.struct(S.effect(f.z).alias("z"), S.positive(get(f.se)).alias("se"))
    else:
        stats = S.row_statistics(get(f.beta), get(f.odds_ratio), get(f.se), get(f.low), get(f.high), get(f.p))
    rows = raw.select("source", "row", F.struct(stats.alias("s")).alias("_"), *[
        V.chromosome(f.chromosome).alias("chromosome"), position.alias("position"), V.allele(f.other).alias("ref"), V.allele(f.effect).alias("alt"),
        V.rsid(get(f.rsid)).alias("rsid"), S.frequency(S.number(get(f.eaf))).alias("eaf"), S.positive(get(f.n)).alias("n"), S.number(get(f.p)).alias("p"),
        S.imputation_score(get(f.info))["score"].alias("info"), fault.alias("fault"),
    ])
    return rows.select(*[F.col("_.s.z").alias("z") if c == "z" else F.col("_.s.se").alias("se") if c == "se" else F.col(c) for c in COLUMNS])


def gwas_ssf(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue's standard layout.  Indels need a harmonisation code that says the reference is known."""
    raw = text_table(spark, path)
    c = raw.columns
    if ("hm_effect_allele" in c) != ("hm_other_allele" in c):
        raise HeaderError("one of the harmonised allele columns is missing")
    if "hm_effect_allele" in c and "hm_code" not in c:
        raise HeaderError("harmonised alleles without hm_code")
    col = lambda *names: next((F.col(n) for n in names if n in c), None)
    rsid = F.coalesce(F.nullif(V.rsid(col("rsid")), F.lit("")), col("variant_id")) if col("rsid") is not None and col("variant_id") is not None else (col("rsid") if col("rsid") is not None else col("variant_id"))
    # Codes 1 to 9 are forward or inferred, 10 to 13 palindromic with a known strand; others leave the reference open.
    known = F.col("hm_code").try_cast("int").between(1, 13) if "hm_code" in c else F.lit(False)
    beta, ratio = one_of(c, BETA, "effect", required=False), one_of(c, ODDS_RATIO, "odds ratio", required=False)
    z = one_of(c, Z_SCORE, "z", required=False)
    if not (beta or ratio or z):
        raise HeaderError("no effect column")
    signed = z if not (beta or ratio) else None
    if signed:
        require_signed(raw, signed)
    n = one_of(c, SAMPLE_SIZE, "sample size", required=False)
    return assembled(raw, Fields(
        chromosome=col("hm_chrom", "chromosome"), position=col("hm_pos", "base_pair_location"), other=col("hm_other_allele", "other_allele"), effect=col("hm_effect_allele", "effect_allele"),
        rsid=rsid, beta=F.col(beta) if beta else None, odds_ratio=F.col(ratio) if ratio else None, z=F.col(signed) if signed else None, se=col("standard_error"), low=col("ci_lower"), high=col("ci_upper"),
        p=col("p_value"), eaf=col("hm_effect_allele_frequency", "effect_allele_frequency"), n=F.col(n) if n else None, info=col("info"), reference_known=known,
    ))


def finngen(spark: SparkSession, path: str) -> DataFrame:
    """#chrom, pos, ref, alt ...; alt is the effect allele."""
    raw = text_table(spark, path)
    return assembled(raw, Fields(F.col("`#chrom`"), F.col("pos"), F.col("ref"), F.col("alt"), rsid=F.col("rsids"), beta=F.col("beta"), se=F.col("sebeta"), p=F.col("pval"), eaf=F.col("af_alt")))


def association_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Plain association tables; columns that name analyses are refused."""
    raw = text_table(spark, path)
    c = raw.columns
    if named := [x for x in c if x in ("analysis_id", "phenotype_id", "analysis_label", "phenotype_label")]:
        raise HeaderError(f"a source is of one analysis, but has {', '.join(named)}")
    get = lambda names, what, required=True: (lambda n: F.col(n) if n else None)(one_of(c, names, what, required))
    return assembled(raw, Fields(
        get(["chromosome", "chrom", "chr"], "chromosome"), get(["position", "pos", "base_pair_location"], "position"), get(["other_allele", "oa", "ref"], "other allele"), get(["effect_allele", "ea", "alt"], "effect allele"),
        rsid=get(["rsid", "snp"], "rsid", False), z=get(Z_SCORE, "z", False), beta=get(BETA, "effect", False), se=get(["se", "standard_error"], "se"), eaf=get(["eaf", "effect_allele_frequency"], "eaf", False), n=get(SAMPLE_SIZE, "n", False),
    ))


def require_signed(raw: DataFrame, column: str) -> None:
    """A z column with values has a negative one."""
    least, n = raw.agg(F.min(S.effect(F.col(column))), F.count(S.effect(F.col(column)))).first()
    if n and least >= 0:
        raise HeaderError(f"{column} has {n} values and none is negative: it is no signed z")


def at_sites(rows: DataFrame, alids: DataFrame) -> DataFrame:
    """Usable rows at the given keys; palindromic ones and those without se or frequency are left out."""
    keyed = rows.withColumn("alid", V.alid(F.col("chromosome"), F.col("position"), F.col("ref"), F.col("alt")))
    usable = keyed.where(~V.is_palindromic(F.col("ref"), F.col("alt")) & F.col("se").isNotNull() & F.col("eaf").isNotNull())
    return usable.join(alids.select("alid"), "alid", "left_semi")
