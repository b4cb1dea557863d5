"""GWAS-VCF and chain files, by Spark's text reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import variants as V
from .tabular import COLUMNS


def gwas_vcf(spark: SparkSession, path: str) -> DataFrame:
    """One sample; ES, SE, EZ, AF, LP, SI and SS by the keys of FORMAT; alt is the effect allele."""
    lines = spark.read.text(path).withColumn("source", F.input_file_name()).withColumn("row", F.monotonically_increasing_id())
    cells = lines.where(~F.col("value").startswith("#")).withColumn("c", F.split("value", "\t"))
    values = F.map_from_arrays(F.split(F.col("c")[8], ":"), F.slice(F.split(F.col("c")[9], ":"), F.lit(1), F.size(F.split(F.col("c")[8], ":"))))
    same = F.size(F.split(F.col("c")[8], ":")) == F.size(F.split(F.col("c")[9], ":"))
    keyed = cells.where(F.size("c") >= 10).withColumn("f", F.when(same, values))
    get = lambda k: F.try_element_at("f", F.lit(k))
    ref, alt, position = F.col("c")[3], F.col("c")[4], F.col("c")[1].try_cast("int")
    se = S.positive(get("SE"))
    rows = keyed.select(
        "source", "row", V.chromosome(F.col("c")[0]).alias("chromosome"), position.alias("position"), V.allele(ref).alias("ref"), V.allele(alt).alias("alt"), V.rsid(F.col("c")[2]).alias("rsid"),
        S.vcf_z(S.effect(get("EZ")), S.effect(get("ES")), se).alias("z"), se.alias("se"), S.frequency(S.number(get("AF"))).alias("eaf"), S.positive(get("SS")).alias("n"),
        F.pow(F.lit(10.0), -S.number(get("LP"))).alias("p"), S.imputation_score(get("SI"))["score"].alias("info"), V.identity_fault(F.col("c")[0], position, alt, ref, F.lit(True)).alias("fault"),
    )
    return rows.select(*COLUMNS)


def chain(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a chain file, as of intervals.lifted: 1-based, ends inclusive.

    A chain is small and its lines depend on those before them, so it is parsed as whole files.
    """

    def parse(frames):
        import pandas as pd

        for frame in frames:
            for text in frame["value"]:
                rows, at, to, head = [], 0, 0, None
                for line in text.splitlines():
                    cells = line.split()
                    if not cells or line.startswith("#"):
                        continue
                    if cells[0] == "chain":
                        head = cells
                        at, to = int(cells[5]), int(cells[10])
                        continue
                    size = int(cells[0])
                    reverse = head[9] == "-"
                    start = int(head[8]) - to if reverse else to + 1
                    rows.append((head[2], at + 1, at + size, head[7], start, head[9], float(head[1])))
                    if len(cells) == 3:
                        at, to = at + size + int(cells[1]), to + size + int(cells[2])
                yield pd.DataFrame(rows, columns=["chromosome", "start", "end", "to_chromosome", "to_start", "strand", "score"])

    blocks = spark.read.text(path, wholetext=True).mapInPandas(parse, "chromosome string, start long, end long, to_chromosome string, to_start long, strand string, score double")
    return blocks.withColumn("chromosome", V.chromosome(F.col("chromosome"))).withColumn("to_chromosome", V.chromosome(F.col("to_chromosome")))
