"""Store releases: directories of Parquet tables with a manifest, written whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import reads, rho

LAYOUTS = ("dense", "ragged", "hybrid")
FORMAT = "1"


@dataclass
class Manifest:
    store_id: str = ""
    release_id: str = ""
    layout: str = "dense"
    assembly: str = "GRCh38"
    coverage: str = "gwas"
    completed: bool = False
    format: str = FORMAT
    provenance: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout {self.layout!r} is none of {LAYOUTS}")
        if self.layout != "ragged" and self.coverage != "gwas":
            raise ValueError("dense and hybrid releases cover whole genomes only")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Release:
    """A release while it is written."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path, manifest

    def write(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        """order: columns by which rows are clustered, so that scans skip by their ranges."""
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        df.write.parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def discard(self, *names: str) -> None:
        for name in names:
            p, fs = _path(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)

    def write_tiers(self) -> None:
        """Rows beyond the widest tier's cut, each with the narrowest tier it reaches, and the variant-major copy."""
        names = ["associations", *(["overflow"] if self.manifest.layout == "hybrid" else [])]
        for name in names:
            rows = self.read(name)
            size = F.abs("z")
            tier = F.when(size >= S.z_critical(5e-8), "p_5e_08").when(size >= S.z_critical(5e-6), "p_5e_06").otherwise("p_5e_04")
            hits = rows.where(reads.significant(5e-4)).withColumn("tier", tier)
            hits.repartitionByRange("analysis_index", "variant_index").sortWithinPartitions("analysis_index", "variant_index").write.partitionBy("tier").parquet(f"{self.path}/{name}_tiers")
            self.write(f"{name}_by_variant", rows, order=["variant_index", "analysis_index"])


class Store:
    """Reads of a release.  All methods return lazy DataFrames."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path, manifest

    @staticmethod
    def open(spark: SparkSession, path: str) -> Store:
        text = spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]
        return Store(spark, path, Manifest(**json.loads(text)))

    @staticmethod
    @contextmanager
    def staging(spark: SparkSession, path: str, manifest: Manifest, overwrite: bool = False) -> Iterator[Release]:
        """Writes to a folder beside the destination and renames it at the end; on an error it is discarded."""
        final, fs = _path(spark, path)
        if fs.exists(final) and not overwrite:
            raise FileExistsError(path)
        temporary = f"{path.rstrip('/')}.tmp.{uuid.uuid4().hex}"
        release = Release(spark, temporary, manifest)
        try:
            yield release
            out = fs.create(_path(spark, f"{temporary}/manifest.json")[0])
            out.write(bytearray(json.dumps(asdict(manifest), indent=1).encode()))
            out.close()
            # A release that is replaced is set aside until the new one stands.
            old = _path(spark, f"{path.rstrip('/')}.old.{uuid.uuid4().hex}")[0]
            replaced = overwrite and fs.exists(final) and fs.rename(final, old)
            if not fs.rename(_path(spark, temporary)[0], final):
                if replaced:
                    fs.rename(old, final)
                raise FileExistsError(path)
            if replaced:
                fs.delete(old, True)
        except BaseException:
            fs.delete(_path(spark, temporary)[0], True)
            raise

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def variants(self) -> DataFrame:
        return self.table("variants")

    def analyses(self) -> DataFrame:
        return self.table("analyses")

    def associations(self, by_variant: bool = False) -> DataFrame:
        """Of all components; dense rows are only those with values, ragged ones may be missing."""
        end = "_by_variant" if by_variant else ""
        rows = self.table(f"associations{end}")
        if self.manifest.layout == "hybrid":
            rows = rows.withColumn("component", F.lit("dense")).unionByName(self.table(f"overflow{end}").withColumn("component", F.lit("overflow")))
        return rows if self.manifest.layout == "ragged" else rows.where("z IS NOT NULL AND se IS NOT NULL")

    def _index_of(self, analysis_id: str) -> int | None:
        row = self.analyses().where(F.col("analysis_id") == analysis_id).select("analysis_index").first()
        return None if row is None else row[0]

    def analysis(self, analysis_id: str, observed_only: bool = False, subset: str | None = None) -> DataFrame:
        """Every association of one analysis (or of all that bear the id, where the release doesn't hold to unique ones); none for an unknown id.  subset: a named subset, which must exist and be current."""
        rows = self.subset(subset) if subset else self.associations()
        named = self.analyses().where(F.col("analysis_id") == analysis_id).select("analysis_index").collect()
        return reads.observed_only(rows.where(F.col("analysis_index").isin([r[0] for r in named])), observed_only)

    def phewas(self, identifier: str, observed_only: bool = False) -> DataFrame:
        named = (F.col("alid") == identifier) | ((F.col("rsid") == identifier) & (F.col("rsid") != ".") & (F.octet_length("rsid") <= 24))
        index = self.variants().where(named).agg(F.min("variant_index")).first()[0]
        rows = self.associations(by_variant=True)
        return reads.observed_only(rows.where(F.lit(False) if index is None else F.col("variant_index") == index), observed_only)

    def range_phewas(self, chromosome: str, start: int, end: int, observed_only: bool = False) -> DataFrame:
        """The range's variants are a stretch of the axis, so the scan is bounded by their numbers."""
        inside = reads.in_range(self.variants(), chromosome, start, end)
        ends = inside.agg(F.min("variant_index"), F.max("variant_index")).first()
        rows = self.associations(by_variant=True)
        return reads.observed_only(rows.where(F.lit(False) if ends[0] is None else F.col("variant_index").between(*ends)), observed_only)

    def range_by_analysis(self, chromosome: str, start: int, end: int, observed_only: bool = False) -> DataFrame:
        if self.manifest.layout != "ragged":
            raise ValueError("only ragged releases have trait positions")
        wanted = self.analyses().where((F.col("trait_chr") == chromosome) & F.col("trait_bp").between(start, end))
        return reads.observed_only(reads.of_analyses(self.associations(), wanted), observed_only)

    def lookup(self, identifiers: list[str], analysis_ids: list[str], observed_only: bool = False) -> DataFrame:
        every = self.manifest.layout != "ragged"
        found = reads.lookup(self.associations(by_variant=True), self.variants(), self.analyses(), identifiers, analysis_ids, every)
        return reads.ordered_lookup(reads.observed_only(found, observed_only))

    def top_hits(self, analysis_id: str | None = None, threshold: float = 5e-8, limit: int | None = None, observed_only: bool = False) -> DataFrame:
        """From the tiers; at a threshold without a tier, dense releases have no hits and others are scanned."""
        index = None if analysis_id is None else self._index_of(analysis_id)
        names = ["associations", *(["overflow"] if self.manifest.layout == "hybrid" else [])]
        key = S.tier_key(threshold)
        if key in S.TIERS:
            tiers = [k for k, t in S.TIERS.items() if t <= threshold]
            parts = [self.table(f"{n}_tiers").where(F.col("tier").isin(tiers)).drop("tier") for n in names]
        elif self.manifest.layout == "dense":
            parts = [self.table("associations").where(F.lit(False))]
        else:
            parts = [self.table(n) for n in names]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if analysis_id is not None and index is None:
            rows = rows.where(F.lit(False))
        return reads.top_hits(rows, threshold, index, limit, observed_only)

    def rho_matrix(self) -> DataFrame:
        return rho.symmetric(self.table("rho"), self.analyses())

    def rho_row(self, analysis_id: str) -> DataFrame:
        index = self._index_of(analysis_id)
        return rho.row(self.table("rho"), -1 if index is None else index)

    def rho(self, *analysis_ids: str) -> DataFrame:
        wanted = reads.request(self.analyses(), list(analysis_ids), "analysis_id").join(self.analyses().select("analysis_id", "analysis_index"), "analysis_id")
        return rho.pairs_of(self.table("rho"), wanted)

    def resolve(self, rows: DataFrame, with_rsid: bool = False) -> DataFrame:
        got = reads.with_identity(rows, self.variants(), self.analyses(), with_rsid)
        return got.withColumn("log10_p", S.log10_p(F.col("z")))

    def build_rho(self, window: int = 15_000, cut: float = 1.0, least: int = 500) -> None:
        from ..operators.windows import thinned

        rows = reads.of_variants(self.associations(), thinned(self.variants(), window))
        # Beside the release's own tables: written apart and renamed, so that readers see one matrix or the other.
        temporary = f"{self.path}/rho.tmp.{uuid.uuid4().hex}"
        rho.estimated(rho.statistics(rows, cut), cut, least).write.parquet(temporary)
        final, fs = _path(self.spark, f"{self.path}/rho")
        old = _path(self.spark, f"{self.path}/rho.old.{uuid.uuid4().hex}")[0]
        replaced = fs.exists(final) and fs.rename(final, old)
        fs.rename(_path(self.spark, temporary)[0], final)
        if replaced:
            fs.delete(old, True)

    def build_subset(self, name: str, alids: DataFrame, overflow_only: str = "refuse") -> None:
        """A named copy of the rows of some variants.  overflow_only: what to do with wanted variants that only the overflow has, refuse or skip."""
        if alids.groupBy("alid").count().where("count > 1").limit(1).count():
            raise ValueError("the variant list repeats a key")
        wanted = self.variants().join(alids, "alid", "left_semi")
        absent = alids.join(self.variants(), "alid", "left_anti")
        if (n := absent.count()) :
            raise ValueError(f"{n} of the variants are not in the release")
        rows = self.table("associations")
        if self.manifest.layout == "hybrid":
            only = reads.of_variants(self.table("overflow"), wanted).select("variant_index").distinct()
            if overflow_only == "refuse" and not only.isEmpty():
                raise ValueError("some of the variants are in the overflow only")
        stamped = reads.of_variants(rows, wanted).withColumn("release_id", F.lit(self.manifest.release_id))
        stamped.repartitionByRange("analysis_index", "variant_index").sortWithinPartitions("analysis_index", "variant_index").write.parquet(f"{self.path}/subsets/{name}")

    def subset(self, name: str) -> DataFrame:
        if self.manifest.layout == "ragged":
            raise ValueError("ragged releases have no subsets")
        path, fs = _path(self.spark, f"{self.path}/subsets/{name}")
        if not fs.exists(path):
            raise KeyError(name)
        rows = self.table(f"subsets/{name}")
        if not rows.where(F.col("release_id") != self.manifest.release_id).isEmpty():
            raise ValueError(f"subset {name} belongs to another release")
        return rows.drop("release_id")

    def subsets(self) -> list[str]:
        path, fs = _path(self.spark, f"{self.path}/subsets")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
