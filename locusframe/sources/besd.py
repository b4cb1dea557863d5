"""BESD: .epi and .esi text tables and the sparse binary .besd, as a Python data source."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import stats as S
from ..functions import variants as V

SPARSE_3F = 0x40400000  # 3.0 as float32
SPARSE_3 = 3
HEADER_INTS = 16


class ProbeRange(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class BesdReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.per = options["path"], int(options.get("probes_per_partition", "500"))

    def _layout(self, file) -> tuple[int, np.ndarray, int, int]:
        """(number of probes, offsets, where row numbers begin, where values begin)."""
        kind = int(np.frombuffer(file.read_at(4, 0), "<u4")[0])
        if kind not in (SPARSE_3F, SPARSE_3):
            raise ValueError(f"{self.path}: not a sparse BESD file")
        at = 4 if kind == SPARSE_3F else 4 * HEADER_INTS
        n_values = int(np.frombuffer(file.read_at(8, at), "<u8")[0])
        end = file.size() - 8 * n_values
        n_offsets = (end - at - 8) // 8
        offsets = np.frombuffer(file.read_at(8 * n_offsets, at + 8), "<u8").astype(np.int64)
        rows = at + 8 + 8 * n_offsets
        return (n_offsets - 1) // 2, offsets, rows, rows + 4 * n_values

    def _open(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        return system.open_input_file(path)

    def partitions(self) -> list[InputPartition]:
        n = self._layout(self._open())[0]
        return [ProbeRange(i, min(n, i + self.per)) for i in range(0, n, self.per)] or [ProbeRange(0, 0)]

    def read(self, partition: ProbeRange):
        file = self._open()
        _, offsets, rows, values = self._layout(file)
        for probe in range(partition.first, partition.end):
            b, s, e = (int(x) for x in offsets[2 * probe : 2 * probe + 3])
            at = np.frombuffer(file.read_at(4 * (s - b), rows + 4 * b), "<u4")
            beta = np.frombuffer(file.read_at(4 * (s - b), values + 4 * b), "<f4")
            se = np.frombuffer(file.read_at(4 * (e - s), values + 4 * s), "<f4")
            for k in range(s - b):
                yield probe, int(at[k]), *(None if math.isnan(x) or x == -9 else float(x) for x in (beta[k], se[k]))


class BesdSource(DataSource):
    """Options: path of the .besd as a URI or absolute path, probes_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "besd"

    def schema(self) -> str:
        return "probe int, esi_row int, beta float, se float"

    def reader(self, schema) -> DataSourceReader:
        return BesdReader(dict(self.options))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, place): the lines of one file, numbered from 0.

    Splits number their own lines; what stands before a split is the sum of the counts of the
    splits before it, one row for each.
    """
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", block.alias("_at"), F.monotonically_increasing_id().alias("_k"))
    per = lines.groupBy("_at").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("_at", "_first", before.alias("_before"))
    return lines.join(starts, "_at").select("value", (F.col("_k") - F.col("_first") + F.col("_before")).cast("int").alias("place"))


def besd(spark: SparkSession, prefix: str) -> DataFrame:
    """probe_id and the common columns for each stored value; the first allele of .esi is the effect."""
    spark.dataSource.register(BesdSource)
    esi, epi = (numbered_lines(spark, f"{prefix}.{end}").withColumn("c", F.split("value", r"\s+")) for end in ("esi", "epi"))
    position = F.col("c")[3].try_cast("int")
    sites = esi.select(
        F.col("place").alias("esi_row"), V.chromosome(F.col("c")[0]).alias("chromosome"), position.alias("position"), V.allele(F.col("c")[5]).alias("ref"), V.allele(F.col("c")[4]).alias("alt"),
        V.rsid(F.col("c")[1]).alias("rsid"), S.frequency(S.number(F.get("c", F.lit(6)))).alias("eaf"), V.identity_fault(F.col("c")[0], position, F.col("c")[4], F.col("c")[5], F.lit(True)).alias("fault"),
    )
    probes = epi.select(F.col("place").alias("probe"), F.col("c")[1].alias("probe_id"), V.chromosome(F.col("c")[0]).alias("trait_chr"), F.col("c")[3].try_cast("int").alias("trait_bp"))
    values = spark.read.format("besd").option("path", f"{prefix}.besd").load()
    joined = values.join(sites, "esi_row").join(probes, "probe")
    return joined.select("probe_id", "trait_chr", "trait_bp", F.lit(prefix).alias("source"), F.col("esi_row").cast("long").alias("row"), "chromosome", "position", "ref", "alt", "rsid", (F.col("beta") / F.col("se")).cast("double").alias("z"), F.col("se").cast("double").alias("se"), "eaf", "fault")
