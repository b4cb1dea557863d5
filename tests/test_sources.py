import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import intervals
from locusframe.sources import besd, column_map, registry, tabular, vcf
from locusframe.streaming import ingest


def put(path, text):
    path.write_text(text)
    return f"file://{path}"


SSF = "chromosome\tbase_pair_location\teffect_allele\tother_allele\tbeta\tstandard_error\teffect_allele_frequency\tp_value\trsid\thm_code\n"


def test_gwas_ssf(spark, tmp_path):
    text = SSF + "1\t100\tG\tA\t0.5\t0.1\t0.3\t1e-5\trs1\t10\n23\t5\tA\tAT\t0.1\tNA\t1.0\t0.05\tnone\t14\nchr2\t7\tT\tC\tinf\t0.1\tNA\tNA\trs3:x\t10\n"
    got = tabular.gwas_ssf(spark, put(tmp_path / "a.tsv", text)).orderBy("row").collect()
    assert [(r.chromosome, r.position, r.alt, r.ref, r.rsid, r.fault) for r in got] == [("1", 100, "G", "A", "rs1", None), ("X", 5, "A", "AT", "", "indel_reference_undeclared"), ("2", 7, "T", "C", "rs3", None)]
    assert got[0].z == pytest.approx(5.0) and got[0].eaf == 0.3
    assert got[1].se == pytest.approx(0.1 / 1.959963984, rel=1e-6) and got[1].eaf is None
    assert got[2].z == float("inf")


def test_headers_are_refused(spark, tmp_path):
    head = "chromosome\tbase_pair_location\teffect_allele\tother_allele"
    for columns in ("", "\tbeta\tBETA", "\tbeta\thm_effect_allele"):
        with pytest.raises(tabular.HeaderError):
            tabular.gwas_ssf(spark, put(tmp_path / "b.tsv", head + columns + "\n"))
    with pytest.raises(tabular.HeaderError):
        tabular.gwas_ssf(spark, put(tmp_path / "c.tsv", head + "\tz\tstandard_error\n1\t2\tA\tC\t3\t1\n"))
    with pytest.raises(tabular.HeaderError):
        tabular.association_tsv(spark, put(tmp_path / "d.tsv", "analysis_id\tchromosome\tposition\teffect_allele\tother_allele\tz\tse\n"))


def test_finngen_and_association_tsv(spark, tmp_path):
    text = "#chrom\tpos\tref\talt\trsids\tnearest_genes\tpval\tmlogp\tbeta\tsebeta\taf_alt\n1\t10\tC\tT\trs5;rs6\tX\t0.1\t1\t-0.2\t0.1\t0.4\n"
    row = tabular.finngen(spark, put(tmp_path / "f.tsv", text)).first()
    assert (row.ref, row.alt, row.rsid) == ("C", "T", "rs5") and row.z == pytest.approx(-2)
    text = "chrom\tpos\tea\toa\tz\tse\teaf\n1\t10\tC\tT\t-2\t0.1\t0.4\n1\t11\tA\tT\t-2\t0.1\t0.4\n"
    rows = registry.read(spark, "association-tsv", put(tmp_path / "g.tsv", text))
    assert rows.count() == 2
    sites = spark.createDataFrame([("1:10:C:T",), ("1:11:A:T",)], "alid string")
    assert [r.alid for r in tabular.at_sites(rows, sites).collect()] == ["1:10:C:T"]  # the other is palindromic


def test_column_map(spark, tmp_path):
    own = column_map.parse('column_map_version = 1\nname = "x"\nignored_columns = ["q"]\n[columns]\nchromosome = "c"\nposition = "p"\neffect_allele = "e"\nother_allele = "o"\nodds_ratio = "or"\n[optional_columns]\nsample_size = "n"\n')
    row = column_map.read(spark, put(tmp_path / "m.tsv", "c\tp\te\to\tor\tq\n1\t2\tA\tC\t2.0\tz\n"), own).first()
    assert row.alt == "A" and row.n is None
    with pytest.raises(tabular.HeaderError):
        column_map.read(spark, put(tmp_path / "m2.tsv", "c\tp\te\to\tor\textra\n"), own)
    with pytest.raises(tabular.HeaderError):
        column_map.parse('column_map_version = 1\nname = "x"\n[columns]\nchromosome = "c"\nunknown = "d"\n')


def test_vcf(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t10\trs1\tA\tG\t.\tPASS\t.\tES:SE:AF:EZ\t0.4:0.2:0.1:.\n1\t11\t.\tA\tG\t.\tPASS\t.\tES:SE:EZ\t0.4:0.2:3\n"
    got = vcf.gwas_vcf(spark, put(tmp_path / "v.vcf", text)).orderBy("row").collect()
    assert [r.z for r in got] == [2.0, 3.0] and got[0].eaf == 0.1 and got[1].eaf is None


def test_chain_and_lift(spark, tmp_path):
    text = "chain 100 chr1 1000 + 100 300 chr1 2000 + 500 700 1\n50 10 0\n140\n\nchain 50 chr1 1000 + 400 450 chr2 600 - 100 150 2\n50\n"
    blocks = vcf.chain(spark, put(tmp_path / "x.chain", text))
    sites = spark.createDataFrame([("1", 101), ("1", 150), ("1", 155), ("1", 161), ("1", 401), ("1", 450), ("3", 1)], "chromosome string, position long")
    got = {(r.chromosome, r.position): (r.new_chromosome, r.new_position, r.strand) for r in intervals.lifted(sites, blocks).collect()}
    assert got["1", 101] == ("1", 501, "+") and got["1", 150] == ("1", 550, "+") and got["1", 155][0] is None
    assert got["1", 161] == ("1", 551, "+") and got["1", 401] == ("2", 500, "-") and got["1", 450] == ("2", 451, "-") and got["3", 1][0] is None
    with pytest.raises(ValueError):
        intervals.require_lift_rate(intervals.lifted(sites, blocks))


def test_besd(spark, tmp_path):
    put(tmp_path / "p.esi", "1 rs1 0 10 A G 0.2\n1 rs2 0 20 C T NA\n1 rs3 0 30 C T 0.4\n")
    put(tmp_path / "p.epi", "1 probe1 0 15 gene1 +\n1 probe2 0 25 gene2 -\n")
    rows, values = [0, 1, 0, 1, 2, 2], [0.2, 0.3, 0.1, 0.1, 0.5, 0.25]
    data = struct.pack("<IQ", besd.SPARSE_3F, 6) + struct.pack("<5Q", 0, 2, 4, 5, 6) + np.array(rows, "<u4").tobytes() + np.array(values, "<f4").tobytes()
    (tmp_path / "p.besd").write_bytes(data)
    got = {(r.probe_id, r.rsid): round(r.z, 4) for r in besd.besd(spark, f"file://{tmp_path}/p").collect()}
    assert got == {("probe1", "rs1"): 2.0, ("probe1", "rs2"): 3.0, ("probe2", "rs3"): 2.0}


def test_manifest(spark, tmp_path):
    head = "trait_id\tfile_path\ttrait_name\tn\tstored_effect_scale\toriginal_sd_method\toriginal_sd\n"
    good = registry.manifest(spark, put(tmp_path / "m.tsv", head + "a\tx\tA\t100\tsd\treported\t2.0\nb\ty\tB\t100\tnative\t\t\n"))
    assert {r.trait_id: r.se_divisor for r in good.collect()} == {"a": 2.0, "b": 1.0}
    for bad in ("a\tx\tA\t1\tsd\t\t\n", "a\tx\tA\t1\tother\t\t\n", "a\tx\tA\t1\tnative\t\t2.0\n"):
        with pytest.raises(tabular.HeaderError):
            registry.manifest(spark, put(tmp_path / "n.tsv", head + bad))
    with pytest.raises(KeyError):
        registry.read(spark, "unknown", "x")


def test_stream(spark, tmp_path):
    schema = "z double, se double, eaf double"
    spark.createDataFrame([(1.0, 0.1, 0.2), (1.0, -1.0, 0.2), (float("inf"), 0.1, 2.0)], schema).write.parquet(f"{tmp_path}/in")
    ingest.admit(ingest.source_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 1
    got = {r.reason: r.n for r in spark.read.parquet(f"{tmp_path}/out/counts").collect()}
    assert got == {"admitted": 1, "se_unusable": 1, "z_nonfinite": 1}


def test_lines_of_several_splits_are_numbered(spark, tmp_path):
    put(tmp_path / "x.esi", "".join(f"line {i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = besd.numbered_lines(spark, f"file://{tmp_path}/x.esi")
        assert spark.read.text(f"file://{tmp_path}/x.esi").rdd.getNumPartitions() > 4
        assert {(r.value, r.place) for r in lines.collect()} == {(f"line {i}", i) for i in range(2000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
