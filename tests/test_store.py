import pytest
from pyspark.sql import functions as F

from locusframe.plans import builders, validation
from locusframe.plans.store import Store

SOURCES = "analysis_id string, source string, row long, chromosome string, position int, ref string, alt string, rsid string, z double, se double, eaf double"


def rows():
    out = []
    for k, a in enumerate(("S1", "S2")):
        for i in range(12):
            out.append((a, "f", 100 * k + i, "chr2" if i < 6 else "1", 1000 + i, "A", "C" if i % 2 else "G", f"rs{i // 2}", 6.0 - i, 0.1, 0.2))
    out.append(("S1", "f", 900, "1", 1007, "A", "C", "rs3", 6.0 - 7, 0.1, 0.2))  # agrees with row 7
    out.append(("S2", "f", 901, "1", 1008, "A", "G", "rs4", 9.0, 0.1, 0.2))  # disagrees with row 8
    out.append(("S2", "f", 902, "1", 1020, "A", "C", "rs9", 1.0, -0.1, 0.2))  # unusable
    return out


@pytest.fixture(scope="module", params=["dense", "ragged", "hybrid"])
def store(request, spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('store')}/{request.param}"
    analyses = spark.createDataFrame([("S1", 0, "2", 1003), ("S2", 1, "1", 1008)], "analysis_id string, analysis_index long, trait_chr string, trait_bp long")
    panel = spark.createDataFrame([(f"1:{1000 + i}:A:{'C' if i % 2 else 'G'}",) for i in range(6, 12)], "alid string")
    return builders.build(spark.createDataFrame(rows(), SOURCES), analyses, path, request.param, panel=panel, release_id="r1", coverage="gwas")


def test_build_and_validate(store):
    assert store.associations().count() == 23  # 24 places, one in conflict
    assert [r.chromosome for r in store.variants().orderBy("variant_index").select("chromosome").collect()] == ["1"] * 6 + ["2"] * 6
    assert validation.validate(store) == {}


def test_reads(store):
    assert store.analysis("S1").count() == 12 and store.analysis("none").count() == 0
    assert store.phewas("rs3").count() == 2
    assert store.range_phewas("chr2", 1000, 1002).count() == 6
    found = store.lookup(["rs0", "nothing"], ["S2", "S1"]).select("analysis_index").collect()
    assert [r[0] for r in found] == ([1, 1, 0, 0] if store.manifest.layout != "ragged" else [1, 0])
    hits = store.top_hits().collect()
    assert [(r.analysis_index, r.z) for r in hits] == [(0, -6.0), (1, -6.0)]  # the effect allele is the second
    assert store.top_hits(threshold=0.05, limit=3).count() == (0 if store.manifest.layout == "dense" else 3)
    assert set(store.resolve(store.phewas("rs3"), with_rsid=True).columns) >= {"alid", "rsid", "analysis_id", "log10_p"}
    if store.manifest.layout == "ragged":
        assert store.range_by_analysis("2", 1000, 1010).count() == 12
    else:
        with pytest.raises(ValueError):
            store.range_by_analysis("2", 1, 2)


def test_subsets(store, spark):
    if store.manifest.layout == "ragged":
        return
    store.build_subset("some", spark.createDataFrame([("1:1006:A:G",), ("1:1007:A:C",)], "alid string"))
    assert store.subsets() == ["some"] and store.analysis("S1", subset="some").count() == 2
    with pytest.raises(KeyError):
        store.analysis("S1", subset="other")


def test_staging_leaves_nothing_behind(spark, tmp_path):
    from locusframe.plans.store import Manifest

    with pytest.raises(RuntimeError), Store.staging(spark, f"{tmp_path}/x", Manifest()) as release:
        release.write("variants", spark.range(1))
        raise RuntimeError
    assert list(tmp_path.iterdir()) == []


def test_rho(spark):
    import numpy as np

    from locusframe.operators import rho

    rng = np.random.default_rng(0)
    a = rng.standard_normal((4000, 2))
    z = np.c_[a[:, 0], 0.6 * a[:, 0] + 0.8 * a[:, 1]]
    long = [(i, j, float(z[i, j])) for i in range(len(z)) for j in range(2)]
    pairs = rho.statistics(spark.createDataFrame(long, "variant_index long, analysis_index long, z double"), 1.5)
    got = rho.estimated(pairs, 1.5).collect()
    assert len(got) == 1 and abs(got[0].rho - 0.6) < 0.06
    matrix = rho.symmetric(rho.estimated(pairs, 1.5), spark.range(2).withColumnRenamed("id", "analysis_index"))
    assert matrix.count() == 4 and matrix.where("i = j").agg(F.sum("rho")).first()[0] == 2.0
