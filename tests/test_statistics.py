import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import ancestry, completion


def test_nnls_against_all_active_sets():
    from itertools import combinations

    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.standard_normal((12, 4)), rng.standard_normal(12)
        best = (b @ b, np.zeros(4))
        for k in range(1, 5):
            for c in combinations(range(4), k):
                x = np.zeros(4)
                x[list(c)] = np.linalg.lstsq(a[:, list(c)], b, rcond=None)[0]
                if (x >= 0).all():
                    best = min(best, (((a @ x - b) ** 2).sum(), x), key=lambda t: t[0])
        assert np.allclose(ancestry.nnls(a, b), best[1], atol=1e-8)


def test_assignment_and_gates(spark):
    rng = np.random.default_rng(1)
    panel = rng.uniform(0.05, 0.95, (3000, 3))
    f = panel @ [0.8, 0.1, 0.1]
    rows = [(0, i, float(f[i])) for i in range(3000)] + [(1, i, float(f[i])) for i in range(50)] + [(2, i, 1 - float(f[i])) for i in range(3000)]
    p = spark.createDataFrame([(i, *map(float, panel[i])) for i in range(3000)], "variant_index long, a double, b double, c double")
    got = {r.analysis_index: r for r in ancestry.assigned(spark.createDataFrame(rows, "analysis_index long, variant_index long, eaf double"), p, {"a": "EUR", "b": "AFR", "c": "AFR"}, ancestry.Gates(least_overlap=1000)).collect()}
    assert got[0].assigned_ancestry == "EUR" and got[0].proportion == pytest.approx(0.8, abs=1e-3) and got[0].residual < 1e-3
    assert got[1].gate == "overlap" and got[2].gate == "orientation"


def test_imputation_of_a_block(spark):
    rng = np.random.default_rng(2)
    n = 60
    place = np.arange(n)
    ld = 0.98 ** np.abs(place[:, None] - place[None])
    vectors, values = completion.components(ld, 0.9)
    assert 1 < vectors.shape[1] < n
    truth = vectors @ (np.sqrt(values) * rng.standard_normal(len(values))) * 2
    seen = rng.random(n) < 0.6
    got, r = completion.block_z(np.where(seen, truth, np.nan), vectors)
    assert r > 0.7 and np.corrcoef(got[~seen], truth[~seen])[0, 1] > 0.8
    assert np.abs(got).max() <= np.abs(truth[seen]).max() + 1e-9
    assert completion.block_z(np.full(n, np.nan), vectors)[0] is None

    rows = spark.createDataFrame([(0, int(i), float(truth[i]), 0.1, 0.3) for i in place if seen[i]], "analysis_index long, variant_index long, z double, se double, eaf double")
    panel = spark.createDataFrame([("b", int(i), int(i), 0.25) for i in place], "block_id string, variant_index long, place int, reference_eaf double")
    eigen = spark.createDataFrame([("b", vectors.tolist())], "block_id string, vectors array<array<double>>")
    fills, quality = completion.completed(rows, panel, eigen)
    filled = fills.collect()
    assert {r.variant_index for r in filled} == {int(i) for i in place if not seen[i]}
    assert all(r.se == pytest.approx(0.1 * np.sqrt(0.42 / 0.375)) for r in filled)
    q = quality.first()
    assert q.n_imputed == len(filled) and q.n_missing == 0 and q.pearson_r == pytest.approx(r)


def test_regions(spark):
    analyses = spark.createDataFrame([(0, "1", 100), (1, "2", 5000), (2, None, None)], "analysis_index long, trait_chr string, trait_bp long")
    table = spark.createDataFrame([(0, "cis", "1", 1, 9), (1, "qc_panel", "3", 1, 9), (1, "significant_trans", "4", 1, 9)], "analysis_index long, kind string, chromosome string, start long, end long")
    got = {tuple(r) for r in completion.regions(analyses, table, 1000).collect()}
    assert got == {(0, "1", 1, 9), (1, "4", 1, 9), (1, "2", 4000, 6000)}


def test_ancestry_filter(spark):
    analyses = spark.createDataFrame([(0, "EUR"), (1, "AFR"), (2, None)], "analysis_index long, assigned_ancestry string")
    assert [r[0] for r in ancestry.to_impute(analyses, "eur").collect()] == [0]
    assert ancestry.to_impute(analyses.withColumn("assigned_ancestry", F.lit(None).cast("string")), "EUR").count() == 3
    with pytest.raises(ValueError):
        ancestry.to_impute(analyses, "SAS")


def test_ratio_outliers_use_the_median():
    rng = np.random.default_rng(3)
    predicted = rng.uniform(1, 2, 200)
    truth = predicted * (1 + 0.01 * rng.standard_normal(200))
    truth[:2] = 1e3, -5.0
    keep = completion.ratio_outliers(truth, predicted)
    assert not keep[:2].any() and keep[2:].mean() > 0.95
    assert not completion.ratio_outliers(np.array([1.0, 2.0]), np.zeros(2)).any()


def test_bottom_k_by_site_hash(spark):
    import hashlib

    from locusframe.operators import windows

    rows = [(i % 3, f"1:{i}:A:C", i) for i in range(90)] + [(0, "1:0:A:C", 500)]
    got = windows.bottom_k(spark.createDataFrame(rows, "g int, alid string, nth int"), "g", "alid", 5, "nth").collect()
    for g in range(3):
        own = sorted((hashlib.blake2b(a.encode(), digest_size=8).digest(), n, a) for h, a, n in rows if h == g)[:5]
        assert {(r.alid, r.nth) for r in got if r.g == g} == {(a, n) for _, n, a in own}
        assert all(r.sampled and r.offered == sum(h == g for h, *_ in rows) for r in got if r.g == g)


def test_regions_of_pairs_are_whole(spark):
    from locusframe.operators import reads

    rows = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.1)], "variant_index long, analysis_index long, z double")
    pairs = spark.createDataFrame([(1, 1), (3, 1)], "variant_index long, analysis_index long")
    assert reads.cells(rows, pairs=pairs).count() == 1
    with pytest.raises(Exception, match="no association 3 1"):
        reads.cells(rows, pairs=pairs, every_pair=True).collect()
