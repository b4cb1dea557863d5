"""What a build and a collapse may cost: reads of the sources, patterns by row, rows of a task."""

import pytest
from pyspark.sql import functions as F

from locusframe.functions import variants as V
from locusframe.operators import admission
from locusframe.plans import builders

from test_store import SOURCES, rows


@pytest.mark.parametrize("layout", ["dense", "ragged"])
def test_a_build_reads_its_sources_three_times(spark, tmp_path, layout):
    read, given = spark.sparkContext.accumulator(0), rows()

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    analyses = spark.createDataFrame([("S1", 0), ("S2", 1)], "analysis_id string, analysis_index long")
    store = builders.build(spark.createDataFrame(given, SOURCES).mapInPandas(counted, SOURCES), analyses, f"{tmp_path}/{layout}", layout)
    assert store.associations().count() == 23 and read.value <= 3 * len(given)


def test_the_first_of_several_names_holds(spark, tmp_path):
    named = [(a, f, r, c, p, ref, alt, {0: ".", 5: "rsB", 7: "rsA"}.get(r % 100 + r // 100, "rsC"), z, se, eaf) for a, f, r, c, p, ref, alt, _, z, se, eaf in rows()]
    analyses = spark.createDataFrame([("S1", 0), ("S2", 1)], "analysis_id string, analysis_index long")
    store = builders.build(spark.createDataFrame(named, SOURCES), analyses, f"{tmp_path}/x")
    got = {(r.chromosome, r.position): r.rsid for r in store.variants().collect()}
    want = {}
    for _, _, _, c, p, *_, rsid, _, se, _ in sorted(named, key=lambda x: x[2]):
        if rsid != "." and se > 0:
            want.setdefault((c.removeprefix("chr"), p), rsid)
    assert len(set(want.values())) == 3 and {k: got[k] for k in want} == want


def test_a_judged_row_meets_few_patterns():
    fault = str(V.identity_fault(F.col("c"), F.col("p"), F.col("e"), F.col("o"), F.lit(True)))
    assert fault.count("regexp_replace") == 1 and fault.count("RLIKE") <= 5


def test_tasks_of_a_collapse_grow_in_number(spark, tmp_path, monkeypatch):
    nan, schema = float("nan"), "k long, z double, se double, eaf double, row_order int"
    given = [(1, None, 0.1, 0.2, 0), (1, 1.0, 0.1, 0.2, 1), (2, None, 0.1, 0.2, 1), (2, None, 0.1, 0.3, 0), (3, nan, 0.1, 0.2, 0), (3, nan, 0.1, 0.2, 1), (4, 1.0, nan, 0.2, 0), (4, 1.0, 0.1, 0.2, 1)]
    path = f"{tmp_path}/rows"
    spark.createDataFrame(given, schema).coalesce(1).write.parquet(path)
    monkeypatch.setattr(admission, "TASK_BYTES", 100)
    got = admission.collapsed(spark.read.parquet(path), ["k"])
    assert got.rdd.getNumPartitions() > 8
    assert sorted((r.k, r.eaf, r.n_rows) for r in got.collect()) == [(2, 0.3, 2), (3, 0.2, 2)]
