import hashlib
import struct
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import toxicity, urls, warc
from locusframe.llm.common import work_folder
from locusframe.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"

# WARC


def pages_rows():
    big = "<html>" + "é" * 600 + "</html>"
    return [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big + "x"), (4, "http://c/", None), (5, "http://d/", "short"), (6, "http://e/", "short"), (None, "http://f/", big), (7, "u", ""), (2, "http://b/", big), (8, "big", "z" * 700_000), (9, "big", "z" * 700_000)]


def test_warc(spark):
    pages = spark.createDataFrame([(*r, "extra") for r in pages_rows()], "page_id long, url string, html string, refers_to string")
    folder = work_folder(spark, "warc-test")
    index = warc.write(warc.with_types(pages), folder)
    got = warc.read(index, folder).collect()
    assert len(got) == len(pages_rows())
    by = {}
    for i, _, h in pages_rows():
        data = (h or "").encode()
        by.setdefault(data, []).append(i)
    texts = {i: (h or "").encode() for i, _, h in pages_rows()}
    for r in got:
        data = texts[r.page_id]
        top = max(i for i in by[data] if i is not None) if len(data) >= 1000 else None
        first = top is None or r.page_id == top
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", top))
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
        assert (r.payload == data) if first else r.payload is None
    assert len({r.record_id for r in got}) == len(got)
    # The index's own page columns aren't looked at.
    blind = index.withColumn("page_id", F.lit(None).cast("long")).withColumn("refers_to", F.lit(-1).cast("long"))
    assert sorted(map(str, warc.read(blind, folder).collect())) == sorted(map(str, got))
    assert warc.write(warc.with_types(pages.limit(0)), work_folder(spark, "warc-none")).count() == 0


def test_bundles_end_with_a_seek_table(spark, tmp_path):
    import zstandard

    system, path = warc.file_system(f"file://{tmp_path}")
    bundle = warc.Bundle(system, f"{path}/x.zst")
    frames = [b"a" * 1000, b"b", b"c" * 50]
    for f in frames:
        bundle.add(f)
    bundle.close()
    data = (tmp_path / "x.zst").read_bytes()
    n, _, magic = struct.unpack("<IBI", data[-9:])
    assert (n, magic) == (3, warc.SEEKABLE)
    reader = warc.Reader(system, f"{path}/x.zst")
    assert [reader.frame(k) for k in (2, 0, 1)] == [frames[2], frames[0], frames[1]]
    # Any reader of concatenated frames reads the whole.
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as whole:
        assert whole.read() == b"".join(frames)


# URLs


def test_urls(spark):
    given = ["http://x.com/", "http://com/", "http://xcom/", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/", "http://example.com/en", "http://a.net/fr/x", "http://net/es/", "http://a.org/p/?b=2&a=1&ref=z#f", "http://m.a.org/p?a=1&b=2", "no scheme", None, "", "http://a.org?x", "http://B.org/q"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("a.org/p?a=1&b=2",), ("a.org/p?a=1&b=2",), ("",), (None,), ("other",)], "canonical string")
    for bound in (8_000_000, 0):  # blocks broadcast, or joined
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.apply(pages, listed, urls.RULES, broadcast_bytes=bound).collect()}
        assert len(got) == len(given)
        assert got[0] == ("x.com", "/", "com/", "allow") and got[1][2] == "com/" and got[2][2] is None
        assert got[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
        assert got[4][2:] == ("example.com/en/", "block") and got[5][2:] == ("com/", "allow")
        assert got[6][2:] == ("net/fr/", "block") and got[7][2:] == ("net/es/", "block")
        assert got[8] == ("a.org", "/p/", None, "block") and got[9][3] == "block"
        assert got[10] == got[11] == got[12] == ("", "", None, "allow")
        assert got[13] == ("a.org", "", None, "allow") and got[14][0] == "b.org"
    none = urls.apply(pages, listed.limit(0), urls.RULES)
    assert none.where("rule IS NULL AND verdict = 'block'").count() == 0
    assert urls.apply(pages.limit(0), listed, urls.RULES).count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("in"), "id").alias("canonical"))
    n = 2000 * 12 // 512 + 1
    blocks = urls.bloom(listed, n)
    others = listed.union(spark.range(20000).select(F.concat(F.lit("out"), "id")))
    tested = others.withColumn("block", urls._block(F.col("canonical"), n)).join(blocks, "block", "left")
    for i, b in enumerate(urls._bits("canonical")):
        tested = tested.withColumn(f"t{i}", F.coalesce(F.col(f"w{i}").bitwiseAND(b) != 0, F.lit(False)))
    hit = tested.where(" AND ".join(f"t{i}" for i in range(8)))
    assert hit.where("canonical LIKE 'in%'").count() == 2000
    assert hit.where("canonical LIKE 'out%'").count() < 1000


# Toxicity


def labelled(spark, n=600):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = list(rng.choice(plain, 60))
        if toxic:
            for _ in range(3):
                w[rng.integers(60)] = "vorq" + "".join(rng.choice(list("xyzuw"), 2))
        docs.append((i, " ".join(w) + ". And more.", "zz"))
        labels.append((i, int(toxic)))
    docs += [(n, None, "zz"), (n + 1, "", "zz"), (None, "abc", "zz"), (0, docs[0][1], "zz")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity.query(docs, labels).collect()
    assert len(got) == 604
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    right = sum(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.95
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_gapped_and_inserted_insults(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    margin = dict(zip(words := ["vorqxy", "vo.rqxz", "v-orqzu", "abcdefg", "vorqqzzy", ""], model.margins(words)))
    assert margin["vorqxy"] > 0 > margin["abcdefg"]
    assert min(margin["vo.rqxz"], margin["v-orqzu"], margin["vorqqzzy"]) > margin["abcdefg"]
    assert toxicity.units("a v o r q b") == ["avorqb"]


def test_insults_in_a_large_script():
    """Landmarks hold more than 250 characters, and the insults' are the last of them."""
    rng = np.random.default_rng(1)
    plain = ["".join(map(chr, rng.integers(0x4E00, 0x5600, rng.integers(5, 9)))) for _ in range(400)]
    insults = ["".join(map(chr, rng.integers(0xC000, 0xC100, 5))) for _ in range(4)]
    texts, labels = [], []
    for i in range(300):
        w = list(rng.choice(plain, 60))
        if i % 5 == 0:
            w[rng.integers(30)], w[30 + rng.integers(30)] = rng.choice(insults, 2)
        texts.append(" ".join(w))
        labels.append(int(i % 5 == 0))
    model = toxicity.train(texts, labels, 0.2)
    assert min(model.margins(insults)) > 0 > max(model.margins(plain))
    assert len(model.alphabet) > 250


def test_short_insults():
    """Of one, two and three letters, beside ordinary words as short."""
    rng = np.random.default_rng(2)
    plain = [*"abcd", *("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400))]
    insults = ["w", "zq", "xvy"]
    texts, labels = [], []
    for i in range(300):
        w = list(rng.choice(plain, 60))
        if i % 5 == 0:
            w[rng.integers(30)], w[30 + rng.integers(30)] = rng.choice(insults, 2)
        texts.append(" ".join(w))
        labels.append(int(i % 5 == 0))
    model = toxicity.train(texts, labels, 0.2)
    assert min(model.margins([*insults, "(zq)", "XVY!".lower()])) > 0 > max(model.margins([*plain, "", "..."]))


def test_training_is_not_the_drivers(spark, monkeypatch):
    """The driver's memory is small, and has the whole pipeline's plans; a worker trains and returns the model."""
    docs, labels = labelled(spark, 200)

    def here(sets):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(toxicity, "_one_of_copies", here)
    model = toxicity.fit(docs, labels)
    assert model.margins(["vorqxy"])[0] > 0 and model.weights.any()


def test_training_holds_a_word_once():
    """Beside the texts there are sets of shared words, not every word of every sentence by itself."""
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefgh"), rng.integers(4, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(plain, 3000)) + (" vorqxy" if i % 5 == 0 else "") for i in range(100)]
    tracemalloc.start()
    toxicity.train(texts, [int(i % 5 == 0) for i in range(100)], 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    for own in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.query(docs, own).collect()} == {0.0}
    assert toxicity.query(docs.limit(0), labels).count() == 0


# SQL and the pipeline


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(D):
        end = "/*.parquet" if os.path.isdir(f"{D}/{f}") else ""
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}{end}'")
    got, want = QUERIES[name](spark, D).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_pipeline(spark):
    """Every stage on what its predecessor kept, with effect; the last packs all that is left."""
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = pipeline.cut(stage(spark, docs, D), "test")
        assert docs.columns == columns, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] == sizes[4]
    assert docs.where("n_chars <> length(text)").count() == 0
    got = pipeline.run(spark, D)
    assert got.select("doc_id").distinct().count() == sizes[-1]
