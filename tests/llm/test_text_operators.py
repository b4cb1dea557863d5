"""Each operator against a brute-force version, over nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.llm import decontamination, fingerprints, jaccard, licenses, likelihood, packing, repeats, suffixes, toxicity
from locusframe.llm.common import released, small_batches

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def letters(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER).decode())


def spaced(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))


def collected(df):
    return Counter(tuple(r) for r in df.collect())


# Decontamination


def test_decontamination(spark, docs, rows, none):
    w = letters(rows[0][1])
    items = [(1, " ".join(w[5:30])), (2, rows[3][1]), (3, "One two"), (10, " ".join(w[20:28])), (4, None), (None, rows[4][1]), (6, ""), (7, "zzz yyy xxx"), (2, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        own, hit, found = letters(text), set(), set()
        for item, t in items:
            if item is None or t is None:
                continue
            b = letters(t)
            for k in range(max(1, len(b) - 7) if b else 0):
                win = b[k : k + 8]
                for i in range(len(own) - len(win) + 1):
                    if own[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(str(item))
        return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2

    want = Counter((i, *brute(t)) for i, t in rows)
    assert collected(decontamination.query(docs, bench)) == want
    # A benchmark in blocks finds the same.
    got = decontamination.find(docs, bench, ["doc_id"], block_bytes=500)
    counts = Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got.collect())
    assert counts == Counter(k[:4] for k in want.elements())
    assert decontamination.query(none, bench).count() == 0
    assert decontamination.query(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    cleaned = decontamination.remove(docs, bench)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    clean = {(i, t) for i, t in rows if not brute(t)[1]}
    assert {(r.doc_id, r.text) for r in cleaned.collect()} >= clean


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    for _ in range(50):
        text = np.r_[rng.integers(1, 5, rng.integers(1, 80)), 0]
        index = decontamination.Index(text)
        phrase = rng.integers(1, 5, (6, 2))
        own, low, high = index.search(phrase)
        which, at = index.locate(low, high)
        got = sorted((own[k], int(p)) for k, p in zip(which, at))
        want = sorted((k, i) for k, p in enumerate(phrase) for i in range(len(text) - 1) if list(text[i : i + 2]) == list(p))
        assert got == want


# Licenses


def test_licenses(spark, none):
    texts = ["Under the MIT License.", "x under the mit license under the mit license", "the apache license, version 2 and CC BY-NC", None, "", "under the mit", "cc cc by nc nc", "under the mit licence",
             "This work is licensed under the GNU General Public License, version 3.", "licensed under the very apache license version 2.0 the license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])]
    got = collected(licenses.query(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    want = Counter()
    for i, t in rows:
        w, places, found = letters(t), [], set()
        for label, base, phrase in licenses.TEMPLATES:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p] if base else []
            places += at
            found |= {label} if at else set()
        want[i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))] += 1
    assert got == want
    more = {r.doc_id: (r.labels, r.score) for r in licenses.query(spark.createDataFrame(rows[:10], "doc_id long, text string")).collect()}
    assert more[8] == ("gpl", 1.0) and more[3] == ("", 0.0)
    assert licenses.query(none).count() == 0


# Repeats


def covered(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (doc, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [10**9, 0])
def test_repeats(docs, rows, none, hot):
    """hot: all anchors that differ go by suffix array, or all by counting."""
    got = repeats.remove(docs, hot_bytes=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert collected(got) == covered(rows, 400)
    assert repeats.query(none).count() == 0


def test_repeats_where_no_text_has_white_space(spark):
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh"), 900))
    rows = []
    for i in range(12):
        own = "".join(rng.choice(list("abcdefgh"), 1200))
        rows.append((i, own[:600] + shared[30 * i : 30 * i + 500] + own[600:]))
    got = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), words=51)
    assert collected(got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))) == covered(rows, 400)


def test_only_segments_with_a_common_core_are_sorted():
    """Over bytes and words, with and without white space: the same strings are found among fewer segments."""
    rng = np.random.default_rng(4)
    for alphabet, unit, length, find in (("abcdefgh ", np.uint8, 400, repeats.byte_segments), ("abcdefgh", np.uint8, 400, repeats.byte_segments), ("abcdefgh ", np.uint64, 51, repeats.word_segments)):
        symbols = np.frombuffer(alphabet.encode(), np.uint8).astype(unit)
        shared = rng.choice(symbols, 2 * length)
        texts = []
        for i in range(60):
            t = rng.choice(symbols, 4 * length)
            n = length // 3 if i % 4 else rng.integers(length, 2 * length)  # of what is shared, mostly less than a string
            low = rng.integers(0, 2 * length - n + 1)
            t[length : length + n] = shared[low : low + n]
            texts.append(t)
        bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        data = np.concatenate(texts)
        _, start, strings, anchor = find(data, bounds, length)
        anchor = anchor.view(np.uint64)
        _, same, count = np.unique(anchor, return_inverse=True, return_counts=True)
        own = np.flatnonzero(count[same] > 1)
        segments = [data[start[i] : start[i] + strings[i] + length - 1] for i in own]
        alike = repeats.may_repeat(segments, anchor[own], length)
        every = repeats.repeated(segments, [1] * len(own), length)
        some = iter(repeats.repeated([x for x, a in zip(segments, alike) if a], [1] * int(alike.sum()), length))
        for x, a in zip(every, alike):
            assert x.tolist() == (next(some).tolist() if a else [])
        assert 0 < sum(len(x) > 0 for x in every) <= alike.sum() < len(own)


def test_word_codes_keep_no_words():
    data = " ".join(f"word{i}" for i in range(50_000)).encode()
    repeats.word_codes(b"one")
    tracemalloc.start()
    assert len(repeats.word_codes(data)) == 400_000
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1e6


def test_without_repeats_keeps_columns_and_rows(docs, rows):
    got = repeats.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    assert got.where("doc_id = 73").first().text == "one"


def test_without_repeats_drops_split_characters(spark):
    """Shared bytes end, or begin, within a letter; what is left of two letters doesn't become a third one."""
    end, begin, both = (" ".join(f"{name}{k}" for k in range(80)) for name in ("end", "begin", "both"))
    texts = [f"one {end}é 1", f"tw{end}è 2", f"ré{begin} 3", f"rĩ{begin}, 4", f"aé{both}é 5", f"cũ{both}è 6"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in repeats.without_repeats(docs).collect()}
    assert got == dict(enumerate([("one  1", 6), ("tw 2", 4), ("r 3", 3), ("r, 4", 4), ("a 5", 3), ("c 6", 3)]))


@pytest.mark.parametrize("hot", [10**9, 0])
def test_removal_of_passages_by_words(spark, docs, rows, hot):
    """Passages of 51 words of any length go, those of 50 stay; white space doesn't matter, and goes between words that go."""
    letter = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    some = [letter[:51], letter[9:59], [x + "é" for x in letter[:51]]]
    more = [(100 + 10 * k + i, f"start{k}{i} {sep.join(p)}{sep}end{k}{i} more") for k, p in enumerate(some) for i, sep in enumerate((" ", " \n", " "))]
    more += [(200, "x " * 51), (201, "y " * 50)]  # repeats itself only where 52 words are
    every = [*rows, *more]
    texts = [(t or "").encode() for _, t in every]
    lists = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    runs = [[tuple(t[a:b] for a, b in at[i : i + 51]) for i in range(len(at) - 50)] for t, at in zip(texts, lists)]
    seen_words = Counter(x for own in runs for x in own)
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = Counter()
    for (doc, _), t, at, own in zip(every, texts, lists, runs):
        gone = [False] * len(t)
        hit = {k for i, x in enumerate(own) if seen_words[x] > 1 for k in range(i, i + 51)}
        between = [(at[k][0], at[k + 1][0] if k + 1 in hit else at[k][1]) for k in hit]
        for a, b in between + [(i, i + 400) for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1]:
            gone[a:b] = [True] * (b - a)
        want[doc, bytes(b for b, g in zip(t, gone) if not g)] += 1
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter((r.doc_id, bytes(r.kept)) for r in repeats.remove(both, hot_bytes=hot, words=51).collect())
    assert got == want
    kept = {r.doc_id: r.text for r in repeats.without_repeats(both).where("doc_id BETWEEN 100 AND 199").collect()}
    assert kept[100] == "start00  end00 more" and kept[101] == "start01  \nend01 more" and kept[122] == "start22  end22 more"
    assert all(kept[i] == dict(more)[i] for i in (110, 111, 112))


def test_induced_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = np.r_[rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), 0]
        want = sorted(range(len(text)), key=lambda i: list(text[i:]))
        assert suffixes.induced(text).tolist() == want == suffixes.by_doubling(text).tolist()


# Fingerprints


def test_fingerprints(spark, none):
    rows = [(i, f"document {i} has words and more words of {'its own ' * i}") for i in range(1, 9)] + [(20, ""), (21, None), (30, "é" * 10), (7, "seven again"), (None, "no id")]
    got = fingerprints.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        n, following = len(t) // 3, order[(k + 1) % len(order)][1]
        want[i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[20].fingerprint == by[21].fingerprint and by[21].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprints.query(none).count() == 0
    one = fingerprints.query(spark.createDataFrame([(1, "alone in the table")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_signature_against_a_plain_version(spark):
    """Every row: the two k-mers of least hash from its point on, in text order."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "longerthaneight", "é"], n)) for n in (1, 2, 3, 40, 500)] + ["", "one"]
    h = lambda *parts: F.xxhash64(*parts)
    pairs = {}
    words = [re.findall(r"\S{1,8}", t) for t in texts]
    every = sorted({(w[i], w[i + 1] if i + 1 < len(w) else None) for w in words for i in range(len(w))}, key=str)
    for r in spark.createDataFrame(every, "a string, b string").select("a", "b", h("a", "b").alias("h")).collect():
        pairs[r.a, r.b] = r.h >> 31
    again = {}
    need = {(pairs[w[i], w[i + 1] if i + 1 < len(w) else None], k) for w in words for i in range(len(w)) for k in range(1, len(w))} if words else set()
    need = sorted({(x, k) for x, k in need if k < 300})
    for r in spark.createDataFrame(need, "x long, k int").select("x", "k", h("x", "k").alias("h")).collect():
        again[r.x, r.k] = r.h >> 31
    tuples, per = {}, []
    for w in words:
        seen, own = Counter(), []
        for i in range(len(w)):
            x = pairs[w[i], w[i + 1] if i + 1 < len(w) else None]
            own.append((again[x, seen[x]] if seen[x] else x, i))
            seen[x] += 1
        own.sort()
        rows = []
        for j in range(32):
            point = (-(1 << 63) + j * (1 << 59)) >> 31
            first = sum(x < point for x, _ in own)
            taken = sorted((own[(first + k) % len(own)] for k in range(2)), key=lambda t: t[1]) if own else []
            rows.append(tuple(x & (1 << 33) - 1 for x, _ in taken))
        per.append(rows)
        tuples |= dict.fromkeys(rows)
    listed = sorted(tuples)
    hashed = [r[0] for r in spark.createDataFrame([(i, list(t)) for i, t in enumerate(listed)], "i int, t array<bigint>").orderBy("i").select(F.xxhash64("t").bitwiseAND(0xFFFFFFFF)).collect()]
    of = dict(zip(listed, hashed))
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fingerprints.signature(F.col("t"))).collect()]
    empty = spark.range(1).select(F.xxhash64(F.array(F.lit(None).cast("long"), F.lit(None).cast("long"))).bitwiseAND(0xFFFFFFFF)).first()[0]
    assert got == [[of[x] if x else empty for x in rows] for rows in per]


def test_fingerprints_are_sensitive_to_order_and_repetition(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    halves = " ".join(a.split()[7:] + a.split()[:7])
    rows = [(a, a), (a, halves), (a, a + " end"), ("x y " * 50, "x y " * 20)]
    like = fingerprints.likeness(fingerprints.signature(F.col("a")), fingerprints.signature(F.col("b")))
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(like).collect()]
    assert got[0] == 1.0 and got[1] < got[2] < 1.0 and got[3] < 1.0


# Jaccard join


def classes(rows):
    sets = []
    for _, t in rows:
        w = spaced(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[find(i)] = find(j)
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and rows[j][0] is not None]
        out[doc, len(sets[i]), min(ids, default=None) if sets[i] else doc] += 1
    return out


def test_jaccard(docs, rows, none):
    assert collected(jaccard.query(docs)) == classes(rows)
    assert jaccard.query(none).count() == 0


@pytest.mark.parametrize("weight", [10**6, 200])
def test_jaccard_in_blocks(docs, rows, weight):
    """Neighbourhoods larger than a block are parted, and no link is lost."""
    found, edges = jaccard.links(docs, block=2, weight=weight)
    of = {r.node: r.component for r in jaccard.components(edges).collect()}
    by = {}
    for r in found.where("cls IS NOT NULL AND doc_id IS NOT NULL").collect():
        by.setdefault(of.get(r.cls, r.cls), set()).add(r.doc_id)
    want = {}
    for (doc, n, component), _ in classes(rows).items():
        if n and doc is not None:
            want.setdefault(component, set()).add(doc)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("few", [0, 100])
def test_components(spark, few):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    of = {r.node: r.component for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert set(of) == set(label) - lone
    assert all((of[x] == of[y]) == (label[x] == label[y]) for x in of for y in of)


def test_prefix_tree_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.choice(60, 30, replace=False)
        sets = {tuple(sorted(np.r_[base[rng.random(30) > 0.1], rng.choice(200, rng.integers(0, 4))])) for _ in range(25)}
        sets = [np.unique(np.array(s, np.uint64)) for s in sets]
        got = jaccard.linked(sets)
        group = list(range(len(sets)))

        def find(x, group=group):
            while group[x] != x:
                x = group[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    group[find(i)] = find(j)
        same = lambda f: {frozenset(k for k in range(len(sets)) if f(k) == f(i)) for i in range(len(sets))}
        assert same(lambda k: got[k]) == same(find)


def test_one_of_each(docs, rows):
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert max(kept.values()) == 1
    per = {}
    for (doc, n, component), k in classes(rows).items():
        per.setdefault(component if n else ("empty", doc), []).append(doc)
    ids = {doc for doc, _ in kept}
    assert ids == {c[1] if isinstance(c, tuple) else c for c in per}


# Likelihood


def spellings(word, names, logp):
    """Natural log of the sum over all ways to spell a word."""
    text = "▁" + word
    ways = [0.0] * (len(text) + 1)
    ways[0] = 1.0
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 20), j):
            piece = text[i:j]
            if piece in names and "▁" not in piece[1:]:
                ways[j] += ways[i] * np.exp(logp[names[piece]])
        if ways[j] == 0:
            ways[j] = ways[j - 1] * np.exp(sum(logp[names[f"<0x{b:02X}>"]] for b in text[j - 1].encode()))
    return np.log(ways[-1]) if ways[-1] > 0 else -np.inf


def test_likelihood(spark, docs, rows, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for t in train for w in [*spaced(t), b""])
    n, v, escape = sum(c.values()), len(c), (sum(k == 1 for k in c.values()) + 1) / (sum(c.values()) + 1)
    lattice = likelihood.adapted(likelihood.Lattice.load(path), spark.createDataFrame([(bytearray(w), k) for w, k in c.items()], "word binary, c long"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {model.id_to_piece(i): i for i in range(model.get_piece_size())}
    short = {w for _, t in rows for w in [*spaced(t), b""] if len(w) < 100}
    log10_p = {w: (lattice.logp[lattice.end] if not w else spellings(w.decode(), names, lattice.logp)) for w in short}
    log10_p = {w: np.log10((1 - escape) * c[w] / n + escape * np.exp(p)) if c[w] else np.log10(escape) + p / np.log(10) for w, p in log10_p.items()}
    for hot in (1 << 18, 5):
        got = likelihood.score(docs, path, hot=hot).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == Counter((i, len(spaced(t)) + 1, sum(c[w] > 0 for w in [*spaced(t), b""]), n) for i, t in rows)
        base = sorted(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*spaced(t), b""]) for _, t in rows)
        assert np.allclose(sorted(r.base_score for r in got), base)
        assert all(r.score < 0 for r in got)
        want = {i: sum(log10_p[w] for w in [*spaced(t), b""]) for i, t in rows if i is not None and all(w in short for w in spaced(t))}
        by = {r.doc_id: r.score for r in got}
        assert len(want) > 30 and all(by[i] == pytest.approx(x) for i, x in want.items())
    assert likelihood.query(none).count() == 0
    # Without training documents, pieces alone.
    alone = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = likelihood.query(spark.createDataFrame([(i, "some words here") for i in alone], "doc_id long, text string")).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)} and all(np.isfinite(r.score) for r in got)


def test_lattice_sums_all_segmentations():
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=path), likelihood.Lattice.load(path)
    names = {model.id_to_piece(i): i for i in range(model.get_piece_size())}

    def brute(word):
        text = "▁" + word
        ways = [0.0] * (len(text) + 1)
        ways[0] = 1.0
        for j in range(1, len(text) + 1):
            for i in range(j):
                piece = text[i:j]
                if piece in names and "▁" not in piece[1:]:
                    ways[j] += ways[i] * np.exp(own.logp[names[piece]])
            if ways[j] == 0:
                ways[j] = ways[j - 1] * np.exp(sum(own.logp[names[f"<0x{b:02X}>"]] for b in text[j - 1].encode()))
        return np.log(ways[-1])

    tests = ["the", "tokenization", "x", "日本", "ab͸c", "zzzzzz"]
    expected = np.zeros(len(own.logp))
    got = own.words(tests, np.ones(len(tests)), expected)
    assert np.allclose(got, [brute(w) for w in tests])
    assert expected.sum() >= len(tests)


# Packing


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(model.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=256).collect()
    pieces, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    # Documents without repeated ids are put together exactly; all ids are there.
    assert sorted(i for p in pieces.values() for _, ids in p for i in ids) == sorted(i for w in want for i in w)
    by_id = {}
    for (doc, _), p in pieces.items():
        by_id.setdefault(doc, []).extend(p)
    texts = {i: t for i, t in rows if i is not None and i != 5}
    for doc, t in texts.items():
        assert [i for _, ids in sorted(by_id[doc]) for i in ids] == model.encode(t or "", add_special_tokens=False).ids + [1]
    assert packing.query(none).count() == 0


def test_a_worker_forgets_its_encoder_at_another_operators_task(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    score = toxicity.scorer(docs, toxicity.train([], [], 0.5)).func
    others = [released(lambda frames: frames), lambda frames: score(pd.Series(["one"]) for _ in frames)]
    for task in others:
        kept = weakref.ref(packing.encoder(path))
        assert packing.encoder(path) is kept()  # its own tasks go on with it
        list(task(iter([0])))
        assert kept() is None


def test_batches_of_long_texts_are_small(spark):
    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"n": [sum(map(len, f["text"]))]})

    small_batches(spark)
    docs = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("a text of ten words "), 2500).alias("text"))
    got = [r.n for r in docs.mapInPandas(sizes, "n long").collect()]
    assert sum(got) == 300 * 50_000 and max(got) <= 5_000_000


def test_cuts_cover_every_length():
    for n in range(1, 5000):
        got = packing.cuts(n, 2048, 32, 1 / 32)
        assert sum(got) == n and max(got) <= 2048 and min(got) > 0


def test_chunks_tokenize_like_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, own = Tokenizer.from_file(path), packing.Encoder(path, most=3)
    texts = ["It's  a TEST, isn't it?", "naïve İstanbul ΟΔΟΣ. ΟΔΟΣ", "a.\x1c.b ́c", "x" * 500, "don't... stop!!", "１２３ ①②", "tab\tnew\nline x y", "", "İ İ i", "é. é"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]
