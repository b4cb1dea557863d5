"""The rows of the whole pipeline against plain Python versions of its stages."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from test_other_operators import labelled
from test_text_operators import letters, spaced

CAPACITY, END = 2048, 1


def one_of_each(docs):
    """(doc_id, text): the smallest id of each component of 5-word shingle sets with a Jaccard index of 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := spaced(t)) else set() for _, t in docs]
    of = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    least = {}
    for (doc, _), c in zip(docs, of):
        least[c] = min(doc, least.get(c, doc))
    return [(d, t) for (d, t), c in zip(docs, of) if least[c] == d]


def without_repeats(docs):
    """Without repeated strings of 400 bytes and repeated passages of 51 words; split characters go."""
    data = [(t or "").encode() for _, t in docs]
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in data]
    strings = Counter(t[i : i + 400] for t in data for i in range(len(t) - 399))
    passages = Counter(tuple(t[a:b] for a, b in w[i : i + 51]) for t, w in zip(data, words) for i in range(len(w) - 50))
    out = []
    for (doc, text), t, w in zip(docs, data, words):
        gone = [False] * len(t)
        hit = {k for i in range(len(w) - 50) if passages[tuple(t[a:b] for a, b in w[i : i + 51])] > 1 for k in range(i, i + 51)}
        spans = [(i, i + 400) for i in range(len(t) - 399) if strings[t[i : i + 400]] > 1]
        spans += [(w[k][0], w[k + 1][0] if k + 1 in hit else w[k][1]) for k in hit]
        for a, b in spans:
            gone[a:b] = [True] * (b - a)
        at, kept = 0, []
        for c in text or "":
            size = len(c.encode())
            if not any(gone[at : at + size]):
                kept.append(c)
            at += size
        out.append((doc, text if text is None else "".join(kept)))
    return out


def without_benchmark(docs, items):
    """Without the stretches from the first to the last word of occurrences of the items' phrases of eight words (or fewer, if the item is)."""
    phrases = {tuple(w[i : i + 8]) for _, t in items for w in [letters(t)] if w for i in range(max(1, len(w) - 7))}
    out = []
    for doc, text in docs:
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        w = letters(text)
        hit = {(i, i + n) for n in {len(p) for p in phrases} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in phrases}
        spans = []
        for a, b in sorted(hit):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        for a, b in reversed(spans):
            text = text[: places[a][0]] + text[places[b - 1][1] :]
        out.append((doc, text))
    return out


def packed(docs):
    """(doc_id, start, length, crc32 of the ids) of each piece: whole sequences, then what fills a slot of 1 / m, or nearly."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    out = Counter()
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]
        start = 0
        while start < len(ids):
            left = len(ids) - start
            m = CAPACITY // left
            if left >= CAPACITY:
                size = CAPACITY
            elif m >= 32 or CAPACITY // m - left <= CAPACITY // m / 32:
                size = left
            else:
                size = CAPACITY // (m + 1)
            out[doc, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())] += 1
            start += size
    return out


def test_rows_of_the_pipeline(spark, rows, tmp_path):
    import corpus_pipeline as pipeline

    toxic, labels = labelled(spark)
    docs = [(r.doc_id, r.text) for r in toxic.where("doc_id < 600").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()]
    seen = set()
    for i, t in rows:
        if i is not None and i not in seen:
            seen.add(i)
            docs.append((1000 + i, t))
    rng = random.Random(3)
    shared = " ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(60))
    long = [" ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7))) for _ in range(n)) for n in (100, 100, 3000, 200)]
    docs += [(2000, f"{long[0]} {shared} one"), (2001, f"{long[1]} {shared} two"), (2002, long[2])]
    words = long[3].split()
    docs += [(2003, f"{long[3]}. {' '.join(words[:90])} é"), (2004, "x" * 400 + "é" + long[0][:60]), (2005, "x" * 400 + "è" + long[1][50:120])]
    items = [(1, " ".join(words[110:130])), (2, " ".join(long[2].split()[500:512])), (3, None), (None, long[2])]
    order = docs[:]
    rng.shuffle(order)
    d = str(tmp_path)
    spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in order], "doc_id long, text string, n_chars int").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    clean = [(i, t) for i, t in docs if "vorq" not in (t or "")]
    each = one_of_each(clean)
    left = without_repeats(each)
    end = without_benchmark(left, [x for x in items if x[0] is not None])
    assert len(docs) > len(clean) > len(each) and left != each and end != left  # every stage has something to do
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pipeline.run(spark, d).collect())
    assert got == packed(end)
