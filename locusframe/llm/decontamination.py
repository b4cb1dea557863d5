"""Benchmark decontamination with an FM-index for each training shard.

A shard, some megabytes of documents, is indexed over its words: words that no benchmark
item has become gaps, gaps and stretches too short for any phrase collapse, and the
Burrows-Wheeler transform of what is left goes into a wavelet matrix.  The benchmark's
phrases are searched backward, all at once, by ranks in the matrix; occurrences are located
by walking to the next sampled suffix position.  What they cover is merged into removal
spans.

Documents never move: the phrases come to them, as a broadcast whose size is checked.  A
benchmark beyond ``block_bytes`` is taken in blocks, one pass over the documents for each,
with the spans so far kept in a table between passes.

Null and empty texts have no words; null items, and items without an id, have no phrases.
Items that repeat an id count once.  Repeated documents are judged each.  A very long
document is a shard of its own.  Columns with the names of results are replaced, others are
kept if asked for.  An empty benchmark finds nothing.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERING, cut, letter_words, pieces, released, small_batches
from .suffixes import by_doubling

WINDOW, SAMPLE = 8, 16
RESULTS = "n_words long, n_hit long, spans array<struct<first:long,end:long>>, items array<string>"
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
END, GAP = 0, 1


class Phrases:
    """The windows of benchmark items, by length, as rows of word ids (2 and up), and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 2) for w in letter_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i : i + window])].add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in {len(w) for w in owners}:
            own = [w for w in owners if len(w) == n]
            self.by_length[n] = (np.array(own, np.int64), [sorted(owners[w]) for w in own])
        self.shortest = min(self.by_length, default=0)


class Index:
    """FM-index of a text over small non-negative integers that ends with END."""

    def __init__(self, text: np.ndarray):
        order = by_doubling(text)
        bwt = text[order - 1]
        self.size = len(text)
        self.levels = max(1, int(text.max()).bit_length())
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=1 << self.levels))]
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.bits.append(bit)
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(self.size - int(self.ones[-1][-1]))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.starts = np.zeros(1 << self.levels, np.int64)  # where a symbol begins below the last level
        symbols, first = np.unique(bwt, return_index=True)
        self.starts[symbols] = first
        sampled = order % SAMPLE == 0
        self.sampled, self.nth, self.positions = sampled, np.r_[0, np.cumsum(sampled)], order[sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i places of the transform."""
        begin = np.zeros_like(i)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1
            ones = self.ones[k]
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
            begin = np.where(one, self.zeros[k] + ones[begin], begin - ones[begin])
        return i - begin

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one place further left."""
        i, symbol = rows, np.zeros_like(rows)
        for k in range(self.levels):
            one = self.bits[k][i]
            symbol = symbol * 2 + one
            i = np.where(one, self.zeros[k] + self.ones[k][i], i - self.ones[k][i])
        return self.before[symbol] + i - self.starts[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high): the rows of those that occur."""
        own = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[own, k]
            known = symbol < len(self.before) - 1
            own, low, high, symbol = own[known], low[known], high[known], symbol[known]
            low, high = self.before[symbol] + self.rank(symbol, low), self.before[symbol] + self.rank(symbol, high)
            some = low < high
            own, low, high = own[some], low[some], high[some]
        return own, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which range, position) of each row of the ranges."""
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.positions[self.nth[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            rows, steps = self.back(rows) if len(rows) else rows, steps + 1
        return which, out


def occurrences(docs: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """(document, first word, end word, items) of each occurrence in a shard."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # a gap after each document
    text = np.full(int((sizes + 1).sum()), GAP, np.int64)
    for d, at in zip(docs, starts):
        text[at : at + len(d)] = np.fromiter(map(phrases.ids.get, d, repeat(GAP)), np.int64, len(d))
    # Stretches of known words, without those too short for any phrase; one gap stands for all between them.
    known = np.r_[False, text != GAP, False]
    begin, end = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    long_enough = end - begin >= max(1, phrases.shortest)
    begin, end = begin[long_enough], end[long_enough]
    none = (np.zeros(0, np.int64),) * 3
    if not len(begin) or not phrases.by_length:
        return *none, []
    keep = np.zeros(len(text) + 1, np.int64)
    np.add.at(keep, begin, 1)
    np.add.at(keep, end, -1)
    place = np.flatnonzero((np.cumsum(keep)[:-1] > 0) | np.isin(np.arange(len(text)), end))
    index = Index(np.r_[text[place], END])
    firsts, ends, items = [], [], []
    for n, (rows, owners) in phrases.by_length.items():
        own, low, high = index.search(rows)
        which, at = index.locate(low, high)
        firsts.append(place[at])
        ends.append(place[at] + n)
        items += [owners[own[w]] for w in which]
    first, end_ = np.concatenate(firsts), np.concatenate(ends)
    doc = np.searchsorted(starts, first, "right") - 1
    return doc, first - starts[doc], end_ - starts[doc], items


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD_BYTES.finditer(data.translate(LOWERING))]
    out, at = [], 0
    for first, end in spans:
        out.append(data[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def find(docs: DataFrame, benchmark: DataFrame, columns: list[str], remove: bool = False, shard: int = 4_000_000, block_bytes: int = 16_000_000) -> DataFrame:
    """``columns`` of the documents, with n_words, n_hit (words in some occurrence), spans (of words, merged) and items (ids, as strings).

    remove: text loses its spans, and n_chars, if there, is counted anew.  shard: characters
    of text in an index.  block_bytes: of benchmark text in a pass.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    state = ["_spans", "_items"]
    fields = [docs.schema[c] for c in dict.fromkeys([*columns, "text"])]
    got = docs.select(*[f.name for f in fields], F.array().cast("array<struct<first:long,end:long>>").alias("_spans"), F.array().cast("array<string>").alias("_items"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    for block in range(blocks):
        last = block == blocks - 1
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # a block at a time
        shared = spark.sparkContext.broadcast(Phrases([(r.item_id, r.text) for r in rows]))
        kept = columns if last else list(dict.fromkeys([*columns, "text"]))
        kept = [c for c in kept if not last or c not in ("n_words", "n_hit", "spans", "items")]

        def run(frames: Iterator[pd.DataFrame], shared=shared, last=last, kept=kept) -> Iterator[pd.DataFrame]:
            phrases = shared.value
            for part in pieces(frames, "text", shard):
                words = [letter_words(t) for t in part["text"]]
                doc, first, end, owners = occurrences(words, phrases)
                spans = [[(s["first"], s["end"]) for s in own] for own in part["_spans"]]
                found = [set(own) for own in part["_items"]]
                for d, a, b, who in zip(doc.tolist(), first.tolist(), end.tolist(), owners):
                    spans[d].append((a, b))
                    found[d].update(who)
                spans = [_merged(s) for s in spans]
                out = part[kept].copy()
                if last:
                    out["n_words"] = [len(w) for w in words]
                    out["n_hit"] = [sum(b - a for a, b in s) for s in spans]
                    if remove:
                        cut_rows = [i for i, s in enumerate(spans) if s]
                        texts = part["text"].tolist()
                        for i in cut_rows:
                            texts[i] = without(texts[i], spans[i])
                        out["text"] = texts
                        if "n_chars" in out:
                            sizes = out["n_chars"].tolist()
                            for i in cut_rows:
                                sizes[i] = len(texts[i])
                            out["n_chars"] = pd.array([None if pd.isna(x) else int(x) for x in sizes], "Int64")
                names = ("spans", "items") if last else state
                out[names[0]] = [[{"first": a, "end": b} for a, b in s] for s in spans]
                out[names[1]] = [sorted(f) for f in found]
                yield out

        types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
        got = got.mapInPandas(released(run), f"{types}, {RESULTS}" if last else f"{schema}, _spans array<struct<first:long,end:long>>, _items array<string>")
        if not last:
            got = cut(got, "decontamination")
    return got


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = find(docs, benchmark, ["doc_id"])
    n_items = F.size("items").cast("long")
    return got.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, each without what it shares with the benchmark."""
    return find(docs, benchmark, docs.columns, remove=True).select(*docs.columns)


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i + 1:i + 8], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 7))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT w.rid, n.n, p.i, array_to_string(w.w[p.i + 1:p.i + n.n], ' ') AS phrase
  FROM w, (SELECT DISTINCT n FROM bw) AS n, LATERAL (SELECT unnest(range(greatest(0, len(w.w) - n.n + 1))) AS i) AS p),
hits AS (SELECT DISTINCT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY rid)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items.items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items.items, ','), '')) AS items_sha256, coalesce(len(items.items), 0) >= 2 AS contaminated
FROM w LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
