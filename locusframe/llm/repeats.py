"""Removal of repeated byte strings by suffix arrays of shards.

Every string of ``length`` bytes has an anchor: its 32-gram of smallest hash, among those that
begin with white space if it has any.  Equal strings have equal anchors at equal offsets, so
strings need to be compared only where anchors are equal.  A run of strings with the same
anchor is a segment; segments whose anchor stands nowhere else are done.  Equal segments are
counted, not compared.  What is left, segments that share an anchor and differ, is gathered
into shards by anchor.  Those that share what surrounds the anchor with no other are done
too; of the rest of a shard the suffix array is built by induced sorting (suffixes.induced),
and a string is repeated if its permuted common prefix with a neighbour in that order is as
long as the string.

An anchor whose differing segments exceed ``hot_bytes`` is no shard's: its strings are parted
by the bytes that all strings of one cell of 32 offsets share, and where these agree but the
cells differ, string by string; all of that is counting, spread over all workers.

Segments are equal if their anchors' hashes and their own agree, 127 bits; cells and strings
of hot anchors likewise.  In shards, bytes are compared.

Passages of a number of words, however short the words, are found in the same way, with the
64-bit hash of a word for a byte.

Null texts are empty and keep nothing; texts shorter than the length stay as they are.
Repeated rows are documents that repeat each other.  Very long texts are taken in windows of
eight megabytes, which changes nothing in the result.  Other columns are kept unless they
have the name of a result.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .common import cut, drop, joined_evenly, pieces, released, small_batches, text_key

GRAM, CELL = 32, 32
STRETCHES = 8  # of offsets of an anchor in its strings
WORDS, WORD_GRAM = 51, 5  # least words of a passage, words of its anchor
_BITS = 24  # of a place in a chunk
CHUNK = 8_000_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M[0]
    return h ^ (h >> np.uint64(32))


def byte_grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash, an even one, of the 32 bytes from each place on."""
    parts = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at].view("<u8")
    h = np.zeros(len(at), np.uint64)
    for k in range(4):
        h = _mixed(h * _M[4] + parts[:, k] * _M[k + 1])
    return h & ~np.uint64(1)


def word_grams(codes: np.ndarray) -> np.ndarray:
    """An odd hash of the five words from each one on."""
    h = np.zeros(max(0, len(codes) - WORD_GRAM + 1), np.uint64)
    for k in range(WORD_GRAM):
        h = _mixed(h * _M[4] + codes[k : k + len(h)] * _M[1])
    return h | np.uint64(1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _keys(h: np.ndarray) -> np.ndarray:
    """Hashes over their places, the first of equal ones least."""
    return (h >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(h), dtype=np.uint64)


def _places(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)


_Segments = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_NONE: _Segments = (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))


def _runs_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, h: np.ndarray) -> _Segments:
    """Segments from ranges of starts, in order: neighbouring ones of a document with the same anchor are one."""
    if not len(doc):
        return _NONE
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != end[:-1])])
    last = np.r_[new[1:], len(doc)] - 1
    return doc[new], start[new], end[last] - start[new], h[new]


def byte_segments(data: np.ndarray, bounds: np.ndarray, length: int) -> _Segments:
    """(document, start in the data, strings, anchor) of each segment.  bounds: where documents begin, and the end."""
    reach = length - GRAM
    found = []
    for at in range(0, max(1, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        space = _SPACE[part]
        space[len(part) - GRAM + 1 :] = False
        place = np.flatnonzero(space)
        # Starts at which the grams in reach change, and those of documents.
        change = np.zeros(n, bool)
        change[0] = True
        for p in (place + 1, place - reach, bounds[:-1] - at):
            change[p[(p >= 0) & (p < n)]] = True
        start = np.flatnonzero(change)
        end = np.r_[start[1:], n]
        doc = np.searchsorted(bounds, start + at, "right") - 1
        end = np.minimum(end, bounds[doc + 1] - at - length + 1)
        some = end > start
        start, end, doc = start[some], end[some], doc[some]
        count = np.r_[0, np.cumsum(space)]
        low, high = count[start], count[start + reach + 1]
        h = byte_grams(part, place)
        tables = [_keys(h)]
        widest = int((high - low).max(initial=0))
        while 2 << (len(tables) - 1) <= widest:
            x, span = tables[-1], 1 << (len(tables) - 1)
            tables.append(np.r_[np.minimum(x[:-span], x[span:]), x[len(x) - span :]])
        have = high > low
        owner, anchor = np.full(len(start), -1), np.zeros(len(start), np.uint64)
        level = np.zeros(len(start), np.int64)
        level[have] = np.log2(high[have] - low[have]).astype(np.int64)
        for k in range(len(tables)):
            own = np.flatnonzero(have & (level == k))
            if len(own):
                which = _places(np.minimum(tables[k][low[own]], tables[k][high[own] - (1 << k)]))
                owner[own], anchor[own] = place[which], h[which]
        got = _runs_of(doc[have], start[have], end[have], owner[have], anchor[have])
        found.append((got[0], got[1] + at, *got[2:]))
        # Stretches without white space in reach: all grams count.
        bare = _runs_of(doc[~have], start[~have], end[~have], owner[~have], anchor[~have])
        for d, first, strings in zip(*(x.tolist() for x in bare[:3])):
            h = byte_grams(part, np.arange(first, first + strings + reach))
            owner = _places(_least(_keys(h), reach + 1))
            begin = first + np.arange(strings)
            got = _runs_of(np.full(strings, d), begin, begin + 1, owner, h[owner])
            found.append((got[0], got[1] + at, *got[2:]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else _NONE


def word_segments(codes: np.ndarray, bounds: np.ndarray, length: int) -> _Segments:
    """The same over words."""
    found = []
    for at in range(0, max(1, len(codes) - length + 1), CHUNK):
        part = codes[at : at + CHUNK + length - 1]
        if len(part) < length:
            break
        h = word_grams(part)
        owner = _places(_least(_keys(h), length - WORD_GRAM + 1))
        start = np.arange(len(owner))
        doc = np.searchsorted(bounds, start + at, "right") - 1
        inside = start + at + length <= bounds[doc + 1]
        got = _runs_of(doc[inside], start[inside], start[inside] + 1, owner[inside], h[owner[inside]])
        found.append((got[0], got[1] + at, *got[2:]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else _NONE


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_codes(data: bytes) -> bytes:
    """Eight bytes for each word (what stands between white space of ASCII)."""
    import xxhash

    return b"".join(map(xxhash.xxh3_64_digest, data.split()))  # a hash costs less than to look it up


def _word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8)
    word = np.r_[False, ~_SPACE[x], False]
    return np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])


def _merged(spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for a, b in sorted(spans_):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("_key", text_key(F.col("text")))


def _occurrences(docs: DataFrame, length: int, words: int) -> DataFrame:
    """(doc, key, start, strings, h, s) of all segments; h is even for bytes and odd for words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashed = xxhash.xxh3_64_intdigest
        for part in pieces(frames, "text", 2_000_000):
            own = [_bytes(t) for t in part["text"]]
            kinds = [(own, np.uint8, length, byte_segments)]
            if words:
                kinds.append(([word_codes(x) for x in own], np.uint64, words, word_segments))
            for texts, unit, n, segments in kinds:
                size = np.dtype(unit).itemsize
                data = np.frombuffer(b"".join(texts), unit)
                bounds = np.r_[0, np.cumsum([len(x) // size for x in texts])].astype(np.int64)
                doc, start, strings, anchor = segments(data, bounds, n)
                view = memoryview(data).cast("B")
                content = _signed([hashed(view[a:b]) for a, b in zip((start * size).tolist(), ((start + strings + (n - 1)) * size).tolist())])
                yield pd.DataFrame({"doc": part["_doc"].to_numpy()[doc], "key": part["_key"].to_numpy()[doc], "start": start - bounds[doc], "strings": strings, "h": anchor.view(np.int64), "s": content})

    least = min(length, 2 * words - 1) if words else length
    long_enough = docs.where(F.octet_length("text") >= least).select("_doc", "_key", "text")
    return long_enough.mapInPandas(released(run), "doc long, key long, start long, strings long, h long, s long")


def _fetched(docs: DataFrame, needed: DataFrame, length: int, words: int) -> DataFrame:
    """needed (h, s, n, doc, key, start, strings) with the bytes, or codes of words, of each segment; texts are read once."""
    fields = ["h", "s", "n", "start", "strings"]
    lists = needed.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct(*fields)).alias("needs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        got: list[bytes] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts)] + [pa.array(got, pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, ["h", "s", "n", "doc", "key", "start", "data"])
            parts.clear()
            got.clear()
            return out

        for batch in batches:
            needs, texts = batch.column("needs"), batch.column("text")
            ends, rows = needs.offsets.to_numpy(), needs.values
            columns = [rows.field(c).to_numpy(zero_copy_only=False) for c in fields]
            docs_, keys = batch.column("_doc").to_pylist(), batch.column("_key").to_pylist()
            for i, (doc, key) in enumerate(zip(docs_, keys)):
                h, s, n, start, strings = (x[ends[i] : ends[i + 1]] for x in columns)
                data, odds = _bytes(texts[i].as_py()), (h & 1).tolist()
                codes = word_codes(data) if any(odds) else b""
                own = [codes[8 * a : 8 * (b + words - 1)] if odd else data[a : b + length - 1] for odd, a, b in zip(odds, start.tolist(), (start + strings).tolist())]
                got += own
                parts.append((h, s, n, np.full(len(h), doc), np.full(len(h), key), start))
                size += sum(map(len, own))
                if size > 4_000_000:
                    size = 0
                    yield batch_of()
        if parts:
            yield batch_of()

    return docs.select("_doc", "_key", "text").join(lists, ["_doc", "_key"]).mapInArrow(released(run), "h long, s long, n long, doc long, key long, start long, data binary")


def may_repeat(segments_: list[np.ndarray], anchors: np.ndarray, length: int) -> np.ndarray:
    """True for segments that may have a string of another one (of all different ones of their anchors).

    Strings whose anchor is at offsets of one stretch have a core in common, which holds the
    anchor; where one of them stands again, so does the core.
    """
    import xxhash

    hashed = xxhash.xxh3_64_intdigest
    own = np.concatenate(segments_)
    size = np.array([len(x) for x in segments_])
    ends = np.cumsum(size)
    starts = ends - size
    at = np.full(len(size), -1)
    gram = GRAM if own.dtype == np.uint8 else WORD_GRAM

    def find(place: np.ndarray) -> None:
        of = np.searchsorted(ends, place, "right")
        inside = place + gram <= ends[of]
        place, of = place[inside], of[inside]
        h = byte_grams(own, place) if gram == GRAM else word_grams(own)[place]
        hit = np.flatnonzero(h == anchors[of])[::-1]
        at[of[hit]] = place[hit]  # the first place of several, as in the segment's strings

    if gram == GRAM:
        find(np.flatnonzero(_SPACE[own]))
    find(np.flatnonzero(np.repeat(at < 0, size)))
    out = at < 0
    view = memoryview(own).cast("B")
    unit = own.itemsize
    step = -(-(length - gram + 1) // STRETCHES)
    for low in range(0, length - gram + 1, step):
        high = min(low + step - 1, length - gram)
        which = np.flatnonzero((at - starts >= low) & (at - (ends - length) <= high) & (at >= 0))
        first = (at[which] - low) * unit
        core = np.array([hashed(view[a : a + (length - high + low) * unit]) for a in first.tolist()], np.uint64)
        _, same, count = np.unique(_mixed(core + _M[1] * anchors[which]), return_inverse=True, return_counts=True)
        out[which] |= count[same] > 1
    return out


def repeated(segments_: list[np.ndarray], weights: list[int], length: int) -> list[np.ndarray]:
    """For each segment, the starts of its strings that some segment has once more; a segment of weight over 1 stands for several."""
    size = np.array([len(x) for x in segments_])
    starts = np.r_[0, np.cumsum(size + 1)].astype(np.int64)
    own = np.concatenate(segments_)
    symbols = own.astype(np.int32) if own.dtype == np.uint8 else np.unique(own, return_inverse=True)[1]
    text = np.ones(starts[-1] + 1, np.uint16 if symbols.max(initial=0) < 65_000 else np.int32)
    text[-1] = 0
    text[np.arange(len(own)) + np.repeat(np.arange(len(size)), size)] = symbols + 2
    prefix, before = suffixes.common_prefixes(text, suffixes.induced(text))
    # Where as much is common, neither string crosses the end of its segment: whole ones only are asked for.
    ends = np.repeat(starts[1:] - 1, size + 1)
    rows = np.flatnonzero((prefix[:-1] >= length) & (np.arange(len(text) - 1) + length <= ends))
    hit = np.zeros(len(text), bool)
    hit[rows] = hit[before[rows]] = True
    return [np.arange(n - length + 1) if w > 1 else np.flatnonzero(hit[a : a + n]) for n, w, a in zip(size.tolist(), weights, starts.tolist())]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(first byte, end) of the bytes that strings with these sorted starts cover, adjoining runs of starts apart."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, np.diff(starts) > 1])
    return [(int(a), int(b) + length) for a, b in zip(starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]])]


SPAN = "doc long, key long, start long, end long, odd boolean"


def spans(docs: DataFrame, length: int, shard_bytes: int, hot_bytes: int, words: int = 0) -> DataFrame:
    """(doc, key, start, end, odd): what repeated strings cover, of documents as of keyed(): bytes, or (odd) words."""
    spark = docs.sparkSession
    small_batches(spark)
    found = cut(_occurrences(docs, length, words), "segments")
    total = found.count()
    anchors = cut(found.groupBy("h").agg(F.count("*").alias("n"), (F.min("s") != F.max("s")).alias("mixed")).where("n > 1"), "anchors")
    shared = cut(joined_evenly(found, anchors, ["h"], "inner", total).drop("n"), "shared")
    drop(found, anchors)
    odd = (F.col("h") % 2 != 0).alias("odd")
    reach = F.col("start") + F.col("strings") + F.when(F.col("h") % 2 != 0, words - 1).otherwise(length - 1)
    covered = ["doc", "key", "start", reach.alias("end"), odd]
    out = [shared.where("NOT mixed").select(*covered)]
    mixed = shared.where("mixed").drop("mixed")
    first = F.min(F.struct("doc", "key", "start", "strings"))
    distinct = cut(mixed.groupBy("h", "s").agg(F.count("*").alias("n"), first.alias("at")).select("h", "s", "n", "at.*"), "distinct")
    several = distinct.where("n > 1").select("h", "s", "n")
    out.append(joined_evenly(mixed, several, ["h", "s"], "left_semi", total).select(*covered))
    used = [shared, distinct]
    weight = F.when(F.col("h") % 2 != 0, 8 * (F.col("strings") + words)).otherwise(F.col("strings") + length)
    sizes = distinct.groupBy("h").agg(F.sum(weight).alias("bytes"))
    totals = sizes.agg(F.sum(F.when(F.col("bytes") <= hot_bytes, F.col("bytes"))).alias("bytes"), F.count(F.when(F.col("bytes") > hot_bytes, 1)).alias("hot")).first()
    if totals.bytes or totals.hot:

        def order(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.drop_duplicates(["h", "s"])
            rows = []
            for odd, own in frame.groupby(frame["h"] & 1):
                n = words if odd else length
                data = [np.frombuffer(x, np.uint64 if odd else np.uint8) for x in own["data"]]
                alike = np.flatnonzero(may_repeat(data, own["h"].to_numpy().view(np.uint64), n))
                if not len(alike):
                    continue
                own = own.iloc[alike]
                got = repeated([data[i] for i in alike], own["n"].tolist(), n)
                for doc, key, start, copies, at in zip(own["doc"], own["key"], own["start"], own["n"], got):
                    if copies == 1:
                        rows += [(doc, key, start + a, start + b, bool(odd)) for a, b in _runs(at, n)]
            return pd.DataFrame(rows, columns=["doc", "key", "start", "end", "odd"])

        data = _fetched(docs, distinct, length, words)
        ordinary = data
        if totals.hot:
            data = cut(data, "bytes")
            hot = cut(sizes.where(F.col("bytes") > hot_bytes).select("h"), "hot")
            used += [data, hot]
            hot_data = data.join(hot, "h", "left_semi")
            for odd_, n in ((0, length), (1, words)):
                if n:
                    out.append(_hot_spans(hot_data.where(F.abs(F.col("h") % 2) == odd_), n, bool(odd_), used))
            ordinary = data.join(hot, "h", "left_anti")
        n_shards = max(1, math.ceil((totals.bytes or 0) / shard_bytes))
        out.append(ordinary.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(n_shards))).groupBy("shard").applyInPandas(order, SPAN))
    spans_ = out[0]
    for x in out[1:]:
        spans_ = spans_.unionByName(x)
    got = cut(spans_, "spans")
    drop(*used)
    return got


def _hot_spans(segments_: DataFrame, length: int, odd: bool, used: list[DataFrame]) -> DataFrame:
    """Spans in the segments of anchors with too many different ones for a shard: by counting cells, then strings."""
    unit = 8 if odd else 1

    def grams(data: bytes) -> np.ndarray:
        return word_grams(np.frombuffer(data, np.uint64)) if odd else byte_grams(np.frombuffer(data, np.uint8), np.arange(len(data) - GRAM + 1))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashed = xxhash.xxh3_64_intdigest
        for part in frames:
            rows = []
            for h, n, doc, key, low, data in part[["h", "n", "doc", "key", "start", "data"]].itertuples(index=False):
                strings = len(data) // unit - length + 1
                anchor = int(np.flatnonzero(grams(data).view(np.int64) == h)[0])
                at = 0
                while at < strings:
                    cell = (anchor - at) // CELL
                    end = min(strings, anchor - cell * CELL + 1)  # strings whose anchor is at offsets of this cell
                    core = data[unit * (anchor - cell * CELL) : unit * max(0, anchor - (cell + 1) * CELL + 1 + length)]
                    keys = (hashed(core, seed=cell) ^ (h & (1 << 64) - 1), hashed(data[unit * at : unit * (end + length - 1)], seed=anchor - at))
                    rows.append((doc, key, low, low + at, end - at, n, *(v - (1 << 64) if v >> 63 else v for v in keys)))
                    at = end
            yield pd.DataFrame(rows, columns=["doc", "key", "segment", "start", "strings", "n", "core", "cell"])

    def strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for part in frames:
            rows = []
            for doc, key, segment, start, n_strings, n, data in part[["doc", "key", "segment", "start", "strings", "n", "data"]].itertuples(index=False):
                low = start - segment
                rows += [(doc, key, start + k, n, xxhash.xxh3_128_digest(data[unit * (low + k) : unit * (low + k + length)])) for k in range(n_strings)]
            yield pd.DataFrame(rows, columns=["doc", "key", "start", "n", "string"])

    schema = "doc long, key long, segment long, start long, strings long, n long, core long, cell long"
    parts = cut(segments_.mapInPandas(cells, schema).dropDuplicates(["doc", "key", "start"]), "cells")
    by_cell = parts.groupBy("core", "cell").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "key", "segment", "start", "strings")).alias("at"))
    by_cell = cut(by_cell.select("core", "cell", "n", "at.*"), "by-cell")
    total = parts.count()
    whole = joined_evenly(parts.drop("n"), by_cell.where("n > 1").select("core", "cell", "n"), ["core", "cell"], "left_semi", total)
    open_cores = by_cell.groupBy("core").agg(F.count("*").alias("n"), (F.min("cell") != F.max("cell")).alias("mixed")).where("mixed").select("core", "n")
    cores = cut(open_cores, "cores")
    left = joined_evenly(by_cell.withColumnRenamed("n", "copies"), cores, ["core"], "left_semi", total).select("doc", "key", "segment", "start", "strings", F.col("copies").alias("n"))
    held = segments_.select("doc", "key", F.col("start").alias("segment"), "data")
    each = left.join(held, ["doc", "key", "segment"]).mapInPandas(strings, "doc long, key long, start long, n long, string binary")
    each = cut(each.dropDuplicates(["doc", "key", "start"]), "strings")
    twice = cut(each.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1"), "twice")
    used += [parts, by_cell, cores, each, twice]
    single = joined_evenly(each.drop("n"), twice, ["string"], "left_semi", each.count()).withColumn("strings", F.lit(1))
    both = whole.select("doc", "key", "start", "strings").unionByName(single.select("doc", "key", "start", "strings"))
    return both.select("doc", "key", "start", (F.col("start") + F.col("strings") + (length - 1)).alias("end"), F.lit(odd).alias("odd"))


def remove(docs: DataFrame, length: int = 400, shard_bytes: int = 1_000_000, hot_bytes: int = 2_000_000, as_text: bool = False, words: int = 0, keep_words: bool = False) -> DataFrame:
    """The documents with kept (bytes that no repeated string covers), n_bytes, n_removed, n_spans (maximal removed runs), n_passages and n_passage_words.

    as_text: kept is a string, of the characters that lost no byte.  words: repeated passages
    of as many words are found too, whatever their bytes (0: none); these are counted in the
    last two columns, and removed unless keep_words.
    """
    own = keyed(docs.drop("kept", "n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_words"))
    got = spans(own.select("_doc", "_key", "text"), length, shard_bytes, hot_bytes, words)
    lists = got.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "end", "odd")).alias("_spans"))
    joined = own.join(lists, ["_doc", "_key"], "left").drop("_doc", "_key")
    fields = [f for f in own.schema if f.name not in ("_doc", "_key")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames, "text", 2_000_000):
            rows = []
            for text, starts, ends, odds in zip(part["text"], part["_starts"], part["_ends"], part["_odds"]):
                data = _bytes(text) if isinstance(text, str) else b""
                both: list[list] = [[], []]
                if starts is not None:
                    both = [list(zip(starts[odds == kind].tolist(), ends[odds == kind].tolist())) for kind in (0, 1)]
                passages = _merged(both[1])
                gone = both[0]
                if passages and not keep_words:
                    first, end = _word_bounds(data)
                    gone = gone + [(int(first[a]), int(end[b - 1])) for a, b in passages]
                out, at, removed = [], 0, 0
                gone = _merged(gone)
                for a, b in gone:
                    out.append(data[at:a])
                    removed += b - a
                    at = b
                out.append(data[at:])
                # Each stretch by itself: halves of two characters may not become a third one.
                kept = "".join(x.decode("utf-8", "ignore") for x in out) if as_text else b"".join(out)
                rows.append((kept, len(data), removed, len(gone), len(passages), sum(b - a for a, b in passages)))
            yield part.drop(columns=["_starts", "_ends", "_odds"]).reset_index(drop=True).join(pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_words"]))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    columns = [f.name for f in fields]
    counts = "n_bytes long, n_removed long, n_spans long, n_passages long, n_passage_words long"
    # As arrays of numbers; structs would be a dict for each span.
    parts = [F.col(f"_spans.{f}").cast("array<bigint>").alias(f"_{f}s") for f in ("start", "end", "odd")]
    return joined.select(*columns, *parts).mapInPandas(released(run), f"{types}, kept {'string' if as_text else 'binary'}, {counts}")


def query(docs: DataFrame) -> DataFrame:
    """The fixed columns tell of strings of 400 bytes; n_passages and n_passage_words of repeated passages of over 50 words, which stay."""
    got = remove(docs.select("doc_id", "text"), words=WORDS, keep_words=True)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated strings of 400 bytes and repeated passages of over 50 words; bytes of a character that lost others go with them."""
    got = remove(docs, as_text=True, words=WORDS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    got = got.withColumn("text", text)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)
