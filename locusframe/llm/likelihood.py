"""Likelihood of documents under a lattice of subword pieces, beside a smoothed word model.

The pieces and their scores come from an existing vocabulary file.  A word, with the mark of
a word's start before it, is any sequence of pieces that spells it; its probability is the
sum over all of them, found by the forward recursion in log space.  Characters that no piece
spells go by their UTF-8 byte pieces.  A document's probability is the product over its words
and one end piece; pieces never cross white space, so that each distinct word is worked out
once and not at each of its places.

What is learnt, from documents outside the held-out fold only: word counts, and the pieces'
probabilities, which start from the vocabulary's scores and take ``rounds`` expectation steps
over all distinct training words.  A word of the training documents is one more piece of its
own lattice: its probability is (1 - e) c / N + e times the sum over the vocabulary's pieces,
where e is the share of training tokens that occur once (what Good and Turing expect of
unseen ones); a word never seen has the second part alone.

The counts, with the sums over pieces, are a table in the shared folder, each distinct word
worked out once.  Only words with the most occurrences a byte, ``hot`` words and ``hot_bytes``
at most, are broadcast, with the pieces, whose number the vocabulary bounds.  Other words meet
their counts in a join, as rows of (document, word, occurrences).

Null and empty texts consist of the end token.  Repeated rows are scored each.  Very long
words take one recursion each.  Other columns are ignored.  An empty table gives no rows;
without training documents all counts are 0.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, small_batches, space_words, uncollected_over

HELD_OUT, FOLDS = 1, 5
START = "▁"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


@dataclass
class Pieces:
    """Pieces of one length, by hash: ``slots`` has 1 + the row of a piece at the hash's upper bits (0: none), rows of further pieces of a slot are ``rest``, sorted by hash."""

    size: int
    shift: np.uint64
    slots: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(size: int, hashes: np.ndarray, places: np.ndarray) -> Pieces:
        bits = max(6, int(16 * len(hashes)).bit_length())
        shift = np.uint64(64 - bits)
        slot = (hashes >> shift).astype(np.int64)
        slots = np.zeros(1 << bits, np.int32)
        _, first = np.unique(slot, return_index=True)
        slots[slot[first]] = first + 1
        rest = np.setdiff1d(np.arange(len(hashes)), first)
        return Pieces(size, shift, slots, hashes, places, rest[np.argsort(hashes[rest])])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are pieces, the pieces' places).  Most hashes end at an empty slot."""
        own = self.slots[h >> self.shift]
        rows = np.flatnonzero(own)
        own, h = own[rows] - 1, h[rows]
        same = self.hashes[own] == h
        if len(self.rest):
            other = np.flatnonzero(~same)
            at = self.rest[np.minimum(np.searchsorted(self.hashes[self.rest], h[other]), len(self.rest) - 1)]
            own[other], same[other] = at, self.hashes[at] == h[other]
        return rows[same], self.places[own[same]]


@dataclass
class Lattice:
    """Pieces by length, shortest first; ``byte`` and ``end`` are places in ``logp`` like theirs."""

    pieces: list[Pieces]
    byte: np.ndarray
    end: int
    logp: np.ndarray

    @staticmethod
    def load(path: str) -> Lattice:
        """From a sentencepiece file.  Scores that are ranks (0, -1, -2 ...) weigh pieces as 1 / (rank + 2.7); others are log probabilities."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names, scores = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])
        byte = np.array([names.index(f"<0x{b:02X}>") if f"<0x{b:02X}>" in names else 0 for b in range(256)])
        plain = [i for i in range(n) if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i) and START not in names[i][1:]]
        ranks = scores[plain].min() < -1000
        logp = np.full(n + 1, -30.0)
        logp[plain] = -np.log(2.7 - scores[plain]) if ranks else scores[plain]
        logp[byte] = logp[plain].min() - np.log(256)
        logp[n] = logp[plain].mean()
        by: dict[int, list[int]] = defaultdict(list)
        for i in plain:
            by[len(names[i])].append(i)
        tables = [Pieces.of(size, _prefix_hashes(np.array([[ord(c) for c in names[i]] for i in ids], np.uint64).T)[-1], np.array(ids)) for size, ids in sorted(by.items())]
        return Lattice(tables, byte, n, logp - np.logaddexp.reduce(logp))

    def words(self, words: list[str], counts: np.ndarray | None = None, expected: np.ndarray | None = None, cells: int = 300_000) -> np.ndarray:
        """Natural log of each word's probability; ``expected`` gets the expected uses of each piece, times ``counts``.  cells: characters, with those that pad, of one block."""
        out = np.zeros(len(words))
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            rows = order[at : at + max(1, cells // int(sizes[order[at]]))]
            out[rows] = self._block([words[i] for i in rows], sizes[rows], None if counts is None else counts[rows], expected)
            at += len(rows)
        return out

    def _block(self, words: list[str], sizes: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Of words in descending length, so that those of at least j characters come first."""
        longest, number = int(sizes[0]), len(words)
        padded = np.zeros((number, longest), np.uint64)
        padded[np.arange(longest) < sizes[:, None]] = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.ascontiguousarray(padded.T)
        prefix = np.concatenate([np.zeros((1, number), np.uint64), _prefix_hashes(chars)])
        power = _BASE ** np.arange(longest + 1, dtype=np.uint64)
        forward = np.full((longest + 1, number), -np.inf)
        forward[0] = 0
        edges = []
        for j in range(1, longest + 1):
            m = int(np.searchsorted(-sizes, -j, "right"))
            end, total = prefix[j, :m], forward[j]
            for p in self.pieces:
                i = j - p.size
                if i < 0:
                    break
                rows, place = p.find(end - prefix[i, :m] * power[p.size])
                if len(rows):
                    total[rows] = np.logaddexp(total[rows], forward[i, rows] + self.logp[place])
                    if expected is not None:
                        edges.append((i, j, rows, place))
            lost = np.flatnonzero(np.isneginf(total[:m]))
            if len(lost):  # no piece ends here: the character's bytes
                for c in np.unique(chars[j - 1, lost]):
                    rows = lost[chars[j - 1, lost] == c]
                    place = self.byte[list(chr(int(c)).encode("utf-8", "surrogatepass"))]
                    total[rows] = forward[j - 1, rows] + self.logp[place].sum()
                    if expected is not None:
                        edges.append((j - 1, j, rows, np.broadcast_to(place, (len(rows), len(place)))))
        whole = forward[sizes, np.arange(number)]
        if expected is not None:
            backward = np.full((longest + 1, number), -np.inf)
            backward[sizes, np.arange(number)] = 0
            places, uses = [], []
            for i, j, rows, place in reversed(edges):
                weight = (self.logp[place] if place.ndim == 1 else self.logp[place].sum(1)) + backward[j, rows]
                backward[i, rows] = np.logaddexp(backward[i, rows], weight)
                use = np.exp(forward[i, rows] + weight - whole[rows]) * counts[rows]
                places.append(place.ravel())
                uses.append(use if place.ndim == 1 else np.repeat(use, place.shape[1]))
            expected += np.bincount(np.concatenate(places), np.concatenate(uses), len(expected))
        return whole


def _prefix_hashes(chars: np.ndarray) -> np.ndarray:
    """Hashes of the first 1, 2 ... characters, which stand along the first axis; times an odd number, so that upper bits tell them apart."""
    out = np.zeros_like(chars)
    h = np.zeros(chars.shape[1], np.uint64)
    for j in range(len(chars)):
        h = h * _BASE + (chars[j] + np.uint64(1)) * _MIX
        out[j] = h
    return out


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _is_end(words: Iterable[bytes]) -> np.ndarray:
    return np.array([not w for w in words], bool)


def word_counts(docs: DataFrame, most: int = 250_000) -> DataFrame:
    """(word, c) over all words of the texts; the end token is the empty word.  most: words that a worker adds up before it hands them on."""

    @uncollected_over
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: Counter = Counter()
        for part in pieces(frames, "text", 2_000_000):
            for text in part["text"]:
                got.update(space_words(text))
            got[b""] += len(part)
            if len(got) > most:
                yield pd.DataFrame({"word": list(got), "c": list(got.values())})
                got.clear()
        if got:
            yield pd.DataFrame({"word": list(got), "c": list(got.values())})

    small_batches(docs.sparkSession)
    return docs.select("text").mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def adapted(lattice: Lattice, counts: DataFrame, rounds: int = 1, prior: float = 1000.0) -> Lattice:
    """The lattice with piece probabilities after ``rounds`` expectation steps; the old ones count as ``prior`` uses."""
    spark = counts.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(lattice)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, expected = shared.value, np.zeros(len(shared.value.logp))
            for frame in frames:
                end = _is_end(frame["word"])
                expected[own.end] += frame["c"][end].sum()
                frame = frame[~end]
                own.words([bytes(w).decode("utf-8", "surrogatepass") for w in frame["word"]], frame["c"].to_numpy(float), expected)
            used = np.flatnonzero(expected)
            yield pd.DataFrame({"place": used, "uses": expected[used]})

        rows = counts.mapInPandas(run, "place long, uses double").groupBy("place").agg(F.sum("uses").alias("uses")).collect()  # a row for each piece at most
        uses = np.exp(lattice.logp) * prior
        uses[[r.place for r in rows]] += [r.uses for r in rows]
        lattice = replace(lattice, logp=np.log(uses / uses.sum()))
    return lattice


def most_frequent(counts: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Words with the most occurrences a byte, down to a bound which a histogram of some hundred bins sets so that at most ``most`` words of ``most_bytes`` are left; no sort, and nothing else reaches the driver."""
    size = F.length("word") + 40
    step = F.floor(8 * F.log2(F.col("c") / size))
    bins = counts.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()
    least, total, bytes_ = None, 0, 0
    for r in sorted(bins, key=lambda r: -r.bin):
        total, bytes_ = total + r.n, bytes_ + r.bytes
        if total > most or bytes_ > most_bytes:
            break
        least = r.bin
    return counts.where(F.lit(False) if least is None else step >= least)


def _decoded(words: list[bytes]) -> list[str]:
    return [bytes(w).decode("utf-8", "surrogatepass") for w in words]


def spelled(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """counts with logp: the natural log of the sum over all ways to spell the word; the end token is one piece."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            got = own.words(_decoded(frame["word"]))
            got[_is_end(frame["word"])] = own.logp[own.end]
            yield frame.assign(logp=got)

    return counts.mapInPandas(run, "word binary, c long, logp double")


def score(docs: DataFrame, vocabulary: str, hot: int = 1 << 18, rounds: int = 1, hot_bytes: int = 24_000_000) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    spark = docs.sparkSession
    small_batches(spark, 10_000)
    own = docs.select(F.col("doc_id").cast("long"), "text")
    counted = cut(word_counts(own.where(fold(F.col("doc_id")) != HELD_OUT)), "words")
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    n, below = total.n, np.log10(max(1e-9, total.n + 0.5 * (total.v + 1)))
    escape = float((total.once + 1) / (n + 1))
    lattice = adapted(Lattice.load(vocabulary), counted, rounds)
    counts = cut(spelled(counted, lattice), "spelled")
    frequent = most_frequent(counts, hot, hot_bytes)
    known = {bytes(r.word): (float(np.log10(r.c + 0.5) - below), float(np.log10((1 - escape) * r.c / n + escape * np.exp(r.logp)))) for r in frequent.collect()}
    whole = total.v <= len(known)
    shared = spark.sparkContext.broadcast((known, lattice))
    unknown, ln10 = float(np.log10(0.5) - below), float(np.log(10))

    @uncollected_over
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        known, lattice = shared.value
        row = TaskContext.get().partitionId() << 33
        ids: dict[bytes, int] = {}
        for part in pieces(frames, "text", 2_000_000):
            if len(ids) > 300_000 or not ids:
                ids = defaultdict(count().__next__)
                base, scores, words = np.zeros(0), np.zeros(0), []
            split = [np.fromiter(map(ids.__getitem__, [*space_words(t), b""]), np.int64) for t in part["text"]]
            new = list(islice(ids, len(words), None))
            words += new
            # nan: not among the broadcast words; if those are all, not in training.
            got = np.array([known.get(w, (np.nan, np.nan)) for w in new]).reshape(-1, 2)
            base, scores = np.r_[base, got[:, 0]], np.r_[scores, got[:, 1]]
            sums = np.zeros((3, len(split)))
            at_rows, others, times = [np.arange(row, row + len(split))], [b" %d" % r for r in range(row, row + len(split))], [np.ones(len(split), np.int32)]
            for k, at in enumerate(split):
                b = base[at]
                rare = np.isnan(b)
                sums[:, k] = len(at) - rare.sum(), np.nansum(b), np.nansum(scores[at])
                which, often = np.unique(at[rare], return_counts=True)
                at_rows.append(np.full(len(which), row + k))
                others += map(words.__getitem__, which.tolist())
                times.append(often.astype(np.int32))
            row += len(split)
            more = len(others) - len(split)
            no_id = np.r_[part["doc_id"].isna().to_numpy(), np.ones(more, bool)]
            yield pd.DataFrame(
                {
                    "row": np.concatenate(at_rows), "word": others, "times": np.concatenate(times),
                    "doc_id": pd.arrays.IntegerArray(np.r_[part["doc_id"].fillna(0).to_numpy(np.int64), np.zeros(more, np.int64)], no_id),
                    "n_tokens": np.r_[[len(at) for at in split], np.zeros(more, int)], "n_known": np.r_[sums[0].astype(int), np.zeros(more, int)],
                    "base": np.r_[sums[1], np.zeros(more)], "score": np.r_[sums[2], np.zeros(more)],
                }
            )

    @F.pandas_udf("double")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Of words that training has not; null of null."""
        lattice = shared.value[1]
        for words in batches:
            out = np.full(len(words), np.nan)
            own = np.flatnonzero(words.notna())
            if len(own):
                got = words.iloc[own]
                out[own] = np.where(_is_end(got), lattice.logp[lattice.end], lattice.words(_decoded(got)))
            yield pd.Series(out)

    schema = "row long, word binary, times int, doc_id long, n_tokens long, n_known long, base double, score double"
    rows = own.mapInPandas(run, schema)  # the row with a document's sums has a word that no text holds
    rows = rows.join(counts, "word", "left") if not whole else rows.withColumn("c", F.lit(None).cast("long")).withColumn("logp", F.lit(None).cast("double"))
    doc_row, seen = F.col("n_tokens") > 0, F.col("c") > 0
    rows = rows.withColumn("spelled", spell(F.when(~doc_row & F.col("c").isNull(), F.col("word"))))
    log10_p = F.when(seen, F.log10((1 - escape) * F.col("c") / max(1, n) + escape * F.exp("logp"))).otherwise(F.lit(float(np.log10(escape))) + F.col("spelled") / ln10)
    rows = rows.select(
        "row", "doc_id", "n_tokens",
        F.when(doc_row, F.col("score")).otherwise(F.col("times") * log10_p).alias("score"),
        F.when(doc_row, F.col("n_known")).otherwise(F.when(seen, F.col("times")).otherwise(0)).alias("n_known"),
        F.when(doc_row, F.col("base")).otherwise(F.col("times") * F.when(seen, F.log10(F.col("c") + 0.5) - F.lit(float(below))).otherwise(unknown)).alias("base"),
    )
    rows = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    return rows.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return score(docs, public_tokenizers.path("piece_bpe_32k.model"))
