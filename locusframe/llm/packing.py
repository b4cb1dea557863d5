"""Harmonic packing of tokenized documents into fixed-capacity training sequences.

Lengths fall into reciprocal-capacity classes: class m holds pieces of at most capacity // m
tokens, and each of its sequences takes exactly m of them, so that a worker never looks at
another class or another worker.  A document gives whole sequences first; what is left goes
to its class if it nearly fills the slot, and else gives up a piece that fills the next
class's slot exactly.  Pieces below the last class are laid one after another.  What a worker
has open when its rows end is laid out once more, longest first.

One pass, no shuffle, and as much memory as the open sequences of every class.

Null and empty texts have no tokens but the end token.  Repeated rows are packed each.  Very
long texts give many whole sequences.  Other columns of the input are not looked at.
An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, pieces, small_batches, uncollected_over

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: White space of Unicode; Python's split() takes four control characters more.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Token ids of texts as little-endian uint32 bytes.

    The tokenizer drops white space and never joins what it separates, so ids are kept by
    chunk, in two generations of at most about ``most`` chunks each: what the younger one
    doesn't take over from the older one is forgotten.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = most
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _one_by_one(self, chunks: list[str]) -> None:
        for chunk, got in zip(chunks, self.model.encode_batch_fast(chunks, add_special_tokens=False)):
            self.known[chunk] = array("I", got.ids).tobytes()

    def _words(self, words: list[str], group: int = 400) -> None:
        """Words of letters only go through the tokenizer together; ids that end a word part them again."""
        groups = [words[i : i + group] for i in range(0, len(words), group)]
        for own, got in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(own):  # a letter that becomes several characters in lower case
                self._one_by_one(own)
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(own, (4 * ends).tolist()):
                self.known[word] = data[at:end]
                at = end

    def _learn(self, chunks: list[str]) -> None:
        known, words, others, marked = self.known, set(), set(), []
        older = self.older
        for x in chunks:
            if x in older:
                known[x] = older[x]
                continue
            base = x.rstrip(MARKS)
            if not base.isalpha():
                others.add(x)
            else:  # letters, then ASCII marks: the tokenizer parts them there
                words.add(base)
                if len(base) < len(x):
                    marked.append((x, base, x[len(base) :]))
                    others.add(x[len(base) :])
        self._words([x for x in words if x not in known])
        self._one_by_one([x for x in others if x not in known])
        for x, base, marks in marked:
            known[x] = known[base] + known[marks]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        get = self.known.get
        out, new = [], {}
        for text in texts:
            text = text.lower() if text.isascii() else text
            chunks = [x for x in _SPACE.split(text) if x] if _CONTROLS.search(text) else text.split()
            ids = list(map(get, chunks))
            unknown, at = [], -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                unknown.append((at, chunks[at]))
                new[chunks[at]] = None
            out.append((ids, unknown))
        self._learn(list(new))
        for ids, unknown in out:
            for at, chunk in unknown:
                ids[at] = self.known[chunk]
        return [b"".join(ids) for ids, _ in out]


def encoder(path: str) -> Encoder:
    """A worker's encoder, which outlives its tasks until one of another operator comes."""
    if path not in KEPT:
        KEPT.clear()
        KEPT[path] = Encoder(path)
    return KEPT[path]


def cuts(n: int, capacity: int, classes: int, slack: float) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        m = capacity // n
        slot = capacity // m
        if m >= classes or slot - n <= slack * slot:
            out.append(n)
            break
        out.append(capacity // (m + 1))
        n -= out[-1]
    return out


def _lay_out(left: list[tuple], capacity: int) -> Iterator[list[tuple]]:
    """Longest first, each into the first sequence with room."""
    bins: list[list[tuple]] = []
    room: list[int] = []
    for piece in sorted(left, key=lambda p: -len(p[2])):
        size = len(piece[2]) // 4
        at = next((i for i, r in enumerate(room) if r >= size), None)
        if at is None:
            at = len(bins)
            bins.append([])
            room.append(capacity)
        bins[at].append(piece)
        room[at] -= size
    return iter(bins)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, classes: int = 32, slack: float = 1 / 32) -> DataFrame:
    """Pieces of the documents (doc_id, text) with their place in a sequence.

    ids: the piece's token ids, little-endian unsigned 32-bit.  sequence_id: unique over all
    workers.  tokenizer: path of a ``tokenizers`` file that every worker can open.  classes:
    number of reciprocal classes.  slack: share of a slot that may stay empty.
    """
    end = np.array([end_id], "<u4").tobytes()

    @uncollected_over  # a million cached strings are no garbage
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 33
        open_bins: dict[int, list[tuple]] = {m: [] for m in range(1, classes + 1)}
        small_fill = 0
        rows: list[tuple] = []

        def close(members: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, n in members:
                rows.append((doc, start, len(ids) // 4, ids, n, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
            rows.clear()
            return out

        for part in pieces(frames, "text", 4_000_000):
            ids_of = encode(part["text"].fillna("").tolist())
            for doc, ids in zip([None if missing else int(d) for d, missing in zip(part["doc_id"], part["doc_id"].isna())], ids_of):
                ids += end
                n = len(ids) // 4
                start = 0
                for size in cuts(n, capacity, classes, slack):
                    m = min(capacity // size, classes)
                    members = open_bins[m]
                    if m == classes:
                        if small_fill + size > capacity:
                            close(members)
                            members.clear()
                            small_fill = 0
                        small_fill += size
                    members.append((doc, start, ids[4 * start : 4 * (start + size)], n))
                    if m < classes and len(members) == m:
                        close(members)
                        members.clear()
                    start += size
                if len(rows) >= 5000:
                    yield frame()
        for members in _lay_out([p for b in open_bins.values() for p in b], capacity):
            close(members)
        if rows:
            yield frame()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    got = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
