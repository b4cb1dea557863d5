"""Toxicity by a gap-weighted subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two words counts their common subsequences of four characters, each weighted
by decay ** (span - 4) in either word; spans up to six are counted, so that a character put
into an insult, or left out, costs weight but doesn't hide it.  Words of fewer than four
characters get marks at their ends, so that they have such subsequences too.  Words are mapped to Nyström
features K(word, landmarks) K(landmarks, landmarks) ** -1/2.

Labels hold for documents, not sentences, so training is multiple-instance, with words for
instances: a clean document's words are clean, a toxic document has toxic words somewhere.
The SVM's first positive instances are words whose document frequencies prove them; then
those of toxic documents beyond the last SVM's margin.  As the map is linear in the
subsequences, the trained SVM folds into one weight for each subsequence of a landmark, and
scoring a new word is a few table look-ups.

A document's score: logistic regression on the count and margins of its toxic words, fitted
on the same training documents and weighted to the labels' true shares.

The sample for fitting is bounded by ``per_class`` documents of each label of at most
``longest`` characters (by hash of doc_id), which bounds the work of the one task that trains;
scoring reads every whole text, and a very long word by windows.  Negative instances are the 12,000 most
frequent clean words, candidates for positive ones the 4000 of most evidence.  An empty table
gives no rows.  Null and empty texts get the score of a document without words.
Repeated rows get equal scores.  Without labels of both kinds all scores are the share of
toxic labels (0 without labels).  Other columns are kept by the caller.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, released, small_batches

LENGTH, SPAN, WIDTH, SLOTS = 4, 6, 24, 1 << 20
PATTERNS = [(0, *inner, s - 1) for s in range(LENGTH, SPAN + 1) for inner in combinations(range(1, s - 1), LENGTH - 2)]
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”…"
_START, _END = "\ufdd0", "\ufdd1"  # no characters of any text
HELD_OUT, FOLDS = 2, 4


def units(text: str) -> list[str]:
    """Lower-case chunks between white space; single letters in a row make one unit."""
    out: list[str] = []
    run: list[str] = []
    for chunk in text.lower().split():
        if len(chunk) == 1 and chunk.isalpha():
            run.append(chunk)
            continue
        if run:
            out += ["".join(run)] if len(run) > 2 else run
            run = []
        out.append(chunk)
    return out + (["".join(run)] if len(run) > 2 else run)


def windows(word: str) -> list[str]:
    """Half-overlapping windows of a long word; nothing is left out.  A short word with its marks."""
    word = word.strip(_EDGES)
    if 0 < len(word) < LENGTH:
        return [_START * max(1, LENGTH - 1 - len(word)) + word + _END]
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


@lru_cache(None)
def _norms(decay: float) -> np.ndarray:
    """By length, of a word without repeated subsequences; words are scaled by these."""
    out = np.zeros(WIDTH + 1)
    for n in range(WIDTH + 1):
        out[n] = np.sqrt(sum(max(0, n - p[-1]) * decay ** (2 * (p[-1] + 1 - LENGTH)) for p in PATTERNS)) or 1.0
    return out


@lru_cache(4)
def _ids(alphabet: str) -> np.ndarray:
    of = np.zeros(0x110000, np.int32)
    of[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
    return of


def subsequences(words: list[str], alphabet: str, decay: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of words of like length: their places in the list, slots (0: holds a character that no landmark has) and weights."""
    of = _ids(alphabet)
    base = max(257, len(alphabet) + 1)
    sizes = np.array([len(w) for w in words])
    norms = _norms(decay)
    low = 0
    for width in (8, 11, 14, 18, WIDTH):
        of_width = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for at in range(0, len(of_width), 1024):
            own = of_width[at : at + 1024]
            flat = np.frombuffer("".join(words[i].ljust(width, "\0") for i in own).encode("utf-32-le", "surrogatepass"), np.uint32)
            chars = np.zeros((len(own), width + SPAN), np.int64)
            chars[:, :width] = of[flat].reshape(len(own), width)
            slots = np.empty((len(PATTERNS), len(own), width - LENGTH + 1), np.int64)
            for k, places in enumerate(PATTERNS):
                code, every = 0, True
                for c in places:
                    got = chars[:, c : c + width - LENGTH + 1]
                    code, every = code * base + got, every & (got > 0)
                slots[k] = ((code * 0x1E3779B97F4A7C15 >> 40) & SLOTS - 1 | 1) * every
            weights = np.array([decay ** (p[-1] + 1 - LENGTH) for p in PATTERNS])[:, None, None] / norms[sizes[own]][None, :, None]
            yield own, slots, np.broadcast_to(weights, slots.shape)


@dataclass
class Model:
    """table: a weight for each slot of subsequences; the margin of a word is their weighted sum, plus bias."""

    alphabet: str
    table: np.ndarray
    bias: float
    decay: float
    weights: np.ndarray
    prior: float

    def margins(self, words: list[str]) -> np.ndarray:
        """The largest margin among the windows of each word."""
        spread = [(i, x) for i, word in enumerate(words) for x in windows(word)]
        owner = np.array([i for i, _ in spread], np.int64)
        got = np.full(len(spread), self.bias)
        for own, slots, weights in subsequences([x for _, x in spread], self.alphabet, self.decay):
            got[own] += (self.table[slots] * weights).sum((0, 2))
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owner, got)
        return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        near = y * (x @ w) < 1
        a = x[near] * cost[near, None]
        h = a.T @ x[near] + ridge * np.eye(len(w))
        new = np.linalg.solve(h, a.T @ y[near])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (cost * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (cost * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _one_of_copies(sets: list[set[str]], rows: int = 8, alike: int = 4) -> np.ndarray:
    """False for a document that agrees in half of its min-hashes with an earlier one: its words are no further evidence."""
    seen: dict[tuple, list[np.ndarray]] = {}
    out = np.ones(len(sets), bool)
    for i, s in enumerate(sets):
        h = np.array([crc32(x.encode("utf-8", "surrogatepass")) for x in s] or [0], np.uint64)
        own = np.array([((h * np.uint64(2 * k + 3) * np.uint64(0x9E3779B1) + np.uint64(k)) >> np.uint64(8) & np.uint64(0xFFFFFFFF)).min() for k in range(rows)])
        out[i] = not any((own == other).sum() >= alike for k in range(rows) for other in seen.get((k, own[k]), []))
        if out[i]:
            for k in range(rows):
                seen.setdefault((k, own[k]), []).append(own)
    return out


def _likelihood_ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Twice the log-likelihood ratio of a word that a of n1 toxic and b of n0 clean documents hold."""
    p = (a + b) / (n1 + n0)

    def fit(k: int, n: int, q: float) -> float:
        return (k * np.log(q) if k else 0.0) + ((n - k) * np.log(1 - q) if n > k else 0.0)

    return 2 * (fit(a, n1, a / max(1, n1)) + fit(b, n0, b / max(1, n0)) - fit(a, n1, p) - fit(b, n0, p))


def features(margins: np.ndarray) -> list[float]:
    """Of a document, from the margins of all its units."""
    n = len(margins)
    hits = margins[margins > 0]
    return [np.log1p(len(hits)), min(2.0, float(hits.max())) if len(hits) else 0.0, float(len(hits) > 0), len(hits) / (n + 5.0), float(np.log1p(n)) / 10, 1.0]


def train(texts: list[str], labels: list[int], share: float, landmarks: int = 128, decay: float = 0.6, rounds: int = 3) -> Model:
    """share: of toxic documents among all labelled ones."""
    y = np.array(labels, bool)
    if y.all() or not y.any():
        return Model("", np.zeros(1), -1.0, decay, np.zeros(6), share)
    # The words of each document, by sentences, as single letters in a row may end with one; equal words are one object.
    same: dict[str, str] = {}
    sets = [{same.setdefault(x, x) for s in _SENTENCE.split(t) for u in units(s) for x in windows(u) if len(x) >= LENGTH} for t in texts]
    one = _one_of_copies([{x for x in s if x[0] != _START} or s for s in sets])
    df = (Counter(x for s, k, o in zip(sets, y, one) if o and not k for x in s), Counter(x for s, k, o in zip(sets, y, one) if o and k for x in s))
    n1, n0 = int((y & one).sum()), int((~y & one).sum())
    odds = {x: np.log((n + 0.2) / (n1 + 0.4) / (df[0][x] + 0.2) * (n0 + 0.4)) for x, n in df[1].items()}
    evidence = {x: _likelihood_ratio(n, df[0][x], n1, n0) if odds[x] > 0 else 0.0 for x, n in df[1].items()}
    ranked = sorted((x for x in odds if df[1][x] > 1 or n1 < 10), key=lambda x: (-evidence[x], x))
    clean = sorted(df[0], key=lambda x: (-df[0][x], x))

    def of_each(words: list[str], n: int) -> list[str]:
        """The first n long words and the first n short ones, which share no subsequence and don't compete."""
        return [x for x in words if x[0] != _START][:n] + [x for x in words if x[0] == _START][:n]

    marks = of_each(ranked, landmarks * 3 // 4) + of_each(clean, landmarks // 4)
    marks = list(dict.fromkeys(marks))
    alphabet = "".join(sorted({c for x in marks for c in x}))
    model = Model(alphabet, np.zeros(SLOTS, np.float32), 0.0, decay, np.zeros(6), share)
    rows = np.zeros((1, len(marks)))
    place = np.zeros(SLOTS, np.int64)

    def explicit(words: list[str]) -> np.ndarray:
        """K(words, landmarks)."""
        out = np.zeros((len(words), len(marks)))
        for own, slots, weights in subsequences(words, alphabet, decay):
            at = place[slots]
            for k, w, p in zip(*np.nonzero(at)):
                out[own[w]] += weights[k, w, p] * rows[at[k, w, p]]
        return out

    for own, slots, weights in subsequences(marks, alphabet, decay):
        used = np.unique(slots[slots > 0])
        used = used[place[used] == 0]
        place[used] = len(rows) + np.arange(len(used))
        rows = np.concatenate([rows, np.zeros((len(used), len(marks)))])
        np.add.at(rows, (place[slots], np.broadcast_to(own[None, :, None], slots.shape)), np.where(slots > 0, weights, 0))
    k = explicit(marks)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    # Instances: words of clean sentences, and the words by which toxic documents stand out.
    negative, candidates = of_each(clean, 12_000), of_each(ranked, 4000)
    good = [x for x in ranked if odds[x] > np.log(4) and evidence[x] > 12][:1000] or ranked[:10]
    phi = {x: v for x, v in zip(negative + candidates, np.c_[explicit(negative + candidates) @ root, np.ones(len(negative) + len(candidates))])}
    for _ in range(rounds):
        positive = [x for x in good if x in phi]
        if not positive:
            break
        x = np.array([phi[w] for w in negative + positive])
        t = np.r_[-np.ones(len(negative)), np.ones(len(positive))]
        cost = np.r_[[np.sqrt(df[0][w]) for w in negative], [np.sqrt(df[1][w]) for w in positive]]
        cost[t > 0] *= min(20.0, cost[t < 0].sum() / cost[t > 0].sum())
        w = _svm(x, t, cost)
        # The witnesses of each toxic document: its words beyond the margin; else its best one.
        margin = {u: float(v @ w) for u, v in phi.items() if u in odds}
        good = []
        for s, toxic, o in zip(sets, y, one):
            if toxic and o and (own := sorted(((margin[u], u) for u in s if u in margin and odds[u] > np.log(4)), reverse=True)):
                good += [u for m, u in own if m > 0 and evidence[u] > 2]
        good = sorted(set(good))
        model.table = (rows @ (root @ w[:-1])).astype(np.float32)[place]
        model.bias = float(w[-1])
    del same, sets, phi
    words = list({u for t in texts for u in units(t)})
    known: dict[str, float] = {}
    for at in range(0, len(words), 20_000):
        known.update(zip(words[at : at + 20_000], model.margins(words[at : at + 20_000]).tolist()))
    x = np.array([features(np.array([known[u] for u in units(t)])) for t in texts])
    cost = np.where(y, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.weights = _logistic(x, y.astype(float), cost)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, longest: int = 20_000) -> Model:
    """Trains on labelled documents (doc_id, text; doc_id, toxic) outside the held-out fold.  per_class, longest: bounds of the sample."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r.toxic): r["count"] for r in own.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    taken = None
    for toxic in (0, 1):
        some = own.where((F.col("toxic") > 0) == bool(toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        taken = some if taken is None else taken.union(some)
    texts = docs.select("doc_id", "text").where((F.length("text") <= longest) & F.col("text").isNotNull())
    # At most 2 * per_class ids are broadcast, and as many texts of at most ``longest`` characters come to one task.
    got = texts.join(F.broadcast(taken), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text", "doc_id")
    sample = got.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_class)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[str] = []
        marks: list[int] = []
        for frame in frames:
            texts += frame["text"].tolist()
            marks += (frame["toxic"] > 0).astype(int).tolist()
        yield pd.DataFrame({"model": [pickle.dumps(train(texts, marks, share))]})

    rows = sample.mapInPandas(released(learn), "model binary").collect()  # the driver gets the model alone
    return pickle.loads(rows[0].model) if rows else train([], [], share)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def scorer(docs: DataFrame, model: Model, most: int = 200_000):
    """A function from a text column to its score, 0 to 1.  most: words whose margins a worker keeps."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        own = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for at in range(0, len(batch), 100):
                split = [units(t) if t else [] for t in batch.iloc[at : at + 100]]
                if len(known) > most:
                    known.clear()
                if new := [x for x in set().union(*split) if x not in known]:
                    known.update(zip(new, own.margins(new).tolist()))
                x = np.array([features(np.array([known[u] for u in d])) for d in split])
                out.append(1 / (1 + np.exp(-np.clip(x @ own.weights, -30, 30))) if own.weights.any() else np.full(len(x), own.prior))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
        known.clear()
        give_back()

    return score


def query(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    score = scorer(docs, fit(docs, labels))
    got = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score(F.col("text")).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of documents whose score is below the threshold, as they are."""
    score = scorer(docs, fit(docs, labels))
    return docs.where(score(F.col("text")) < threshold)
