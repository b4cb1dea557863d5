"""Exact Jaccard self-join of word-shingle sets by prefix trees.

1. Equal sets are one class.  A quarter of all shingles, chosen by hash, is looked at: if more
   than a fifth of a class's size are shingles that no other class has, it has no partner.
   The classes left are tested so again, with all their shingles.
2. The classes left are ordered alike: shingles by how frequent they are (a sketch of fixed
   size over all classes tells), then by hash.  Two sets of Jaccard 0.8 share a shingle
   among their first n - ceil(0.8 n) + 1; classes that share one are in one neighbourhood.
3. A neighbourhood's sets form a prefix tree, ordered by frequency inside it.  From each
   class found so far the tree is walked level by level; sets with a common beginning share
   its overlap, and subtrees are left where overlap, what remains and the sizes can't reach
   the threshold, or where all sets are linked already.

Small neighbourhoods are worked on together, up to about ``weight`` shingles.  A neighbourhood
beyond ``block`` classes or ``weight`` shingles is parted by set size and hash into blocks of
that weight.  Blocks are joined inside first; one member of each block's largest component
then meets those of the other blocks; and what is still outside the neighbourhood's largest
component meets every block of like sizes.  So a group of near copies, however large, costs
in proportion to its size, and no pair is left out that could join two components.  Links are
decided by whole sets of 64-bit shingle hashes; nothing is dropped or capped.

Null and empty texts, and texts without words, have an empty set and link with nothing;
fewer words than ``k`` are one shingle.  Repeated rows are of one class.  A null doc_id is
never the smallest of a component that has others.  A very long text is one set, in memory
while it is worked on.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERING, cut, drop, pieces, released, slices, small_batches, text_key, uncollected
from .suffixes import prefix_hashes, substring_hashes

K = 5
SLOTS, PART = 1 << 20, 1 << 14
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingles in order, one text after another."""
    own = [(t or "").encode("utf-8", "surrogatepass").translate(LOWERING) for t in texts]
    data = np.frombuffer(b" ".join(own) + b" ", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in own])
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    words = _mixed(substring_hashes(prefix_hashes(data), begin, end - begin) + (end - begin).astype(np.uint64))
    doc = np.searchsorted(ends, begin, "right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    total = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * np.uint64(pow(0xD1342543DE82EF95, j, 1 << 64))
    whole = doc[: len(total)] == doc[k - 1 : k - 1 + len(total)] if len(total) else np.zeros(0, bool)
    hashes, owner = _mixed(total[whole]), doc[: len(total)][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = []
        for d in short:
            h = np.uint64(count[d])
            for w in words[first[d] : first[d] + count[d]]:
                h = np.uint64((int(h) * 0x9E3779B97F4A7C15 + int(w)) & (1 << 64) - 1)
            extra.append(h)
        hashes, owner = np.r_[hashes, _mixed(np.array(extra, np.uint64))], np.r_[owner, short]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[new], owner[new]
    return hashes, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].astype(np.int64)


def _set_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    sums = np.r_[np.uint64(0), np.cumsum(_mixed(hashes + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)]
    return _mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def needed(a: np.ndarray | int, b: np.ndarray | int, share: int) -> np.ndarray | int:
    """The least intersection of sets of these sizes with 100 * intersection >= share * union."""
    return -(-share * (a + b) // (100 + share))


class Tree:
    """Compressed prefix tree of sorted integer sets, as arrays by node; children come after their parents."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        common = [0] + [_common(sets[a], sets[b]) for a, b in zip(order, order[1:])] + [0]
        parent, depth, begin, source, leaf = [-1], [0], [0], [order[0] if order else 0], [-1]
        stack = [0]  # nodes on the path of the last set
        for i, s in enumerate(order):
            at, size = common[i], len(sets[s])
            last = None
            while depth[stack[-1]] > at:
                last = stack.pop()
            if depth[stack[-1]] < at:  # the last path parts inside an edge
                parent.append(stack[-1]), depth.append(at), begin.append(depth[stack[-1]]), source.append(source[last]), leaf.append(-1)
                parent[last], begin[last] = len(parent) - 1, at
                stack.append(len(parent) - 1)
            parent.append(stack[-1]), depth.append(size), begin.append(depth[stack[-1]]), source.append(s), leaf.append(s)
            stack.append(len(parent) - 1)
        # A node made when an edge was parted stands after its child: number anew by depth of nesting.
        level = np.full(len(parent), -1)
        level[0] = 0
        for i in range(len(parent)):
            path, j = [], i
            while level[j] < 0:
                path.append(j)
                j = parent[j]
            for n, j_ in enumerate(reversed(path), 1):
                level[j_] = level[j] + n
        to_new = np.empty(len(parent), np.int64)
        by_level = np.lexsort((np.array(parent), level))
        to_new[by_level] = np.arange(len(parent))
        self.parent = np.array([to_new[parent[i]] if parent[i] >= 0 else -1 for i in by_level])
        self.leaf, self.depth = np.array(leaf)[by_level], np.array(depth)[by_level]
        edges = [sets[source[i]][begin[i] : depth[i]] if i else np.zeros(0, np.int64) for i in by_level]
        self.bounds = np.r_[0, np.cumsum([len(e) for e in edges])]
        self.tokens = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.last = np.array([e[-1] if len(e) else -1 for e in edges])
        sizes = np.array([len(s) for s in sets])
        self.least, self.most = np.full(len(parent), np.iinfo(np.int64).max), np.zeros(len(parent), np.int64)
        is_leaf = self.leaf >= 0
        self.least[is_leaf] = self.most[is_leaf] = sizes[self.leaf[is_leaf]]
        for i in range(len(parent) - 1, 0, -1):
            p = self.parent[i]
            self.least[p], self.most[p] = min(self.least[p], self.least[i]), max(self.most[p], self.most[i])
        self.level = level[by_level]
        self.node_of = np.empty(len(sets), np.int64)
        self.node_of[self.leaf[is_leaf]] = np.flatnonzero(is_leaf)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    return int(differs[0]) if len(differs) else n


def _least_labels(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The components of sets 0 .. n-1 that share tokens, each by its least set."""
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    starts = np.flatnonzero(np.r_[True, tokens[order][1:] != tokens[order][:-1]])
    size = np.diff(np.r_[starts, len(owner)])
    label = np.arange(n)
    while len(starts):
        least = np.repeat(np.minimum.reduceat(label[owner], starts), size)
        new = label.copy()
        np.minimum.at(new, owner, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def linked(sets: list[np.ndarray], share: int = 80) -> np.ndarray:
    """The component of each distinct set, by one of its members.

    What can't link is parted before a tree is built, and again with the counts of the parts:
    sets with too many shingles of their own, and sets without a common one among their first,
    rarest first.
    """
    component, todo = np.arange(len(sets)), [np.arange(len(sets))]
    while todo:
        group = todo.pop()
        if len(group) < 2:
            continue
        size = np.array([len(sets[i]) for i in group])
        owner = np.repeat(np.arange(len(group)), size)
        values, ids, count = np.unique(np.concatenate([sets[i] for i in group]), return_inverse=True, return_counts=True)
        own = np.bincount(owner, count[ids] == 1, len(group)).astype(np.int64)
        possible = 100 * own <= (100 - share) * size
        if not possible.all():
            todo.append(group[possible])
            continue
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(values))  # rarest first
        place = rank[ids]
        by = np.lexsort((place, owner))
        nth = np.arange(len(by)) - np.repeat(np.cumsum(size) - size, size)
        first = by[nth < np.repeat(size - -(-share * size // 100) + 1, size)]
        label = _least_labels(place[first], owner[first], len(group))
        if (label > 0).any():
            order = np.argsort(label, kind="stable")
            todo += np.split(group[order], np.flatnonzero(np.diff(label[order])) + 1)
            continue
        frequent = len(values) - 1 - rank  # frequent ones first: long common beginnings
        parts = np.split(frequent[ids], np.cumsum(size)[:-1])
        component[group] = group[_walked([np.sort(x) for x in parts], size - own, len(values), share)]
    return component


def _walked(sets: list[np.ndarray], common: np.ndarray, n_values: int, share: int) -> np.ndarray:
    """Components by walks of the prefix tree.  common: how many of a set's shingles others have too."""
    tree, n = Tree(sets), len(sets)
    sizes = np.array([len(s) for s in sets])
    component, open_, mask = np.full(n, -1), np.ones(n, bool), np.zeros(n_values, np.int64)
    nodes, stale = None, 0

    def alive() -> tuple:
        """The nodes above open sets, level by level, with their edges."""
        keep = np.zeros(len(tree.parent), bool)
        at = tree.node_of[open_]
        while len(at):
            at = at[~keep[at]]
            keep[at] = True
            at = np.unique(tree.parent[at])
            at = at[at >= 0]
        own = np.flatnonzero(keep)
        size = tree.bounds[own + 1] - tree.bounds[own]
        ends = np.cumsum(size)
        tokens = tree.tokens[np.arange(size.sum()) - np.repeat(ends - size, size) + np.repeat(tree.bounds[own], size)]
        new_id = np.full(len(tree.parent), -1)
        new_id[own] = np.arange(len(own))
        levels = np.searchsorted(tree.level[own], np.arange(tree.level[own].max() + 2) if len(own) else [0])
        return own, tokens, np.r_[0, ends], np.where(tree.parent[own] >= 0, new_id[tree.parent[own]], 0), levels

    for start in np.argsort(sizes - common, kind="stable").tolist():  # those with little of their own reach most
        if not open_[start]:
            continue
        component[start], open_[start] = start, False
        queue, stale = [start], stale + 1
        while queue:
            q = queue.pop()
            size = len(sets[q])
            least_overlap = needed(size, sizes, share)
            if not (open_ & (least_overlap <= common) & (least_overlap <= common[q])).any():
                continue
            if nodes is None or stale > 0.2 * (open_.sum() + stale):
                nodes, stale = alive(), 0
            own, tokens, edge, parent, levels = nodes
            mask[sets[q]] = 1
            hits = np.r_[0, np.cumsum(mask[tokens])]
            overlap = hits[edge[1:]] - hits[edge[:-1]]
            rest = np.r_[np.cumsum(mask[::-1])[::-1], 0]  # shingles of q from a rank on
            mask[sets[q]] = 0
            going = np.zeros(len(own), bool)
            going[0] = True
            least, most, depth, last = tree.least[own], tree.most[own], tree.depth[own], tree.last[own]
            possible = (100 * most >= share * size) & (share * least <= 100 * size)
            for a, b in zip(levels[1:], levels[2:]):
                own_parent = parent[a:b]
                overlap[a:b] += overlap[own_parent]
                bound = overlap[a:b] + np.minimum(rest[last[a:b] + 1], most[a:b] - depth[a:b])
                going[a:b] = going[own_parent] & possible[a:b] & (bound >= needed(size, least[a:b], share))
                if not going[a:b].any():
                    break
            # A set that is the beginning of others ends at an inner node: its own overlap decides.
            leaf = tree.leaf[own]
            got = leaf[going & (leaf >= 0) & (overlap >= needed(size, depth, share))]
            got = got[open_[got]]
            if len(got):
                component[got], open_[got] = start, False
                queue += got.tolist()
                stale += len(got)
    return component


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, n, cls): the class of each document's set; of empty sets, null."""

    @released
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames, "text", 2_000_000):
            hashes, bounds = shingle_sets(part["text"].tolist(), k)
            n = np.diff(bounds)
            out = part[["doc_id", "key"]].copy()
            out["doc_id"] = pd.array([None if x else int(v) for v, x in zip(part["doc_id"], part["doc_id"].isna())], "Int64")
            out["n"] = n
            out["cls"] = pd.arrays.IntegerArray(_set_keys(hashes, bounds), n == 0)
            yield out

    return docs.select("doc_id", "key", "text").mapInPandas(run, "doc_id long, key long, n long, cls long")


def _packed(texts: list[str | None]) -> list[bytes]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    return [packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]


def _unpacked(frames: Iterator[pd.DataFrame], most: int = 2_000_000) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    """Batches of packed texts (z; n shingles), in slices of about ``most`` characters."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for frame in frames:
        for part in slices(frame, frame["n"].to_numpy() * 8, most):
            yield part, [unpacker.decompress(z).decode("utf-8", "surrogatepass") for z in part["z"]]


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[str | None]]]:
    for part in pieces(frames, "text", 2_000_000):
        yield part, part["text"].tolist()


def _planes(h: np.ndarray) -> bytes:
    """Sorted hashes without their last 16 bits, byte by byte, so that the first bytes pack well."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :6] = x.T
    return out.view(">u8").ravel().astype(np.uint64)


def _alone(texts: DataFrame, batches, k: int, sample: int, total: int, most: int = 3_000_000) -> DataFrame:
    """(cls, u): how many (of a ``sample``-th) of a class's shingles no other class has.

    A worker hands on, for each part of the hashes' range, packed arrays of hashes and classes;
    of a shingle that several of its classes have, only two.  Counts by class are packed
    likewise until they are added up.  total: shingles of all classes;
    most: in a part.
    """
    parts = max(1, math.ceil(total / sample / most))

    def hand_on(h: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        first = np.r_[True, h[1:] != h[:-1]]
        last = np.r_[first[1:], True]
        kept = first | (last & (c != c[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]))
        h, c = h[kept], c[kept]
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        at = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
        rows = [(i, _planes(h[a:b]), c[a:b].tobytes()) for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())) if b > a]
        return pd.DataFrame(rows, columns=["part", "h", "c"])

    @released
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, own in batches(frames):
            hashes, bounds = shingle_sets(own, k)
            keys = _set_keys(hashes, bounds)
            new = np.array([c not in seen and not seen.add(c) for c in keys.tolist()], bool)
            if len(seen) > 1_000_000:
                seen.clear()
            n = np.diff(bounds)
            taken = (hashes % np.uint64(sample) == 0) & np.repeat(new, n)
            held.append((hashes[taken], np.repeat(keys, n)[taken]))
            size += int(taken.sum())
            if size > 1_500_000:
                yield hand_on(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield hand_on(*(np.concatenate(x) for x in zip(*held)))

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([_from_planes(x) for x in frame["h"]])
        c = np.frombuffer(b"".join(frame["c"]), np.int64)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        alone = np.minimum.reduceat(c, start) == np.maximum.reduceat(c, start)
        cls, u = np.unique(c[start[alone]], return_counts=True)
        group = (cls.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        at = np.searchsorted(group[order], np.arange(parts + 1))
        rows = [(g, cls[order[x:y]].tobytes(), u[order[x:y]].tobytes()) for g, (x, y) in enumerate(zip(at.tolist(), at[1:].tolist())) if y > x]
        return pd.DataFrame(rows, columns=["group", "cls", "u"])

    def total_of(frame: pd.DataFrame) -> pd.DataFrame:
        cls, ids = np.unique(np.frombuffer(b"".join(frame["cls"]), np.int64), return_inverse=True)
        u = np.bincount(ids, np.frombuffer(b"".join(frame["u"]), np.int64), len(cls))
        return pd.DataFrame({"cls": cls, "u": u.astype(np.int64)})

    got = texts.mapInPandas(run, "part int, h binary, c binary").groupBy("part").applyInPandas(add, "group int, cls binary, u binary")
    return got.groupBy("group").applyInPandas(total_of, "cls long, u long")


def _possible(classes: DataFrame, alone: DataFrame, share: int) -> DataFrame:
    """Rows (cls, n ...) but those with too many shingles that no other class has."""
    return classes.join(alone, "cls", "left").where(100 * F.coalesce("u", F.lit(0)) <= (100 - share) * F.col("n")).drop("u")


def _sketch(texts: DataFrame, k: int) -> np.ndarray:
    """Counts of shingles by 20 bits of their hashes: four megabytes, whatever the input."""

    @released
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int64)
        for _, own in _unpacked(frames):
            counts += np.bincount((shingle_sets(own, k)[0] >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        yield pd.DataFrame({"part": range(SLOTS // PART), "counts": [c.astype("<u4").tobytes() for c in counts.reshape(-1, PART)]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in frame["counts"])
        return pd.DataFrame({"part": frame["part"].iloc[:1], "counts": [np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()]})

    rows = texts.select("n", "z").mapInPandas(run, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    out = np.zeros(SLOTS, np.int64)
    for r in rows:
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, "<u4")
    return out


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, to) of a few edges: each node's component, by its least member."""
    frame = pd.concat(frames)
    nodes, ids = np.unique(np.r_[frame["a"], frame["b"]], return_inverse=True)
    a, b = ids[: len(frame)], ids[len(frame) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pd.DataFrame({"node": nodes, "to": nodes[label]})


def components(edges: DataFrame, few: int = 500_000) -> DataFrame:
    """(node, component) of edges (a, b), by contraction: each node goes to its neighbour of least hash in the round, until ``few`` edges are left, which one task contracts."""
    edges = cut(edges.where("a <> b").distinct(), "edges")
    labels, rounds = None, 0
    while n := edges.count():
        if n <= few:
            goes = cut(edges.coalesce(1).mapInPandas(_contracted, "node long, to long"), "contraction")
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("r"), F.col(c).alias("v"))
            goes = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), "m")["v"].alias("to")), "contraction")
        done = [edges]
        if labels is None:
            labels = goes
        else:
            new = cut(labels.join(goes.select(F.col("node").alias("to"), F.col("to").alias("then")), "to", "left").select("node", F.coalesce("then", "to").alias("to")), "labels")
            done += [labels, goes]
            labels = new
        if n <= few:
            drop(*done)
            break
        a = goes.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = goes.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = cut(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop(*done)
        rounds += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("to").alias("component"))


def links(docs: DataFrame, share: int = 80, k: int = K, sample: int = 4, block: int = 1024, weight: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(classes of all documents as of _classes, links (a, b) of classes, by which components are those of all links)."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    classes = cut(_classes(own, k), "classes")
    per = classes.where("cls IS NOT NULL").groupBy("cls").agg(F.max("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "key")).alias("at"))
    per = cut(per.select("cls", "n", F.col("at.doc_id").alias("doc_id"), F.col("at.key").alias("key")), "representatives")
    total = per.agg(F.sum("n")).first()[0] or 0
    left = _possible(per, _alone(own.select("text"), _texts, k, sample, total), share)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames, "text", 8_000_000):
            doc = pd.array([None if x else int(v) for v, x in zip(part["doc_id"], part["doc_id"].isna())], "Int64")
            yield pd.DataFrame({"doc_id": doc, "key": part["key"].to_numpy(), "z": _packed(part["text"].tolist())})

    packed = own.where(F.octet_length("text") > 0).mapInPandas(pack, "doc_id long, key long, z binary")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.key") == F.col("c.key"))
    first = cut(packed.alias("d").join(left.alias("c"), same).select("cls", "n", "z"), "texts")
    # Repeated rows have their representative's key too; one of each is enough.
    kept = first.groupBy("cls").agg(F.max("n").alias("n"))
    total = kept.agg(F.sum("n")).first()[0] or 0
    # Once more among those left, and now with all their shingles.
    possible = _possible(kept, _alone(first.select("n", "z"), _unpacked, k, 1, total), share)
    texts = cut(first.join(possible.select("cls"), "cls", "left_semi"), "texts")
    drop(per, first)
    counts = _sketch(texts, k)
    common = np.maximum(counts // max(1, 4 * int(counts.mean()) + 4), 0)
    shared = spark.sparkContext.broadcast(np.where(common > 0, np.ceil(np.log2(common + 1)), 0).astype(np.uint64))

    def beginnings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The classes' first shingles in the common order."""
        frequent = shared.value
        for part, own in _unpacked(frames, 1_000_000):
            hashes, bounds = shingle_sets(own, k)
            size = np.diff(bounds)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((hashes, frequent[(hashes >> np.uint64(44)).astype(np.int64)], owner))
            nth = np.arange(len(hashes)) - np.repeat(bounds[:-1], size)
            first = nth < np.repeat(size - -(-share * size // 100) + 1, size)
            yield pd.DataFrame({"h": hashes[order][first].view(np.int64), "cls": part["cls"].to_numpy()[owner[first]]})

    starts = cut(texts.mapInPandas(beginnings, "h long, cls long"), "beginnings")
    roots = starts.groupBy("h").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("h", "a")
    near = components(starts.join(roots, "h").select("a", F.col("cls").alias("b")))
    members = cut(texts.join(near, texts.cls == near.node).select("component", "cls", "n", "z").dropDuplicates(["cls"]), "members")
    drop(starts, texts)
    found = cut(_joined(members, share, k, block, weight), "links")
    drop(members)
    return classes, found


EDGES = "a long, b long"


def _joined(members: DataFrame, share: int, k: int, block: int, weight: int) -> DataFrame:
    """Links inside neighbourhoods: members (component, cls, n, z)."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("cls")
        cls = frame["cls"].to_numpy()
        sets: list[np.ndarray] = []
        for _, own in _unpacked(iter([frame[["n", "z"]]])):
            hashes, bounds = shingle_sets(own, k)
            sets += [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
        with uncollected():
            got = linked(sets, share)
        linked_ = got != np.arange(len(cls))
        return pd.DataFrame({"a": cls[got[linked_]], "b": cls[linked_]})

    sizes = members.groupBy("component").agg(F.count("*").alias("classes"), F.sum("n").alias("weight"))
    large = cut(sizes.where((F.col("classes") > block) | (F.col("weight") > weight)), "large")
    if large.isEmpty():
        small = members
    else:
        small = members.join(large.select("component"), "component", "left_anti")
    total = small.agg(F.sum("n")).first()[0] or 0
    groups = max(1, math.ceil(total / weight))
    edges = small.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(groups))).select("task", "cls", "n", "z").groupBy("task").applyInPandas(join, EDGES)
    if large.isEmpty():
        return edges
    # Blocks of like set sizes; a set meets sets of up to 100 / share times its size.
    wide = members.join(large.select("component"), "component").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / share)))))
    cells = wide.groupBy("component", "band").agg(F.greatest(F.ceil(F.sum("n") / weight), F.ceil(F.count("*") / block)).alias("parts"))
    wide = cut(wide.join(cells, ["component", "band"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts"))).drop("parts"), "wide")
    inside = cut(wide.groupBy("component", "band", "part").applyInPandas(lambda frame: join(frame), EDGES), "inside")
    key = ["component", "band", "part"]

    def labelled(edges_: DataFrame) -> DataFrame:
        of = components(edges_)
        return wide.select(*key, "cls", "n").join(of.select(F.col("node").alias("cls"), F.col("component").alias("_c")), "cls", "left").withColumn("label", F.coalesce("_c", "cls")).drop("_c")

    def largest(labels: DataFrame, by: list[str]) -> DataFrame:
        per = labels.groupBy(*by, "label").agg(F.count("*").alias("m"), F.min("cls").alias("cls"))
        return per.groupBy(*by).agg(F.max_by(F.struct("label", "cls"), F.struct("m", "label")).alias("top")).select(*by, "top.label", "top.cls")

    # One member of each block's largest component; a thousand blocks at a time.
    tops = largest(labelled(inside), key)
    pivots = wide.join(tops.select("cls"), "cls", "left_semi")
    many = pivots.groupBy("component").agg(F.ceil(F.count("*") / 1000).alias("chunks"))
    pivots = pivots.join(many, "component").withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")))
    across = cut(pivots.select("component", "chunk", "cls", "n", "z").groupBy("component", "chunk").applyInPandas(lambda frame: join(frame), EDGES), "across")
    labels = cut(labelled(inside.unionByName(across)), "labels")
    outside = labels.join(largest(labels, ["component"]).select("component", F.col("label").alias("top")), "component").where("label <> top").select("component", "band", "cls", "n")
    per = outside.groupBy("component", "band").agg(F.greatest(F.ceil(F.sum("n") / weight), F.ceil(F.count("*") / block)).alias("parts"))
    outside = cut(outside.join(per, ["component", "band"]).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("parts"))).select("component", "band", "own", "cls"), "outside")
    out = edges.unionByName(inside).unionByName(across)
    if outside.isEmpty():
        return out
    blocks = wide.select(*key).distinct()
    groups_ = outside.select("component", F.col("band").alias("to"), "own").distinct().withColumn("band", F.explode(F.sequence(F.col("to") - 1, F.col("to") + 1)))
    meets = cut(groups_.join(blocks, ["component", "band"]).withColumn("task", F.xxhash64("component", "to", "own", "band", "part")), "meetings")
    theirs = wide.join(meets.select(*key, "task"), key).select("task", "cls", "n", "z")
    ours = outside.join(meets.select("component", F.col("to").alias("band"), "own", "task"), ["component", "band", "own"]).select("task", "cls")
    ours = ours.join(wide.select("cls", "n", "z"), "cls").select("task", "cls", "n", "z")
    return out.unionByName(reduce(DataFrame.unionByName, [theirs, ours]).groupBy("task").applyInPandas(lambda frame: join(frame), EDGES))


def joined(docs: DataFrame, share: int = 80, k: int = K) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, component_id (smallest doc_id reachable by links), group (null for an empty set)."""
    classes, found = links(docs, share, k)
    of = components(found)
    labelled = classes.join(of.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("group", F.coalesce("component", "cls"))
    least = cut(labelled.where("cls IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least")), "least")
    got = labelled.join(least, "group", "left")
    return got.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "group")


def query(docs: DataFrame) -> DataFrame:
    return joined(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the document of smallest doc_id (null ones last, then by hash of the text), as it is; documents with empty sets all stay.  Repeated rows of a document stay once."""
    got = joined(docs)
    first = got.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "key")).alias("at")).select("at.doc_id", "at.key")
    kept = first.unionByName(got.where("group IS NULL").select("doc_id", "key"))
    key = lambda doc: F.coalesce(doc.cast("long"), F.lit(-(1 << 63)))
    kept = kept.select(key(F.col("doc_id")).alias("_doc"), F.col("key").alias("_key"))
    own = docs.withColumn("_doc", key(F.col("doc_id"))).withColumn("_key", text_key(F.col("text")))
    # The same partitioning serves the semi join and the removal of repeated rows.
    return own.join(kept, ["_doc", "_key"], "left_semi").dropDuplicates(["_doc", "_key"]).select(*docs.columns)
