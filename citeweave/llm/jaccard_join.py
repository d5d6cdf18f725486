"""N-gram Jaccard join with prefix trees.

1. Every text becomes a set of shingles, named by 64-bit hashes; equal sets are one class from here on.
2. Shingles get one global order: by hash, with frequent ones last. Sets that are similar enough share two shingles
   that follow each other in both, among the first few of each, so inverted lists of such pairs hold every link. A
   shingle alone meets strangers, the more the larger the corpus is; a pair hardly does. Within a list, set sizes and
   a histogram of the hashes bound the overlap from above; what remains are candidate groups.
3. Within a candidate group the ordered sets are stored in a prefix tree. A set walks the tree with the overlap so
   far, shared by all sets below a node, and leaves a subtree when even its longest remainder can't reach the
   overlap that its smallest set needs, or when all of it is already in the set's component.

Only component links leave a task, never all pairs of a list or a group. Lists and groups longer than a block are cut
into blocks. Each block is joined by itself, and its sets are named by leaders, which are then joined by pairs of blocks:
leaders of a list stand for all sets with much the same histogram, by the extremes of sizes and histograms. In a
candidate group a component of a block is led by its smallest set, and what the leaders leave outside the group's largest
component is joined with the whole group. So the work on a group of copies grows with its size; where few sets of a list
or group link, it grows with the square of the number of leaders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeweave.llm.common import arrow_rows, drop_staged, mix64, scratch, staged
from citeweave.operators.components import components

#: Words of a shingle, and the threshold as a fraction: links have SHARE[1] * intersection >= SHARE[0] * union.
WORDS, SHARE = 4, (85, 100)
#: A shingle is frequent if so many sets hold it and one in so many sets; so many shingles are counted at a time, and
#: those are reported that occur so often among them.
FREQUENT, FREQUENT_ONE_IN, COUNTED_AT_ONCE, LEAST_COUNTED = 256, 1000, 1 << 21, 4
#: Buckets of the hash histogram of sets up to so many shingles; each size tier has twice as many of both. With more
#: shingles a bucket, the histograms of sets that have nothing in common are too much alike.
BUCKETS, TIER = 128, 2048
#: Rows of a block of a list; sets, and shingles in all, of a block of a candidate group.
LIST_BLOCK, BLOCK_SETS, BLOCK_SHINGLES = 1024, 256, 1 << 19
#: Sets of a list that one leader stands for have histograms that differ from its own by this part of its size at most.
NEAR_LEADER = 0.04
#: Buckets of ids of candidates, which are broadcast so that most other texts aren't shuffled.
ID_BUCKETS = 1 << 20
#: Lists up to this length are compared by shifts of the whole partition instead of one by one.
SHORT_LIST = 24
TEXTS_BYTES = 4 << 20
#: Rows of an Arrow batch, which a task holds as texts and as sets.
BATCH_ROWS = 2000
#: Words up to so many bytes are hashed by eight bytes at a time, all words together.
LONG_WORD = 128
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of lower-cased bytes, and where it starts; words up to eight bytes never collide by length."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        hashes = mix64(lengths.astype(np.uint64) * _BASE)
        short = np.flatnonzero(lengths <= LONG_WORD)
        for lane in range(LONG_WORD // 8):
            short = short[lengths[short] > 8 * lane] if lane else short
            if not len(short):
                break
            rest = np.minimum(lengths[short] - 8 * lane, 8).astype(np.uint64)
            value = eights[starts[short] + 8 * lane] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
            hashes[short] = mix64(hashes[short] * _BASE + value)
    for k in np.flatnonzero(lengths > LONG_WORD):
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes, starts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    lowered = [(t or "").encode().lower() for t in texts]
    at = 0
    while at < len(lowered):
        stop, size = at, 0
        while stop < len(lowered) and (stop == at or size + len(lowered[stop]) < TEXTS_BYTES):
            size += len(lowered[stop]) + 1
            stop += 1
        part = lowered[at:stop]
        hashes, starts = _word_hashes(np.frombuffer(b"\n".join(part), np.uint8))
        edges = np.cumsum([0] + [len(t) + 1 for t in part])
        bounds = np.searchsorted(starts, edges)
        with np.errstate(over="ignore"):
            for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                h = hashes[first:last]
                k = min(words, len(h))
                if not k:
                    out.append(np.zeros(0, np.uint64))
                    continue
                mixed = np.full(len(h) - k + 1, np.uint64(k))
                for j in range(k):
                    mixed = mix64(mixed * _BASE + h[j : len(h) - k + 1 + j])
                out.append(np.unique(mixed))
        at = stop
    return out


def run_length(share: tuple[int, int] = SHARE) -> int:
    """Shingles of a run, by which sets meet; where links may have less than half in common, only single ones are sure to be shared."""
    return 2 if 2 * share[0] > share[1] else 1


def prefix_length(n: int, share: tuple[int, int] = SHARE) -> int:
    """Of two sets that link, each has a common run that ends among its first so many shingles in the global order.

    A shingle that only this set has breaks run_length() runs of it, one that only the other has breaks one run less. With
    links of SHARE[0] / SHARE[1], of n shingles at most n * (1 - SHARE[0] / SHARE[1]) are its own, and most runs break then.
    """
    return run_length(share) * (share[1] - share[0]) * n // share[1] + 1 if n else 0


def runs(ordered: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """The name of the run that ends with each shingle; what comes before the first one is the same in all sets."""
    if run_length(share) == 1:
        return ordered
    with np.errstate(over="ignore"):
        return mix64(np.concatenate([np.zeros(min(1, len(ordered)), np.uint64), ordered[:-1]]) * _BASE + ordered)


def tier_of(n: int) -> int:
    tier = 0
    while n > TIER << tier:
        tier += 1
    return tier


def histogram(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall in each of equal ranges; counts stop at 255, which keeps differences lower bounds."""
    bits = (BUCKETS << tier_of(len(hashes))).bit_length() - 1
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def set_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums by which equal sets are told."""
    return tuple(int(mix64(hashes ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (1, 2))


def _frequent(docs: DataFrame, n: int, words: int) -> pd.DataFrame:
    """The frequent shingles with their counts; at most FREQUENT_ONE_IN times the mean set size of them.

    Counts are gathered over COUNTED_AT_ONCE shingles of a task and reported from LEAST_COUNTED on, so what is missed of
    a shingle is less than LEAST_COUNTED for each such portion of the corpus.
    """

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
        keep = counts >= LEAST_COUNTED
        return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(counts[keep])], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for hashes in shingle_sets(batch.column(0).to_pylist(), words):
                held.append(hashes)
                size += len(hashes)
                if size >= COUNTED_AT_ONCE:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    found = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= max(FREQUENT, n // FREQUENT_ONE_IN)).toPandas()


def _described(docs: DataFrame, frequent: pd.DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Of every document: set size, set fingerprint, hash histogram, and the runs of its prefix, those that end with a frequent shingle apart."""
    table = frequent.sort_values("shingle")
    shared = docs.sparkSession.sparkContext.broadcast((table["shingle"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = shared.value
        order = np.argsort(hot)
        hot, counts = hot[order], counts[order]
        for batch in batches:
            rows = []
            for hashes in shingle_sets(batch.column(1).to_pylist(), words):
                n = len(hashes)
                place = np.minimum(np.searchsorted(hot, hashes), max(len(hot) - 1, 0))
                known = hot[place] == hashes if len(hot) else np.zeros(n, bool)
                p = prefix_length(n, share)
                prefix = hashes[~known][:p]
                often = np.zeros(0, np.uint64)
                if len(prefix) < p:
                    late = hashes[known]
                    often = late[np.lexsort((late, counts[place[known]]))][: p - len(prefix)]
                f1, f2 = set_fingerprint(hashes)
                names = runs(np.concatenate([prefix, often]), share).view(np.int64)
                rows.append((n, f1, f2, histogram(hashes).tobytes(), names[: len(prefix)], names[len(prefix) :]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["doc_id", "n", "f1", "f2", "histogram", "prefix", "often"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, histogram binary, prefix array<long>, often array<long>")


def _bounded(a: np.ndarray, b: np.ndarray, hist: list[np.ndarray], n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which pairs of rows may link: sizes alike, and histograms that differ by no more than a link allows."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    passes = share[1] * small >= share[0] * large
    # intersection I and union U: U - I >= d, the histograms' difference, and U + I = the sum of sizes
    for size in {len(hist[k]) for k in np.unique(np.concatenate([a[passes], b[passes]]))} if passes.any() else ():
        at = np.flatnonzero(passes & np.array([min(len(hist[i]), len(hist[j])) == size for i, j in zip(a, b, strict=True)]))
        for first in range(0, len(at), max(1, (1 << 22) // size)):
            part = at[first : first + max(1, (1 << 22) // size)]
            x, y = (np.array([_folded(hist[k], size) for k in side[part]], np.int16) for side in (a, b))
            apart = np.abs(x - y).sum(1, dtype=np.int64)
            total = n[a[part]] + n[b[part]]
            passes[part] = share[1] * (total - apart) >= share[0] * (total + apart)
    return passes


def _folded(hist: np.ndarray, size: int) -> np.ndarray:
    return hist if len(hist) == size else np.minimum(hist.reshape(size, -1).sum(1, dtype=np.int64), 255)


#: A link (a, b); or, for a list of several blocks, a leader (a) with the extremes of its group's sizes and histograms.
_LINKS = "a long, b long, list long, low long, high long, floor binary, ceiling binary"


def _extremes(hist: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = min(map(len, hist))
    folded = np.array([_folded(h, size) for h in hist])
    return folded.min(0).astype(np.uint8), folded.max(0).astype(np.uint8)


def _led(rows: np.ndarray, key: np.ndarray, n: np.ndarray, hist: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows in order of block and size by leaders, each first: those of its block with much the same histogram."""
    while len(rows):
        leader = rows[0]
        inside = rows[(key[rows] == key[leader]) & (n[rows] <= n[leader] * (1 + NEAR_LEADER))]
        inside = inside[[len(hist[k]) == len(hist[leader]) for k in inside]]
        apart = np.abs(np.array([hist[k] for k in inside], np.int16) - hist[leader]).sum(1, dtype=np.int64)
        group = inside[apart <= NEAR_LEADER * n[leader]]
        yield group
        rows = rows[~np.isin(rows, group)]


def _list_links(share: tuple[int, int]):
    """Links and leaders from rows sorted by block: each row is linked to the smallest row of its group in the block."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        key, whole = frame["block"].to_numpy(), frame["list"].to_numpy()
        doc, before, n = frame["doc_id"].to_numpy(), frame["before"].to_numpy(), frame["n"].to_numpy()
        hist = [np.frombuffer(h, np.uint8) for h in frame["histogram"]]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        low = np.arange(len(key))
        short = np.repeat(sizes <= SHORT_LIST, sizes)
        left, right = [], []
        for shift in range(1, min(SHORT_LIST, len(key))):
            i = np.flatnonzero((key[:-shift] == key[shift:]) & short[:-shift])
            if not len(i):
                break
            left.append(i)
            right.append(i + shift)
        for start, size in zip(starts[sizes > SHORT_LIST], sizes[sizes > SHORT_LIST], strict=True):
            # along the sizes only a stretch can link; rows that came together elsewhere by the same run are skipped
            order = start + np.argsort(n[start : start + size], kind="stable")
            ends = np.searchsorted(n[order], n[order] * share[1] // share[0], "right")
            for at in range(size):
                i = np.full(max(0, ends[at] - at - 1), order[at])
                j = order[at + 1 : ends[at]]
                differs = (before[i] != before[j]) | (before[i] == 0)
                i, j = i[differs], j[differs]
                fresh = low[i] != low[j]
                i, j = i[fresh], j[fresh]
                good = _bounded(i, j, hist, n, share) if len(i) else np.zeros(0, bool)
                if good.any():
                    lowest = min(low[i[0]], low[j[good]].min())
                    merged = np.unique(np.append(low[j[good]], low[i[0]]))
                    part = low[start : start + size]
                    part[np.isin(part, merged)] = lowest
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            differs = (before[i] != before[j]) | (before[i] == 0)
            i, j = i[differs], j[differs]
            good = _bounded(i, j, hist, n, share) if len(i) else np.zeros(0, bool)
            i, j = i[good], j[good]
            while len(i):
                least = np.minimum(low[i], low[j])
                old = low.copy()
                np.minimum.at(low, i, least)
                np.minimum.at(low, j, least)
                low = low[low]
                if (low == old).all():
                    break
        linked = np.flatnonzero(low != np.arange(len(key)))
        rows = [(a, b, None, None, None, None, None) for a, b in zip(doc[low[linked]].tolist(), doc[linked].tolist(), strict=True)]
        several = np.flatnonzero(frame["several"].to_numpy())
        for group in _led(several[np.lexsort((n[several], key[several]))], key, n, hist):
            floor, ceiling = _extremes([hist[k] for k in group])
            rows += [(int(doc[group[0]]), int(doc[k]), None, None, None, None, None) for k in group[1:]]
            rows.append((int(doc[group[0]]), None, int(whole[group[0]]), int(n[group].min()), int(n[group].max()), floor.tobytes(), ceiling.tobytes()))
        return pd.DataFrame(rows, columns=["a", "b", "list", "low", "high", "floor", "ceiling"]).astype({c: "Int64" for c in ("a", "b", "list", "low", "high")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            whole = int(np.searchsorted(held["block"].to_numpy(), held["block"].iloc[-1])) if len(held) else 0
            if whole:
                yield links(held.iloc[:whole].reset_index(drop=True))
                held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield links(held)

    return run


def _leader_links(share: tuple[int, int]):
    """Links between the leaders of two blocks of a list whose groups may hold sets that link."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("a", kind="stable").reset_index(drop=True)
        one, other = (np.flatnonzero(frame["place"].to_numpy() == k) for k in key[1:])
        doc, least, most = (frame[c].to_numpy(np.int64) for c in ("a", "low", "high"))
        size = min(map(len, frame["floor"])) if len(frame) else 0
        floor, ceiling = (np.array([_folded(np.frombuffer(h, np.uint8), size) for h in frame[c]], np.int16) for c in ("floor", "ceiling"))
        low = np.arange(len(frame))
        for i in one.tolist():
            j = other[low[other] != low[i]]
            j = j[(share[1] * np.maximum(most[i], least[j]) >= share[0] * np.maximum(least[i], least[j])) & (share[1] * np.maximum(most[j], least[i]) >= share[0] * np.maximum(least[i], least[j]))]
            if len(j):
                apart = np.maximum(np.maximum(floor[i] - ceiling[j], floor[j] - ceiling[i]), 0).sum(1, dtype=np.int64)
                total = most[i] + most[j]
                j = j[share[1] * (total - apart) >= share[0] * (total + apart)]
            if len(j):
                merged = np.unique(np.append(low[j], low[i]))
                low[np.isin(low, merged)] = merged[0]
        linked = low != np.arange(len(low))
        return pd.DataFrame({"a": doc[low[linked]], "b": doc[linked]})

    return run


class PrefixTree:
    """Ordered sets in a tree whose edges hold the shingles that all sets below share next."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.labels: list[np.ndarray] = [np.zeros(0, int)]
        self.children: list[list[int]] = [[]]
        self.members: list[list[int]] = [[]]
        stack = [(0, 0)]  # (node, depth at its end) along the last set's path
        last = np.zeros(0, int)
        for k in order:
            current = sets[k]
            m = min(len(last), len(current))
            differ = np.flatnonzero(last[:m] != current[:m])
            common = int(differ[0]) if len(differ) else m
            below = None
            while stack[-1][1] > common:
                below = stack.pop()
            node, depth = stack[-1]
            if below is not None and depth < common:  # split the edge that the paths leave
                low = below[0]
                middle = self._add(self.labels[low][: common - depth], [low])
                self.labels[low] = self.labels[low][common - depth :]
                self.children[node][-1] = middle
                stack.append((middle, common))
                node, depth = middle, common
            if len(current) > depth:
                leaf = self._add(current[depth:], [])
                self.children[node].append(leaf)
                stack.append((leaf, len(current)))
                node = leaf
            self.members[node].append(k)
            last = current
        #: Of the sets at or below a node: the most shingles left after the node, and the smallest and largest sizes.
        self.deep = np.zeros(len(self.labels), int)
        self.least, self.most = np.full(len(self.labels), np.iinfo(np.int64).max), np.zeros(len(self.labels), np.int64)
        for node in self._bottom_up():
            for k in self.members[node]:
                self.least[node], self.most[node] = min(self.least[node], sizes[k]), max(self.most[node], sizes[k])
            for child in self.children[node]:
                self.deep[node] = max(self.deep[node], self.deep[child] + len(self.labels[child]))
                self.least[node], self.most[node] = min(self.least[node], self.least[child]), max(self.most[node], self.most[child])

    def _add(self, label: np.ndarray, children: list[int]) -> int:
        self.labels.append(label)
        self.children.append(children)
        self.members.append([])
        return len(self.labels) - 1

    def _bottom_up(self) -> list[int]:
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += self.children[node]
        return order[::-1]


def join_group(sets: list[np.ndarray], share: tuple[int, int] = SHARE, known: np.ndarray | None = None) -> np.ndarray:
    """The smallest index linked, directly or not, with each set of a group; sets with equal ``known`` are linked already."""
    sizes = np.array([len(s) for s in sets], np.int64)
    found, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles that no other set of the group holds count for sizes only; frequent ones come first and share paths
    rank = np.empty(len(found), np.int64)
    rank[np.lexsort((found, -counts))] = np.arange(len(found))
    cuts = np.cumsum(sizes)[:-1]
    local = [np.sort(r[c > 1]) for r, c in zip(np.split(rank[inverse], cuts), np.split(counts[inverse], cuts), strict=True)]
    tree = PrefixTree(local, sizes)
    root = np.arange(len(sets))
    if known is not None:
        _, first, inside = np.unique(known, return_index=True, return_inverse=True)
        root = first[inside]

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    one = [-1] * len(tree.labels)  # a node's component while all sets below are in one
    upward = tree._bottom_up()
    above = [0] * len(tree.labels)
    for node in upward:
        for child in tree.children[node]:
            above[child] = node

    def settle(node: int) -> int:
        """The component of everything below, or -1."""
        if one[node] >= 0:
            one[node] = find(one[node])
            return one[node]
        return -1

    def update(node: int) -> None:
        while True:
            parts = {find(k) for k in tree.members[node]} | {settle(c) for c in tree.children[node]}
            if len(parts) != 1 or -1 in parts:
                return
            one[node] = parts.pop()
            if node == 0:
                return
            node = above[node]

    home = [0] * len(sets)
    for node in upward:
        for k in tree.members[node]:
            home[k] = node
    for node in {home[k] for k in range(len(sets))}:
        update(node)
    holds = np.zeros(len(found), bool)
    for q in range(len(sets)):
        if not sizes[q]:
            continue
        holds[local[q]] = True
        stack = [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            if settle(node) == find(q) or tree.least[node] * share[0] > share[1] * sizes[q] or tree.most[node] * share[1] < share[0] * sizes[q]:
                continue
            overlap += int(holds[tree.labels[node]].sum())
            # the smallest set that may still link needs the least overlap
            partner = max(int(tree.least[node]), -(-share[0] * int(sizes[q]) // share[1]))
            need = -(-share[0] * (int(sizes[q]) + partner) // (share[0] + share[1]))
            if overlap + min(int(tree.deep[node]), len(local[q]) - overlap) < need:
                continue
            for k in tree.members[node]:
                if k != q and share[1] * overlap >= share[0] * (sizes[q] + sizes[k] - overlap) and find(k) != find(q):
                    low, high = sorted((find(k), find(q)))
                    root[high] = low
                    update(home[q])
                    update(node)
            stack += [(child, overlap) for child in tree.children[node]]
        holds[local[q]] = False
    return np.array([find(k) for k in range(len(sets))])


def _join_groups(share: tuple[int, int]):
    """Links of one block, or of two, of a candidate group from rows (doc_id, shingles, known component)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable").drop_duplicates(["doc_id", "shingles"])
        ids, known = frame["doc_id"].to_numpy(), frame["known"].to_numpy()
        low = join_group([np.frombuffer(s, np.uint64) for s in frame["shingles"]], share, known)
        linked = known[low] != known
        return pd.DataFrame({"a": ids[low[linked]], "b": ids[linked]})

    return run


def _shingled(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, f1, f2 and the shingles of every document's set, and its group, place and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            marks = [set_fingerprint(s) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *(batch.column(k) for k in (2, 3, 4))], ["doc_id", "n", "f1", "f2", "shingles", "group", "place", "blocks"])

    kinds = "doc_id long, n long, f1 long, f2 long, shingles binary, group long, place int, blocks int"
    return docs.select("doc_id", "text", "group", "place", "blocks").mapInArrow(run, kinds)


def _block(key: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")


def _sized(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows with the number of blocks of their key. Only keys of several blocks are broadcast, so they are few: each has hundreds of rows."""
    several = rows.groupBy(key).agg(blocks.alias("blocks")).where("blocks > 1")
    return rows.join(F.broadcast(several), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _paired(rows: DataFrame) -> DataFrame:
    """Rows with (place, blocks) once for every pair of blocks (one, other) that theirs is in."""
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("partner", partner).withColumns({"one": F.least("place", "partner"), "other": F.greatest("place", "partner")}).drop("partner")


def _candidate_links(reps: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) such that sets that link are connected by them: sets of one inverted list that may link by their bounds."""
    # most runs are in one set, and go first; only a run that doesn't end with a frequent shingle is counted in one task
    met = reps.select("doc_id", F.posexplode("prefix").alias("at", "list")).withColumn("rows", F.count("*").over(W.partitionBy("list"))).where("rows > 1").drop("rows")
    often = reps.select("doc_id", F.size("prefix").alias("first"), F.posexplode("often").alias("at", "list")).select("doc_id", (F.col("first") + F.col("at")).alias("at"), "list")
    met = staged(met.unionByName(often), "met")
    # each row of a list with the run before: sets that have that in common too meet in its list; one that went has no others
    earlier = W.partitionBy("doc_id").orderBy("at")
    before = F.when(F.lag("at").over(earlier) == F.col("at") - 1, F.lag("list").over(earlier))
    listed = staged(met.select("doc_id", "list", F.coalesce(before, F.lit(0)).alias("before")), "listed")
    drop_staged(met)
    sums = {"rows": F.count("*"), "least": F.min("before"), "most": F.max("before")}
    long = staged(listed.groupBy("list").agg(*(c.alias(k) for k, c in sums.items())).where(F.col("rows") > LIST_BLOCK), "long")
    listed = listed.join(F.broadcast(long), "list", "left")  # one of more than LIST_BLOCK rows
    short = listed.where("rows is null").withColumns({k: c.over(W.partitionBy("list")) for k, c in sums.items()})
    listed = short.unionByName(listed.where("rows is not null")).where("rows > 1 and (least <> most or least = 0)")

    # blocks of lists; in a list of several blocks every row counts, since those it meets elsewhere may lie in another
    listed = listed.withColumn("blocks", F.ceil(F.col("rows") / LIST_BLOCK).cast("int")).withColumn("several", F.col("blocks") > 1)
    listed = listed.select("doc_id", "several", F.when(F.col("several"), F.lit(0)).otherwise(F.col("before")).alias("before"), "list", F.xxhash64("list", _block("doc_id", "blocks")).alias("block"))
    listed = listed.join(reps.select("doc_id", "n", "histogram"), "doc_id").repartition("block").sortWithinPartitions("block")
    found = staged(listed.select("block", "list", "several", "doc_id", "before", "n", "histogram").mapInPandas(_list_links(share), _LINKS), "candidates")

    leaders = found.where("b is null").select("a", "list", "low", "high", "floor", "ceiling")
    paired = _paired(_sized(leaders, "list", F.ceil(F.count("*") / LIST_BLOCK).cast("int")).withColumn("place", _block("a", "blocks")))
    return found.where("b is not null").select("a", "b").unionByName(paired.groupBy("list", "one", "other").applyInPandas(_leader_links(share), "a long, b long"))


def _blocks(counted: Column) -> Column:
    """How many blocks the rows of a group that are counted make."""
    shingles = F.coalesce(F.sum(F.when(counted, F.col("n"))), F.lit(0))
    return F.greatest(F.ceil(F.count_if(counted) / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (group, doc_id, n, ...) with their block (place) of so many (blocks) of their group."""
    return _sized(rows, "group", _blocks(F.lit(True))).withColumn("place", _block("doc_id", "blocks"))


def _across(rows: DataFrame, sides: list[tuple[Column, Column]]) -> DataFrame:
    """Of rows (group, doc_id, n, known) of groups of several blocks, those of each pair of sides once for every pair of blocks (one, other)."""
    sizes = [_blocks(side).alias(f"blocks{k}_{s}") for k, pair in enumerate(sides) for s, side in enumerate(pair)]
    blocks = F.broadcast(rows.groupBy("group").agg(*sizes))  # one of each large group

    def places(k: int, s: int) -> Column:
        """The pairs of blocks that a row of side ``s`` is in; none where the other side has no rows."""
        place, partners = _block("doc_id", f"blocks{k}_{s}"), F.col(f"blocks{k}_{1 - s}")
        pair = lambda partner: F.struct(F.lit(k).alias("pair"), (partner if s else place).alias("one"), (place if s else partner).alias("other"))
        return F.when(sides[k][s] & (partners > 0), F.transform(F.sequence(F.lit(0), partners - 1), pair))

    every = F.flatten(F.array_compact(F.array(*(places(k, s) for k in range(len(sides)) for s in (0, 1)))))
    return rows.join(blocks, "group").select("group", "doc_id", "known", F.explode(every).alias("at")).select("group", "doc_id", "known", "at.*")


def _exact_links(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) of the sets (doc_id, n, shingles) of each candidate group, with their block (place) of so many (blocks)."""
    join = _join_groups(share)
    shingles = sets.select("doc_id", "shingles").hint("merge")  # what joins them grows with the data: never broadcast
    inside = sets.select("group", "place", "doc_id", "shingles", F.col("doc_id").alias("known"))
    links = staged(inside.groupBy("group", "place").applyInPandas(join, "a long, b long"), "links")
    large = sets.where("blocks > 1").select("group", "doc_id", "n")
    if not large.limit(1).count():
        return links

    # the leaders of blocks
    follows = links.select(F.col("b").alias("doc_id"))
    leads, led = (large.join(follows, "doc_id", how).withColumn("leads", F.lit(how == "left_anti")) for how in ("left_anti", "left_semi"))
    large = staged(leads.unionByName(led), "large")
    among = _paired(_cut(large.where("leads"))).select("group", "one", "other", "doc_id", F.col("doc_id").alias("known")).join(shingles, "doc_id")
    links = staged(links.unionByName(among.groupBy("group", "one", "other").applyInPandas(join, "a long, b long")), "links")

    # what lies outside a group's largest component with all of the group, but for leaders with leaders
    known = staged(large.join(components(links), F.col("doc_id") == F.col("node"), "left").select("group", "doc_id", "n", "leads", F.coalesce("component", "doc_id").alias("known")), "known")
    most = known.groupBy("group", "known").agg(F.count("*").alias("sets")).groupBy("group").agg(F.max(F.struct("sets", "known")).alias("most"))
    most = F.broadcast(most.select("group", F.col("most.known").alias("largest")))  # one of each large group
    known = staged(known.join(most, "group").withColumn("outside", F.expr("known <> largest")), "known")
    if not known.where("outside").limit(1).count():
        return links
    outside, leads = F.col("outside"), F.col("leads")
    rest = _across(known, [(outside & ~leads, F.lit(True)), (outside & leads, ~leads)]).join(shingles, "doc_id")
    return links.unionByName(rest.groupBy("group", "pair", "one", "other").applyInPandas(join, "a long, b long"))


def similar_components(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Null and empty texts have empty sets and link with nothing. Rows repeated with one id are one document, which has the
    links of all its texts, and give a row each; a null id gives a row of its own with its set size and a null component.
    A text of any length is one set, in one task. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _components(rows, words, share)


def _components(rows: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """similar_components() of rows (doc_id, text)."""
    n = rows.count()
    spark = rows.sparkSession
    wide = staged(_described(rows, _frequent(rows, n, words), words, share), "described")
    described = staged(wide.select("doc_id", "n", "f1", "f2"), "sizes")
    n_ids = described.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    repeated = n_ids[0] != n_ids[1]
    # a class of equal sets is represented by its smallest document
    sets = described.where("n > 0 and doc_id is not null")
    classes = staged(sets.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    key = ["doc_id", "n", "f1", "f2"]
    own = classes.withColumnRenamed("rep", "doc_id")
    reps = wide.where("n > 0 and doc_id is not null").join(own, key)
    reps = staged((reps.dropDuplicates(key) if repeated else reps).select("doc_id", "n", "histogram", "prefix", "often"), "reps")
    drop_staged(wide)
    with scratch(spark) as keep:
        candidates = keep(_candidate_links(reps, share), "candidates")
    with scratch(spark) as keep:
        groups = keep(components(candidates), "groups")

    # the exact join inside candidate groups, whose texts are read again
    sizes = reps.groupBy("doc_id").agg(F.sum("n").alias("n")) if repeated else reps.select("doc_id", "n")
    members = staged(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group")).join(sizes, "doc_id"), "members")
    drop_staged(reps, candidates)
    placed = staged(_cut(members).select("doc_id", "group", "place", "blocks"), "placed")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).cast("int")
    chosen = rows.where("doc_id is not null").withColumn("bucket", bucket).join(F.broadcast(placed.select(bucket.alias("bucket")).distinct()), "bucket")
    grouped = _shingled(chosen.select("doc_id", "text").join(placed.hint("merge"), "doc_id"), words).where("n > 0")
    grouped = staged(grouped.dropDuplicates(key) if repeated else grouped, "grouped")
    with scratch(spark) as keep:
        links = keep(_exact_links(grouped, share), "links")
    drop_staged(groups, members, placed, grouped)

    # every document takes the component of its class
    if not repeated:
        linked = staged(components(links), "linked")
        drop_staged(links)
        out = described.join(classes, ["n", "f1", "f2"], "left").join(linked, F.col("rep") == F.col("node"), "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))

    # classes that one id has texts of are one
    member = staged(sets.join(classes, ["n", "f1", "f2"]).select("doc_id", "rep").distinct(), "member")
    first = staged(member.groupBy("doc_id").agg(F.min("rep").alias("first"), F.max("rep").alias("last")), "first")
    both = member.join(first.where("first <> last"), "doc_id").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    linked = staged(components(links.unionByName(both)), "linked")
    drop_staged(classes, links, member)
    of_document = first.join(linked, F.col("first") == F.col("node"), "left").select("doc_id", F.coalesce("component", "first").alias("component_id"))
    out = described.select("doc_id", F.col("n").alias("n_shingles")).join(of_document, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
