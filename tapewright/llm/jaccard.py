"""N-gram Jaccard self-join with a count-vector R-tree.

Distinct word shingles are 64-bit hashes.  Documents with equal sets are one
point.  The shingles are hashed into groups, 64 of them or four to eight shingles to a
group, and the counts of the groups are the point's coordinates: the overlap of two sets is at
most the sum of the coordinates' minima.

1. The top of the tree is a set of shuffle keys, so that it spreads over tasks.  A
   node of it holds the points with a non-zero count in one leading coordinate (a
   single shingle; the order puts frequent ones last, by a counter sketch of fixed
   size): two sets whose first n - ceil(t n) + 1 shingles have none in common can't
   reach the overlap.  Long sets, which would meet by chance, are dealt by whole
   groups of coordinates: linked sets differ in fewer shingles than there are
   groups, so one group at least is equal in both.
2. Below, a task packs the points of its nodes into R-trees by node, size and
   leading counts, and joins each tree with itself: pairs of boxes whose nodes, sizes
   or summed minima of upper corners rule a link out go at once, then pairs of points
   by their own minima, first of 64 coarse counts, then of all.
3. Points that the bound connects form clusters.  Within a cluster the pairs that
   survive are verified on the sets, found again through a tree of the cluster.  A
   set that is connected already is tested no more: the result is classes, not pairs.

Large nodes and clusters are cut into tiles in two steps, so that near copies leave before
pairs of tiles are made.  First each row is sent to one tile, which is searched alone.  In a
node, what a tile connects goes on as one box, its points' upper corner and range of
sizes, and boxes of different tiles are connected by the same bound.  In a cluster, a few
sets go to every tile, so that the tiles' classes meet there; only sets outside the
cluster's largest class are then taken to the tiles of all others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, among, fresh, rows_of, written
from .graph import components

#: Coarse coordinates of the boxes; points that are sent have finer ones from so many shingles a coordinate on.
GROUPS, CROWD = 64, 8
LEAF = 16
#: Rows of nodes that a task packs into one tree, and pairs that it compares at once.
TREE_ROWS, PAIRS = 2048, 1 << 16
#: Counters of the frequency sketch (as a power of 2) and the blocks that they are sent in.
SKETCH_BITS, SKETCH_BLOCKS = 21, 64
#: Points of a node's tile; nodes of more than two tiles are cut.
TILE_SETS = 256
#: Boxes of a node's tile, as long as that makes few tiles, then more boxes and bytes of them.
SPREAD_BOXES, TILE_BOXES, TILE_BYTES = 6, 4096, 1 << 26
#: Sets and shingles of a cluster's tile, and sets of the cluster that go to every tile.
SPREAD_SETS, TILE_SHINGLES, PIVOTS = 64, 4_000_000, 8
#: Most tiles that ``SPREAD_SETS`` makes of a cluster's largest class and of the rest, when they meet.
SPREAD_CLASS, SPREAD_REST = 32, 4
MEMO_WORDS = 500_000
#: Pairs whose smaller set has so many shingles meet by whole groups; classes of sizes grow by half.
LONG = 1024

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct shingle hashes of texts, with a bounded memo of word hashes."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        codes = list(map(memo.get, words))
        if None in codes:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for i, c in enumerate(codes):
                if c is None:
                    w = words[i]
                    c = memo.get(w)
                    if c is None:
                        c = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "big")
                        if len(w) <= 64:
                            memo[w] = c
                    codes[i] = c
        w = np.array(codes, np.uint64)
        k = min(self.words, len(w))
        with np.errstate(over="ignore"):
            h = np.full(len(w) - k + 1, k, np.uint64)
            for j in range(k):
                h = _mix(h * _A + w[j : len(w) - k + 1 + j])
        return np.unique(h)


class CountTree:
    """R-tree over count vectors, packed by group, size and leading counts.

    Boxes keep the upper corner and the ranges of size and group; only points of
    one group are neighbours.  ``seen`` counts boxes (or pairs of them) that were
    visited and pruned, and points that were compared and kept.  With ``tops``, the
    points are boxes of sets, from ``sizes`` to ``tops`` shingles each.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray | None = None, groups: np.ndarray | None = None, tops: np.ndarray | None = None):
        sizes = points.sum(axis=1, dtype=np.int64) if sizes is None else sizes
        groups = np.zeros(len(points), np.int64) if groups is None else groups
        tops = sizes if tops is None else tops
        self.order = np.lexsort((*(points[:, g] for g in range(3)), sizes, groups))
        points, sizes, groups, tops = points[self.order], sizes[self.order], groups[self.order], tops[self.order]
        self.levels = [(points, sizes, tops, groups, groups)]
        while len(self.levels[-1][0]) > LEAF:
            high, low, top, first, last = self.levels[-1]
            starts = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(top, starts), np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)))
        self.seen = dict.fromkeys(("visited", "pruned", "compared", "kept"), 0)

    def _count(self, leaf: bool, before: int, after: int):
        self.seen["compared" if leaf else "visited"] += before
        self.seen["kept" if leaf else "pruned"] += after if leaf else before - after

    def search(self, point: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Rows whose bound lets them link to ``point``, a set of ``n``."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            high, low, top, _, _ = self.levels[level]
            if level < len(self.levels) - 1:
                at = _children(at, len(high))
            before = len(at)
            at = at[(100 * top[at] >= percent * n) & (percent * low[at] <= 100 * n)]
            at = at[np.minimum(point, high[at]).sum(axis=1, dtype=np.int64) * (100 + percent) >= percent * (n + low[at])]
            self._count(level == 0, before, len(at))
        return self.order[at]

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows a, b of different points of one group whose bound lets them link."""
        m = len(self.levels[-1][0])
        a, b = np.triu_indices(m)
        for level in range(len(self.levels) - 1, -1, -1):
            found = []
            if level < len(self.levels) - 1:
                n = len(self.levels[level][0])
                step = PAIRS // LEAF**2
                blocks = ((_below(a[i : i + step], b[i : i + step], n)) for i in range(0, len(a), step))
            else:
                blocks = [(a, b)]
            for x, y in blocks:
                found.append(self._close(level, x, y, percent))
            a, b = (np.concatenate(z) for z in zip(*found)) if found else (a[:0], b[:0])
        return self.order[a], self.order[b]

    def _close(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        high, low, top, first, last = self.levels[level]
        before = len(a)
        keep = (first[a] <= last[b]) & (first[b] <= last[a]) & (100 * top[a] >= percent * low[b]) & (100 * top[b] >= percent * low[a])
        if level == 0:
            keep &= a != b
        a, b = a[keep], b[keep]
        # overlap >= percent/(100+percent) of both sizes
        keep = np.minimum(high[a], high[b]).sum(axis=1, dtype=np.int64) * (100 + percent) >= percent * (low[a] + low[b])
        self._count(level == 0, before, int(keep.sum()))
        return a[keep], b[keep]


def _children(at: np.ndarray, n: int) -> np.ndarray:
    out = (at[:, None] * LEAF + np.arange(LEAF)[None, :]).ravel()
    return out[out < n]


def _below(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of pairs of boxes, each once."""
    steps = np.arange(LEAF)
    x = np.broadcast_to(a[:, None, None] * LEAF + steps[None, :, None], (len(a), LEAF, LEAF)).ravel()
    y = np.broadcast_to(b[:, None, None] * LEAF + steps[None, None, :], (len(a), LEAF, LEAF)).ravel()
    keep = (x < n) & (y < n) & (x <= y)
    return x[keep], y[keep]


def counts_of(s: np.ndarray, groups: int) -> np.ndarray:
    """Counts of a set's shingles by ``groups`` (a power of 2) groups."""
    return np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def point_of(s: np.ndarray, crowd: int = 2) -> bytes:
    """A set's counts as bytes: as many groups as leave at most ``crowd`` shingles to each on average, and no count above 255."""
    groups = max(GROUPS, 1 << max(0, (len(s) - 1) // crowd).bit_length())
    while True:
        counts = counts_of(s, groups)
        if counts.max(initial=0) <= 255:
            return counts.astype(np.uint8).tobytes()
        groups *= 2


#: Counts of a set and of a box as they are stored.
POINT, BOX = np.dtype("u1"), np.dtype("<u2")


def folded(points: list[bytes], groups: int, unit: np.dtype = POINT) -> np.ndarray:
    """Points as rows of ``groups`` counts: finer groups add up to coarser ones."""
    lengths = np.array([len(p) // unit.itemsize for p in points])
    short = int(lengths.max(initial=0)) // groups * np.iinfo(unit).max < 1 << 16
    out = np.zeros((len(points), groups), np.uint16 if short else np.uint32)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        x = np.frombuffer(b"".join(points[i] for i in at), unit).reshape(len(at), groups, n // groups)
        out[at] = x.sum(axis=2, dtype=out.dtype)
    return out


def boxes(points: list[bytes], sizes: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(root, smallest size, greatest size, upper corner) of the rows of each root."""
    order = np.argsort(root, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        own = [points[i] for i in rows]
        corner = folded(own, min(map(len, own))).max(axis=0)
        # a count that the corner can't hold: boxes of single points are whole as well, as the edges connect them
        parts = [(rows, corner)] if corner.max() <= np.iinfo(BOX).max else [([i], np.frombuffer(points[i], POINT)) for i in rows]
        for part, high in parts:
            yield int(part[0]), int(sizes[part].min()), int(sizes[part].max()), high.astype(BOX).tobytes()


def fine_enough(points: list[bytes], sizes: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int, unit: np.dtype = POINT) -> np.ndarray:
    """Which of the pairs pass the bound on the finest groups that both points have."""
    lengths = np.array([len(p) // unit.itemsize for p in points])
    groups, out = np.minimum(lengths[a], lengths[b]), np.ones(len(a), bool)
    for g in np.unique(groups[groups > GROUPS]):
        mine = np.flatnonzero(groups == g)
        rows, at = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
        x, left, right = folded([points[i] for i in rows], int(g), unit), at[: len(mine)], at[len(mine) :]
        step = max(1, PAIRS * GROUPS // int(g))
        for i in range(0, len(mine), step):
            k = mine[i : i + step]
            shared = np.minimum(x[left[i : i + step]], x[right[i : i + step]]).sum(axis=1, dtype=np.int64)
            out[k] = shared * (100 + percent) >= percent * (sizes[a[k]] + sizes[b[k]])
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least row of each component of the pairs to its other rows."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        np.minimum.at(now, root[a], least)
        np.minimum.at(now, root[b], least)
        now = now[now]
        if (now == root).all():
            break
        root = now
    rows = np.flatnonzero(root != np.arange(n))
    return root[rows], rows


def connect(sets: list[np.ndarray], percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Edges from the first set of each class of linked sets to its other ones.

    With ``split``, sets before it have neighbours from it on only.  A set that is
    reached leaves the search, so every later search is smaller.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    groups = max(GROUPS, 1 << int(np.median(sizes) / 2).bit_length())
    points = np.array([counts_of(s, groups) for s in sets], np.uint32)
    tree = CountTree(points, sizes)
    alive = np.ones(m, bool)
    side = None if split is None else np.arange(m) < split
    edges: list[tuple[int, int]] = []
    for seed in range(m):
        if not alive[seed]:
            continue
        alive[seed] = False
        stack = [seed]
        while stack:
            i = stack.pop()
            found = tree.search(points[i], int(sizes[i]), percent)
            found = found[alive[found]]
            if side is not None:
                found = found[side[found] != side[i]]
            if len(found):
                found = found[_linked(sets, sizes, i, found, percent)]
            alive[found] = False
            stack += found.tolist()
            edges += [(seed, int(j)) for j in found]
    return edges


def _linked(sets: list[np.ndarray], sizes: np.ndarray, i: int, rows: np.ndarray, percent: int) -> np.ndarray:
    """Which of the rows' sets link to set i, by their shared shingles."""
    own = sets[i]
    every = np.concatenate([sets[j] for j in rows])
    at = np.searchsorted(own, every)
    at[at == len(own)] = len(own) - 1
    shared = np.add.reduceat((own[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[rows])[:-1]]))
    return 100 * shared >= percent * (sizes[i] + sizes[rows] - shared)


# --- passes over the documents -----------------------------------------------


def _packed(counts: np.ndarray) -> bytes:
    """Counters compressed byte by byte: most are small, so all but the lowest bytes are zeros."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _describe(words: int, kind: str):
    """Rows of documents (block null) and, at the end of a task, rows of its sketch."""

    def run(batches):
        shingles, counts = Shingles(words), np.zeros(1 << SKETCH_BITS, np.uint32)
        none = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                none = pa.nulls(1, b.column(0).type)
                n, digests, points = [], [], []
                for text in b.column(1).to_pylist():
                    s = shingles(text)
                    n.append(len(s))
                    points.append(point_of(s, CROWD) if len(s) else None)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] += np.uint32(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(points, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], NAMES)
        if none is not None:
            for i, part in enumerate(counts.reshape(SKETCH_BLOCKS, -1)):
                if part.any():
                    blob = _packed(part)
                    yield pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([blob], pa.binary())], NAMES)

    NAMES = ["doc_id", "h", "n", "digest", "point", "block", "counts"]
    return run, f"doc_id {kind}, h long, n long, digest binary, point binary, block int, counts binary"


def _sum_sketch(batches) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = sums.setdefault(block, np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, np.uint32))
            own += _unpacked(blob)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])


def _most_different(n: int, m: int, percent: int) -> int:
    """Most shingles in which linked sets of n and m may differ."""
    return (100 - percent) * (n + m) // (100 + percent)


def size_classes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(class, its smallest and greatest size) of the pairs in which a set of n may be: by the smaller set's size."""
    out, j, low = [], 0, LONG
    while low <= n:
        high = low * 3 // 2 - 1
        if 100 * high >= percent * n:
            out.append((j, low, high))
        j, low = j + 1, high + 1
    return out


def group_keys(s: np.ndarray, percent: int) -> list[np.ndarray]:
    """Keys of a long set: a digest of each non-empty group, for each class of pairs.

    Linked sets differ in at most D shingles, so in at most D of the groups.  A
    set with more than D non-empty groups has an equal one in common with its
    partner; one with fewer (too uneven a hash) also takes the class's own key.
    """
    n, out = len(s), []
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(s + _A))])
        for j, low, high in size_classes(n, percent):
            k = (_most_different(high, 100 * high // percent, percent) + 1) * 28 // 25 + 2
            ends = np.concatenate([[0], np.searchsorted(s, np.arange(1, k, dtype=np.uint64) * np.uint64(2**64 // k)), [n]])
            full = np.flatnonzero(np.diff(ends))
            place = _mix(np.uint64(j + 1) * _C + full.astype(np.uint64))
            out.append(_mix(total[ends[full + 1]] - total[ends[full]] + place))
            if len(full) <= min(_most_different(high, 100 * high // percent, percent), _most_different(n, max(n, 100 * n // percent), percent)):
                out.append(_mix(np.array([j + 1], np.uint64) * _B))
    return out


def _prefixes(words: int, percent: int, sketch):
    def run(batches):
        shingles, counts = Shingles(words), np.frombuffer(sketch.value, np.uint32)
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                keys, ids = [], []
                for text in batch.slice(at, 512).column(0).to_pylist():
                    s = shingles(text)
                    n = len(s)
                    if not n:
                        continue
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if digest in seen:  # an equal set of this task has told its prefix
                        continue
                    if len(seen) < 500_000:
                        seen.add(digest)
                    own = group_keys(s, percent) if n >= LONG else []
                    if -(-percent * n // 100) < LONG:  # may link to a set that is not long
                        k = n - -(-percent * n // 100) + 1
                        own.append(s[np.argsort(counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:k]])
                    keys += own
                    ids.append(np.full(sum(map(len, own)), int.from_bytes(digest[:8], "big", signed=True), np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], ["key", "id"])

    return run


NODE = ["key", "i", "j", "tile", "n", "id", "point", "top", "cut"]


def _connected(rows: pa.Table, percent: int, unit: np.dtype, seen: dict | None = None):
    """Distinct rows of nodes (key, id, size, point, cut) and edges of them that connect what the bound lets link."""
    key, i, j, tile, sizes, ids = (rows.column(c).to_numpy() for c in NODE[:6])
    new = np.ones(len(ids), bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    fresh = new.copy()
    fresh[1:] |= ids[1:] != ids[:-1]  # tasks may name a set again
    group = np.cumsum(new)[fresh]
    key, i, j, tile, sizes, ids = (x[fresh] for x in (key, i, j, tile, sizes, ids))
    points = rows.column("point").filter(pa.array(fresh)).to_pylist()
    tops, cut = (rows.column(c).to_numpy(zero_copy_only=False)[fresh] if c in rows.column_names else default for c, default in (("top", sizes), ("cut", np.zeros(len(ids), bool))))
    tree = CountTree(folded(points, GROUPS, unit), sizes.astype(np.int64), group, tops.astype(np.int64))
    a, b = tree.pairs(percent)
    across = (i[a] == j[a]) | (tile[a] != tile[b])
    a, b = a[across], b[across]
    close = fine_enough(points, sizes, a, b, percent, unit)
    if seen is not None:
        for k, v in {**tree.seen, "trees": 1, "pairs": int(close.sum())}.items():
            seen[k] = seen.get(k, 0) + v
    return (key, ids, sizes, points, cut), forest(len(ids), a[close], b[close])


def node_edges(rows: pa.Table, percent: int, seen: dict | None = None, unit: np.dtype = POINT) -> tuple[np.ndarray, np.ndarray]:
    """Edges (ids) that connect what the bound lets link in each node; ``rows``: columns ``NODE``, sorted."""
    (_, ids, *_), (a, b) = _connected(rows, percent, unit, seen)
    return ids[a], ids[b]


def _node_edges(percent: int, unit: np.dtype = POINT):
    """Edges a, b of rows sorted as ``NODE``, and boxes of nodes that are cut: trees of whole nodes, about ``TREE_ROWS`` rows each."""

    def edges(parts) -> Iterator[pa.RecordBatch]:
        (key, ids, sizes, points, cut), (a, b) = _connected(pa.Table.from_batches(parts), percent, unit)
        none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), *none], EDGE)
        if cut.any():
            root = np.arange(len(ids))
            root[b] = a
            own = np.flatnonzero(cut)
            found = list(boxes([points[i] for i in own], sizes[own], root[own]))
            for at in range(0, len(found), 1024):
                first, low, top, corner = zip(*found[at : at + 1024])
                row = own[list(first)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[row]), pa.array(key[row]), pa.array(low, pa.int64()), pa.array(top, pa.int64()), pa.array(corner, pa.binary())], EDGE)

    def run(batches):
        held, n, last = [], 0, None
        for b in rows_of(batches, TREE_ROWS):
            if not b.num_rows:
                continue
            at = np.stack([b.column(c).to_numpy() for c in range(3)])
            ends = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            if n >= TREE_ROWS and last is not None:
                # the node that is open ends where the next one begins
                cut = 0 if (at[:, 0] != last).any() else int(ends[0]) if len(ends) else None
                if cut is not None:
                    yield from edges([*held, b.slice(0, cut)])
                    held, n, b = [], 0, b.slice(cut)
            held.append(b)
            n += b.num_rows
            last = at[:, -1]
        if n:
            yield from edges(held)

    EDGE = ["a", "b", "key", "n", "top", "point"]
    return run, "a long, b long, key long, n long, top long, point binary"


def _near(met: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Edges a, b that connect what the bound lets link; ``met``: key, id and the number ``met`` of the key's rows."""
    cut = F.col("met") > 2 * TILE_SETS
    tile = F.when(cut, F.pmod(F.xxhash64("id"), F.ceil(F.col("met") / TILE_SETS))).otherwise(0).cast("int")
    nodes = met.select("key", "id", cut.alias("cut"), tile.alias("tile")).join(points, "id").withColumns({"i": F.col("tile"), "j": F.col("tile"), "top": F.col("n")})
    run, schema = _node_edges(percent)
    first = written(_in_order(nodes).mapInArrow(run, schema))
    corners = first.where("key is not null").select("key", F.col("a").alias("id"), "n", "top", "point")
    run, schema = _node_edges(percent, BOX)
    second = _in_order(_boxes_dealt(corners)).mapInArrow(run, schema)
    return first.where("key is null").select("a", "b").unionByName(second.select("a", "b"))


def _boxes_dealt(corners: DataFrame) -> DataFrame:
    """Boxes (key, id, n, top, point) of different tiles, once for each pair of tiles of boxes."""
    per = corners.groupBy("key").agg(F.count("*").alias("boxes"), F.sum(F.length("point")).alias("bytes")).where("boxes > 1")
    tiles = F.greatest(F.least(_tiles_of(F.col("boxes"), TILE_SETS), F.lit(SPREAD_BOXES)), _tiles_of(F.col("boxes"), TILE_BOXES), _tiles_of(F.col("bytes"), TILE_BYTES))
    return _dealt(corners.join(per.select("key", tiles.alias("tiles")), "key")).withColumn("cut", F.lit(False))


def _in_order(nodes: DataFrame) -> DataFrame:
    return nodes.select(*NODE).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "id")


def _tiles(words: int, percent: int):
    """Edges of linked sets for rows sorted by (cluster, i, j): digests as a, b."""

    def solve(rows) -> list[tuple[bytes, bytes]]:
        i, j = rows[0][1], rows[0][2]
        members = {r[4]: r for r in sorted(rows, key=lambda r: (r[3], r[4]))}
        rows = sorted(members.values(), key=lambda r: (r[3] != i, len(r[5]), r[4]))
        split = sum(r[3] == i for r in rows) if i != j else None
        if len(rows) < 2 or split in (0, len(rows)):
            return []
        edges = connect([r[5] for r in rows], percent, split)
        return [(rows[a][4], rows[b][4]) for a, b in edges]

    def run(batches):
        shingles, rows, out = Shingles(words), [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    if rows and rows[0][:3] != r[:3]:
                        out += solve(rows)
                        rows = []
                    s = shingles(r[5])
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == r[4]:
                        rows.append((*r[:5], s))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["a", "b"])
                    out = []
        out += solve(rows) if rows else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["a", "b"])

    return run


def _tiles_of(n, most: int):
    """Tiles of ``n``: 1 up to twice ``most``."""
    return F.when(n > 2 * most, F.ceil(n / most)).otherwise(1).cast("int")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows with ``id`` and ``tiles``, once for each pair of tiles ``i, j`` that holds their own ``tile``."""
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    return df.withColumn("tile", tile).withColumn("p", F.explode(pairs)).select("*", "p.i", "p.j").drop("p", "tiles")


def _alone(placed: DataFrame) -> DataFrame:
    """Rows of clusters with ``tiles``, each in its own tile; pivots in all."""
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    every = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(own))
    return placed.withColumn("i", F.explode(every)).withColumns({"j": F.col("i"), "tile": F.col("i")})


def _rest_dealt(placed: DataFrame) -> DataFrame:
    """Rows (cluster, digest, id, n, class) of clusters of several classes, for each pair of tiles that isn't within the largest class."""
    kinds = placed.groupBy("cluster", "class").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    per = kinds.groupBy("cluster").agg(F.max(F.struct("sets", "size", "class")).alias("big"), F.count("*").alias("kinds"), F.sum("sets").alias("sets"), F.sum("size").alias("size")).where("kinds > 1")

    def tiles(sets, size, most: int):
        return F.greatest(_tiles_of(size, TILE_SHINGLES), F.least(_tiles_of(sets, SPREAD_SETS), F.lit(most)))

    large = tiles(F.col("big.sets"), F.col("big.size"), SPREAD_CLASS)
    rest = tiles(F.col("sets") - F.col("big.sets"), F.col("size") - F.col("big.size"), SPREAD_REST)
    of = placed.join(per.select("cluster", F.col("big.class").alias("big"), large.alias("large"), rest.alias("rest")), "cluster")
    inside, h = F.col("class") == F.col("big"), F.xxhash64("id")
    tile = F.when(inside, F.col("rest") + F.pmod(h, F.col("large"))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    partners = F.sequence(F.lit(0), F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("large")) - 1)
    pairs = F.transform(partners, lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    return of.withColumn("tile", tile).withColumn("p", F.explode(pairs)).select("cluster", "digest", "w", "wh", "p.i", "p.j", "tile")


def _roots(src: DataFrame, sets: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, root``: digests of linked sets of each cluster and their class."""
    pivots = F.array(*(F.min_by("id", F.xxhash64(F.lit(k), "id")) for k in range(PIVOTS)))
    of = sets.join(clusters, "id")
    per = of.groupBy("cluster").agg(F.sum("n").alias("size"), F.count("*").alias("sets"), pivots.alias("pivots"))
    tiles = F.greatest(_tiles_of(F.col("size"), TILE_SHINGLES), _tiles_of(F.col("sets"), SPREAD_SETS))
    placed = written(of.join(per.select("cluster", tiles.alias("tiles"), "pivots"), "cluster").withColumn("pivot", F.array_contains("pivots", F.col("id"))).drop("pivots"))

    def linked(dealt: DataFrame) -> DataFrame:
        texts = among(src.withColumn("h", F.xxhash64("text")), "h", dealt, "wh")  # few texts are in clusters: the others stay where they are
        texts = texts.join(dealt, texts["doc_id"].eqNullSafe(dealt["w"]) & (texts["h"] == dealt["wh"])).select("cluster", "i", "j", "tile", "digest", "text")
        return texts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_tiles(words, percent), "a binary, b binary")

    found = components(linked(_alone(placed)))
    # clusters in tiles: what the tiles and their pivots leave in several classes
    cut = placed.where("tiles > 1").drop("tiles", "pivot").join(found, F.col("digest") == F.col("node"), "left").withColumn("class", F.coalesce("root", "digest"))
    rest = written(_rest_dealt(written(cut.drop("node", "root"))))
    if rest.isEmpty():
        return found
    return components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(linked(rest)))


def _classes(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``doc_id, h, n, class, least``; class: null without words, least: the class's smallest id."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run, schema = _describe(words, kind)
    described = written(src.withColumn("h", F.xxhash64("text")).mapInArrow(run, schema))
    sums = described.where("block is not null").select("block", "counts").repartition(SKETCH_BLOCKS, "block").mapInArrow(_sum_sketch, "block int, counts binary").collect()  # of fixed size
    sketch = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.uint32)
    for r in sums:
        sketch[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    sent = spark.sparkContext.broadcast(sketch.tobytes())

    # the first 8 bytes name a set in blocks and clusters, where mistaking two only widens a cluster
    name = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    rows = described.where("block is null").select("doc_id", "h", "n", "digest", "point", name.alias("id"))
    keys = src.select("text").mapInArrow(_prefixes(words, percent, sent), "key long, id long")
    of_key = W.partitionBy("key")
    # a written table: the keys' shuffle, most of which meets nothing, is over before points are sent
    met = written(keys.withColumns({"low": F.min("id").over(of_key), "high": F.max("id").over(of_key), "met": F.count("*").over(of_key)}).where("low <> high").select("key", "id", "met"))
    points = rows.where("n > 0").groupBy("id").agg(F.first("point").alias("point"), F.first("n").alias("n"))
    clusters = written(components(_near(met, points, percent)).select(F.col("node").alias("id"), F.col("root").alias("cluster")))
    sets = rows.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("x"), F.first("id").alias("id"), F.first("n").alias("n"))
    roots = _roots(src, sets.select("digest", "id", "n", F.col("x.doc_id").alias("w"), F.col("x.h").alias("wh")), clusters, words, percent).withColumnRenamed("node", "digest")
    joined = rows.join(roots, "digest", "left").withColumn("class", F.coalesce("root", "digest"))
    # a written table, so that the join below stands alone in its stage and a hot class's rows can be split
    least = written(joined.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")))
    return joined.join(least, "class", "left").select("doc_id", "h", "n", "class", "least")


def classes(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two documents link when 100 * shared >= percent * united distinct shingles of
    ``words`` words (A-Z lower-cased, ASCII white space; shorter texts are one
    shingle).  ``component_id`` is the smallest id that links reach.  A text
    without words, or a null one, has 0 shingles and links with nothing.  Null
    ids join classes but never name one, unless no member has an id; repeated rows
    stay; an empty table gives an empty result; other columns are not read.

    Sets are told apart by 128 bits and shingles by 64: a pair's overlap is wrong
    with a probability of about its number of shingle pairs over 2**64.
    """
    found = _classes(docs, words, percent, id_col, text_col)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one whose id names the class.

    Rows without words all stay.  Of rows of a class that share the kept id one
    stays; rows of other classes with that id are their own classes' matter.  A row with a null id stays only where no member of its class has an id, one row
    for each such class.  Keeps the columns of ``docs``.
    """
    found = written(_classes(docs, words, percent, id_col, text_col).where("n > 0"))
    h = fresh("h", docs.columns)
    # one row of each class, by id and text: an id may stand in several classes
    named = found.where("doc_id = least").groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("m")).select(F.col("m.doc_id").alias(id_col), F.col("m.h").alias(h))
    unnamed = found.where("least is null").groupBy("class").agg(F.min("h").alias(h)).select(h).distinct()
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    full = docs.where(~wordless)
    kept = full.where(F.col(id_col).isNotNull()).withColumn(h, F.xxhash64(text_col)).join(named, [id_col, h], "left_semi").dropDuplicates([id_col, h])
    rest = full.where(F.col(id_col).isNull()).withColumn(h, F.xxhash64(text_col)).join(unnamed, h, "left_semi").dropDuplicates([h])
    return kept.select(*docs.columns).unionByName(rest.select(*docs.columns)).unionByName(docs.where(wordless))
