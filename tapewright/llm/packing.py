"""Best-fit packing by bin completion with branch and bound.

Packing depends only on how many pieces there are of each length, and lengths
run from 1 to the capacity: that histogram, whatever the corpus' size, is all
the driver sees.  Best-fit decreasing gives the incumbent; where it misses the
lower bound, a search completes the bin of the largest remaining piece with
undominated fillings, each any number of times, and prunes by waste.  The solution
is a list of patterns with multiplicities; a piece finds its sequence from its length and its rank
among the pieces of that length, which tasks count for themselves.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bytebpe import ByteBpe
from .common import written

#: Nodes that the whole search may visit before the incumbent stands, unless a caller says otherwise.
SEARCH_NODES = 1_000
#: Counts of a task's pieces by length are broadcast up to so many rows (24 bytes each), else joined by shuffle.
BROADCAST_COUNTS = 500_000
#: So many steps of listing fillings count as a node.
STEPS = 1_000

Pattern = tuple[tuple[int, ...], int]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """(lengths, number of bins) for every kind of bin; bins of a kind are filled together."""
    open_: dict[int, list[list]] = {}  # room -> [lengths, bins]
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], bins: int):
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([lengths, bins])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = min(capacity // size, n)
                bins = n // each
                put(capacity - each * size, (size,) * each, bins)
                n -= each * bins
                continue
            room = rooms[i]
            group = open_[room][-1]
            each = min(room // size, n)
            bins = min(group[1], n // each)
            group[1] -= bins
            lengths = group[0]
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            put(room - each * size, lengths + (size,) * each, bins)
            n -= each * bins
    return [(lengths, bins) for groups in open_.values() for lengths, bins in groups]


def _sums(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Item i: bit t is set if pieces of the i smallest lengths add up to t."""
    sums, mask = [1], (1 << room + 1) - 1
    for s in sizes:
        x, left, k = sums[-1], min(counts[s], room // s), 1
        while left:
            k = min(k, left)
            x |= x << k * s & mask
            left, k = left - k, 2 * k
        sums.append(x)
    return sums


def _by_waste(sizes: list[int], counts: dict[int, int], room: int, after: tuple[int, ...] | None = None) -> Iterator[tuple[int, ...] | None]:
    """All undominated ways to fill ``room``, lazily: least waste first, then larger pieces first.

    ``sizes`` ascend.  A filling is dominated if a free piece still fits, or could
    take the place of a smaller one.  With ``after``, only fillings that come later
    in this order.  Every ``STEPS`` steps that find none give a None.
    """
    sizes = sizes[: bisect_right(sizes, room)]
    sums = _sums(sizes, counts, room)
    first, steps = 0 if after is None else room - sum(after), 0
    for waste in range(first, room + 1):
        # (undecided lengths, sum to fill, pieces so far, smallest larger length with a free piece, equal to `after` so far)
        stack = [(len(sizes), room - waste, (), None, after is not None and waste == first)]
        while stack:
            steps += 1
            if steps % STEPS == 0:
                yield None
            undecided, left, chosen, larger, tight = stack.pop()
            i = bisect_right(sizes, left, 0, undecided)
            if i < undecided:
                larger = sizes[i]
            if not sums[i] >> left & 1 or (larger is not None and larger <= waste):
                continue
            if not i:
                if not tight:
                    yield chosen
                continue
            s = sizes[i - 1]
            top = min(counts[s], left // s) if larger is None or larger - s > waste else 0
            own = -1
            if tight and after[len(chosen)] <= s:
                own = after.count(s)
                top = min(top, own)
            for k in range(top + 1):
                stack.append((i - 1, left - k * s, (*chosen, *(s,) * k), s if k < counts[s] else larger, k == own))


def _within(sizes: list[int], counts: dict[int, int], room: int, tolerance: int) -> tuple[int, ...]:
    """Of the fillings that waste at most ``tolerance`` (else, as little as can be) the one of the largest pieces.

    Small pieces stay free for later bins, where they can still close gaps.
    """
    sizes = sizes[: bisect_right(sizes, room)]
    sums = _sums(sizes, counts, room)
    spare = room - min(sums[-1].bit_length() - 1, room - tolerance)
    out: list[int] = []
    left = room
    for i in range(len(sizes), 0, -1):
        s = sizes[i - 1]
        k = min(counts[s], left // s)
        # the smaller lengths must be able to end within the spare
        while k and not sums[i - 1] >> max(0, left - k * s - spare) & (1 << min(left - k * s, spare) + 1) - 1:
            k -= 1
        out += [s] * k
        left -= k * s
    return tuple(out)


def fillings(sizes: list[int], counts: dict[int, int], room: int, most: int) -> list[tuple[int, ...]]:
    """The first ``most`` undominated ways to fill ``room``: least waste first, then larger pieces first."""
    return list(islice((f for f in _by_waste(sizes, counts, room) if f is not None), most))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs.

    For every least length a: pieces over capacity - a stay alone among the pieces
    of a and more, those over half the capacity each need a bin, and what the
    others of at least a don't find room for beside the latter needs bins too.
    """
    sizes = sorted(counts)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    alone = sum(n for s, n in counts.items() if 2 * s > capacity)
    for a in [s for s in sizes if 2 * s <= capacity]:
        room = sum(n * (capacity - s) for s, n in counts.items() if capacity < 2 * s <= 2 * (capacity - a))
        small = sum(s * n for s, n in counts.items() if a <= s and 2 * s <= capacity)
        best = max(best, alone + max(0, -(-(small - room) // capacity)))
    return max(best, alone)


def pack(counts: dict[int, int], capacity: int, nodes: int | None = SEARCH_NODES) -> list[Pattern]:
    """Patterns that hold every piece, in as few bins as the search finds.

    Depth first over bins of the largest piece left; a branch is a pattern and how
    often it is taken, and goes if its waste leaves no way to beat the incumbent.
    The first dives only follow one branch of a bin, the largest pieces within a
    tolerated waste, for doubling tolerances.  The whole search then takes every
    undominated filling by waste, as often as possible first, then fewer down to 1:
    further bins of that piece have later patterns, which waste no less, so every
    set of undominated bins is one path.  It ends at the lower bound, when the
    branches are exhausted, or after ``nodes`` nodes; with None it has no limit and
    the result is optimal.
    """
    counts = {s: n for s, n in counts.items() if n and s > 0}
    if not counts:
        return []
    total, bound = sum(s * n for s, n in counts.items()), lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    best_bins = sum(m for _, m in best)

    def most_of(pattern: tuple[int, ...]) -> int:
        return min(rest[s] // k for s, k in Counter(pattern).items())

    def whole(last: tuple[int, ...] | None) -> Iterator[Pattern | None]:
        if not rest:
            return
        largest = max(rest)
        bins_of = -(-rest[largest] // (capacity // largest))
        free = {s: n - (s == largest) for s, n in rest.items() if s <= capacity - largest and n > (s == largest)}
        after = last[1:] if last and last[0] == largest else None
        for filling in _by_waste(sorted(free), free, capacity - largest, after):
            if filling is None:
                yield None
                continue
            pattern = (largest, *filling)
            lost = capacity - sum(pattern)
            # this bin and the later ones of this piece waste as much, each
            if waste + bins_of * lost > (best_bins - 1) * capacity - total:
                return
            most = most_of(pattern)
            # nothing fits beside a piece that stays alone
            for times in range(most, 0 if filling else most - 1, -1):
                if waste + max(times, bins_of) * lost <= (best_bins - 1) * capacity - total:
                    yield pattern, times

    def dive(tolerance: int):
        def one(last: tuple[int, ...] | None) -> Iterator[Pattern]:
            if not rest:
                return
            largest = max(rest)
            free = {s: n - (s == largest) for s, n in rest.items() if s <= capacity - largest and n > (s == largest)}
            pattern = (largest, *_within(sorted(free), free, capacity - largest, tolerance))
            times = most_of(pattern)
            if waste + times * (capacity - sum(pattern)) <= (best_bins - 1) * capacity - total:
                yield pattern, times

        return one

    dives = [0, *(1 << i for i in range(2, capacity.bit_length() - 1))]
    for sweep in (*map(dive, dives), whole):
        # depth first, on one histogram that is changed and restored: memory grows with the depth alone
        rest, chosen, bins, waste, visited = dict(counts), [], 0, 0, 0
        levels = [sweep(None)]
        while levels and best_bins > bound and (sweep is not whole or nodes is None or visited < nodes):
            try:
                branch = next(levels[-1])
            except StopIteration:
                levels.pop()
                if chosen:
                    lengths, times = chosen.pop()
                    bins, waste = bins - times, waste - times * (capacity - sum(lengths))
                    for s in lengths:
                        rest[s] = rest.get(s, 0) + times
                continue
            visited += 1
            if branch is None:
                continue
            pattern, times = branch
            for s in pattern:
                rest[s] -= times
                if not rest[s]:
                    del rest[s]
            chosen.append(branch)
            bins, waste = bins + times, waste + times * (capacity - sum(pattern))
            if not rest and bins < best_bins:
                best, best_bins = list(chosen), bins
            levels.append(sweep(pattern))
    return best


def _layout(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks of its slots, their first sequence and their offset."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for lengths, bins in patterns:
        offset = 0
        for s in lengths:
            first = given.get(s, 0)
            slots.setdefault(s, []).append((first, sequence, offset))
            given[s] = first + bins
            offset += s
        sequence += bins
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in slots.items()}


def cut(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: ``doc_id, piece, start, length, ids_crc32, part, rank``.

    ``part`` is the task that cut the piece and ``rank`` counts the task's pieces
    of that length from 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        part, bpe, ranks = TaskContext.get().partitionId(), ByteBpe(tokenizer_path), [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                row, piece, start, length, crc, rank = [], [], [], [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    ids = bpe.encode(text or "") + end
                    n = len(ids) // 4
                    a, z, k = 0, n % capacity or capacity, 0
                    while a < n:
                        row.append(i), piece.append(k), start.append(a), length.append(z - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * z]))
                        rank.append(ranks[z - a])
                        ranks[z - a] += 1
                        a, z, k = z, z + capacity, k + 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, nodes: int | None = SEARCH_NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id``
    alone.  Only documents over ``capacity`` are cut, the first piece being the
    shorter one.  Null ids stay null and repeated rows are packed as often as they
    come; an empty table gives an empty result; other columns are not read.
    Sequences are gapless from offset 0 and hold at most ``capacity`` ids.  ``nodes``
    bounds the search (None: until the fewest sequences are proven).
    """
    pieces = written(cut(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col))
    per = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    layout = pieces.sparkSession.sparkContext.broadcast(_layout(pack(counts, capacity, nodes)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = per.select("part", "length", before.alias("first"))
    small = per.count() <= BROADCAST_COUNTS
    ranked = pieces.join(F.broadcast(first) if small else first.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def place(batches):
        for b in batches:
            lengths, ranks = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                firsts, sequences, offsets = layout.value[int(n)]
                slot = np.searchsorted(firsts, ranks[at], side="right") - 1
                sequence[at], offset[at] = sequences[slot] + ranks[at] - firsts[slot], offsets[slot]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
