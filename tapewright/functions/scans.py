"""Recursions along time, spread over chunks of an instrument's rows.

A recursion's effect over a chunk is a small map from the state before it to the
state after it (an affine map for exponential means; for holding rules the state
behind each state that may come in).  So: every chunk gives its map, one pass over
the chunks of an instrument turns the maps into the state that each chunk starts
with, and then all chunks run side by side.  Rows are grouped by chunk alone; what is
grouped by instrument is one short row a chunk.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .windows import KEYS, unused

DAY_US = 86_400_000_000


def over_chunks(
    df: DataFrame,
    summarize: Callable[[pa.Table, int], Any],
    chain: Callable[[list[Any]], list[Any]],
    apply: Callable[[pa.Table, int, Any], pa.Table],
    schema: T.StructType,
    *,
    columns: Sequence[str],
    chunk_us: int,
    keys: Sequence[str] = KEYS,
    time: str = "open_time",
) -> DataFrame:
    """``apply(rows, first, start)`` for each chunk of ``chunk_us`` microseconds, rows in order of ``time``.

    ``first`` is the place of the chunk's first row among its instrument's, from 0.
    ``start`` is what ``chain`` gives for the chunk, from the list of what ``summarize(rows,
    first)`` gave for all of the instrument's chunks in order; it sees ``columns`` only.
    """
    chunk = unused("chunk", df)
    x = df.withColumn(chunk, F.floor(F.unix_micros(F.col(time).cast("timestamp")) / chunk_us))
    group = [*keys, chunk]
    narrow = x.select(*dict.fromkeys([*group, time, *columns]))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    firsts = narrow.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    fields = [narrow.schema[c] for c in group]
    carried = T.StructType([*fields, T.StructField("first", T.LongType()), T.StructField("payload", T.BinaryType())])

    def rows(found: list[tuple[pa.Table, int, int, Any]]) -> pa.Table:
        """One row for each (table with the key, row of it, first, payload)."""
        kept = [t.select(group).slice(i, 1) for t, i, _, _ in found]
        more = pa.table([pa.array([f for _, _, f, _ in found], pa.int64()), pa.array([pickle.dumps(p) for *_, p in found], pa.binary())], ["first", "payload"])
        table = pa.concat_tables(kept)
        return pa.table([*table.columns, *more.columns], carried.names)

    def summary(table: pa.Table, at: pa.Table) -> pa.Table:
        first = at["first"][0].as_py()
        return rows([(at, 0, first, summarize(table.sort_by(time), first))])

    def chained(table: pa.Table) -> pa.Table:
        table = table.sort_by(chunk)
        starts = chain([pickle.loads(p) for p in table["payload"].to_pylist()])
        return rows([(table, i, f, s) for i, (f, s) in enumerate(zip(table["first"].to_pylist(), starts, strict=True))])

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        out = apply(table.sort_by(time).drop_columns([chunk]), start["first"][0].as_py(), pickle.loads(start["payload"][0].as_py()))
        return out.select(schema.names)

    summaries = narrow.groupBy(*group).cogroup(firsts.groupBy(*group)).applyInArrow(summary, carried)
    starts = summaries.groupBy(*keys).applyInArrow(chained, carried)
    return x.groupBy(*group).cogroup(starts.groupBy(*group)).applyInArrow(run, schema)


# --- exponential means -------------------------------------------------------


class Mean:
    """One exponential mean as a scan; ``seeds`` are the places whose mean starts it, None: the first value does."""

    def __init__(self, name: str, source: str, alpha: float, seeds: tuple[int, int] | None):
        self.name, self.source, self.alpha, self.seeds = name, source, alpha, seeds

    def summarize(self, x: np.ndarray, first: int) -> tuple[float, bool, tuple | None]:
        """Sum of the chunk's seeds, whether the seeds end before or in it, and the map of the values after them."""
        if self.seeds is None:
            return 0.0, True, self._map(x)
        low, high = (min(max(s - first, 0), len(x)) for s in self.seeds)
        done = first + len(x) >= self.seeds[1]
        return float(x[low:high].sum()), done, self._map(x[high:]) if done else None

    def _map(self, x: np.ndarray) -> tuple:
        """Values missing at the start, the first value, factor and addend of what follows it, values missing at the end."""
        known = np.flatnonzero(~np.isnan(x))
        if not len(known):
            return len(x), None, 1.0, 0.0, 0
        factor, addend, last = 1.0, 0.0, int(known[0])
        for at in known[1:].tolist():
            keep = (1.0 - self.alpha) ** (at - last)
            factor, addend, last = keep * factor, keep * addend + (1.0 - keep) * x[at], at
        return int(known[0]), float(x[known[0]]), factor, addend, len(x) - 1 - last

    def chain(self, parts: list[tuple]) -> list[tuple[float, float | None, int]]:
        """Per chunk: the seeds' sum before it; the mean before it (None: not begun) and how often its weight has decayed since."""
        out, total, mean, decay = [], 0.0, None, 1
        for seeds, done, moved in parts:
            out.append((total, mean, decay))
            total += seeds
            if not done:
                continue
            missing, value, factor, addend, trailing = moved
            if mean is None and self.seeds is not None:
                mean, decay = total / (self.seeds[1] - self.seeds[0]), 1
            if value is None:
                decay += missing if mean is not None else 0
                continue
            if mean is None:
                joined = value
            else:
                keep = (1.0 - self.alpha) ** (decay + missing)
                joined = keep * mean + (1.0 - keep) * value
            mean, decay = factor * joined + addend, 1 + trailing
        return out

    def values(self, x: np.ndarray, first: int, start: tuple[float, float | None, int]) -> np.ndarray:
        total, y, decay = start
        out, at = np.full(len(x), np.nan), 0
        if y is None:
            if self.seeds is None:
                known = np.flatnonzero(~np.isnan(x))
                if not len(known):
                    return out
                at = int(known[0])
                y = float(x[at])
            else:
                low, high = (min(max(s - first, 0), len(x)) for s in self.seeds)
                if first + len(x) < self.seeds[1]:
                    return out
                y, at = (total + float(x[low:high].sum())) / (self.seeds[1] - self.seeds[0]), high - 1
            out[at] = y
            at += 1
        for t in range(at, len(x)):
            v = x[t]
            if v == v:
                keep = (1.0 - self.alpha) ** decay
                y, decay = keep * y + (1.0 - keep) * v, 1
            else:
                decay += 1
            out[t] = y
        return out


def with_means(df: DataFrame, means: Sequence[Mean], *, chunk_us: int, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``df`` with the columns of ``means``, chunk by chunk."""
    names = {m.name for m in means}
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in names], *[T.StructField(m.name, T.DoubleType()) for m in means]])

    def doubles(table: pa.Table, c: str) -> np.ndarray:
        return table.column(c).cast(pa.float64()).to_numpy().astype(np.float64)

    def apply(table: pa.Table, first: int, starts: list) -> pa.Table:
        made = [m.values(doubles(table, m.source), first, s) for m, s in zip(means, starts, strict=True)]
        table = table.drop_columns([n for n in names if n in table.column_names])
        for m, y in zip(means, made):
            table = table.append_column(m.name, pa.array(y, pa.float64(), mask=np.isnan(y)))
        return table

    return over_chunks(
        df,
        lambda table, first: [m.summarize(doubles(table, m.source), first) for m in means],
        lambda parts: [list(s) for s in zip(*(m.chain([p[i] for p in parts]) for i, m in enumerate(means)))],
        apply, schema, columns=[m.source for m in means], chunk_us=chunk_us, keys=keys, time=time,
    )


# --- holding rules -----------------------------------------------------------


class Holding:
    """Positions under a longest holding and a cooldown.

    A state is a number: s >= 0 waits s more bars before an entry counts, -h holds
    since h bars (-1 without a longest holding, where that doesn't matter).
    """

    def __init__(self, longest: int | None, cooldown: int, delay: int, first: int):
        self.longest, self.cooldown, self.delay, self.first = longest, cooldown, delay, first

    def states(self) -> range:
        return range(-(self.longest or 1), max(self.first, self.cooldown) + 1)

    def run(self, opens: np.ndarray, closes: np.ndarray, n: int, state: int, held: np.ndarray | None = None) -> int:
        """The state after n bars with entries at ``opens`` and exits at ``closes``; marks ``held``."""
        at = state
        if state < 0:
            at = self._close(closes, 0, -1, -state, n, held)
        while 0 <= at < n and (i := np.searchsorted(opens, at)) < len(opens):
            start = int(opens[i])
            at = self._close(closes, start, start, 0, n, held)
        if at < 0:
            return at
        return at - n if at >= n else 0

    def _close(self, closes: np.ndarray, begin: int, start: int, before: int, n: int, held: np.ndarray | None) -> int:
        """Hold from ``begin`` on: the bar from which entries count again, or the negative state in which the chunk ends."""
        j = np.searchsorted(closes, start, side="right")
        end = int(closes[j]) if j < len(closes) else None
        if self.longest is not None and (end is None or begin + self.longest - before < end):
            end = begin + self.longest - before
        stop = n if end is None else min(end, n)
        if held is not None:
            held[begin:stop] = True
        if end is None or end >= n:  # an end at n is found by the next chunk, whose first bar it is
            return -1 if self.longest is None else -(before + n - begin)
        return end + self.cooldown

    def delayed(self, tail: np.ndarray, own: np.ndarray) -> np.ndarray:
        """A chunk's signals as they count: ``delay`` bars late, after the last ones of the chunks before."""
        return np.concatenate([tail, own])[: len(own)]


def hold(entries: np.ndarray, exits: np.ndarray, rules: Holding, start: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """Held bars of a chunk that starts in a state, after the last signals of the chunks before."""
    state, entry_tail, exit_tail = start
    held = np.zeros(len(entries), bool)
    rules.run(np.flatnonzero(rules.delayed(entry_tail, entries)), np.flatnonzero(rules.delayed(exit_tail, exits)), len(held), state, held)
    return held


def moves(entries: np.ndarray, exits: np.ndarray, rules: Holding) -> tuple:
    """What a chunk does to each state, with the signals that its first bars lack left open.

    The first ``delay`` bars answer to signals of earlier chunks: they are run when
    those are known, so the map is that of the bars behind them.
    """
    d = rules.delay
    inside = max(0, len(entries) - d)
    opens, closes = np.flatnonzero(entries[:inside]), np.flatnonzero(exits[:inside])
    after = [rules.run(opens, closes, inside, s) for s in rules.states()]
    return len(entries), after, entries[inside:], exits[inside:]


def chain_holdings(parts: list[tuple], rules: Holding) -> list[tuple]:
    none = np.zeros(rules.delay, bool)
    state, entry_tail, exit_tail, out = rules.first, none, none, []
    for n, after, entries, exits in parts:
        out.append((state, entry_tail, exit_tail))
        lead = min(n, rules.delay)
        state = rules.run(np.flatnonzero(entry_tail[:lead]), np.flatnonzero(exit_tail[:lead]), lead, state)
        if n > rules.delay:
            state = after[state - rules.states().start]
        # of the chunk's own signals the last ones wait for the next chunk
        entry_tail, exit_tail = (np.concatenate([t, own])[-rules.delay :] if rules.delay else none for t, own in ((entry_tail, entries), (exit_tail, exits)))
    return out


def with_held(df: DataFrame, name: str, weight: float, rules: Holding, *, chunk_us: int, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``df`` (``entry``, ``exit``) with the position in ``name``, chunk by chunk."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def flags(table: pa.Table, c: str) -> np.ndarray:
        return table.column(c).fill_null(False).to_numpy().astype(bool)

    return over_chunks(
        df,
        lambda table, first: moves(flags(table, "entry"), flags(table, "exit"), rules),
        lambda parts: chain_holdings(parts, rules),
        lambda table, first, start: table.append_column(name, pa.array(hold(flags(table, "entry"), flags(table, "exit"), rules, start) * weight, pa.float64())),
        schema, columns=["entry", "exit"], chunk_us=chunk_us, keys=keys, time=time,
    )
