"""Indicators: plain window columns, and the recursive ones as one kernel pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F, types as T

from .scans import DAY_US, Mean, with_means
from .windows import KEYS, full, last_rows, unused


def sma(c: Column, period: int, w: WindowSpec) -> Column:
    return full(period, F.avg(c), c, last_rows(w, period))


@dataclass(frozen=True)
class Recursive:
    """A column that only recursion gives.

    ``kind``: ``ema`` (seeded by the mean of the first ``period`` values),
    ``ema_first`` (seeded by the first value) or ``wilder`` (seeded at row
    ``period`` by the mean of rows 1 to ``period``).
    """

    name: str
    kind: str
    source: str
    period: int

    def values(self, table: pa.Table, time: str) -> np.ndarray:
        return _KERNELS[self.kind](_doubles(table, self.source), self.period)


@dataclass(frozen=True)
class PointOfControl:
    """Centre of the fullest of ``buckets`` even price buckets over [t - days, t).

    A kernel and not a window over collected arrays: a wavelet matrix of the prices
    with running volumes answers what a window traded below a price in as many steps
    as a price's rank has bits, however long the window.  Bars without a price take no part.
    """

    name: str
    source: str
    days: int
    buckets: int
    volume: str = "volume"

    def values(self, table: pa.Table, time: str) -> np.ndarray:
        micros = table.column(time).cast(pa.int64()).to_numpy()
        p, v = _doubles(table, self.source), np.nan_to_num(_doubles(table, self.volume))
        known = ~np.isnan(p)
        there = micros[known]
        first = np.searchsorted(there, micros - self.days * 86_400_000_000)
        last = np.searchsorted(there, micros)  # equal times are not earlier
        return fullest_of_windows(p[known], v[known], first, last, self.buckets)


def fullest(p: np.ndarray, v: np.ndarray, n: int) -> float:
    """Centre of the bucket with the most volume, the lowest of equal ones.

    Prices are compared with explicit edges ``low + i * ((high - low) / n)``;
    one price alone is its own bucket.
    """
    low, high = p.min(), p.max()
    if low == high:
        return float(low)
    edges = low + np.arange(n) * ((high - low) / n)
    i = int(np.bincount(np.searchsorted(edges, p, side="right") - 1, v, n).argmax())
    return float((edges[i] + (high if i == n - 1 else edges[i + 1])) / 2)


class VolumeBelow:
    """Volume of rows [a, b) with a price below a limit: a wavelet matrix of the prices' ranks.

    Each level splits the rows by one bit of their rank, zeros first in their order,
    and keeps how many zeros and what volume lie before each place.
    """

    def __init__(self, prices: np.ndarray, volumes: np.ndarray):
        self.levels, ranks = np.unique(prices, return_inverse=True)
        self.bits = max(1, int(len(self.levels)).bit_length())
        self.zeros, self.volume = [], [np.concatenate([[0.0], np.cumsum(volumes)])]
        for bit in reversed(range(self.bits)):
            zero = (ranks >> bit & 1) == 0
            order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            ranks, volumes = ranks[order], volumes[order]
            self.volume.append(np.concatenate([[0.0], np.cumsum(volumes)]))

    def __call__(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        below = np.searchsorted(self.levels, limit, side="left")
        a, b, out = np.broadcast_to(a, below.shape), np.broadcast_to(b, below.shape), np.zeros(below.shape)
        for level, bit in enumerate(reversed(range(self.bits))):
            zeros, volume = self.zeros[level], self.volume[level + 1]
            one, za, zb = (below >> bit & 1) == 1, zeros[a], zeros[b]
            out += np.where(one, volume[zb] - volume[za], 0.0)  # all with a zero here are below
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        return out


def _extremes(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of each non-empty [a, b), from those of stretches whose lengths are powers of two."""
    low, high, width = [x], [x], 1
    while 2 * width <= len(x):
        low.append(np.minimum(low[-1][:-width], low[-1][width:]))
        high.append(np.maximum(high[-1][:-width], high[-1][width:]))
        width *= 2
    power = np.frexp((b - a).astype(np.float64))[1] - 1
    lows, highs = np.empty(len(a)), np.empty(len(a))
    for k in np.unique(power):
        at = np.flatnonzero(power == k)
        i, j = a[at], b[at] - (1 << int(k))
        lows[at], highs[at] = np.minimum(low[k][i], low[k][j]), np.maximum(high[k][i], high[k][j])
    return lows, highs


def fullest_of_windows(p: np.ndarray, v: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """``fullest`` of rows [first, last) for every pair; NaN for an empty one."""
    out = np.full(len(first), np.nan)
    asked = np.flatnonzero(first < last)
    if not len(asked):
        return out
    below, exact = VolumeBelow(p, v), bool((v == np.floor(v)).all() and v.sum() < 2**53)
    for at in np.array_split(asked, max(1, -(-len(asked) * n // 1_000_000))):
        a, b = first[at], last[at]
        low, high = _extremes(p, a, b)
        edges = low[:, None] + np.arange(n) * ((high - low) / n)[:, None]
        total = below.volume[0][b] - below.volume[0][a]
        sums = np.diff(np.column_stack([below(a[:, None], b[:, None], edges), total]), axis=1)
        best = sums.argmax(1)
        centre = (edges[np.arange(len(at)), best] + np.where(best == n - 1, high, edges[np.arange(len(at)), np.minimum(best + 1, n - 1)])) / 2
        out[at] = np.where(low == high, low, centre)
        if not exact:  # differences of running sums are rounded: near ties are looked at again
            near = (sums >= sums.max(1, keepdims=True) - 1e-9 * np.maximum(below.volume[0][-1], 1.0)).sum(1) > 1
            for i in np.flatnonzero(near & (low != high)).tolist():
                out[at[i]] = fullest(p[a[i] : b[i]], v[a[i] : b[i]], n)
    return out


def _doubles(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).cast(pa.float64()).to_numpy().astype(np.float64)


def _fold(x: np.ndarray, alpha: float, start: int, seed: float, out: np.ndarray) -> None:
    """out[start:] of y = alpha x + (1 - alpha) y; a missing x repeats y and the next weight decays on."""
    y, decay = seed, 1.0
    for t in range(start, len(x)):
        v = x[t]
        if v == v:
            keep = (1.0 - alpha) ** decay
            y = keep * y + (1.0 - keep) * v if decay > 1.0 else (1.0 - alpha) * y + alpha * v
            decay = 1.0
        else:
            decay += 1.0
        out[t] = y


def exponential(x: np.ndarray, period: int, warmup: str = "sma") -> np.ndarray:
    """Exponential mean with alpha = 2 / (period + 1).

    Across missing values the older value's weight decays once for every bar
    that passed: period 3 over 100, 101, missing, 103 ends at
    0.25 * 100.5 + 0.75 * 103 = 102.375.
    """
    out, alpha = np.full(len(x), np.nan), 2.0 / (period + 1)
    if warmup == "first":
        known = np.flatnonzero(~np.isnan(x))
        if len(known):
            at = int(known[0])
            out[at] = x[at]
            _fold(x, alpha, at + 1, x[at], out)
        return out
    if len(x) < period:
        return out
    seed = x[:period].mean()
    out[period - 1] = seed
    _fold(x, alpha, period, seed, out)
    return out


def wilder(x: np.ndarray, period: int) -> np.ndarray:
    """Wilder's mean, alpha = 1 / period; row 0 has no change and takes no part."""
    out = np.full(len(x), np.nan)
    if len(x) <= period:
        return out
    seed = x[1 : period + 1].mean()
    out[period] = seed
    _fold(x, 1.0 / period, period + 1, seed, out)
    return out


_KERNELS = {"ema": exponential, "ema_first": lambda x, n: exponential(x, n, "first"), "wilder": wilder}


def as_mean(r: Recursive) -> Mean:
    """The same column as a scan over chunks."""
    alpha = 1.0 / r.period if r.kind == "wilder" else 2.0 / (r.period + 1)
    return Mean(r.name, r.source, alpha, {"ema": (0, r.period), "ema_first": None, "wilder": (1, r.period + 1)}[r.kind])


def with_recursive(df: DataFrame, columns: Sequence[Recursive | PointOfControl], keys: Sequence[str] = KEYS, time: str = "open_time", chunk_days: int | None = None) -> DataFrame:
    """``df`` with all ``columns`` in one pass over each instrument's bars.

    One shuffle by instrument, shared by the windows that follow on the same
    keys.  A task holds one instrument's bars (about half a million a year at
    one minute) as Arrow columns.  With ``chunk_days`` no task holds more than
    so many days of bars (and what a point of control looks back on): means are
    scans over chunks, for few instruments with very many bars.
    """
    if not columns:
        return df
    if chunk_days is not None:
        means = [as_mean(c) for c in columns if isinstance(c, Recursive)]
        df = with_means(df, means, chunk_us=chunk_days * DAY_US, keys=keys, time=time) if means else df
        for c in columns:
            df = _in_spans(df, c, keys, time, chunk_days) if isinstance(c, PointOfControl) else df
        return df
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in {c.name for c in columns}], *[T.StructField(c.name, T.DoubleType()) for c in columns]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        for c in columns:
            y = c.values(table, time)
            if c.name in table.column_names:
                table = table.drop_columns([c.name])
            table = table.append_column(c.name, pa.array(y, pa.float64(), mask=np.isnan(y)))
        return table.select(schema.names)

    return df.groupBy(*keys).applyInArrow(run, schema)


def _in_spans(df: DataFrame, c: PointOfControl, keys: Sequence[str], time: str, chunk_days: int) -> DataFrame:
    """A point of control by chunks of time, each with the days before it that its bars look back on."""
    span, own = unused("span", df), unused("own", df)
    size, back = chunk_days * DAY_US, c.days * DAY_US
    at = F.unix_micros(F.col(time).cast("timestamp"))
    first = F.floor(at / size)
    spans = F.sequence(first, F.floor((at + back) / size))
    x = df.withColumn(span, F.explode(spans)).withColumn(own, F.col(span) == first)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != c.name], T.StructField(c.name, T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        y = c.values(table, time)
        table = table.drop_columns([c.name]) if c.name in table.column_names else table
        table = table.append_column(c.name, pa.array(y, pa.float64(), mask=np.isnan(y)))
        return table.filter(table.column(own)).select(schema.names)

    return x.groupBy(*keys, span).applyInArrow(run, schema)


def rsi(gain: Column, loss: Column) -> Column:
    """From smoothed gains and losses; 50 where neither moved."""
    return F.when(gain + loss == 0, F.lit(50.0)).otherwise(100 * F.try_divide(gain, gain + loss))


def gains(c: Column, w: WindowSpec) -> tuple[Column, Column]:
    """Gain and loss of each bar against the one before."""
    change = c - F.lag(c).over(w)
    return F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    ready = before.isNotNull() & high.isNotNull() & low.isNotNull()
    return F.when(ready, F.greatest(high - low, F.abs(high - before), F.abs(low - before)))


def crosses(fast: Column, slow: Column, w: WindowSpec) -> tuple[Column, Column]:
    """Golden and death cross on the bar where they happen; missing sides cross nothing."""
    ready = fast.isNotNull() & slow.isNotNull()
    above = F.coalesce(fast > slow, F.lit(False))
    was_ready = F.lag(ready, 1, False).over(w)
    was_above = F.lag(above, 1, False).over(w)
    return above & ~was_above & was_ready, ~above & was_above & ready
