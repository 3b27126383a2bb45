"""Order books kept from snapshots and updates, and summarised at most once an interval.

The same book serves a stream (``keeper``) and a replay of stored messages, so a
replay equals the stream.  A replay is cut where a
snapshot starts a book anew: those epochs run in parallel, and only what an epoch
hands over (counters, the next capture) is carried from one to the next.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..model import SequenceDecision
from ..sources.columns import LEVELS

MESSAGE = "symbol string, market string, seq long, kind string, event_time timestamp, first_update_id long, final_update_id long, bids array<struct<price:double,quantity:double>>, asks array<struct<price:double,quantity:double>>"
_COUNTERS = ("applied", "discarded", "resynchronized")
_DEPTH = ", ".join(f"{s}_quantity_{n} double" for n in LEVELS for s in ("bid", "ask"))
SUMMARY = f"symbol string, market string, captured_at timestamp, best_bid_price double, best_ask_price double, {_DEPTH}, applied long, discarded long, resynchronized long"


def decide(local: int, first: int, final: int, syncing: bool) -> SequenceDecision:
    """What to do with an update, given the last id that the book holds.

    Old updates are discarded.  While syncing, the first that reaches past the
    snapshot may overlap it; afterwards updates must join exactly.
    """
    if final <= local:
        return SequenceDecision.DISCARD
    joins = first <= local + 1 if syncing else first == local + 1
    return SequenceDecision.APPLY if joins else SequenceDecision.RESYNCHRONIZE


@dataclass
class Book:
    """State of one listing: both sides, the last id and the next capture."""

    bids: dict[float, float] = field(default_factory=dict)
    asks: dict[float, float] = field(default_factory=dict)
    last_update_id: int | None = None
    syncing: bool = True
    next_capture: int | None = None
    applied: int = 0
    discarded: int = 0
    resynchronized: int = 0

    @staticmethod
    def _set(side: dict[float, float], levels: Iterable[Any]) -> None:
        for level in levels:
            price, quantity = level["price"], level["quantity"]
            if quantity == 0:
                side.pop(price, None)
            else:
                side[price] = quantity

    def restart(self, last_update_id: int, bids: Iterable[Any], asks: Iterable[Any]) -> None:
        self.bids.clear()
        self.asks.clear()
        self.last_update_id, self.syncing = last_update_id, True
        self._set(self.bids, bids)
        self._set(self.asks, asks)

    def update(self, first: int, final: int, bids: Iterable[Any], asks: Iterable[Any]) -> SequenceDecision:
        """Without a book, or after a break, updates wait for the next snapshot."""
        if self.last_update_id is None:
            self.discarded += 1
            return SequenceDecision.DISCARD
        what = decide(self.last_update_id, first, final, self.syncing)
        if what == SequenceDecision.DISCARD:
            self.discarded += 1
        elif what == SequenceDecision.RESYNCHRONIZE:
            self.resynchronized += 1
            self.last_update_id = None
        else:
            self._set(self.bids, bids)
            self._set(self.asks, asks)
            self.last_update_id, self.syncing = final, False
            self.applied += 1
        return what

    def summary(self) -> list[float | None]:
        """Best prices, then bid and ask sums of the best 5, 10 and 20 levels."""
        bids, asks = sorted(self.bids.items(), reverse=True), sorted(self.asks.items())
        out: list[float | None] = [bids[0][0] if bids else None, asks[0][0] if asks else None]
        for n in LEVELS:
            out += [float(sum(q for _, q in bids[:n])), float(sum(q for _, q in asks[:n]))]
        return out


def _applied(book: Book, rows: pd.DataFrame) -> Iterator[tuple[Any, int]]:
    """Feed messages in order of ``seq``, a snapshot before an update of the same ``seq``; each applied update and its time in microseconds."""
    for r in rows.sort_values(["seq", "kind"], kind="stable").itertuples(index=False):
        at = None if pd.isna(r.event_time) else int(pd.Timestamp(r.event_time).value // 1000)
        if feed(book, r.kind, r.first_update_id, r.final_update_id, r.bids, r.asks):
            yield r, at


def feed(book: Book, kind: str, first: Any, final: Any, bids: Iterable[Any], asks: Iterable[Any]) -> bool:
    """Give a book one message; whether it was an update that it applied."""
    if kind == "snapshot":
        book.restart(int(final), bids, asks)
        return False
    return book.update(int(first), int(final), bids, asks) == SequenceDecision.APPLY


def process(book: Book, rows: pd.DataFrame, interval_us: int) -> list[tuple]:
    """One summary for each interval of event time, on applied updates only."""
    out = []
    for r, now in _applied(book, rows):
        if book.next_capture is None or now >= book.next_capture:
            out.append((r.event_time, *book.summary(), book.applied, book.discarded, book.resynchronized))
            book.next_capture = now + interval_us
    return out


def handover(times: Sequence[int], interval_us: int, most: int | None) -> tuple[list[int], list[int]]:
    """What the next capture is after updates at ``times``, for every next capture of at most ``most`` before them.

    Returns ``until, after``: with a next capture of at most ``until[i]`` (and more than
    ``until[i - 1]``) it is ``after[i]`` in the end; beyond the last it stays as it is.
    Without ``most`` there was no capture before.  In order of time ``most`` is within
    an interval of the first update, so the lists are short.
    """
    ahead: list[tuple[int, int]] = []  # (-time, result) of the later updates that exceed all between, nearest last
    for t in reversed(times):
        n = bisect_left(ahead, (-(t + interval_us) + 1,))  # those at t + interval or later
        result = ahead[n - 1][1] if n else t + interval_us
        while ahead and -ahead[-1][0] <= t:
            ahead.pop()
        ahead.append((-t, result))
    until, after = [], []
    for t, result in reversed(ahead):
        if after and after[-1] == result:
            until[-1] = -t
        else:
            until.append(-t)
            after.append(result)
        if most is None or -t >= most:
            break
    return until, after


_COLUMNS = ["symbol", "market", "seq", "kind", "event_time", "first_update_id", "final_update_id", "bids", "asks"]


def updates_only(updates: DataFrame) -> DataFrame:
    """Updates as input; they need ``symbol, market, seq``."""
    return updates.withColumn("kind", F.lit("update")).select(_COLUMNS)


def messages(updates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Updates and snapshots as one input; both need ``symbol, market, seq``."""
    s = snapshots.withColumns({"kind": F.lit("snapshot"), "event_time": F.lit(None).cast("timestamp"), "first_update_id": F.lit(None).cast("long"), "final_update_id": F.col("last_update_id")})
    return updates_only(updates).unionByName(s.select(_COLUMNS))


#: Messages whose snapshots are numbered in one task.
_BLOCK = 65_536
_LISTING = ["symbol", "market"]
_EPOCH = "symbol string, market string, epoch long, applied long, discarded long, resynchronized long"


def epochs(stored: DataFrame) -> DataFrame:
    """``stored`` with ``epoch``: how many snapshots of the listing have come, its own included; in blocks of ``seq``."""
    x = stored.withColumn("__block", F.floor(F.col("seq") / _BLOCK))
    one = (F.col("kind") == "snapshot").cast("long")
    blocks = x.groupBy(*_LISTING, "__block").agg(F.sum(one).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*_LISTING).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(one).over(W.partitionBy(*_LISTING, "__block").orderBy("seq"))  # by value: messages of one seq are of one epoch
    placed = x.withColumn("__within", within).join(blocks.select(*_LISTING, "__block", before.alias("__before")), [*_LISTING, "__block"])
    return placed.withColumn("epoch", F.col("__before") + F.col("__within")).drop("__block", "__before", "__within")


_MESSAGES = ["kind", "event_time", "first_update_id", "final_update_id"]


def _epochs_of(batches: Iterable[pa.RecordBatch], more: int) -> Iterator[tuple[tuple, tuple | None, tuple]]:
    """Rows in order as (epoch's key, what the epoch has to start with where it begins, message); times in microseconds."""
    last = None
    for b in batches:
        columns = [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in b.columns]
        for symbol, market, epoch, *rest in zip(*(c.to_pylist() for c in columns)):
            key = (symbol, market, epoch)
            yield key, tuple(rest[:more]) if key != last else None, tuple(rest[more:])
            last = key


def _survey(step: int):
    """Per epoch its counters and its ``handover``, from ids and times alone; an epoch's times are all that is kept."""

    def made(key: tuple, book: Book, times: array, latest: int | None) -> tuple:
        until, after = handover(times, step, None if latest is None else latest + step)
        return (*key, book.applied, book.discarded, book.resynchronized, until, after)

    def run(batches):
        book, key, times, latest, done = Book(), None, array("q"), None, []
        for now, begun, (kind, at, first, final) in _epochs_of(batches, 1):
            if begun is not None:
                done += [made(key, book, times, latest)] if key else []
                book, key, times, latest = Book(), now, array("q"), begun[0]
            if feed(book, kind, first, final, (), ()):
                times.append(at)
            if len(done) >= _ROWS:
                yield _arrow(done, _SURVEYED)
                done = []
        yield _arrow(done + ([made(key, book, times, latest)] if key else []), _SURVEYED)

    return run


def _summaries(step: int):
    """Summaries of epochs one after another: the open book is all that is kept."""

    def run(batches):
        book, done = Book(), []
        for (symbol, market, _), begun, (kind, at, first, final, bids, asks) in _epochs_of(batches, 4):
            if begun is not None:
                applied, discarded, resynchronized, capture = begun
                book = Book(next_capture=capture, applied=applied, discarded=discarded, resynchronized=resynchronized)
            if feed(book, kind, first, final, bids, asks) and (book.next_capture is None or at >= book.next_capture):
                done.append((symbol, market, at, *book.summary(), book.applied, book.discarded, book.resynchronized))
                book.next_capture = at + step
            if len(done) >= _ROWS:
                yield _arrow(done, _SUMMARIZED)
                done = []
        yield _arrow(done, _SUMMARIZED)

    return run


_ROWS = 10_000
_LONGS = pa.list_(pa.int64())
_SURVEYED = pa.schema([("symbol", pa.string()), ("market", pa.string()), *[(c, pa.int64()) for c in ("epoch", *_COUNTERS)], ("until", _LONGS), ("after", _LONGS)])
_SUMMARIZED = pa.schema([("symbol", pa.string()), ("market", pa.string()), ("captured_at", pa.timestamp("us", tz="UTC")), *[(c.split()[0], pa.int64() if c.endswith("long") else pa.float64()) for c in SUMMARY.split(", ")[3:]]])


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def replay(stored: DataFrame, interval_seconds: float = 1.0) -> DataFrame:
    """Summaries of stored messages, equal to those of one pass over each listing.

    Three steps: every epoch's counters and ``handover``, from the ids and times alone;
    one pass over the epochs of a listing for what each starts with; then the books.
    Rows stream through in sorted order, so an epoch needs no more memory than its
    book, and in the first step its times.  ``seq`` and the listing are not null.
    """
    step = int(interval_seconds * 1_000_000)
    key = [*_LISTING, "epoch"]
    placed = epochs(stored)

    def starts(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        capture, counts, out = None, [0, 0, 0], []
        for r in rows.sort_values("epoch").itertuples(index=False):
            out.append((*k, r.epoch, *counts, capture))
            counts = [a + b for a, b in zip(counts, (r.applied, r.discarded, r.resynchronized))]
            at = 0 if capture is None else bisect_left(r.until, capture)
            if at < len(r.until):
                capture = int(r.after[at])
        return pd.DataFrame(out, columns=[*key, *_COUNTERS, "next_capture"]).astype({"next_capture": "Int64"})

    def in_order(df: DataFrame, columns: list[str]) -> DataFrame:
        # by a hash: a shuffle by the keys of the join before it is left out, and the join, once it is broadcast, no longer keeps an epoch in one task
        return df.repartition(F.hash(*key)).sortWithinPartitions(*key, "seq", "kind").select(*key, *columns)

    narrow = placed.select(*key, "seq", *_MESSAGES)
    tops = narrow.groupBy(*key).agg(F.max(F.unix_micros("event_time")).alias("top"))
    reach = tops.select(*key, F.max("top").over(W.partitionBy(*_LISTING).orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)).alias("latest"))
    surveyed = in_order(narrow.join(reach, key), ["latest", *_MESSAGES]).mapInArrow(_survey(step), f"{_EPOCH}, until array<long>, after array<long>")
    begun = surveyed.groupBy(*_LISTING).applyInPandas(starts, f"{_EPOCH}, next_capture long")
    begins = [*_COUNTERS, "next_capture"]
    return in_order(placed.join(begun, key), [*begins, *_MESSAGES, "bids", "asks"]).mapInArrow(_summaries(step), SUMMARY)
