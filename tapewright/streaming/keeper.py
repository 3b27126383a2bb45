"""Live order books as keyed state: a map of price to quantity for each side.

A micro-batch writes the levels that it changes and nothing else of the book.
Reading the whole side is put off until a summary needs it.

A book that has no snapshot, or has lost an update, asks for one: the processor
emits a request, ``SnapshotDesk`` answers it at the rate that the exchange allows,
and the answer comes back as input.  Updates that arrive meanwhile wait in the
state and are then decided against the new book, as they would be by a loop that
stops for the snapshot.  A request without an answer is sent again by a timer.

Updates reach the state in blocks of Arrow, made where they are read.  Of a run of
updates that join, only the last quantity of each price between two summaries is set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..model import Listing, Market, SequenceDecision
from ..sources import payloads
from ..sources.rest import Fetcher, RateLimit, SnapshotGuard, snapshot_weight
from . import orderbook
from .orderbook import SUMMARY, Book

#: Summaries and requests in one table; ``after_id`` is the last update that a request has seen.
OUTPUT = f"{SUMMARY}, kind string, request long, after_id long"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_HEAD = "last_update_id long, syncing boolean, next_capture long, applied long, discarded long, resynchronized long, request long, asking boolean, after_id long"
_WAITING = "block binary"
_BLOCK = ["seq", "event_time", "first_update_id", "final_update_id", "bids", "asks"]
_PACKED = f"symbol string, market string, kind string, seq long, final_update_id long, bids {payloads.LEVELS}, asks {payloads.LEVELS}, request long, block binary"
#: Updates of a block that waits.
_BLOCK_ROWS = 10_000


class StoredSide:
    """One side of a book in a map state; changes are kept until ``flush``."""

    def __init__(self, state: Any):
        self.state, self.changed, self.emptied, self.loaded = state, {}, False, None

    def __setitem__(self, price: float, quantity: float) -> None:
        self.changed[price] = quantity
        if self.loaded is not None:
            self.loaded[price] = quantity

    def pop(self, price: float, default: Any = None) -> None:
        self.changed[price] = None
        if self.loaded is not None:
            self.loaded.pop(price, default)

    def clear(self) -> None:
        self.changed, self.emptied, self.loaded = {}, True, {}

    def items(self):
        if self.loaded is None:
            self.loaded = {k[0]: v[0] for k, v in self.state.iterator()}
            for price, quantity in self.changed.items():
                if quantity is None:
                    self.loaded.pop(price, None)
                else:
                    self.loaded[price] = quantity
        return self.loaded.items()

    def flush(self) -> int:
        """Write the changes; returns how many levels that were."""
        if self.emptied:
            self.state.clear()
        for price, quantity in self.changed.items():
            if quantity is not None:
                self.state.updateValue((price,), (quantity,))
            elif not self.emptied:
                self.state.removeKey((price,))
        return len(self.changed)


@dataclass
class Desk:
    """What a listing has asked for: the number of its last request, whether it waits, and what it had seen."""

    request: int = 0
    asking: bool = False
    after_id: int | None = None
    asked: list[tuple[int, int]] = field(default_factory=list)

    def ask(self, after_id: int) -> None:
        self.request, self.asking, self.after_id = self.request + 1, True, after_id
        self.asked.append((self.request, after_id))


def advance(book: Book, desk: Desk, rows: list, interval_us: int, on_demand: bool) -> tuple[list[tuple], list]:
    """Feed messages in order; returns the summaries and the updates that wait for an answer.

    A message is ``(seq, kind, event time in microseconds, first id, final id, bids, asks, request)``.
    """
    out, waiting = [], []
    for m in rows:
        _, kind, at, first, final, bids, asks, request = m
        if kind == "answer" and not (desk.asking and request == desk.request):
            continue  # to a request that has been answered
        if kind != "update":
            if kind == "snapshot":  # one that came by itself, in its place among the updates
                book.discarded += len(waiting)
                waiting = []
            book.restart(final, bids, asks)
            desk.asking = False
            continue
        if desk.asking:
            waiting.append(m)
            continue
        if on_demand and book.last_update_id is None:
            desk.ask(final)
            waiting.append(m)
            continue
        what = book.update(first, final, bids, asks)
        if what == SequenceDecision.RESYNCHRONIZE and on_demand:
            desk.ask(final)
        if what == SequenceDecision.APPLY and (book.next_capture is None or at >= book.next_capture):
            out.append((at, *book.summary(), book.applied, book.discarded, book.resynchronized))
            book.next_capture = at + interval_us
    return out, waiting


class Updates:
    """Updates in order, as columns of ids and times and flat levels."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        at = self.table.column("event_time").cast(pa.timestamp("us", tz="UTC")).cast(pa.int64()).fill_null(np.iinfo(np.int64).min)
        self.at, self.first, self.final, self.seq = at.to_numpy(), *(self.table.column(c).to_numpy() for c in ("first_update_id", "final_update_id", "seq"))
        self.sides = [self._flat(c) for c in ("bids", "asks")]
        joins = (self.first[1:] == self.final[:-1] + 1) & (self.final[1:] > self.final[:-1])
        self.breaks = np.append(np.flatnonzero(~joins) + 1, len(self))

    def _flat(self, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = pa.concat_arrays(self.table.column(column).chunks) if len(self) else pa.array([], self.table.schema.field(column).type)
        return lists.offsets.to_numpy(), lists.values.field("price").to_numpy(zero_copy_only=False), lists.values.field("quantity").to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return self.table.num_rows

    def message(self, i: int) -> tuple:
        bids, asks = ([{"price": float(p), "quantity": float(q)} for p, q in zip(price[o[i] : o[i + 1]], quantity[o[i] : o[i + 1]])] for o, price, quantity in self.sides)
        return int(self.seq[i]), "update", int(self.at[i]), int(self.first[i]), int(self.final[i]), bids, asks, None

    def set(self, book: Book, i: int, end: int) -> None:
        """What updates ``i`` up to ``end`` leave at each price."""
        for side, (o, price, quantity) in zip((book.bids, book.asks), self.sides):
            for p, q in dict(zip(price[o[i] : o[end]].tolist(), quantity[o[i] : o[end]].tolist())).items():
                side.pop(p, None) if q == 0 else side.__setitem__(p, q)

    def apply_run(self, book: Book, i: int, interval_us: int) -> tuple[list[tuple], int]:
        """From update ``i``, which joins, to the next one that doesn't: summaries and that one."""
        end = int(self.breaks[np.searchsorted(self.breaks, i, side="right")])
        latest, out, done = np.maximum.accumulate(self.at[i:end]), [], i
        while done < end:
            # what lies before is earlier than the next capture, so that the running maximum finds it
            due = done if book.next_capture is None else i + int(np.searchsorted(latest, book.next_capture))
            until = min(due + 1, end)
            self.set(book, done, until)
            book.applied += until - done
            if due < end:
                at = int(self.at[due])
                out.append((at, *book.summary(), book.applied, book.discarded, book.resynchronized))
                book.next_capture = at + interval_us
            done = until
        book.last_update_id, book.syncing = int(self.final[end - 1]), False
        return out, end


def advance_all(book: Book, desk: Desk, items: Iterable[tuple | Updates], interval_us: int, on_demand: bool) -> tuple[list[tuple], list[pa.Table]]:
    """As ``advance`` for messages of which updates come as ``Updates``: runs that join go at once, the others one by one."""
    out, waiting = [], []
    for m in items:
        if not isinstance(m, Updates):
            if m[1] == "snapshot":
                book.discarded += sum(w.num_rows for w in waiting)
                waiting = []
            out += advance(book, desk, [m], interval_us, on_demand)[0]
            continue
        i, n = 0, len(m)
        while i < n and not desk.asking:
            local = book.last_update_id
            if local is not None and m.first[i] == local + 1 and m.final[i] > local:
                made, i = m.apply_run(book, i, interval_us)
            elif local is None and not on_demand:
                book.discarded, made, i = book.discarded + n - i, [], n
            else:
                made, waits = advance(book, desk, [m.message(i)], interval_us, on_demand)
                i += not waits
            out += made
        if i < n:
            waiting.append(m.table.slice(i))
    return out, waiting


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Updates of each listing and batch as one block; other messages as they are."""
    for b in batches:
        t = pa.Table.from_batches([b])
        update = pa.array([k == "update" for k in t.column("kind").to_pylist()], pa.bool_())
        others, mine = t.filter(pa.array([not u for u in update.to_pylist()], pa.bool_())), t.filter(update)
        out = [(*r, None) for r in zip(*(others.column(c).to_pylist() for c in _NAMED[:-1]))]
        listings = np.array([f"{a}\0{m}" for a, m in zip(mine.column("symbol").to_pylist(), mine.column("market").to_pylist())], object)
        for listing in dict.fromkeys(listings):
            rows = mine.filter(pa.array(listings == listing))
            out.append((rows.column("symbol")[0].as_py(), rows.column("market")[0].as_py(), "update", None, None, None, None, None, _block(rows.select(_BLOCK))))
        columns = list(zip(*out)) or [()] * len(_NAMED)
        levels = b.schema.field("bids").type
        kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [levels] * 2 + [pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMED)


_NAMED = ["symbol", "market", "kind", "seq", "final_update_id", "bids", "asks", "request", "block"]


def _block(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _rows(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _levels(x: Any) -> list[dict]:
    return [{"price": float(v["price"]), "quantity": float(v["quantity"])} for v in x] if x is not None else []


class BookKeeper(StatefulProcessor):
    """Book, request and waiting updates of one listing."""

    def __init__(self, interval_us: int, on_demand: bool, retry_ms: int):
        self.interval_us, self.on_demand, self.retry_ms = interval_us, on_demand, retry_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.bids, self.asks = (handle.getMapState(s, "price double", "quantity double") for s in ("bids", "asks"))
        self.head, self.waiting = handle.getValueState("head", _HEAD), handle.getListState("waiting", _WAITING)

    def _load(self) -> tuple[Book, Desk]:
        book, desk = Book(StoredSide(self.bids), StoredSide(self.asks)), Desk()
        if self.head.exists():
            book.last_update_id, book.syncing, book.next_capture, book.applied, book.discarded, book.resynchronized, desk.request, desk.asking, desk.after_id = self.head.get()
        return book, desk

    def _new_items(self, frames: Iterator[pd.DataFrame]) -> tuple[list[tuple], list[tuple | Updates]]:
        """Answers, and in order of ``seq`` what else has come, snapshots first."""
        others, blocks = [], []
        for f in frames:
            for r in f.itertuples(index=False):
                if r.kind == "update":
                    blocks.append(_rows(r.block))
                else:
                    others.append((int(r.seq), r.kind, None, None, int(r.final_update_id), _levels(r.bids), _levels(r.asks), None if pd.isna(r.request) else int(r.request)))
        others.sort(key=lambda m: m[0])
        answers, items, at = [m for m in others if m[1] == "answer"], [], 0
        updates = pa.concat_tables(blocks).sort_by("seq") if blocks else None
        for m in others:
            if m[1] != "answer":
                until = int(np.searchsorted(updates.column("seq").to_numpy(), m[0])) if blocks else 0
                items += [Updates(updates.slice(at, until - at))] if until > at else []
                items, at = [*items, m], until
        return answers, [*items, Updates(updates.slice(at))] if blocks and at < updates.num_rows else items

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        book, desk = self._load()
        answers, new = self._new_items(rows)
        was_asking, answered = desk.asking, any(m[7] == desk.request for m in answers) or any(not isinstance(m, Updates) for m in new)
        waited = []
        if was_asking and answered:  # without an answer they go on waiting where they are
            blocks = [_rows(b) for (b,) in self.waiting.get()]
            waited = [Updates(pa.concat_tables(blocks))] if blocks else []
        out, waiting = advance_all(book, desk, [*answers, *waited, *new], self.interval_us, self.on_demand)
        book.bids.flush()
        book.asks.flush()
        self.head.update((book.last_update_id, book.syncing, book.next_capture, book.applied, book.discarded, book.resynchronized, desk.request, desk.asking, desk.after_id))
        kept = [(_block(w.slice(i, _BLOCK_ROWS)),) for w in waiting for i in range(0, w.num_rows, _BLOCK_ROWS)]
        if was_asking and not answered:
            if kept:
                self.waiting.appendList(kept)
        elif kept:
            self.waiting.put(kept)
        elif was_asking:
            self.waiting.clear()
        if desk.asked and self.retry_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
        yield self._frame(key, out, desk.asked)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, desk = self._load()
        if desk.asking:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
            yield self._frame(key, [], [(desk.request, desk.after_id)])
        else:
            yield self._frame(key, [], [])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(key: tuple, summaries: list[tuple], asked: list[tuple[int, int]]) -> pd.DataFrame:
        rows = [(*key, pd.Timestamp(at, unit="us"), *rest, "summary", None, None) for at, *rest in summaries]
        width = len(_NAMES) - len(key) - 3
        rows += [(*key, *[None] * width, "request", number, after) for number, after in asked]
        df = pd.DataFrame(rows, columns=_NAMES)
        counts = [*orderbook._COUNTERS, "request", "after_id"]
        return df.astype({"captured_at": "datetime64[us]"} | dict.fromkeys(counts, "Int64") | {c: "float64" for c in _NAMES[3:-3] if c not in counts})


def stream(live: DataFrame, interval_seconds: float = 1.0, *, on_demand: bool = False, retry_seconds: float = 30.0) -> DataFrame:
    """Summaries of a stream of messages, and with ``on_demand`` requests for snapshots (``kind`` tells which).

    Messages of a micro-batch are fed in order of ``seq``, snapshots before updates.
    Without ``on_demand`` a book that lacks a snapshot discards updates until one comes.
    The state needs the RocksDB provider.
    """
    full = live if "request" in live.columns else live.withColumn("request", F.lit(None).cast("long"))
    names = ["symbol", "market", "seq", "kind", "event_time", "first_update_id", "final_update_id", "bids", "asks", "request"]
    keeper = BookKeeper(int(interval_seconds * 1_000_000), on_demand, int(retry_seconds * 1000) if on_demand else 0)
    return full.select(names).mapInArrow(_packed, _PACKED).groupBy("symbol", "market").transformWithStateInPandas(keeper, OUTPUT, "append", "processingTime" if on_demand else "none")


class SnapshotDesk:
    """Answers requests for snapshots, one after another and no faster than the guard and the budget allow.

    ``fetch`` takes ``(path, params)`` and returns the payload and the weight used so
    far.  Answers are files in ``folder``, which is shared; an answer that is written
    twice counts once, as it names its request.
    """

    def __init__(self, fetch: Fetcher, folder: str, depth: int = 1000, limit: RateLimit | None = None, guard: SnapshotGuard | None = None):
        snapshot_weight(depth)
        self.fetch, self.folder, self.depth, self.limit, self.guard = fetch, folder, depth, limit or RateLimit(), guard or SnapshotGuard()
        self.served: list[tuple[str, str, int]] = []

    def open(self, spark: SparkSession) -> None:
        spark.createDataFrame([], _ANSWER).write.mode("append").json(f"{self.folder}/begin")

    def answers(self, spark: SparkSession) -> DataFrame:
        raw = spark.readStream.schema(_ANSWER).option("recursiveFileLookup", "true").json(self.folder)
        return raw.select(
            "symbol", "market", F.col("last_update_id").alias("seq"), F.lit("answer").alias("kind"), F.lit(None).cast("timestamp").alias("event_time"), F.lit(None).cast("long").alias("first_update_id"),
            F.col("last_update_id").alias("final_update_id"), "bids", "asks", "request",
        )

    def serve(self, requests: DataFrame, batch: int) -> int:
        """Fetch what a batch asks for: at most one request a listing."""
        asked = requests.select("symbol", "market", "request", "after_id").collect()
        rows = []
        for symbol, market, request, after in asked:
            listing = Listing(symbol, Market(market))
            self.guard.wait()
            payload = self.limit.call(self.fetch, payloads.SNAPSHOT_PATH[listing.market], {"symbol": listing.native_symbol, "limit": self.depth, "after": after})
            sides = [[(float(p), float(n)) for p, n in payload[side]] for side in ("bids", "asks")]
            rows.append((symbol, market, request, int(payload["lastUpdateId"]), *sides))
            self.served.append((symbol, market, request))
        if rows:
            requests.sparkSession.createDataFrame(rows, _ANSWER).coalesce(1).write.mode("overwrite").json(f"{self.folder}/{batch}")
        return len(rows)


_ANSWER = f"symbol string, market string, request long, last_update_id long, bids {payloads.LEVELS}, asks {payloads.LEVELS}"
