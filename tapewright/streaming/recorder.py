"""Recording live frames: trades and book summaries into the store, and live candles."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Listing, Timeframe
from ..operators.bars import trades_to_candles
from ..sources import payloads
from ..sources.store import DEPTH_TABLE, TRADE_TABLE, Store, Table
from . import keeper, orderbook

#: Arbitrary state with maps and timers needs this provider.
_PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

COUNTERS = ("applied", "discarded", "resynchronized")


@dataclass(frozen=True)
class RecordingRules:
    """How often to flush and to capture."""

    flush_rows: int = 5000
    flush_seconds: int = 30
    capture_seconds: float = 1.0
    snapshot_depth: int = 1000
    retry_seconds: float = 30.0


def frames(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of text frames dropped into a folder, in place of a socket."""
    reader = spark.readStream.schema("value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format("text").load(path)


def trade_stream(raw: DataFrame, listing: Listing) -> DataFrame:
    """Trades of a listing's combined stream."""
    own = payloads.of_stream(raw, f"{listing.native_symbol.lower()}@{payloads.AGG_TRADE}")
    return payloads.agg_trades(own).withColumns({"symbol": F.lit(listing.symbol), "market": F.lit(listing.market.value)})


def update_stream(raw: DataFrame, listing: Listing) -> DataFrame:
    """Book updates of a listing's combined stream; their ids give the order."""
    own = payloads.of_stream(raw, f"{listing.native_symbol.lower()}@{payloads.DEPTH_UPDATE}")
    return payloads.depth_updates(own).withColumns({"symbol": F.lit(listing.symbol), "market": F.lit(listing.market.value), "seq": F.col("final_update_id")})


def live_candles(trades: DataFrame, timeframe: Timeframe, lateness: str = "10 minutes") -> DataFrame:
    """Candles of a trade stream, each emitted once its bar is past the watermark.

    Repeated trades within the watermark count once.
    """
    once = trades.withWatermark("transact_time", lateness).dropDuplicatesWithinWatermark(["symbol", "market", "trade_id"])
    return trades_to_candles(once, timeframe)


class Flushes:
    """Micro-batches held back until there are ``flush_rows`` rows or ``flush_seconds`` have passed.

    Held batches are tables below ``folder``, named by batch, so a replayed batch
    replaces itself; a flush saves them all at once and deletes them.  ``written``
    counts new rows, ``latest`` holds the greatest counters that batches have shown.
    Whole batches that an earlier process has left there are flushed at once; of a
    batch whose writing it didn't end nothing is kept, as the stream gives it again.
    """

    def __init__(self, store: Store, table: Table, folder: str, rules: RecordingRules, clock: Callable[[], float] = time.monotonic):
        self.store, self.table, self.folder, self.rules, self.clock = store, table, folder, rules, clock
        self.held: dict[int, int] = {}
        self.written, self.latest, self.since, self.lock = 0, dict.fromkeys(COUNTERS, 0), clock(), Lock()
        for name in store.names(folder):
            if "_SUCCESS" in store.names(f"{folder}/{name}"):
                self.held[int(name)] = 1
            else:
                store.delete(f"{folder}/{name}")
        if self.held:
            self.flush()

    def take(self, batch: DataFrame, number: int) -> None:
        path, counters = f"{self.folder}/{number}", [c for c in COUNTERS if c in batch.columns]
        batch.write.mode("overwrite").parquet(path)
        seen = batch.sparkSession.read.schema(batch.schema).parquet(path).agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in counters]).first()
        with self.lock:
            self.held[number] = seen["n"]
            self.latest.update({c: max(self.latest[c], seen[c] or 0) for c in counters})
            due = sum(self.held.values()) >= self.rules.flush_rows or self.clock() - self.since >= self.rules.flush_seconds
        if due:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            paths = [f"{self.folder}/{n}" for n in sorted(self.held)]
            if any(self.held.values()):
                self.written += self.store.save(self.table, self.store.spark.read.schema(self.table.schema).parquet(*paths))
            for path in paths:
                self.store.delete(path)
            self.held, self.since = {}, self.clock()


def _started(df: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    """Start with the state store that the books need; the session's own choice stays."""
    conf = df.sparkSession.conf
    own = {k: conf.get(k, None) for k in _PROVIDER}
    for k, v in _PROVIDER.items():
        conf.set(k, v)
    try:
        writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    finally:
        for k, v in own.items():
            conf.unset(k) if v is None else conf.set(k, v)


def save_stream(df: DataFrame, store: Store, table: Table, checkpoint: str, rules: RecordingRules = RecordingRules(), once: bool = False) -> tuple[StreamingQuery, Flushes]:
    """Append micro-batches through the store's idempotent save: a replayed batch adds nothing."""
    flushes = Flushes(store, table, f"{checkpoint}/held", rules)
    return _started(df, checkpoint, flushes.take, once), flushes


def save_books(updates: DataFrame, desk: keeper.SnapshotDesk, store: Store, checkpoint: str, rules: RecordingRules = RecordingRules()) -> tuple[StreamingQuery, Flushes]:
    """As ``save_stream`` for summaries of books that ask ``desk`` for their snapshots."""
    spark = updates.sparkSession
    desk.open(spark)
    no = F.lit(None).cast("long").alias("request")
    live = orderbook.updates_only(updates).select("*", no).unionByName(desk.answers(spark))
    flushes = Flushes(store, DEPTH_TABLE, f"{checkpoint}/held", rules)

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the state moves once for both uses
        try:
            desk.serve(batch.where("kind = 'request'"), number)
            flushes.take(batch.where("kind = 'summary'").drop("kind", "request", "after_id"), number)
        finally:
            batch.unpersist()

    return _started(keeper.stream(live, rules.capture_seconds, on_demand=True, retry_seconds=rules.retry_seconds), checkpoint, take, False), flushes


def _settled(query: StreamingQuery) -> None:
    """Until two batches in a row have read nothing; timers keep batches coming, so a query with requests is never out of them."""
    last, quiet = None, 0
    while quiet < 2 and query.isActive:
        progress = query.lastProgress
        if progress is not None and progress["batchId"] != last:
            last = progress["batchId"]
            quiet = 0 if progress["numInputRows"] else quiet + 1
        time.sleep(0.05)
    if query.exception() is not None:
        raise query.exception()


def record(spark: SparkSession, raw: DataFrame, snapshots: DataFrame | keeper.SnapshotDesk, listing: Listing, store: Store, checkpoint: str, rules: RecordingRules = RecordingRules(), once: bool = False, timeout: float | None = None, raw_updates: DataFrame | None = None) -> dict[str, int]:
    """Record trades and book summaries side by side; returns what this run has done.

    ``trades`` and ``depth`` are the rows written; ``applied``, ``discarded`` and
    ``resynchronized`` count updates as of the last summary.  Both consumers share one
    ``timeout``; when one fails or time is up both end, and what is held is flushed.  ``snapshots`` is a
    desk that fetches them when a book asks, or a stream of snapshots with
    ``symbol, market, seq`` that come by themselves.  ``raw_updates`` are the same frames
    for the books, say in batches of another size; else ``raw`` serves both.
    """
    updates = update_stream(raw if raw_updates is None else raw_updates, listing)
    if isinstance(snapshots, keeper.SnapshotDesk):
        depth, depth_flushes = save_books(updates, snapshots, store, f"{checkpoint}/depth", rules)
    else:
        books = keeper.stream(orderbook.messages(updates, snapshots), rules.capture_seconds).drop("kind", "request", "after_id")
        depth, depth_flushes = save_stream(books, store, DEPTH_TABLE, f"{checkpoint}/depth", rules, once)
    trades, trade_flushes = save_stream(trade_stream(raw, listing), store, TRADE_TABLE, f"{checkpoint}/trades", rules, once)
    end = None if timeout is None else time.monotonic() + timeout
    try:
        if once:
            if isinstance(snapshots, keeper.SnapshotDesk):
                _settled(depth)
            else:
                depth.awaitTermination()
            trades.awaitTermination()
        else:
            while depth.isActive and trades.isActive and (end is None or time.monotonic() < end):
                time.sleep(0.2)
            for q in (trades, depth):
                if q.exception() is not None:
                    raise q.exception()
    finally:
        for q in (trades, depth):
            q.stop()
    for flushes in (trade_flushes, depth_flushes):
        flushes.flush()
    return {"trades": trade_flushes.written, "depth": depth_flushes.written, **depth_flushes.latest}
