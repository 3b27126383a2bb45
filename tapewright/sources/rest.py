"""Paged HTTP sources as Spark data sources, with the transport injected.

A *fetcher* is a callable ``(path, params) -> (payload, used_weight)``, named as
``module:function``, so that tasks import it; tests give one that serves files.
"""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import TIMEFRAME_SECONDS, Instrument, TimeRange
from ..operators.merge import CANDLE_KEY, keep_first
from .files import open_folder

Fetcher = Callable[[str, dict[str, Any]], tuple[Any, int]]

PAGE = 1000
# Weight that a minute allows, and the request weights of a page of candles and of an order-book snapshot by its depth.
WEIGHT_LIMIT, PAGE_WEIGHT = 1200, 2
SNAPSHOT_WEIGHT = ((100, 5), (500, 25), (1000, 50), (5000, 250))


class RateLimit:
    """Retries with exponential backoff and jitter, and a pause when the minute's weight runs out."""

    def __init__(self, *, attempts: int = 5, weight_limit: int = WEIGHT_LIMIT, base: float = 0.5, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time, seed: int | None = None):
        self.attempts, self.weight_limit, self.base, self.sleep, self.now, self.random = attempts, weight_limit, base, sleep, now, random.Random(seed)

    def call(self, fetch: Fetcher, path: str, params: dict[str, Any]) -> Any:
        for attempt in range(self.attempts):
            try:
                payload, used = fetch(path, params)
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                self.sleep(self.base * 2**attempt * (1 + self.random.random()))
                continue
            if used > self.weight_limit:
                self.sleep(60 - self.now() % 60)
            return payload
        raise AssertionError("unreachable")


@dataclass(frozen=True)
class Lease:
    """What one of several tasks may spend: so much weight in each minute whose number leaves ``turn`` over ``cycle``."""

    share: int
    cycle: int = 1
    turn: int = 0


def leases(tasks: int, weight: int, budget: int) -> list[Lease]:
    """One budget a minute dealt to tasks that know nothing of each other.

    ``weight`` is the price of the dearest request.  More tasks than the budget has
    requests take turns by the minute.  In no minute the shares that may be used add up to more than the budget.
    """
    requests = budget // weight
    if not tasks or requests < 1:
        raise ValueError(f"a budget of {budget} can't pay {tasks} tasks' requests of {weight}")
    cycle = -(-tasks // requests)
    at_once = -(-tasks // cycle)
    return [Lease(requests // at_once * weight, cycle, i % cycle) for i in range(tasks)]


class LeasedLimit(RateLimit):
    """A rate limit that pays each attempt from its lease, in the server's minutes.

    The first and last ``edge`` seconds of a minute are left out, as clocks differ.  A
    task that is run again doesn't know what its lost attempt has spent, so with
    ``anew`` it starts in the next minute (speculative copies must be off).
    """

    def __init__(self, lease: Lease, weight: int, *, edge: float = 2.0, anew: bool = False, **options: Any):
        super().__init__(**options)
        self.lease, self.weight, self.edge = lease, weight, edge
        self.minute, self.spent, self.since = -1, 0, int(self.now() // 60) + 1 if anew else 0

    def pay(self) -> None:
        """Wait until the lease covers one more request."""
        while True:
            now = self.now()
            minute, second = int(now // 60), now % 60
            ours = minute % self.lease.cycle == self.lease.turn and minute >= self.since
            if ours and second < self.edge:
                self.sleep(self.edge - second)
            elif ours and second <= 60 - self.edge and (minute > self.minute or self.spent + self.weight <= self.lease.share):
                self.spent = self.weight + (self.spent if minute == self.minute else 0)
                self.minute = minute
                return
            else:
                self.sleep(60 - second)

    def call(self, fetch: Fetcher, path: str, params: dict[str, Any]) -> Any:
        def paid(path: str, params: dict[str, Any]) -> tuple[Any, int]:
            self.pay()
            return fetch(path, params)

        return super().call(paid, path, params)


class SnapshotGuard:
    """At least two seconds between order-book snapshots."""

    def __init__(self, interval: float = 2.0, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic):
        self.interval, self.sleep, self.now, self.last = interval, sleep, now, None

    def wait(self) -> None:
        if self.last is not None and (rest := self.last + self.interval - self.now()) > 0:
            self.sleep(rest)
        self.last = self.now()


def snapshot_weight(depth: int) -> int:
    for most, weight in SNAPSHOT_WEIGHT:
        if depth <= most:
            return weight
    raise ValueError(f"no snapshot of {depth} levels")


def load_fetcher(name: str) -> Fetcher:
    """``module:function``, or ``module:function|argument`` for a function that takes an argument first."""
    name, given, argument = name.partition("|")
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return partial(found, argument) if given else found


def stored_pages(folder: str, path: str, params: dict[str, Any]) -> tuple[list[list[Any]], int]:
    """A fetcher over Parquet files (``epoch, open, high, low, close, volume``) in a shared folder, in place of a server."""
    from pyarrow import compute, dataset

    files, root = open_folder(folder)
    data = dataset.dataset(root, filesystem=files, format="parquet")
    field = compute.field("epoch")
    rows = data.to_table(filter=(field >= params["startTime"]) & (field <= params["endTime"])).sort_by("epoch").slice(0, params["limit"]).to_pylist()
    return [[r["epoch"], *[str(r[c]) for c in ("open", "high", "low", "close", "volume")]] for r in rows], PAGE_WEIGHT


def pages(fetch: Fetcher, symbol: str, interval: str, start_ms: int, end_ms: int, limit: RateLimit | None = None) -> Iterator[list[Any]]:
    """Kline rows page by page; ends on an empty page or one that doesn't advance."""
    step, at, limit = TIMEFRAME_SECONDS[interval] * 1000, start_ms, limit or RateLimit()
    while at < end_ms:
        page = limit.call(fetch, "klines", {"symbol": symbol, "interval": interval, "startTime": at, "endTime": end_ms - 1, "limit": PAGE})
        if not page:
            return
        yield from page
        following = int(page[-1][0]) + step
        if following <= at:
            return
        at = following


class _Slice(InputPartition):
    def __init__(self, start: int, end: int, lease: Lease):
        self.start, self.end, self.lease = start, end, lease


class _KlineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self):
        """Whole pages in slices of equal length, at most one for each task, each with its part of the budget."""
        start, end = int(self.o["start"]), int(self.o["end"])
        page = TIMEFRAME_SECONDS[self.o["interval"]] * 1000 * PAGE
        pages_ = max(1, -(-(end - start) // page))
        tasks = min(pages_, int(self.o.get("tasks", 8)))
        width = -(-pages_ // tasks) * page
        bounds = [(a, min(a + width, end)) for a in range(start, end, width)] or [(start, start)]
        dealt = leases(len(bounds), PAGE_WEIGHT, int(self.o.get("budget", WEIGHT_LIMIT)))
        return [_Slice(a, b, lease) for (a, b), lease in zip(bounds, dealt, strict=True)]

    def read(self, partition):
        context = TaskContext.get()
        limit = LeasedLimit(partition.lease, PAGE_WEIGHT, anew=context is not None and context.attemptNumber() > 0)
        for n, row in enumerate(pages(load_fetcher(self.o["fetcher"]), self.o["symbol"], self.o["interval"], partition.start, partition.end, limit)):
            yield (n, int(row[0]), *[float(x) for x in row[1:6]])


class KlineSource(DataSource):
    """``spark.read.format("paged_klines")`` with options fetcher, symbol, interval, start, end (epoch ms).

    ``tasks`` (8) is how many tasks read at once and ``budget`` (1200) the weight that
    all of them together may use in a minute.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_klines"

    def schema(self) -> str:
        return "arrival long, epoch long, open double, high double, low double, close double, volume double"

    def reader(self, schema):
        return _KlineReader(dict(self.options))


def rest_candles(spark: SparkSession, fetcher: str, instrument: Instrument, period: TimeRange, **options: int) -> DataFrame:
    """Candles of a period; of a bar that comes twice the later arrival stays.  ``options``: tasks, budget."""
    spark.dataSource.register(KlineSource)

    def ms(t: datetime) -> str:
        return str(int(t.astimezone(timezone.utc).timestamp() * 1000))

    raw = spark.read.format("paged_klines").options(fetcher=fetcher, symbol=instrument.native_symbol, interval=instrument.timeframe.value, start=ms(period.start), end=ms(period.end), **{k: str(v) for k, v in options.items()}).load()
    named = raw.select(F.lit(instrument.symbol).alias("symbol"), F.lit(instrument.market.value).alias("market"), F.lit(instrument.timeframe.value).alias("timeframe"), F.timestamp_millis("epoch").alias("open_time"), "open", "high", "low", "close", "volume", "arrival")
    return keep_first(named, CANDLE_KEY, F.desc("arrival")).drop("arrival").where((F.col("open_time") >= F.lit(period.start)) & (F.col("open_time") < F.lit(period.end)))


# The symbols that the reference price knows.
REFERENCE_COINS = {"BTC/USDT": "bitcoin", "ETH/USDT": "ethereum", "SOL/USDT": "solana"}


def reference_closes(spark: SparkSession, payload: dict[str, list[list[float]]]) -> DataFrame:
    """``day, close``: each UTC day's last of the payload's ``prices`` ([epoch ms, price])."""
    rows = spark.createDataFrame([(int(t), float(p)) for t, p in payload["prices"]], "ms long, price double")
    return rows.groupBy(F.to_date(F.timestamp_millis("ms")).alias("day")).agg(F.max_by("price", "ms").alias("close"))
