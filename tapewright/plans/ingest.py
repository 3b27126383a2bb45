"""Filling the store: find gaps, route them to sources, sanitise, save, check."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import Instrument, Listing, SourceKind, Timeframe, TimeRange
from ..operators import quality
from ..operators.bars import daily_close, trades_to_candles
from ..operators.merge import merge_candles
from ..sources.routing import route_table
from ..sources.store import CANDLE_TABLE, TRADE_TABLE, Store

#: Loads candles of a period from one kind of source.
Loader = Callable[[Instrument, TimeRange], DataFrame]


@dataclass
class InstrumentReport:
    instrument: Instrument
    expected: int = 0
    before: int = 0
    after: int = 0
    written: dict[str, int] = field(default_factory=dict)
    anomalies: dict[str, int] = field(default_factory=dict)
    failed_checks: int = 0
    failure: str | None = None

    @property
    def ok(self) -> bool:
        return self.failure is None and self.failed_checks == 0


def counted(spark: SparkSession, store: Store, instrument: Instrument, period: TimeRange) -> tuple[int, int]:
    """Bars expected and present."""
    counts = quality.completeness(store.existing_open_times(instrument, period), quality.expected_bars(spark, period, instrument.timeframe)).first()
    return counts["expected"], counts["actual"]


def spans(missing: DataFrame, timeframe: Timeframe, now: datetime) -> dict[SourceKind, list[TimeRange]]:
    """What to load from each source: gaps are routed as rows and their hull taken within each month, neighbouring months joined.

    The driver sees two rows a month at most, however many gaps there are.
    """
    gaps = quality.gaps(missing, timeframe)
    parts = route_table(gaps.select(F.col("gap_start").alias("start"), (F.col("gap_end") + F.expr(f"INTERVAL {timeframe.interval}")).alias("end")), now)
    month = F.trunc("start", "month")
    months = F.sequence(month, F.trunc(F.col("end") - F.expr("INTERVAL 1 MICROSECOND"), "month"), F.expr("INTERVAL 1 MONTH"))
    x = parts.withColumn("month", F.explode(months))
    begin, following = F.col("month").cast("timestamp"), F.add_months("month", 1).cast("timestamp")
    hulls = x.groupBy("source", "month").agg(F.min(F.unix_micros(F.greatest("start", begin))).alias("a"), F.max(F.unix_micros(F.least("end", following))).alias("b"))
    out: dict[SourceKind, list[TimeRange]] = {}
    for r in hulls.orderBy("source", "month").collect():
        span = TimeRange(*(datetime.fromtimestamp(r[c] / 1e6, timezone.utc) for c in "ab"))
        own = out.setdefault(SourceKind(r["source"]), [])
        if own and own[-1].end == span.start:
            own[-1] = TimeRange(own[-1].start, span.end)
        else:
            own.append(span)
    return out


def synchronize(spark: SparkSession, store: Store, instrument: Instrument, period: TimeRange, now: datetime, loaders: dict[SourceKind, Loader], reference: DataFrame | None = None, tolerance: float = 0.01) -> InstrumentReport:
    """Fill one instrument's gaps.

    The gaps are routed, and what each source is to give is loaded month by month as
    one table, sanitised, cut to the missing bars and saved at once: the number of
    jobs grows with the sources, not with the gaps.
    """
    report = InstrumentReport(instrument)
    closed = period.clamp_end(instrument.timeframe.floor(now))
    report.expected, report.before = counted(spark, store, instrument, closed)
    missing = quality.missing_bars(store.existing_open_times(instrument, closed), quality.expected_bars(spark, closed, instrument.timeframe)).cache()
    try:
        for kind, periods in spans(missing, instrument.timeframe, now).items():
            loaded = reduce(DataFrame.unionByName, [loaders[kind](instrument, span) for span in periods])
            wanted = quality.closed_only(loaded, instrument.timeframe, now).join(missing.select("open_time"), "open_time", "left_semi")
            flagged = quality.flag(wanted, instrument.timeframe).cache()
            try:
                summary = quality.sanitation_summary(flagged).first().asDict()
                for k, v in summary.items():
                    report.anomalies[k] = report.anomalies.get(k, 0) + (v or 0)
                rows = quality.accepted(flagged).withColumn("source", F.lit(kind.value))
                report.written[kind.value] = store.save(CANDLE_TABLE, rows)
            finally:
                flagged.unpersist()
    finally:
        missing.unpersist()
    _, report.after = counted(spark, store, instrument, closed)
    if reference is not None:
        ours = daily_close(store.read(CANDLE_TABLE, instrument, closed))
        report.failed_checks = quality.price_cross_check(ours, reference, tolerance).where("not passed").count()
    return report


def ingest(spark: SparkSession, store: Store, instruments: Sequence[Instrument], period: TimeRange, now: datetime, loaders: dict[SourceKind, Loader], references: dict[str, DataFrame] | None = None, tolerance: float = 0.01, concurrency: int = 4) -> list[InstrumentReport]:
    """All instruments, a few at a time; a failure stays with its instrument.

    Saves of different instruments touch different partitions of the layout
    unless they share a symbol: those run one after the other.
    """

    def one(group: list[Instrument]) -> list[InstrumentReport]:
        out = []
        for i in group:
            try:
                out.append(synchronize(spark, store, i, period, now, loaders, (references or {}).get(i.symbol), tolerance))
            except Exception as e:  # noqa: BLE001 - reported with its instrument
                out.append(InstrumentReport(i, failure=f"{type(e).__name__}: {e}"))
        return out

    groups: dict[Listing, list[Instrument]] = {}
    for i in instruments:
        groups.setdefault(i.listing, []).append(i)
    with ThreadPoolExecutor(concurrency) as pool:
        return [r for part in pool.map(one, groups.values()) for r in part]


def backfill_candles(store: Store, instrument: Instrument, archive: DataFrame, rest: DataFrame) -> int:
    """Both sources merged, the archive's bars preferred."""
    both = merge_candles(archive.withColumn("source", F.lit("archive")), rest.withColumn("source", F.lit("rest")).select(*archive.columns, "source"))
    return store.save(CANDLE_TABLE, both)


def backfill_trades(store: Store, listing: Listing, trades: DataFrame, official: DataFrame, timeframe: Timeframe, tolerance: float = 1e-6) -> tuple[int, DataFrame]:
    """Save trades; returns the rows written and how the bars rebuilt from them agree with official ones."""
    n = store.save(TRADE_TABLE, trades.withColumn("source", F.lit("archive")))
    return n, quality.agreement(trades_to_candles(trades, timeframe), official, tolerance)
