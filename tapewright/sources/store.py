"""Stored market tables: layout, idempotent saves, reads and roll-ups.

Tables are Parquet folders partitioned by symbol, market and UTC date, sorted by
time within files (so row groups carry tight bounds) and compressed with zstd.
Saves append what the table lacks; one writer at a time is assumed.  Saves and
removals of one-minute candles note their days, so that a roll-up recomputes those alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..model import Instrument, Listing, Timeframe, TimeRange
from ..operators.bars import continuous_aggregate
from ..operators.merge import CANDLE_KEY, new_rows
from .columns import CANDLES, DEPTH, TRADES, conform


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    time: str
    order: tuple[str, ...] = ()


CANDLE_TABLE = Table("candles", CANDLES, CANDLE_KEY, "open_time", ("source",))
CANDLES_5M = Table("candles_5m", CANDLES, CANDLE_KEY, "open_time")
CANDLES_1H = Table("candles_1h", CANDLES, CANDLE_KEY, "open_time")
TRADE_TABLE = Table("agg_trades", TRADES, ("symbol", "market", "transact_time", "trade_id"), "transact_time", ("source",))
DEPTH_TABLE = Table("order_book_depth", DEPTH, ("symbol", "market", "captured_at"), "captured_at")
_DAY = ["symbol", "market", "date"]
TABLES = (CANDLE_TABLE, CANDLES_5M, CANDLES_1H, TRADE_TABLE, DEPTH_TABLE)


# The age in days from which a table's days are compacted.
COMPACT_AFTER = {"candles": 30}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: Table) -> str:
        return f"{self.root}/{table.name}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder; none where there is no folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def migrate(self) -> list[str]:
        """Create what is missing; returns the names of the new tables."""
        new = [t for t in TABLES if not self._exists(f"{self.path(t)}/_SUCCESS")]
        for t in new:
            self._write(self.spark.createDataFrame([], t.schema), t, "append")
        return [t.name for t in new]

    def _write(self, df: DataFrame, table: Table, mode: str, **options: str) -> None:
        dated = df.withColumn("date", F.to_date(table.time))
        spread = dated.repartition("symbol", "market", "date").sortWithinPartitions("symbol", "market", "date", *table.key[2:])
        spread.write.mode(mode).options(compression="zstd", **options).partitionBy("symbol", "market", "date").parquet(self.path(table))

    def read(self, table: Table, listing: Listing | Instrument | None = None, period: TimeRange | None = None) -> DataFrame:
        """Rows of a listing or instrument in a half-open period; partitions are pruned by symbol, market and date."""
        names = [f.name for f in table.schema.fields]
        if not self._exists(self.path(table)):
            return self.spark.createDataFrame([], table.schema)
        df = self.spark.read.schema(self._dated(table)).parquet(self.path(table))
        if listing is not None:
            df = df.where((F.col("symbol") == listing.symbol) & (F.col("market") == listing.market.value))
            if isinstance(listing, Instrument) and "timeframe" in names:
                df = df.where(F.col("timeframe") == listing.timeframe.value)
        if period is not None:
            df = df.where((F.col("date") >= F.lit(period.start.date())) & (F.col("date") <= F.lit((period.end - timedelta(microseconds=1)).date())))
            df = df.where((F.col(table.time) >= F.lit(period.start)) & (F.col(table.time) < F.lit(period.end)))
        return df.select(*names)

    def save(self, table: Table, batch: DataFrame) -> int:
        """Append the rows that the table lacks; returns how many.

        Of rows with one key the smallest ``source`` stays; a stored row wins.
        The stored keys are read from the batch's partitions only, and there between its
        first and last moment: every key holds the time.
        """
        rows = conform(batch, table.schema).withColumn("date", F.to_date(table.time)).cache()
        try:
            parts = rows.select("symbol", "market", "date").distinct()
            first, last, *days = rows.agg(F.min(F.unix_micros(table.time)), F.max(F.unix_micros(table.time)), F.min("date"), F.max("date")).first()
            if days[0] is None:
                return 0
            there = self.read(table).withColumn("date", F.to_date(table.time)).where(F.col("date").between(F.lit(days[0]), F.lit(days[1])))
            there = there.where(F.col(table.time).between(F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last))))
            there = there.join(F.broadcast(parts), ["symbol", "market", "date"], "left_semi") if parts.count() < 10_000 else there
            fresh = new_rows(rows.drop("date"), there, table.key, *[F.col(c).asc_nulls_last() for c in table.order]).cache()
            try:
                n = fresh.count()
                if n:
                    if table is CANDLE_TABLE:  # first: a note too many costs a day's work, a note too few a wrong bar
                        self._touch(fresh)
                    self._write(fresh, table, "append")
                return n
            finally:
                fresh.unpersist()
        finally:
            rows.unpersist()

    def compact(self, table: Table, before: date) -> int:
        """Rewrite each day before ``before`` that lies in several files as one; returns the days rewritten.

        Recording appends a small file to a day at every flush.  Days are rewritten in
        one job, partition by partition.
        """
        df = self.read(table).withColumns({"date": F.to_date(table.time), "file": F.input_file_name()}).where(F.col("date") < F.lit(before))
        many = df.groupBy("symbol", "market", "date").agg(F.countDistinct("file").alias("files")).where("files > 1").select("symbol", "market", "date").cache()
        try:
            n = many.count()
            if n:
                # the rows are read before the folders that hold them are replaced
                rows = df.drop("file").join(many, ["symbol", "market", "date"], "left_semi").drop("date")
                staged = f"{self.path(table)}_compacting"
                rows.write.mode("overwrite").parquet(staged)
                self._write(self.spark.read.schema(table.schema).parquet(staged), table, "overwrite", partitionOverwriteMode="dynamic")
                self.delete(staged)
            return n
        finally:
            many.unpersist()

    def compact_aged(self, now: datetime) -> dict[str, int]:
        """Compact the days that are older than their table's policy says; returns the days rewritten by table."""
        by_name = {t.name: t for t in TABLES}
        return {name: self.compact(by_name[name], (now - timedelta(days=age)).date()) for name, age in COMPACT_AFTER.items()}

    def existing_open_times(self, instrument: Instrument, period: TimeRange, table: Table = CANDLE_TABLE) -> DataFrame:
        return self.read(table, instrument, period).select("open_time")

    def latest_trade_id(self, listing: Listing) -> int | None:
        return self.read(TRADE_TABLE, listing).agg(F.max("trade_id")).first()[0]

    def candle_table(self, timeframe: Timeframe) -> Table:
        """The stored table that serves a timeframe."""
        return {"5m": CANDLES_5M, "1h": CANDLES_1H}.get(timeframe.value, CANDLE_TABLE)

    def remove(self, table: Table, rows: DataFrame) -> int:
        """Delete the stored rows with the keys of ``rows``; returns how many.  Their days are rewritten."""
        keys = rows.select(*table.key).distinct().withColumn("date", F.to_date(table.time))
        days = keys.select(*_DAY).distinct().cache()
        try:
            there = self._of_days(table, days)
            kept = there.join(keys, [*table.key, "date"], "left_anti")
            counts = there.agg(F.count("*")).first()[0], kept.agg(F.count("*")).first()[0]
            if counts[0] > counts[1]:
                if table is CANDLE_TABLE:
                    self._touch(keys.join(there.select(*table.key), list(table.key), "left_semi"))
                self._replace_days(table, kept.select(*[f.name for f in table.schema.fields]), days)
            return counts[0] - counts[1]
        finally:
            days.unpersist()

    def _of_days(self, table: Table, days: DataFrame) -> DataFrame:
        """Stored rows of (symbol, market, date), with ``date``; the range of days is pruned, of few listings so are the others."""
        span = days.agg(F.min("date"), F.max("date")).first()
        if span[0] is None or not self._exists(self.path(table)):
            return self.spark.createDataFrame([], self._dated(table))
        df = self.spark.read.schema(self._dated(table)).parquet(self.path(table)).where(F.col("date").between(F.lit(span[0]), F.lit(span[1])))
        symbols = [r[0] for r in days.select("symbol").distinct().limit(1001).collect()]
        if len(symbols) <= 1000:
            df = df.where(F.col("symbol").isin(symbols))
        return df.join(days, _DAY, "left_semi")

    @staticmethod
    def _dated(table: Table) -> T.StructType:
        return T.StructType([*table.schema.fields, T.StructField("date", T.DateType())])

    def _replace_days(self, table: Table, rows: DataFrame, days: DataFrame) -> int:
        """Make ``rows`` all that the table has of ``days``; a day without rows goes.  Returns the rows."""
        staged, listed = f"{self.path(table)}_staged", f"{self.path(table)}_days"
        # both are read before the folders that they may stem from are replaced
        rows.write.mode("overwrite").parquet(staged)
        days.write.mode("overwrite").parquet(listed)
        rows, days = self.spark.read.schema(rows.schema).parquet(staged), self.spark.read.schema(days.schema).parquet(listed)
        n = rows.count()
        if n:
            self._write(conform(rows, table.schema), table, "overwrite", partitionOverwriteMode="dynamic")
        empty = days.join(rows.select("symbol", "market", F.to_date(table.time).alias("date")).distinct(), _DAY, "left_anti")
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for r in empty.toLocalIterator():  # folders are the driver's to delete; one day after another
            self.delete(f"{self.path(table)}/symbol={escape(r['symbol'])}/market={escape(r['market'])}/date={r['date']}")
        self.delete(staged)
        self.delete(listed)
        return n

    # --- roll-ups ---------------------------------------------------------

    def _notes(self, timeframe: str) -> str:
        return f"{self.root}/touched/{timeframe}"

    def _touch(self, candles: DataFrame) -> None:
        """Note for each roll-up the days whose one-minute candles change."""
        days = candles.where("timeframe = '1m'").select("symbol", "market", F.to_date("open_time").alias("date")).distinct().cache()
        try:
            for timeframe in REFRESH_POLICY if days.take(1) else ():
                days.coalesce(1).write.mode("append").parquet(f"{self._notes(timeframe)}/{uuid.uuid4().hex}")
        finally:
            days.unpersist()

    def touched(self, timeframe: Timeframe) -> DataFrame:
        """``symbol, market, date`` whose roll-up is behind the stored candles."""
        return self._noted(timeframe, self.names(self._notes(timeframe.value))).distinct()

    def _noted(self, timeframe: Timeframe, names: list[str]) -> DataFrame:
        whole = [f"{self._notes(timeframe.value)}/{n}" for n in names if self._exists(f"{self._notes(timeframe.value)}/{n}/_SUCCESS")]
        schema = "symbol string, market string, date date"
        return self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)

    def refresh_touched(self, timeframe: Timeframe, period: TimeRange | None = None) -> int:
        """Bring a roll-up up to date: recompute the days that saves and removals have touched since the last time, and no others.

        Bars whose minutes are gone go too.  With ``period`` only its days are done, the
        others stay noted.  Returns the days recomputed.  What is noted meanwhile is left for the next time.
        """
        table = self._roll_up(timeframe)
        names = self.names(self._notes(timeframe.value))
        noted = self._noted(timeframe, names).distinct().cache()
        try:
            inside = F.lit(True) if period is None else F.col("date").between(F.lit(period.start.date()), F.lit((period.end - timedelta(microseconds=1)).date()))
            days = noted.where(inside)
            n = days.count()
            if n:
                self._replace_days(table, self._rolled(self._of_days(CANDLE_TABLE, days), timeframe, table), days)
            later = noted.where(~inside)
            if period is not None and later.count():
                later.coalesce(1).write.parquet(f"{self._notes(timeframe.value)}/{uuid.uuid4().hex}")
            for name in names:
                self.delete(f"{self._notes(timeframe.value)}/{name}")
            return n
        finally:
            noted.unpersist()

    def refresh(self, timeframe: Timeframe, period: TimeRange) -> int:
        """Recompute a roll-up of the 1m candles for a period, touched or not; returns its bars.

        Whole days are rewritten, since a day is the unit of the layout.
        """
        table = self._roll_up(timeframe)
        whole = TimeRange(Timeframe("1d").floor(period.start), Timeframe("1d").ceil(period.end))
        minutes = self.read(CANDLE_TABLE, period=whole)
        day = lambda df: df.select("symbol", "market", F.to_date("open_time").alias("date"))
        days = day(minutes).unionByName(day(self.read(table, period=whole))).distinct()
        return self._replace_days(table, self._rolled(minutes, timeframe, table), days)

    def rolled_up(self, timeframe: Timeframe, listing: Listing | Instrument | None = None, period: TimeRange | None = None) -> DataFrame:
        """A roll-up as it would be if it were up to date: stored bars of the days that nothing has touched, the others computed."""
        table = self._roll_up(timeframe)
        behind = self.touched(timeframe)
        stored, minutes = (self.read(t, listing, period).withColumn("date", F.to_date("open_time")) for t in (table, CANDLE_TABLE))
        fresh = self._rolled(minutes.join(behind, _DAY, "left_semi"), timeframe, table)
        return stored.join(behind, _DAY, "left_anti").drop("date").unionByName(fresh)

    @staticmethod
    def _rolled(minutes: DataFrame, timeframe: Timeframe, table: Table) -> DataFrame:
        return conform(continuous_aggregate(minutes, timeframe), table.schema)

    def _roll_up(self, timeframe: Timeframe) -> Table:
        table = self.candle_table(timeframe)
        if table is CANDLE_TABLE:
            raise ValueError(f"{timeframe} is no roll-up")
        return table


# How far back the roll-ups are refreshed, how close to now, and how often (seconds).
REFRESH_POLICY = {"5m": (259_200, 600, 300), "1h": (259_200, 7200, 1800)}


def refresh_period(timeframe: Timeframe, now: datetime) -> TimeRange:
    start, end, _ = REFRESH_POLICY[timeframe.value]
    return TimeRange(now - timedelta(seconds=start), now - timedelta(seconds=end))


def write_with_identity(df: DataFrame, path: str, **identity: str) -> None:
    """Parquet with the instrument's names as columns."""
    df.withColumns({k: F.lit(v) for k, v in identity.items()}).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_gaps(gaps: DataFrame, path: str) -> None:
    gaps.write.mode("overwrite").option("header", True).csv(path)
