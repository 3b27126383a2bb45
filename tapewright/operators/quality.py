"""Audits: gaps, bad bars, agreement with other sources, missing trades."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.windows import KEYS, ordered, unused
from ..model import TIMEFRAME_SECONDS, Timeframe, TimeRange

# The largest believable change of the close from bar to bar.
JUMP_CAPS = {"1m": 0.05, "5m": 0.08, "15m": 0.12, "1h": 0.20, "4h": 0.30, "1d": 0.50}
FLAGS = ("ohlc_invalid", "negative_value", "zero_volume", "price_jump")
FATAL = ("ohlc_invalid", "negative_value")


def expected_bars(spark: SparkSession, period: TimeRange, timeframe: Timeframe) -> DataFrame:
    """``open_time`` of every bar of a period; generated in tasks, not on the driver."""
    step = TIMEFRAME_SECONDS[timeframe.value]
    start, end = timeframe.ceil(period.start), period.end
    n = max(0, -(-int((end - start).total_seconds()) // step))
    return spark.range(n).select(F.timestamp_seconds(F.lit(int(start.timestamp())) + F.col("id") * step).alias("open_time"))


def missing_bars(existing: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected bars that an instrument lacks; ``existing`` holds one instrument's open times."""
    return expected.join(existing.select("open_time").distinct(), "open_time", "left_anti")


def gaps(missing: DataFrame, timeframe: Timeframe, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of missing bars of each instrument: ``gap_start, gap_end, missing``, closed at both ends."""
    step = TIMEFRAME_SECONDS[timeframe.value]
    w = W.partitionBy(*keys).orderBy("open_time")
    island = F.unix_timestamp(F.col("open_time").cast("timestamp")) - step * F.row_number().over(w)
    per = missing.withColumn("island", island).groupBy(*keys, "island").agg(F.min("open_time").alias("gap_start"), F.max("open_time").alias("gap_end"), F.count("*").alias("missing"))
    return per.drop("island")


def completeness(existing: DataFrame, expected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (for each of ``keys``): ``expected, actual, missing, coverage``."""
    on = [*keys, "open_time"]
    there = existing.select(*on).distinct().withColumn("there", F.lit(1))
    x = expected.join(there, on, "left").groupBy(*keys).agg(F.count("*").alias("expected"), F.coalesce(F.sum("there"), F.lit(0)).alias("actual"))
    return x.select(*keys, "expected", "actual", (F.col("expected") - F.col("actual")).alias("missing"), F.try_divide(F.col("actual"), F.col("expected")).alias("coverage"))


def on_grid(df: DataFrame, timeframe: Timeframe, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``df``, but reading it fails where an instrument lacks a bar between its first and last: a window of n rows would span more than n bars."""
    step = TIMEFRAME_SECONDS[timeframe.value] * 1_000_000
    at, before = F.unix_micros(F.col(time).cast("timestamp")), F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(W.partitionBy(*keys).orderBy(time))
    wrong = before.isNotNull() & (at - before != step)
    message = F.concat(F.lit(f"the grid of {timeframe} has a hole before "), F.col(time).cast("string"))
    checked, names = unused("checked", df), df.columns
    return df.withColumn(checked, F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(True)).where(checked).select(*names)


def availability(df: DataFrame, names: Sequence[str], keys: Sequence[str] = (), time: str = "open_time") -> DataFrame:
    """``keys, feature, known, last``: the share of bars on which each feature is known, and its last known value."""
    last = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col(time))).cast("double")
    one = df.groupBy(*keys).agg(*[F.struct(F.lit(n).alias("feature"), F.avg(F.col(n).isNotNull().cast("double")).alias("known"), last(n).alias("last")).alias(f"f_{i}") for i, n in enumerate(names)])
    return one.select(*keys, F.inline(F.array(*[f"f_{i}" for i in range(len(names))])))


def jump_cap(timeframe: str) -> float:
    if timeframe not in JUMP_CAPS:
        raise ValueError(f"no jump threshold for {timeframe}")
    return JUMP_CAPS[timeframe]


def flag(candles: DataFrame, timeframe: Timeframe) -> DataFrame:
    """Candles with a Boolean column for each kind of anomaly.

    Bars are compared with the bar before as it came, bad or not; the first
    bar never jumps.
    """
    cap, w = jump_cap(timeframe.value), ordered()
    numeric = [c for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume", "trade_count") if c in candles.columns]

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    invalid = sure(F.col("high") < F.greatest("open", "close", "low")) | sure(F.col("low") > F.least("open", "close", "high"))
    negative = F.lit(False)
    for c in numeric:
        negative = negative | sure(F.col(c) < 0)
    before = F.lag("close").over(w)
    jump = sure(F.abs(F.try_divide(F.col("close"), before) - 1) > cap)
    return candles.withColumns({"ohlc_invalid": invalid, "negative_value": negative, "zero_volume": sure(F.col("volume") == 0), "price_jump": jump})


def accepted(flagged: DataFrame) -> DataFrame:
    return flagged.where(~(F.col(FATAL[0]) | F.col(FATAL[1]))).drop(*FLAGS)


def anomalies(flagged: DataFrame) -> DataFrame:
    return flagged.where(" or ".join(FLAGS))


def sanitation_summary(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (for each of ``keys``): how many bars carry each flag, and how many are accepted and rejected."""
    fatal = F.col(FATAL[0]) | F.col(FATAL[1])
    return flagged.groupBy(*keys).agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in FLAGS], F.sum((~fatal).cast("long")).alias("accepted"), F.sum(fatal.cast("long")).alias("rejected"))


AGREEMENT = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume", "trade_count")


def agreement(rebuilt: DataFrame, official: DataFrame, tolerance: float = 1e-6, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each column (and each of ``keys``, among symbol and market): largest relative difference over common bars, and the bars that one side lacks.

    The difference is absolute where the official value is 0.  A single full
    outer join gives the counts and the differences.
    """
    on = ["symbol", "market", "open_time"]
    a = rebuilt.select(*on, *[F.col(c).cast("double").alias(f"a_{c}") for c in AGREEMENT], F.lit(True).alias("in_a"))
    b = official.select(*on, *[F.col(c).cast("double").alias(f"b_{c}") for c in AGREEMENT], F.lit(True).alias("in_b"))

    def difference(c: str) -> Column:
        d = F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
        return F.max(F.when(F.col(f"b_{c}") == 0, d).otherwise(d / F.abs(F.nullif(F.col(f"b_{c}"), F.lit(0.0)))))

    one = a.join(b, on, "full_outer").groupBy(*keys).agg(
        F.sum((F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).cast("long")).alias("common"),
        F.sum(F.col("in_a").isNull().cast("long")).alias("missing_in_rebuilt"), F.sum(F.col("in_b").isNull().cast("long")).alias("missing_in_official"),
        *[difference(c).alias(c) for c in AGREEMENT],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(0.0)).alias("difference")) for c in AGREEMENT]))
    out = one.select(*keys, "common", "missing_in_rebuilt", "missing_in_official", rows.alias("r"))
    return out.select(*keys, "r.name", "r.difference", (F.col("r.difference") <= tolerance).alias("passed"), "common", "missing_in_rebuilt", "missing_in_official")


def price_cross_check(ours: DataFrame, reference: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Daily closes against a reference price: ``day, ours, reference, difference, passed``."""
    x = ours.select("day", F.col("close").alias("ours")).join(reference.select("day", F.col("close").alias("reference")), "day").dropna()
    d = F.try_divide(F.abs(F.col("ours") - F.col("reference")), F.col("reference"))
    return x.withColumn("difference", d).withColumn("passed", F.coalesce(F.col("difference") <= tolerance, F.lit(False)))


def missing_trade_ids(trades: DataFrame, chunk: str = "1 day") -> DataFrame:
    """Ids that no row covers, for each listing: ``symbol, market, missing``.

    Rows are compared with the row before within chunks of time; the chunks'
    ends are then compared with each other.  So a listing's trades spread over
    many tasks, and only one row for each chunk is gathered.
    """
    order = ["transact_time", "trade_id"]
    x = trades.select("symbol", "market", *order, "first_trade_id", "last_trade_id", F.window("transact_time", chunk)["start"].alias("chunk"))
    w = W.partitionBy("symbol", "market", "chunk").orderBy(*order)
    lost = F.greatest(F.col("first_trade_id") - F.lag("last_trade_id").over(w) - 1, F.lit(0))
    key = F.struct(*order)
    per = x.withColumn("lost", lost).groupBy("symbol", "market", "chunk").agg(F.sum("lost").alias("lost"), F.min_by("first_trade_id", key).alias("first"), F.max_by("last_trade_id", key).alias("last"))
    between = F.greatest(F.col("first") - F.lag("last").over(W.partitionBy("symbol", "market").orderBy("chunk")) - 1, F.lit(0))
    return per.withColumn("between", between).groupBy("symbol", "market").agg((F.coalesce(F.sum("lost"), F.lit(0)) + F.coalesce(F.sum("between"), F.lit(0))).alias("missing"))


def closed_only(candles: DataFrame, timeframe: Timeframe, now: datetime) -> DataFrame:
    """Bars that had ended at ``now``."""
    return candles.where(F.col("open_time") <= F.lit(timeframe.floor(now) - timeframe.step))

