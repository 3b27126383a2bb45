"""Candles from trades, and coarser candles from finer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import Timeframe

SUMMED = ("volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume")


def _first(c: str, order) -> object:
    return F.min_by(c, F.when(F.col(c).isNotNull(), order))


def _last(c: str, order) -> object:
    return F.max_by(c, F.when(F.col(c).isNotNull(), order))


def trades_to_candles(trades: DataFrame, timeframe: Timeframe) -> DataFrame:
    """One candle for each bar with a trade; bars without trades don't exist.

    A trade row may stand for several trades: ``trade_count`` sums last - first + 1.
    All aggregates combine before the shuffle, which carries one row for each bar and task.
    """
    order = F.struct("transact_time", "trade_id")
    quote = F.col("price") * F.col("quantity")
    taker = ~F.col("buyer_is_maker")
    return (
        trades.groupBy("symbol", "market", F.window("transact_time", timeframe.interval).alias("bar"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.sum("quantity").alias("volume"), F.sum(quote).alias("quote_volume"),
            F.sum(F.when(taker, F.col("quantity")).otherwise(0.0)).alias("taker_buy_base_volume"),
            F.sum(F.when(taker, quote).otherwise(0.0)).alias("taker_buy_quote_volume"),
            F.sum(F.col("last_trade_id") - F.col("first_trade_id") + 1).alias("trade_count"),
        )
        .withColumns({"open_time": F.col("bar.start"), "timeframe": F.lit(timeframe.value)})
        .drop("bar")
    )


def resample(candles: DataFrame, timeframe: Timeframe) -> DataFrame:
    """Coarser candles, left-closed and left-labelled; absent volumes sum to 0."""
    out = candles.groupBy("symbol", "market", F.window("open_time", timeframe.interval)["start"].alias("bar")).agg(
        _first("open", F.col("open_time")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), _last("close", F.col("open_time")).alias("close"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMMED],
        F.coalesce(F.sum("trade_count"), F.lit(0)).alias("trade_count"),
    )
    # a bar without any price is no bar
    return out.where(F.coalesce("open", "high", "low", "close").isNotNull()).withColumnRenamed("bar", "open_time").withColumn("timeframe", F.lit(timeframe.value))


def continuous_aggregate(candles: DataFrame, timeframe: Timeframe, source: str = "1m") -> DataFrame:
    """The stored roll-up of ``source`` candles: like ``resample``, but an unknown trade count stays null."""
    return (
        candles.where(F.col("timeframe") == source)
        .groupBy("symbol", "market", F.window("open_time", timeframe.interval)["start"].alias("bar"))
        .agg(F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"))
        .withColumnRenamed("bar", "open_time")
        .withColumn("timeframe", F.lit(timeframe.value))
    )


def daily_close(candles: DataFrame) -> DataFrame:
    """Last close of each UTC day."""
    day = F.to_date("open_time").alias("day")
    return candles.groupBy("symbol", "market", day).agg(_last("close", F.col("open_time")).alias("close"))
