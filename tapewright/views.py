"""Market tables derived from an ``events`` table, and the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .model import Timeframe
from .operators.bars import trades_to_candles

HOUR = Timeframe("1h")


def trades(spark: SparkSession, sf_dir: str, per_venue: bool = False) -> DataFrame:
    return trades_of(spark.read.parquet(f"{sf_dir}/events.parquet"), per_venue)


def trades_of(e: DataFrame, per_venue: bool = False) -> DataFrame:
    """One trade for each event; with ``per_venue`` the event type becomes the symbol."""
    ten = F.lit(10.0)
    return e.select(
        (F.col("event_type") if per_venue else F.lit("ALL/USDT")).alias("symbol"), F.lit("spot").alias("market"), F.col("event_id").alias("trade_id"),
        (F.col("event_id") * 3).alias("first_trade_id"), (F.col("event_id") * 3 + F.col("event_id") % 3).alias("last_trade_id"),
        F.col("ts").cast("timestamp").alias("transact_time"), (F.lit(100.0) + F.col("value") / ten).alias("price"),
        (1 + F.col("user_id") % 7).cast("double").alias("quantity"), (F.col("user_id") % 2 == 0).alias("buyer_is_maker"),
    )


def depth(t: DataFrame) -> DataFrame:
    i = F.col("trade_id")

    def q(*parts) -> object:
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total.cast("double")

    return t.select(
        "symbol", "market", F.col("transact_time").alias("captured_at"),
        (F.col("price") - (1 + i % 3).cast("double") / 100).alias("best_bid_price"), (F.col("price") + (1 + (i * 5) % 4).cast("double") / 100).alias("best_ask_price"),
        q(1 + i % 11).alias("bid_quantity_5"), q(1 + (i * 7) % 13).alias("ask_quantity_5"),
        q(2 + i % 11, i % 5).alias("bid_quantity_10"), q(2 + (i * 7) % 13, i % 6).alias("ask_quantity_10"),
        q(4 + i % 11, i % 5, i % 17).alias("bid_quantity_20"), q(4 + (i * 7) % 13, i % 6, i % 19).alias("ask_quantity_20"),
    )


def candles(t: DataFrame, timeframe: Timeframe = HOUR) -> DataFrame:
    return trades_to_candles(t, timeframe)


#: The same views for DuckDB, to stand behind WITH.
SQL_TRADES = """trades AS (
  SELECT 'ALL/USDT' AS symbol, 'spot' AS market, event_id AS trade_id, event_id * 3 AS first_trade_id, event_id * 3 + event_id % 3 AS last_trade_id,
    event_type AS venue, ts AS transact_time, CAST(100 AS DOUBLE) + value / CAST(10 AS DOUBLE) AS price, CAST(1 + user_id % 7 AS DOUBLE) AS quantity, (user_id % 2 = 0) AS buyer_is_maker
  FROM events
)"""
SQL_DEPTH = """depth AS (
  SELECT symbol, market, trade_id, transact_time AS captured_at,
    price - CAST(1 + trade_id % 3 AS DOUBLE) / 100 AS best_bid_price, price + CAST(1 + (trade_id * 5) % 4 AS DOUBLE) / 100 AS best_ask_price,
    CAST(1 + trade_id % 11 AS DOUBLE) AS bid_quantity_5, CAST(1 + (trade_id * 7) % 13 AS DOUBLE) AS ask_quantity_5,
    CAST(2 + trade_id % 11 + trade_id % 5 AS DOUBLE) AS bid_quantity_10, CAST(2 + (trade_id * 7) % 13 + trade_id % 6 AS DOUBLE) AS ask_quantity_10,
    CAST(4 + trade_id % 11 + trade_id % 5 + trade_id % 17 AS DOUBLE) AS bid_quantity_20, CAST(4 + (trade_id * 7) % 13 + trade_id % 6 + trade_id % 19 AS DOUBLE) AS ask_quantity_20
  FROM trades
)"""


def sql_candles(name: str = "candles", unit: str = "hour", source: str = "trades") -> str:
    return f"""{name} AS (
  SELECT symbol, market, date_trunc('{unit}', transact_time) AS open_time,
    first(price ORDER BY transact_time, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY transact_time, trade_id) AS close,
    sum(quantity) AS volume, sum(price * quantity) AS quote_volume,
    sum(CASE WHEN buyer_is_maker THEN 0 ELSE quantity END) AS taker_buy_base_volume, sum(CASE WHEN buyer_is_maker THEN 0 ELSE price * quantity END) AS taker_buy_quote_volume,
    CAST(sum(last_trade_id - first_trade_id + 1) AS BIGINT) AS trade_count
  FROM {source} GROUP BY ALL
)"""
