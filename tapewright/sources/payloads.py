"""Exchange messages: JSON text to typed columns, strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..model import Listing, Market
from .columns import epoch_per_row

# Stream names and endpoints of the public market-data feeds.
AGG_TRADE, DEPTH_UPDATE = "aggTrade", "depth@100ms"
WEBSOCKET = {Market.SPOT: "wss://stream.binance.com:9443", Market.USDM: "wss://fstream.binance.com"}
REST = {Market.SPOT: "https://api.binance.com", Market.USDM: "https://fapi.binance.com"}
SNAPSHOT_PATH = {Market.SPOT: "/api/v3/depth", Market.USDM: "/fapi/v1/depth"}

_LEVELS = "array<array<string>>"
_TRADE = "T long, a long, f long, l long, p string, q string, m boolean"
_UPDATE = f"E long, U long, u long, b {_LEVELS}, a {_LEVELS}"
_SNAPSHOT = f"lastUpdateId long, bids {_LEVELS}, asks {_LEVELS}"
LEVELS = "array<struct<price:double,quantity:double>>"


def stream_url(listing: Listing, streams: tuple[str, ...]) -> str:
    symbol = listing.native_symbol.lower()
    return f"{WEBSOCKET[listing.market]}/stream?streams={'/'.join(f'{symbol}@{s}' for s in streams)}"


def snapshot_url(listing: Listing, depth: int) -> str:
    return f"{REST[listing.market]}{SNAPSHOT_PATH[listing.market]}?symbol={listing.native_symbol}&limit={depth}"


def stream_of(value: Column) -> Column:
    """The combined stream's name of a frame, as ``btcusdt@aggTrade``."""
    return F.get_json_object(value, "$.stream")


def payload_of(value: Column) -> Column:
    """The message itself: frames of combined streams wrap it in ``data``."""
    return F.coalesce(F.get_json_object(value, "$.data"), value)


def _levels(c: Column) -> Column:
    return F.transform(c, lambda x: F.struct(F.get(x, F.lit(0)).cast("double").alias("price"), F.get(x, F.lit(1)).cast("double").alias("quantity")))


def _needed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raises on a message that lacks one of the columns; null frames are no messages.

    Filters may run in any order, so the guard itself lets null frames pass.
    """
    lacking = F.lit(False)
    for c in columns:
        lacking = lacking | F.col(c).isNull()
    guard = F.when(F.col("__frame") & lacking, F.raise_error(F.lit("a message lacks a field")).cast("boolean")).otherwise(F.col("__frame"))
    return df.where(guard)


def of_stream(frames: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Frames of one stream of a combined connection; the others' text is never parsed further.

    A text that lacks the name, and an escape that may stand for it, is not parsed at all.
    """
    may = F.contains(F.col(value), F.lit(name)) | F.contains(F.col(value), F.lit("\\"))
    own = F.when(may, F.when(stream_of(F.col(value)) == name, F.col(value)))
    return frames.where(own.isNotNull())


def _once(df: DataFrame, keep: list[str], parsed: Column) -> DataFrame:
    """``keep`` and the fields of the struct ``parsed``, behind a generator: what is asked of a field later doesn't parse the text again."""
    return df.select(*keep, F.inline(F.array(parsed)))


def agg_trades(frames: DataFrame, value: str = "value") -> DataFrame:
    """Trade events of frames; other columns of ``frames`` stay."""
    keep = [c for c in frames.columns if c != value]
    flagged = frames.withColumn("__frame", F.col(value).isNotNull())
    x = _once(flagged, [*keep, "__frame"], F.from_json(payload_of(F.col(value)), _TRADE, {"mode": "FAILFAST"}))
    x = _needed(x, ["T", "a", "f", "l", "p", "q", "m"])
    return x.select(*keep, epoch_per_row("T").alias("transact_time"), F.col("a").alias("trade_id"), F.col("f").alias("first_trade_id"), F.col("l").alias("last_trade_id"), F.col("p").cast("double").alias("price"), F.col("q").cast("double").alias("quantity"), F.col("m").alias("buyer_is_maker"))


def depth_updates(frames: DataFrame, value: str = "value") -> DataFrame:
    keep = [c for c in frames.columns if c != value]
    # field names differ in case only: they get others as they are read
    texts = ["__E", "__U", "__u_", "__b", "__a"]
    flagged = frames.withColumn("__frame", F.col(value).isNotNull())
    read = flagged.select(*keep, "__frame", F.json_tuple(payload_of(F.col(value)), "E", "U", "u", "b", "a").alias(*texts))
    at, first, final, b, a = (F.col(c) for c in texts)
    x = _once(read, [*keep, "__frame"], F.struct(at.cast("long").alias("E"), first.cast("long").alias("first_update_id"), final.cast("long").alias("final_update_id"), F.from_json(b, _LEVELS).alias("b"), F.from_json(a, _LEVELS).alias("a")))
    x = _needed(x, ["E", "first_update_id", "final_update_id", "b", "a"])
    return x.select(*keep, epoch_per_row("E").alias("event_time"), "first_update_id", "final_update_id", _levels(F.col("b")).alias("bids"), _levels(F.col("a")).alias("asks"))


def snapshots(frames: DataFrame, value: str = "value") -> DataFrame:
    keep = [c for c in frames.columns if c != value]
    x = frames.withColumn("__m", F.from_json(F.col(value), _SNAPSHOT, {"mode": "FAILFAST"})).select(*keep, "__m.*", F.col(value).isNotNull().alias("__frame"))
    x = _needed(x, ["lastUpdateId", "bids", "asks"])
    return x.select(*keep, F.col("lastUpdateId").alias("last_update_id"), _levels(F.col("bids")).alias("bids"), _levels(F.col("asks")).alias("asks"))
