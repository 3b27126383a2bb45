"""Schemas of the three market tables, and conforming to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

LEVELS = (5, 10, 20)
FLOATS = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume")


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _TS, _D, _L = T.StringType(), T.TimestampType(), T.DoubleType(), T.LongType()
CANDLES = _schema(symbol=_S, market=_S, timeframe=_S, open_time=_TS, **{c: _D for c in FLOATS}, trade_count=_L, source=_S, ingested_at=_TS)
TRADES = _schema(symbol=_S, market=_S, trade_id=_L, transact_time=_TS, price=_D, quantity=_D, first_trade_id=_L, last_trade_id=_L, buyer_is_maker=T.BooleanType(), source=_S, ingested_at=_TS)
DEPTH = _schema(symbol=_S, market=_S, captured_at=_TS, best_bid_price=_D, best_ask_price=_D, **{f"{s}_quantity_{n}": _D for n in LEVELS for s in ("bid", "ask")}, ingested_at=_TS)


def conform(df: DataFrame, schema: T.StructType, optional: bool = True) -> DataFrame:
    """The schema's columns, cast; NaN becomes null, unknown columns go.

    Absent columns are null where ``optional``, else an error.
    """
    lacking = [f.name for f in schema.fields if f.name not in df.columns]
    if lacking and not optional:
        raise ValueError(f"columns are missing: {lacking}")
    out = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.when(~F.isnan(c), c) if f.dataType == _D else c).alias(f.name))
    return df.select(*out)


def conform_candles(df: DataFrame) -> DataFrame:
    return conform(df, CANDLES)


def conform_trades(df: DataFrame) -> DataFrame:
    """Identity, price and side must be there; only the bookkeeping columns may be absent."""
    required = [f.name for f in TRADES.fields if f.name not in ("source", "ingested_at")]
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    return conform(df, TRADES)


def conform_depth(df: DataFrame) -> DataFrame:
    return conform(df, DEPTH)


def epoch_to_timestamp(df: DataFrame, epoch: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Epochs of unknown unit as UTC times.

    The unit follows from the largest value of each group (a file or a batch):
    below 1e11 seconds, below 1e14 milliseconds, else microseconds.
    """
    top = F.max(epoch).over(W.partitionBy(*by))
    return df.withColumn(out, _moment(F.col(epoch), top))


def epoch_per_row(epoch: str):
    """The form for streams, which have no column maximum: each value names its own unit."""
    return _moment(F.col(epoch), F.col(epoch))


def _moment(x, scale):
    return F.when(scale < 10**11, F.timestamp_seconds(x)).when(scale < 10**14, F.timestamp_millis(x)).otherwise(F.timestamp_micros(x))
