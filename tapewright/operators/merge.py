"""Merging and deduplication by identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CANDLE_KEY = ("symbol", "market", "timeframe", "open_time")
TRADE_KEY = ("symbol", "market", "trade_id")


def keep_first(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def by_priority(parts: Sequence[DataFrame], key: Sequence[str], *order: Column) -> DataFrame:
    """Union of parts in which a key keeps its row of the earliest part."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_first(out, key, F.col("__part"), *order).drop("__part")


def merge_candles(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """All bars of both; where both have one, ``preferred`` wins."""
    return by_priority([preferred, other], CANDLE_KEY)


def merge_trades(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """All trades of both by trade id, never by time."""
    return by_priority([preferred, other], TRADE_KEY, F.col("transact_time"))


def new_rows(batch: DataFrame, target: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """Rows of ``batch`` to append: one for each key, none that ``target`` already has."""
    fresh = keep_first(batch, key, *(order or (F.lit(0),)))
    return fresh.join(target.select(*key), list(key), "left_anti")
