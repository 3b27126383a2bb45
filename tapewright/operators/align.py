"""Alignment in time: as-of joins and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..model import Timeframe


def as_of(left: DataFrame, right: DataFrame, time: str, keys: Sequence[str], values: Sequence[str], *, tiebreak: str | None = None, chunk: str = "1 day") -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row at or before each row's time.

    Both sides are laid on one line and the last right row is carried forward.
    The line is cut into chunks of time, so one instrument spreads over many
    tasks; what a chunk starts with is the last right row of the chunks before
    it, found on a table of one row for each chunk.  Of right rows with equal
    times the one with the largest ``tiebreak`` counts, a null value included.
    """
    order = F.col(tiebreak) if tiebreak else F.lit(0)
    held = F.struct(*values)
    names = list(left.columns)

    def start(c: str) -> Column:
        return F.window(c, chunk)["start"]

    marks = right.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__tag"), order.alias("__o"), held.alias("__v"))
    rows = left.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__tag"), F.lit(None).cast(marks.schema["__o"].dataType).alias("__o"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), F.struct(*names).alias("__row"))
    line = marks.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)).unionByName(rows).withColumn("__chunk", start("__t"))
    within = W.partitionBy(*keys, "__chunk").orderBy("__t", "__tag", "__o").rowsBetween(W.unboundedPreceding, 0)
    seen = line.withColumn("__seen", F.last("__v", ignorenulls=True).over(within)).where("__tag = 1")
    ends = line.groupBy(*keys, "__chunk").agg(F.max_by("__v", F.when(F.col("__tag") == 0, F.struct("__t", "__o"))).alias("__end"))
    carried = ends.select(*keys, "__chunk", F.last("__end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    out = seen.join(carried, [*keys, "__chunk"], "left").withColumn("__got", F.coalesce("__seen", "__before"))
    return out.select("__row.*", *[F.col(f"__got.{v}").alias(v) for v in values])


def grid(start: Column, end: Column, timeframe: Timeframe) -> Column:
    """The bar starts of [start, end), as an array."""
    step = F.expr(f"interval {timeframe.interval}")
    return F.when(start < end, F.filter(F.sequence(start, end, step), lambda t: t < end)).otherwise(F.array().cast("array<timestamp>"))


def align_to_candles(candles: DataFrame, values: DataFrame) -> DataFrame:
    """Candles with a per-bar table's columns; bars without a value get null."""
    keys = [k for k in ("symbol", "market", "timeframe", "open_time") if k in values.columns]
    return candles.join(values, keys, "left")
