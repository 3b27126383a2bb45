"""Feature columns over candles, and over trades and depth aligned to candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..model import ActivityMeasure, DepthAggregation, ExtremeSide, PriceSource
from ..operators.align import as_of
from .windows import KEYS, full, prior_rows, with_trailing


def price(source: PriceSource) -> Column:
    """Close, or the typical price: a third of high + low + close, a missing leg counting 0."""
    if source == PriceSource.CLOSE:
        return F.col("close")
    return (F.coalesce("high", F.lit(0.0)) + F.coalesce("low", F.lit(0.0)) + F.coalesce("close", F.lit(0.0))) / 3


def session_frame(keys=KEYS, time: str = "open_time") -> WindowSpec:
    """From the start of the UTC day to the current bar."""
    return W.partitionBy(*keys, F.to_date(time)).orderBy(time).rowsBetween(W.unboundedPreceding, 0)


def weighted(p: Column, v: Column, frame: WindowSpec, n: int | None) -> Column:
    known = F.when(p.isNotNull(), v)
    total = F.sum(known).over(frame)
    mean = F.when(total > 0, F.sum(p * v).over(frame) / total)
    return mean if n is None else F.when(F.count(p * v).over(frame) == n, mean)


def vwap(frame: WindowSpec, source: PriceSource = PriceSource.TYPICAL, rolling: int | None = None) -> Column:
    """Volume-weighted price; null where the volume is not positive."""
    return weighted(price(source), F.col("volume"), frame, rolling)


def centred(source: PriceSource, keys=KEYS) -> Column:
    """The price less its mean over the instrument, so that squares don't cancel; put it in a column first."""
    p = price(source)
    return p - F.avg(p).over(W.partitionBy(*keys))


def vwap_spread(frame: WindowSpec, centred_price: Column, rolling: int | None = None) -> Column:
    """Volume-weighted standard deviation of a centred price."""
    v = F.col("volume")
    mean, square = weighted(centred_price, v, frame, rolling), weighted(centred_price * centred_price, v, frame, rolling)
    return F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def vwap_bands(mean: Column, spread: Column, multiples: tuple[int, ...] = (1, 2)) -> dict[str, Column]:
    return {f"band_{side}_{k}": mean + sign * k * spread for k in multiples for side, sign in (("upper", 1), ("lower", -1))}


def activity(measure: ActivityMeasure, w: WindowSpec) -> Column:
    if measure == ActivityMeasure.ABSOLUTE_RETURN:
        return F.abs(F.ln(F.try_divide(F.col("close"), F.lag("close").over(w))))
    return F.col(measure.value).cast("double")


def z_rolling(x: Column, window: int, w: WindowSpec) -> Column:
    """Against the ``window`` bars before, the current one excluded."""
    frame = prior_rows(w, window)
    mean, spread = full(window, F.avg(x), x, frame), full(window, F.stddev_samp(x), x, frame)
    return F.when(spread > 0, (x - mean) / spread)


def z_hour_of_day(x: Column, keys=KEYS, time: str = "open_time") -> Column:
    """Against all earlier bars of the same UTC hour."""
    frame = W.partitionBy(*keys, F.hour(time)).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    spread = F.when(F.count(x).over(frame) > 1, F.stddev_samp(x).over(frame))
    return F.when(spread > 0, (x - F.avg(x).over(frame)) / spread)


def prior_extreme(side: ExtremeSide, window: int, w: WindowSpec) -> Column:
    c, f = (F.col("high"), F.max) if side == ExtremeSide.HIGH else (F.col("low"), F.min)
    return full(window, f(c), c, prior_rows(w, window))


def broken(side: ExtremeSide, level: Column) -> Column:
    """Whether the bar breaks the level; an unknown level breaks nothing."""
    return F.coalesce(F.col("high") > level if side == ExtremeSide.HIGH else F.col("low") < level, F.lit(False))


def excess(side: ExtremeSide, level: Column) -> Column:
    beyond = F.col("high") - level if side == ExtremeSide.HIGH else level - F.col("low")
    return F.when(beyond.isNotNull(), F.greatest(beyond, F.lit(0.0)))


# --- from depth and trades ---------------------------------------------------


def imbalance(level: int) -> Column:
    """(bid - ask) / (bid + ask) of a depth level; null without quantity."""
    b, a = F.col(f"bid_quantity_{level}"), F.col(f"ask_quantity_{level}")
    return F.when(b + a > 0, (b - a) / (b + a))


def bar_start(time: str, seconds: int) -> Column:
    """Start of the bar that holds a time, in the time's own type."""
    return F.window(time, f"{seconds} seconds")["start"]


def imbalance_per_bar(depth: DataFrame, level: int, aggregation: DepthAggregation, seconds: int, name: str) -> DataFrame:
    """``symbol, market, open_time, name``: mean of ratios, or the last known one."""
    x = depth.select("symbol", "market", "captured_at", bar_start("captured_at", seconds).alias("open_time"), imbalance(level).alias("x"))
    value = F.avg("x") if aggregation == DepthAggregation.MEAN else F.max_by("x", F.when(F.col("x").isNotNull(), F.col("captured_at")))
    return x.groupBy("symbol", "market", "open_time").agg(value.alias(name))


def liquidity_swing(trades: DataFrame, depth: DataFrame, side: ExtremeSide, window_seconds: float) -> DataFrame:
    """``symbol, market, captured_at, swing``: taker volume of the window over what the book lost.

    The volume is the last trade's trailing sum at or before the sample (as-of);
    the loss is the trailing maximum of the deepest level less its current value.
    """
    micros = int(window_seconds * 1_000_000)
    keys = ("symbol", "market")
    quantity = F.col("ask_quantity_20" if side == ExtremeSide.HIGH else "bid_quantity_20")
    wanted = ~F.col("buyer_is_maker") if side == ExtremeSide.HIGH else F.col("buyer_is_maker")
    taken = trades.select(*keys, F.col("transact_time").alias("t"), F.col("trade_id").alias("id"), F.when(wanted, F.col("quantity")).otherwise(0.0).alias("q"))
    marks = with_trailing(taken, {"volume": ("q", "sum")}, micros, keys=keys, time="t").select(*keys, "t", "id", "volume")
    book = with_trailing(depth.select(*keys, F.col("captured_at").alias("t"), quantity.alias("q")), {"most": ("q", "max")}, micros, keys=keys, time="t")
    samples = book.select(*keys, "t", (F.col("most") - F.col("q")).alias("loss"))
    joined = as_of(samples, marks, "t", keys, ["volume"], tiebreak="id")
    return joined.select(*keys, F.col("t").alias("captured_at"), F.when(F.col("loss") > 0, F.col("volume") / F.col("loss")).alias("swing"))


def swing_per_bar(swings: DataFrame, seconds: int, name: str) -> DataFrame:
    return swings.groupBy("symbol", "market", bar_start("captured_at", seconds).alias("open_time")).agg(F.median("swing").alias(name))


