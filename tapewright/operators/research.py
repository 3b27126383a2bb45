"""Research statistics: predictive power, breakouts, slippage, correlation, deflation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..functions.permutation import partner
from ..functions.windows import KEYS, unused, with_extremes
from ..model import BreakoutLabel, ExtremeSide, TakerSide


def forward_return(price: Column, horizon: int, w: WindowSpec, time: str | None = None, maximum_step_seconds: float | None = None) -> Column:
    """Return over the next ``horizon`` rows; null where they span more than the longest step."""
    r = F.try_divide(F.lead(price, horizon).over(w), price) - 1
    if time is None or maximum_step_seconds is None:
        return r
    elapsed = F.unix_micros(F.lead(F.col(time).cast("timestamp"), horizon).over(w)) - F.unix_micros(F.col(time).cast("timestamp"))
    return F.when(elapsed <= int(maximum_step_seconds * 1_000_000), r)


#: Stretches of values in which counts are summed up side by side.
STRETCHES = 64


def _positions(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Per distinct non-null value: ``keys, c, __n`` (rows with it), ``__before`` (rows below it), ``__total``.

    Values are counted first, then split by approximate quantiles into stretches whose
    sums are carried on, so that one instrument's values spread over many tasks.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("__n"))
    shares = [i / STRETCHES for i in range(1, STRETCHES)]
    edges = counts.groupBy(*keys).agg(F.percentile_approx(c, shares, F.lit(1000)).alias("__edges"), F.sum("__n").alias("__total"))
    placed = counts.join(edges, list(keys)).withColumn("__at", F.size(F.filter("__edges", lambda e: e < F.col(c)))).drop("__edges")
    sums = placed.groupBy(*keys, "__at").agg(F.sum("__n").alias("__s"))
    earlier = F.sum("__s").over(W.partitionBy(*keys).orderBy("__at").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(*keys, "__at", F.coalesce(earlier, F.lit(0)).alias("__start"))
    within = F.sum("__n").over(W.partitionBy(*keys, "__at").orderBy(c).rowsBetween(W.unboundedPreceding, -1))
    return placed.join(starts, [*keys, "__at"]).select(*keys, c, "__n", (F.col("__start") + F.coalesce(within, F.lit(0))).alias("__before"), "__total")


def average_ranks(df: DataFrame, keys: Sequence[str], c: str, name: str) -> DataFrame:
    """``df`` with the rank of ``c`` from 1, equal values sharing their mean rank; rows without a value or key go."""
    ranks = _positions(df, keys, c).select(*keys, c, (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, c])


def percentiles(df: DataFrame, keys: Sequence[str], c: str, shares: Sequence[float]) -> DataFrame:
    """``keys, percentiles``: exact, interpolated between neighbours, one for each share; keys without a value have no row."""
    x, below = _positions(df, keys, c), F.col("__before")
    found = []
    for share in shares:
        at = (F.col("__total") - 1) * F.lit(float(share))
        holds = lambda i: F.max(F.when((below <= i) & (i < below + F.col("__n")), F.col(c)))  # noqa: B023, E731
        low, high, part = holds(F.floor(at)), holds(F.ceil(at)), F.max(at - F.floor(at))
        found.append(F.when(low == high, low).otherwise((1 - part) * low + part * high))
    return x.groupBy(*keys).agg(F.array(*found).alias("percentiles"))


def information_coefficient(pairs: DataFrame, keys: Sequence[str], feature: str = "feature", forward: str = "forward") -> DataFrame:
    """``keys, samples, coefficient, t_statistic``: correlation of average ranks."""
    known = pairs.select(*keys, F.col(feature).alias("x"), F.col(forward).alias("y")).dropna(subset=["x", "y"])
    ranked = average_ranks(average_ranks(known, keys, "x", "rx"), keys, "y", "ry")
    per = ranked.groupBy(*keys).agg(F.count("*").alias("samples"), F.corr("rx", "ry").alias("coefficient"))
    ic, n = F.col("coefficient"), F.col("samples")
    t = F.when((n > 2) & (F.abs(ic) < 1), ic * F.sqrt(n - 2.0) / F.sqrt(1 - ic * ic))
    return per.withColumn("t_statistic", t)


def quantile_buckets(pairs: DataFrame, keys: Sequence[str], buckets: int, feature: str = "feature", forward: str = "forward") -> DataFrame:
    """``keys, bucket, samples, mean_forward`` over buckets of even counts by value; equal edges merge."""
    known = pairs.select(*keys, F.col(feature).alias("x"), F.col(forward).alias("y")).dropna(subset=["x", "y"])
    edges = percentiles(known, keys, "x", [i / buckets for i in range(buckets + 1)]).select(*keys, F.array_distinct("percentiles").alias("edges"))
    inner = F.filter("edges", lambda e: (e < F.col("x")) & (e > F.element_at("edges", 1)))
    placed = known.join(edges, list(keys)).withColumn("bucket", F.size(inner))
    return placed.groupBy(*keys, "bucket").agg(F.count("*").alias("samples"), F.avg("y").alias("mean_forward"))


def breakout_labels(candles: DataFrame, side: ExtremeSide, level: str, event: str, horizon: int, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """The breakout bars with a complete future: ``label`` and both excursions.

    A breakout failed if the price came back through the broken level within the
    next ``horizon`` bars.
    """
    x = with_extremes(candles, {"__high": ("high", "max", horizon), "__low": ("low", "min", horizon)}, ahead=True, keys=keys, time=time)
    x = x.where(F.coalesce(F.col(event), F.lit(False)) & F.col("__high").isNotNull() & F.col("__low").isNotNull())
    up = side == ExtremeSide.HIGH
    failed = F.col("__low") < F.col(level) if up else F.col("__high") > F.col(level)
    good = F.col("__high") - F.col(level) if up else F.col(level) - F.col("__low")
    bad = F.col(level) - F.col("__low") if up else F.col("__high") - F.col(level)
    return x.withColumns({
        "label": F.when(failed, BreakoutLabel.FAILED.value).otherwise(BreakoutLabel.HELD.value),
        "favourable_excursion": F.greatest(good, F.lit(0.0)), "adverse_excursion": F.greatest(bad, F.lit(0.0)),
    }).drop("__high", "__low")


def breakout_statistics(labelled: DataFrame, observations: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, observable, events, held, held_median, failed_median`` for the excursions and the observables."""
    held = F.col("label") == BreakoutLabel.HELD.value
    names = ["favourable_excursion", "adverse_excursion", *observations]
    one = labelled.groupBy(*keys).agg(
        F.count("*").alias("events"), F.sum(held.cast("long")).alias("held"),
        *[F.median(F.when(held, F.col(c))).alias(f"h_{c}") for c in names], *[F.median(F.when(~held, F.col(c))).alias(f"f_{c}") for c in names],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("observable"), F.col(f"h_{c}").alias("held_median"), F.col(f"f_{c}").alias("failed_median")) for c in names]))
    x = one.select(*keys, "events", "held", rows.alias("r")).select(*keys, "r.observable", "events", "held", "r.held_median", "r.failed_median")
    return x.withColumns({"difference": F.col("held_median") - F.col("failed_median"), "ratio": F.try_divide("held_median", "failed_median")})


def spread() -> Column:
    return F.col("best_ask_price") - F.col("best_bid_price")


def mid() -> Column:
    return (F.col("best_bid_price") + F.col("best_ask_price")) / 2


def taker_side() -> Column:
    """Who took: the seller where the buyer made the market."""
    return F.when(F.col("buyer_is_maker"), TakerSide.SELL.value).otherwise(TakerSide.BUY.value)


def slippage(depth: DataFrame, keys: Sequence[str] = ("symbol", "market")) -> DataFrame:
    """Half spread over mid: count, mean, median, 95th percentile; depth of the first five levels; hours covered."""
    notional = F.greatest(F.col("bid_quantity_5"), F.lit(0.0)) * mid()
    x = depth.select(*keys, "captured_at", F.try_divide(spread() / 2, mid()).alias("rate"), notional.alias("notional"))
    span = F.unix_micros(F.max("captured_at").cast("timestamp")) - F.unix_micros(F.min("captured_at").cast("timestamp"))
    per = x.groupBy(*keys).agg(F.count("rate").alias("samples"), (span / 3_600_000_000.0).alias("covered_hours"), F.avg("rate").alias("mean_rate"))
    # both columns as rows of one table: one pass ranks them
    what = unused("of", depth)
    stacked = x.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias(what), F.col(c).alias("value")) for c in ("rate", "notional")])))
    found = percentiles(stacked, [*keys, what], "value", (0.5, 0.95))
    at = lambda c, i: F.max(F.when(F.col(what) == c, F.col("percentiles")[i]))
    shares = found.groupBy(*keys).agg(at("rate", 0).alias("median_rate"), at("rate", 1).alias("p95_rate"), at("notional", 0).alias("median_notional"))
    return per.join(shares, list(keys), "left")


def activity_heatmap(candles: DataFrame, measure: str = "trade_count", keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``keys, weekday`` (Monday is 0)``, hour, relative``: the mean of ``measure`` in each cell over its mean at all."""
    overall = candles.groupBy(*keys).agg(F.avg(measure).alias("overall"))
    cells = candles.groupBy(*keys, F.weekday(time).alias("weekday"), F.hour(time).alias("hour")).agg(F.avg(measure).alias("mean"))
    return cells.join(overall, list(keys)).select(*keys, "weekday", "hour", F.try_divide("mean", "overall").alias("relative"))


def turning_points(candles: DataFrame, bars: int = 6, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``keys, flips, steepest``: changes of the closes' direction, and the bar that ends the steepest fall over ``bars``."""
    w = W.partitionBy(*keys).orderBy(time)
    close = F.col("close")
    x = candles.select(*keys, time, F.signum(close - F.lag(close).over(w)).alias("g"), (F.try_divide(close, F.lag(close, bars).over(w)) - 1).alias("fall"))
    x = x.withColumn("flip", F.coalesce(F.col("g") != F.lag("g").over(w), F.lit(False)))
    return x.groupBy(*keys).agg(F.sum(F.col("flip").cast("long")).alias("flips"), F.min_by(time, "fall").alias("steepest"))


def around(candles: DataFrame, points: DataFrame, point: str = "steepest", bars: int = 120, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """The candles within ``bars`` of each instrument's one ``point``, with ``offset`` from it."""
    n = candles.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(time)))
    marks = n.join(points.select(*keys, F.col(point).alias(time)), [*keys, time]).select(*keys, F.col("__n").alias("__at"))
    x = n.join(marks, list(keys)).withColumn("offset", F.col("__n") - F.col("__at"))
    return x.where(F.abs("offset") <= bars).drop("__n", "__at")


def strategy_correlation(returns: DataFrame, bar: Sequence[str], strategy: str = "strategy", value: str = "returns") -> DataFrame:
    """``first, second, bars, correlation`` over the bars where either strategy earns; fewer than 3 are no correlation."""
    a = returns.select(*bar, F.col(strategy).alias("first"), F.col(value).alias("x"))
    b = returns.select(*bar, F.col(strategy).alias("second"), F.col(value).alias("y"))
    both = a.join(b, list(bar)).where((F.col("first") < F.col("second")) & ((F.col("x") != 0) | (F.col("y") != 0)))
    per = both.groupBy("first", "second").agg(F.count("*").alias("bars"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.corr("x", "y").alias("c"))
    return per.select("first", "second", "bars", F.when((F.col("bars") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c")).alias("correlation"))


# --- trial deflation ---------------------------------------------------------


def sharpe_standard_error(observations: int, periods_per_year: float) -> float:
    if observations < 2:
        raise ValueError("at least two observations are needed")
    return math.sqrt(periods_per_year / observations)


def expected_maximum_sharpe(trials: int, observations: int, periods_per_year: float) -> float:
    """About what the best of ``trials`` worthless strategies shows by luck."""
    if trials < 1:
        raise ValueError("at least one trial is needed")
    return 0.0 if trials == 1 else math.sqrt(2 * math.log(trials)) * sharpe_standard_error(observations, periods_per_year)


def expected_maximum_sharpe_column(trials: Column, observations: Column, periods_per_year: float) -> Column:
    return F.when(trials <= 1, F.lit(0.0)).otherwise(F.sqrt(2 * F.ln(trials.cast("double"))) * F.sqrt(F.lit(periods_per_year) / observations))


# --- shuffle test ------------------------------------------------------------


def shuffle_returns(candles: DataFrame, seed: int, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """Candles whose log returns are permuted and accumulated anew.

    A seeded Feistel network gives each return its new place, so nothing is sorted
    again and the rows of one instrument meet their new places in many tasks.  Open,
    high and low scale with the close; volumes stay.  First and last close stay up to
    rounding.  Helper columns take names that ``candles`` lacks.
    """
    place, back, dealt_back, many, close = (unused(c, candles) for c in ("place", "back", "dealt", "bars", "rebuilt"))
    w, own = W.partitionBy(*keys).orderBy(time), W.partitionBy(*keys)
    x = candles.withColumns({place: F.row_number().over(w).cast("long"), many: F.count("*").over(own), back: F.ln(F.try_divide(F.col("close"), F.lag("close").over(w)))})
    to = partner(F.col(place) - 2, F.col(many) - 1, F.lit(seed), *[F.col(k) for k in keys])
    dealt = x.where(F.col(place) > 1).select(*keys, (to + 2).alias(place), F.col(back).alias(dealt_back))
    y = x.join(dealt, [*keys, place], "left")
    first = F.first("close").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rebuilt = first * F.exp(F.coalesce(F.sum(dealt_back).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))
    y = y.withColumn(close, rebuilt)
    scaled = {c: F.col(c) * (F.col(close) / F.col("close")) for c in ("open", "high", "low")}
    return y.withColumns(scaled).withColumn("close", F.col(close)).select(*candles.columns)
