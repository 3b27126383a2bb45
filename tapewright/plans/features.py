"""Feature kinds, and one plan that computes many features over one market view."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..functions import features as fn
from ..functions.indicators import PointOfControl, Recursive, gains, rsi, sma, true_range, with_recursive
from ..functions.windows import KEYS, last_rows, ordered, with_extremes
from ..model import TIMEFRAME_SECONDS, ActivityBaseline, ActivityMeasure, DepthAggregation, ExtremeSide, FeatureSpec, MarketInput, PriceSource, Timeframe, VWAPMode
from .parameters import Parameters


@dataclass(frozen=True)
class MarketView:
    """Lazy inputs of one or many instruments; candles name the output's rows."""

    candles: DataFrame
    trades: DataFrame | None = None
    depth: DataFrame | None = None


@dataclass(frozen=True)
class Feature:
    """One column.

    ``prepare`` columns come first, then the ``recursive`` ones in one kernel
    pass and the ``extremes`` of earlier bars, then ``column``.  ``aligned`` gives a
    per-bar table to join instead.
    """

    name: str
    warmup: int
    column: Callable[[WindowSpec], Column] | None = None
    prepare: Callable[[WindowSpec], dict[str, Column]] | None = None
    recursive: tuple[Recursive | PointOfControl, ...] = ()
    extremes: tuple[tuple[str, str, str, int], ...] = ()
    aligned: Callable[[MarketView, int], DataFrame] | None = None
    inputs: frozenset[MarketInput] = frozenset([MarketInput.CANDLES])


def _sma(p: Parameters) -> Feature:
    n, c = p.integer("period", least=1), p.text("column", "close")
    return Feature(f"sma_{n}", n - 1, lambda w: sma(F.col(c), n, w))


def _ema(p: Parameters) -> Feature:
    n, c = p.integer("period", least=1), p.text("column", "close")
    return Feature(f"ema_{n}", n, recursive=(Recursive(f"ema_{n}", "ema", c, n),))


def _rsi(p: Parameters) -> Feature:
    n, c = p.integer("period", least=1), p.text("column", "close")
    up, down = f"__up_{c}", f"__down_{c}"
    smooth = (Recursive(f"__rsi_up_{n}_{c}", "wilder", up, n), Recursive(f"__rsi_down_{n}_{c}", "wilder", down, n))
    return Feature(f"rsi_{n}", n, lambda w: rsi(F.col(smooth[0].name), F.col(smooth[1].name)), lambda w: dict(zip((up, down), gains(F.col(c), w))), smooth)


def _atr(p: Parameters) -> Feature:
    n = p.integer("period", 14, least=1)
    return Feature(f"atr_{n}", n, prepare=lambda w: {"__range": true_range(F.col("high"), F.col("low"), F.col("close"), w)}, recursive=(Recursive(f"atr_{n}", "wilder", "__range", n),))


def _vwap_parts(p: Parameters):
    mode, n, source = p.choice("mode", VWAPMode, "session"), p.integer("window", 20, least=1), p.choice("price_source", PriceSource, "typical")
    if mode == VWAPMode.SESSION:
        return "vwap_session", 0, lambda w: fn.session_frame(), None, source
    return f"vwap_rolling_{n}", n - 1, lambda w: last_rows(w, n), n, source


def _vwap(p: Parameters) -> Feature:
    name, warmup, frame, n, source = _vwap_parts(p)
    return Feature(name, warmup, lambda w: fn.vwap(frame(w), source, n))


def _vwap_deviation(p: Parameters) -> Feature:
    name, warmup, frame, n, source = _vwap_parts(p)
    centred = f"__centred_{source}"

    def column(w: WindowSpec) -> Column:
        f = frame(w)
        spread = fn.vwap_spread(f, F.col(centred), n)
        return F.when(spread > 0, (fn.price(source) - fn.vwap(f, source, n)) / spread)

    return Feature(f"{name}_deviation", warmup, column, lambda w: {centred: fn.centred(source)})


def _activity(p: Parameters) -> Feature:
    measure, baseline, n = p.choice("measure", ActivityMeasure, "trade_count"), p.choice("baseline", ActivityBaseline, "rolling"), p.integer("window", 60, least=2)
    raw = f"__activity_{measure}"
    value = (lambda w: fn.z_rolling(F.col(raw), n, w)) if baseline == ActivityBaseline.ROLLING else (lambda w: fn.z_hour_of_day(F.col(raw)))
    return Feature(f"activity_{measure}_{baseline}_{n}", n, value, lambda w: {raw: fn.activity(measure, w)})


def _prior(side: ExtremeSide, n: int) -> tuple[str, str, str, int]:
    """Name, column, kind and bars of an extreme that features share."""
    return f"__prior_{side}_{n}", side.value, "max" if side == ExtremeSide.HIGH else "min", n


def _prior_extreme(p: Parameters) -> Feature:
    side, n = p.choice("side", ExtremeSide, "high"), p.integer("window", 20, least=1)
    level = _prior(side, n)
    return Feature(f"prior_{side}_{n}", n, lambda w: F.col(level[0]), extremes=(level,))


def _breakout(p: Parameters) -> Feature:
    side, n = p.choice("side", ExtremeSide, "high"), p.integer("window", 20, least=1)
    level = _prior(side, n)
    return Feature(f"breakout_{side}_{n}", n, lambda w: fn.broken(side, F.col(level[0])).cast("double"), extremes=(level,))


def _distance_to_poc(p: Parameters) -> Feature:
    days, buckets = p.integer("window_days", 5, least=1), p.integer("bucket_count", 100, least=1)
    poc = PointOfControl(f"__poc_{days}_{buckets}", "__typical", days, buckets)
    distance = F.try_divide(F.col("close") - F.col(poc.name), F.col(poc.name))
    return Feature(f"distance_to_poc_{days}d", days, lambda w: distance, lambda w: {"__typical": fn.price(PriceSource.TYPICAL)}, (poc,))


_DEPTH = frozenset([MarketInput.CANDLES, MarketInput.DEPTH])


def _obi(p: Parameters) -> Feature:
    level, how = p.integer("depth_level", 5), p.choice("aggregation", DepthAggregation, "mean")
    if level not in (5, 10, 20):
        raise ValueError("depth_level must be 5, 10 or 20")
    name = f"obi_{level}_{how}"
    return Feature(name, 0, aligned=lambda v, s: fn.imbalance_per_bar(v.depth, level, how, s, name), inputs=_DEPTH)


def _liquidity_swing(p: Parameters) -> Feature:
    side, seconds = p.choice("side", ExtremeSide, "high"), p.number("window_seconds", 5)
    if seconds <= 0:
        raise ValueError("window_seconds must be above 0")
    name = f"liquidity_swing_{side}_{seconds:g}s"
    return Feature(name, 0, aligned=lambda v, s: fn.swing_per_bar(fn.liquidity_swing(v.trades, v.depth, side, seconds), s, name), inputs=_DEPTH | {MarketInput.TRADES})


#: kind -> builder; extend by adding an entry.
FEATURES: dict[str, Callable[[Parameters], Feature]] = {
    "sma": _sma, "ema": _ema, "rsi": _rsi, "atr": _atr, "vwap": _vwap, "vwap_deviation": _vwap_deviation, "activity": _activity, "obi": _obi,
    "prior_extreme": _prior_extreme, "breakout": _breakout, "liquidity_swing": _liquidity_swing, "distance_to_poc": _distance_to_poc,
}


def build_feature(spec: FeatureSpec, registry: Mapping[str, Callable[[Parameters], Feature]] = FEATURES) -> Feature:
    if spec.kind not in registry:
        raise ValueError(f"unknown feature {spec.kind!r}; known: {sorted(registry)}")
    p = Parameters(spec.kind, spec.parameters)
    out = registry[spec.kind](p)
    p.ensure_used()
    return out


@dataclass
class FeaturePlan:
    """All features of a run as one lazy plan: windows share one shuffle by instrument."""

    features: Sequence[Feature]
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.names = [f.name for f in self.features]
        if not self.names:
            raise ValueError("at least one feature is needed")
        twice = sorted({n for n in self.names if self.names.count(n) > 1})
        if twice:
            raise ValueError(f"features share a name: {twice}")

    @classmethod
    def of(cls, specs: Sequence[FeatureSpec]) -> FeaturePlan:
        return cls([build_feature(s) for s in specs])

    @property
    def inputs(self) -> frozenset[MarketInput]:
        return frozenset().union(*(f.inputs for f in self.features))

    @property
    def warmup(self) -> int:
        return max(f.warmup for f in self.features)

    def table(self, view: MarketView, timeframe: Timeframe, trim: bool = True) -> DataFrame:
        """Candles and features; trimmed before the first bar on which all features are known."""
        for f in self.features:
            for x in f.inputs - {MarketInput.CANDLES}:
                if getattr(view, x.value) is None:
                    raise ValueError(f"{f.name} needs {x}, which the view lacks")
        w, df = ordered(), view.candles
        columns = list(df.columns)
        prepared: dict[str, Column] = {}
        for f in self.features:
            prepared |= f.prepare(w) if f.prepare else {}
        df = df.withColumns(prepared) if prepared else df
        df = with_recursive(df, list(dict.fromkeys(r for f in self.features for r in f.recursive)))
        extremes = {name: spec for f in self.features for name, *spec in f.extremes}
        df = with_extremes(df, extremes) if extremes else df
        final = {f.name: f.column(w) for f in self.features if f.column}
        df = df.withColumns(final) if final else df
        for f in self.features:
            if f.aligned:
                df = df.join(f.aligned(view, TIMEFRAME_SECONDS[timeframe.value]), ["symbol", "market", "open_time"], "left")
        df = df.select(*columns, *self.names)
        return trimmed(df, self.names) if trim else df


def trimmed(df: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """Rows from each instrument's first row without a null feature on; later holes stay."""
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    first = F.min(F.when(known, F.col(time))).over(W.partitionBy(*keys))
    return df.withColumn("__first", first).where(F.col(time) >= F.col("__first")).drop("__first")
