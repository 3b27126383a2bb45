"""Values that live on the driver: names, ranges, rules and specifications."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from enum import StrEnum
from typing import Self


class Market(StrEnum):
    SPOT = "spot"
    USDM = "usdm"


class MarketInput(StrEnum):
    CANDLES = "candles"
    TRADES = "trades"
    DEPTH = "depth"


class Comparison(StrEnum):
    ABOVE = "above"
    BELOW = "below"
    AT_LEAST = "at_least"
    AT_MOST = "at_most"

    @property
    def symbol(self) -> str:
        return {"above": ">", "below": "<", "at_least": ">=", "at_most": "<="}[self.value]


class CrossDirection(StrEnum):
    UP = "up"
    DOWN = "down"


class ExtremeSide(StrEnum):
    HIGH = "high"
    LOW = "low"


class ActivityMeasure(StrEnum):
    TRADE_COUNT = "trade_count"
    VOLUME = "volume"
    ABSOLUTE_RETURN = "absolute_return"


class ActivityBaseline(StrEnum):
    ROLLING = "rolling"
    HOUR_OF_DAY = "hour_of_day"


class DepthAggregation(StrEnum):
    MEAN = "mean"
    LAST = "last"


class PriceSource(StrEnum):
    CLOSE = "close"
    TYPICAL = "typical"


class VWAPMode(StrEnum):
    SESSION = "session"
    ROLLING = "rolling"


class BreakoutLabel(StrEnum):
    HELD = "held"
    FAILED = "failed"


class TakerSide(StrEnum):
    BUY = "buy"
    SELL = "sell"


class SequenceDecision(StrEnum):
    DISCARD = "discard"
    APPLY = "apply"
    RESYNCHRONIZE = "resynchronize"


class SourceKind(StrEnum):
    ARCHIVE = "archive"
    REST = "rest"


class ConditionTree(StrEnum):
    ENTRY = "entry"
    EXIT = "exit"
    FILTERS = "filters"


class PositionDirection(StrEnum):
    LONG = "long"
    FLAT = "flat"
    SHORT = "short"

    @property
    def weight(self) -> float:
        return {"long": 1.0, "flat": 0.0, "short": -1.0}[self.value]


#: The known timeframes and their seconds.
TIMEFRAME_SECONDS = {"1s": 1, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14_400, "1d": 86_400}


@dataclass(frozen=True, order=True)
class Timeframe:
    value: str

    def __post_init__(self) -> None:
        if self.value not in TIMEFRAME_SECONDS:
            raise ValueError(f"unknown timeframe {self.value!r}; known: {sorted(TIMEFRAME_SECONDS)}")

    @property
    def step(self) -> timedelta:
        return timedelta(seconds=TIMEFRAME_SECONDS[self.value])

    @property
    def interval(self) -> str:
        """For Spark's window()."""
        return f"{TIMEFRAME_SECONDS[self.value]} seconds"

    def floor(self, t: datetime) -> datetime:
        seconds = TIMEFRAME_SECONDS[self.value]
        return datetime.fromtimestamp(int(t.timestamp()) // seconds * seconds, timezone.utc)

    def ceil(self, t: datetime) -> datetime:
        low = self.floor(t)
        return low if low == t else low + self.step

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True)
class Listing:
    symbol: str
    market: Market

    @property
    def native_symbol(self) -> str:
        return self.symbol.replace("/", "").upper()


@dataclass(frozen=True)
class Instrument:
    symbol: str
    market: Market
    timeframe: Timeframe

    @property
    def listing(self) -> Listing:
        return Listing(self.symbol, self.market)

    @property
    def native_symbol(self) -> str:
        return self.listing.native_symbol

    @property
    def storage_key(self) -> str:
        return f"{self.market}_{self.native_symbol}_{self.timeframe}"


@dataclass(frozen=True)
class TimeRange:
    """Half-open [start, end), in aware times."""

    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        if self.start.tzinfo is None or self.end.tzinfo is None:
            raise ValueError("a time range needs aware times")
        if self.end < self.start:
            raise ValueError("a time range can't end before it starts")

    @property
    def is_empty(self) -> bool:
        return self.start == self.end

    def clamp_end(self, end: datetime) -> Self:
        return type(self)(self.start, max(self.start, min(self.end, end)))


@dataclass(frozen=True)
class Gap:
    """Closed at both ends: the first and the last missing bar."""

    start: datetime
    end: datetime
    missing: int


@dataclass(frozen=True)
class CostModel:
    taker_fee_rate: float = 0.001
    slippage_rate: float = 0.0005
    maker_fee_rate: float = 0.001

    def __post_init__(self) -> None:
        if min(self.taker_fee_rate, self.slippage_rate, self.maker_fee_rate) < 0:
            raise ValueError("cost rates can't be negative")

    @property
    def one_way(self) -> float:
        return self.taker_fee_rate + self.slippage_rate

    @property
    def round_trip(self) -> float:
        return 2 * self.one_way

    @classmethod
    def frictionless(cls) -> Self:
        return cls(0.0, 0.0, 0.0)


@dataclass(frozen=True)
class HoldingRules:
    maximum_holding_bars: int | None = None
    cooldown_bars: int | None = None

    def __post_init__(self) -> None:
        if self.maximum_holding_bars is not None and self.maximum_holding_bars < 1:
            raise ValueError("maximum_holding_bars must be at least 1")
        if self.cooldown_bars is not None and self.cooldown_bars < 0:
            raise ValueError("cooldown_bars can't be negative")

    @property
    def has_time_rules(self) -> bool:
        return self.maximum_holding_bars is not None or bool(self.cooldown_bars)


Scalar = int | float | str


@dataclass(frozen=True)
class FeatureSpec:
    kind: str
    parameters: dict[str, Scalar] = field(default_factory=dict)

    def describe(self) -> str:
        inner = ", ".join(f"{k}={self.parameters[k]}" for k in sorted(self.parameters))
        return f"{self.kind}({inner})"


@dataclass(frozen=True)
class ConditionSpec:
    kind: str
    parameters: dict[str, Scalar] = field(default_factory=dict)
    children: tuple[ConditionSpec, ...] = ()


@dataclass(frozen=True)
class StrategySpec:
    name: str
    features: tuple[FeatureSpec, ...]
    entry: ConditionSpec
    exit: ConditionSpec
    filters: ConditionSpec | None = None
    holding: HoldingRules = HoldingRules()
    direction: PositionDirection = PositionDirection.LONG

    def with_exit_from(self, donor: StrategySpec) -> StrategySpec:
        """Entries, filters and direction of this one; exit and holding rules of ``donor``."""
        return StrategySpec(f"{self.name}+exit:{donor.name}", merge_features(self.features, donor.features), self.entry, donor.exit, self.filters, donor.holding, self.direction)


def merge_features(*groups: tuple[FeatureSpec, ...]) -> tuple[FeatureSpec, ...]:
    """All distinct specifications, in order of appearance."""
    return tuple({f.describe(): f for g in groups for f in g}.values())
