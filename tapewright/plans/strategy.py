"""Strategies: assembly from specifications, signals, comparison and search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.windows import KEYS, ordered
from ..model import ConditionSpec, ConditionTree, CostModel, FeatureSpec, HoldingRules, PositionDirection, Scalar, StrategySpec, Timeframe, merge_features
from ..operators import backtest as bt, research
from .conditions import Condition, Constant, build_condition
from .features import FeaturePlan, MarketView, build_feature

CANDLE_COLUMNS = frozenset(["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume", "trade_count"])


@dataclass(frozen=True)
class Strategy:
    name: str
    entry: Condition
    exit: Condition
    filters: Condition = Constant(True)
    holding: HoldingRules = HoldingRules()
    direction: PositionDirection = PositionDirection.LONG

    @classmethod
    def buy_and_hold(cls) -> Strategy:
        return cls("buy_and_hold", Constant(True), Constant(False))

    @property
    def required(self) -> frozenset[str]:
        return self.entry.required | self.exit.required | self.filters.required

    @property
    def warmup(self) -> int:
        return max(self.entry.warmup, self.exit.warmup, self.filters.warmup)

    def describe(self) -> str:
        return f"{self.name}: {self.direction} when {self.entry.describe()}, unless not {self.filters.describe()}; out when {self.exit.describe()}"


def assemble(spec: StrategySpec) -> Strategy:
    """Bind a specification; references to columns that nothing declares fail here, before any read."""
    out = Strategy(spec.name, build_condition(spec.entry), build_condition(spec.exit), build_condition(spec.filters) if spec.filters else Constant(True), spec.holding, spec.direction)
    declared = CANDLE_COLUMNS | {build_feature(f).name for f in spec.features}
    lacking = sorted(out.required - declared)
    if lacking:
        raise ValueError(f"{spec.name} refers to columns that it doesn't declare: {lacking}; declared: {sorted(declared)}")
    return out


def signals(table: DataFrame, strategy: Strategy, delay: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """``table`` with ``entry_signal, exit_signal, allowed, position``."""
    w = ordered(keys)
    x = table.withColumns({"entry_signal": strategy.entry.evaluate(table, w), "exit_signal": strategy.exit.evaluate(table, w), "allowed": strategy.filters.evaluate(table, w)})
    x = x.withColumns({"entry": F.col("entry_signal") & F.col("allowed"), "exit": F.col("exit_signal")})
    return bt.with_positions(x, weight=strategy.direction.weight, warmup=strategy.warmup, holding=strategy.holding, delay=delay, keys=keys).drop("entry", "exit")


def strategy_table(view: MarketView, specs: Sequence[StrategySpec], timeframe: Timeframe, trim: bool = True) -> DataFrame:
    """One wide table for many strategies; a feature that several need is computed once."""
    return FeaturePlan.of(merge_features(*(s.features for s in specs))).table(view, timeframe, trim)


def compare(view: MarketView, specs: Sequence[StrategySpec], timeframe: Timeframe, costs: CostModel = CostModel(), periods_per_year: float = 8760.0, capital: float = 10_000.0) -> DataFrame:
    """Performance of each strategy and of holding, on the same trimmed bars."""
    table = strategy_table(view, specs, timeframe)
    curves = strategy_curves(table, [*map(assemble, specs), Strategy.buy_and_hold()], costs, capital)
    keys = ("strategy", *KEYS)
    out = bt.performance(curves, bt.trades(curves, costs, keys), periods_per_year, capital, keys)
    base = W.partitionBy(*KEYS)
    hold = F.max(F.when(F.col("strategy") == "buy_and_hold", F.col("total_return"))).over(base)
    return out.withColumn("excess_return", F.col("total_return") - hold)


def positions_of(table: DataFrame, strategies: Sequence[Strategy], keys: Sequence[str] = KEYS, delay: int = 1) -> DataFrame:
    """``trial, strategy, keys, open_time, close, position`` of many strategies over one table.

    All conditions are columns of the one table, so it is computed once; then a
    row is dealt to each strategy, and those groups spread over the tasks.
    """
    w = ordered(keys)
    flags = {f"__{k}_{i}": c for i, s in enumerate(strategies) for k, c in (("in", s.entry.evaluate(table, w) & s.filters.evaluate(table, w)), ("out", s.exit.evaluate(table, w)))}

    def row(i: int, s: Strategy):
        hold, cool = s.holding.maximum_holding_bars, s.holding.cooldown_bars
        return F.struct(
            F.lit(i).alias("trial"), F.lit(s.name).alias("strategy"), F.col(f"__in_{i}").alias("entry"), F.col(f"__out_{i}").alias("exit"), F.lit(s.direction.weight).alias("weight"),
            F.lit(s.warmup).alias("warmup"), F.lit(hold).cast("int").alias("maximum_holding_bars"), F.lit(cool).cast("int").alias("cooldown_bars"),
        )

    dealt = table.withColumns(flags).select(*keys, "open_time", "close", F.explode(F.array(*[row(i, s) for i, s in enumerate(strategies)])).alias("t")).select(*keys, "open_time", "close", "t.*")
    found = bt.positions_of_many(dealt, time_rules=any(s.holding.has_time_rules for s in strategies), delay=delay, keys=("trial", "strategy", *keys))
    return found.select("trial", "strategy", *keys, "open_time", "close", "position")


def strategy_curves(table: DataFrame, strategies: Sequence[Strategy], costs: CostModel, capital: float = 10_000.0) -> DataFrame:
    """The strategies' equity curves, told apart by the column ``strategy``."""
    return bt.equity_curve(positions_of(table, strategies), costs, capital, ("strategy", *KEYS))


def ranked_by_sharpe(performance: DataFrame) -> DataFrame:
    """Best first; an undefined ratio ranks last."""
    return performance.orderBy(F.desc_nulls_last("sharpe"), "strategy")


def beating_the_baseline(performance: DataFrame) -> DataFrame:
    """Strategies that earn more than holding."""
    return performance.where((F.col("strategy") != "buy_and_hold") & (F.col("excess_return") > 0))


def most_correlated(correlations: DataFrame) -> DataFrame:
    """The pair with the highest defined correlation: at most one row."""
    return correlations.where("correlation is not null").orderBy(F.desc("correlation"), "first", "second").limit(1)


# --- search ------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureAxis:
    feature_index: int
    key: str
    values: tuple[Scalar, ...]


@dataclass(frozen=True)
class ConditionAxis:
    """All parameters named ``key`` in one tree."""

    tree: ConditionTree
    key: str
    values: tuple[Scalar, ...]


@dataclass(frozen=True)
class Increasing:
    """The parameter of one feature must be below another's."""

    faster: int
    slower: int
    key: str = "period"


@dataclass(frozen=True)
class SearchSpace:
    base: StrategySpec
    axes: tuple[FeatureAxis | ConditionAxis, ...]
    constraints: tuple[Increasing, ...] = ()

    def __post_init__(self) -> None:
        if not self.axes or any(not a.values for a in self.axes):
            raise ValueError("a search space needs axes, and every axis needs values")

    @property
    def combinations(self) -> int:
        n = 1
        for a in self.axes:
            n *= len(a.values)
        return n

    def expand(self) -> list[StrategySpec]:
        """All combinations that the constraints allow, named by their parameters."""
        out = []
        for values in product(*(a.values for a in self.axes)):
            spec = self.base
            for axis, value in zip(self.axes, values, strict=True):
                spec = _applied(spec, axis, value)
            if all(float(spec.features[c.faster].parameters[c.key]) < float(spec.features[c.slower].parameters[c.key]) for c in self.constraints):
                suffix = "_".join(f"{a.key}{v}" for a, v in zip(self.axes, values))
                out.append(replace(spec, name=f"{self.base.name}__{suffix}"))
        if not out:
            raise ValueError("the constraints allow no combination")
        return out


def _mapped(node: ConditionSpec | None, change) -> ConditionSpec | None:
    if node is None:
        return None
    return ConditionSpec(node.kind, {k: change(k, v) for k, v in node.parameters.items()}, tuple(_mapped(c, change) for c in node.children))


def _applied(spec: StrategySpec, axis: FeatureAxis | ConditionAxis, value: Scalar) -> StrategySpec:
    if isinstance(axis, ConditionAxis):
        tree = getattr(spec, axis.tree.value)
        if tree is None:
            raise ValueError(f"{spec.name} has no {axis.tree}")
        return replace(spec, **{axis.tree.value: _mapped(tree, lambda k, v: value if k == axis.key else v)})
    if axis.feature_index >= len(spec.features):
        raise ValueError(f"{spec.name} has no feature {axis.feature_index}")
    old = spec.features[axis.feature_index]
    new = FeatureSpec(old.kind, {**old.parameters, axis.key: value})
    features = (*spec.features[: axis.feature_index], new, *spec.features[axis.feature_index + 1 :])
    before, after = build_feature(old).name, build_feature(new).name
    rename = lambda k, v: after if v == before else v  # noqa: E731 - conditions refer to features by name
    return replace(spec, features=features, entry=_mapped(spec.entry, rename), exit=_mapped(spec.exit, rename), filters=_mapped(spec.filters, rename))


def walk_forward(df: DataFrame, in_sample: float = 0.7, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``df`` with ``fold``: the first int(count * in_sample) bars are ``in``, the rest ``out``."""
    if not 0 < in_sample < 1:
        raise ValueError("in_sample must lie between 0 and 1")
    n, i = F.count("*").over(W.partitionBy(*keys)), F.row_number().over(W.partitionBy(*keys).orderBy(time))
    return df.withColumn("fold", F.when(i <= F.floor(n * F.lit(in_sample)), "in").otherwise("out"))


def expanding_folds(df: DataFrame, folds: int, in_sample: float = 0.7, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """Anchored folds: fold k is the first k + 1 of folds + 1 blocks; a row appears in each fold that holds it."""
    n, i = F.count("*").over(W.partitionBy(*keys)), F.row_number().over(W.partitionBy(*keys).orderBy(time))
    x = df.withColumns({"__i": i, "__block": F.floor(n / (folds + 1))}).withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    x = x.withColumn("__size", F.col("__block") * (F.col("number") + 1)).where("__i <= __size")
    return x.withColumn("fold", F.when(F.col("__i") <= F.floor(F.col("__size") * F.lit(in_sample)), "in").otherwise("out")).drop("__i", "__block", "__size")


def search(view: MarketView, space: SearchSpace, timeframe: Timeframe, costs: CostModel = CostModel(), periods_per_year: float = 8760.0, in_sample: float = 0.7, capital: float = 10_000.0) -> DataFrame:
    """Per trial: ``trial, strategy, trades, in_sharpe, in_return, out_sharpe, out_return``.

    All trials share one trimmed table; trial and fold are partition columns, so
    the tasks spread over trials.  Both folds start afresh: no position and full
    capital.
    """
    specs = space.expand()
    table = walk_forward(strategy_table(view, specs, timeframe), in_sample)
    keys = ("trial", "strategy", "fold", *KEYS)
    both = positions_of(table, [assemble(spec) for spec in specs], ("fold", *KEYS))
    curves = bt.equity_curve(both, costs, capital, keys)
    w = W.partitionBy(*keys).orderBy("open_time")
    curves = curves.withColumn("starts", (F.col("position") != 0) & (F.lag("position", 1, 0.0).over(w) == 0))
    per = curves.groupBy(*keys).agg(bt.sharpe(F.col("returns"), periods_per_year).alias("sharpe"), (F.max_by("equity", "open_time") / capital - 1).alias("total"), F.sum(F.col("starts").cast("long")).alias("trades"), F.count("*").alias("bars"))
    inside, outside = F.col("fold") == "in", F.col("fold") == "out"
    return per.groupBy("trial", "strategy", *KEYS).agg(
        F.max(F.when(inside, F.col("trades"))).alias("trades"), F.max(F.when(inside, F.col("sharpe"))).alias("in_sharpe"), F.max(F.when(inside, F.col("total"))).alias("in_return"),
        F.max(F.when(outside, F.col("sharpe"))).alias("out_sharpe"), F.max(F.when(outside, F.col("total"))).alias("out_return"), F.max(F.when(inside, F.col("bars"))).alias("in_bars"),
    )


def search_summary(trials: DataFrame, periods_per_year: float = 8760.0) -> DataFrame:
    """One row for each instrument: best trial (the first of equals), median, survival rate and haircut."""
    good = F.col("in_sharpe") > 0
    alive = good & (F.coalesce("out_sharpe", F.lit(0.0)) > 0)
    per = trials.groupBy(*KEYS).agg(
        F.count("*").alias("trials"), F.max("in_sharpe").alias("best_sharpe"), F.max_by("strategy", F.when(F.col("in_sharpe").isNotNull(), F.struct("in_sharpe", -F.col("trial")))).alias("best"),
        F.coalesce(F.median("in_sharpe"), F.lit(0.0)).alias("median_sharpe"), F.coalesce(F.try_divide(F.sum(alive.cast("long")), F.sum(good.cast("long"))), F.lit(0.0)).alias("survival_rate"), F.max("in_bars").alias("bars"),
    )
    lucky = research.expected_maximum_sharpe_column(F.col("trials"), F.col("bars"), periods_per_year)
    return per.withColumn("expected_maximum_sharpe", lucky).withColumn("haircut", F.col("best_sharpe") - F.col("expected_maximum_sharpe"))
