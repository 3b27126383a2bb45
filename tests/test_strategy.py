import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions.windows import ordered
from tapewright.model import Comparison, ConditionSpec, ConditionTree, CostModel, CrossDirection, FeatureSpec, HoldingRules, StrategySpec, merge_features
from tapewright.operators import backtest as bt, research
from tapewright.plans.conditions import All, AnyOf, Compare, Constant, Crossover, Event, Not, Range, Sustained, Threshold, build_condition
from tapewright.plans.features import FeaturePlan, MarketView, build_feature
from tapewright.plans.strategy import ConditionAxis, FeatureAxis, Increasing, SearchSpace, Strategy, assemble, expanding_folds, search, search_summary, signals, walk_forward
from tapewright.plans.yaml_specs import load_strategy, parse_pipeline, parse_strategy
from tapewright.queries import SHIPPED, shipped
from tapewright.model import Timeframe

HOUR = Timeframe("1h")


def flags(spark, make_candles, entries, exits, closes=None):
    n = len(entries)
    x = make_candles(closes or list(range(100, 100 + n)))
    rows = {i: (bool(entries[i]), bool(exits[i])) for i in range(n)}
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("symbol").orderBy("open_time")) - 1
    pick = lambda k: F.element_at(F.array(*[F.lit(rows[j][k]) for j in range(n)]), (F.col("i") + 1).cast("int"))
    return x.withColumn("i", i).withColumns({"entry": pick(0), "exit": pick(1)})


def held(df):
    return [int(r["position"]) for r in df.orderBy("open_time").collect()]


def test_window_and_kernel_agree(spark, make_candles):
    rng = random.Random(4)
    for _ in range(3):
        n = 60
        e, x = [rng.random() < 0.2 for _ in range(n)], [rng.random() < 0.2 for _ in range(n)]
        df = flags(spark, make_candles, e, x)
        window = held(bt.with_positions(df, weight=1.0, warmup=3))
        shift = lambda s: np.array([False, *s[:-1]])
        assert window == bt.resolve(shift(e), shift(x), HoldingRules(), 4).astype(int).tolist()


def test_time_rules(spark, make_candles):
    df = flags(spark, make_candles, [1] * 12, [0] * 12)
    assert held(bt.with_positions(df, weight=1.0, warmup=0, holding=HoldingRules(3, 2))) == [0, 1, 1, 1, 0, 0, 1, 1, 1, 0, 0, 1]


def test_entry_wins_and_exit_acts_later(spark, make_candles):
    df = flags(spark, make_candles, [1, 0, 0, 0], [1, 0, 1, 0])
    assert held(bt.with_positions(df, weight=1.0, warmup=0, delay=0)) == [1, 1, 0, 0]


def test_costs_multiply_and_trades(spark, make_candles):
    df = flags(spark, make_candles, [1, 0, 0, 0, 0], [0, 0, 1, 0, 0], [100, 100, 110, 99, 99])
    costs = CostModel(0.001, 0.0)
    curve = bt.equity_curve(bt.with_positions(df, weight=1.0, warmup=0), costs)
    e = [r["equity"] for r in curve.orderBy("open_time").collect()]
    assert e[1] == pytest.approx(9990) and e[2] == pytest.approx(9990 * 1.1) and e[3] == pytest.approx(9990 * 1.1 * 0.999)
    t = bt.trades(curve, costs).collect()
    assert len(t) == 1 and (t[0]["entry_price"], t[0]["exit_price"], t[0]["bars_held"]) == (100, 110, 2)
    assert t[0]["net_return"] == pytest.approx(0.1 - 0.002)
    p = bt.performance(curve, bt.trades(curve, costs), 8760.0).first()
    assert p["trades"] == 1 and p["exposure"] == pytest.approx(0.4) and p["payoff_ratio"] is None


def test_undefined_statistics_are_null(spark, make_candles):
    curve = bt.equity_curve(make_candles([1, 2, 3]).withColumn("position", F.lit(0.0)), CostModel())
    p = bt.performance(curve, bt.trades(curve, CostModel()), 8760.0).first()
    assert (p["sharpe"], p["sortino"], p["win_rate"], p["trades"], p["maximum_drawdown"]) == (None, None, None, 0, 0.0)


def test_break_even(spark, make_candles):
    df = flags(spark, make_candles, [1, 0, 0, 0], [0, 0, 1, 0], [100, 100, 101, 101]).withColumn("position", F.col("entry").cast("double"))
    df = bt.with_positions(df.drop("position"), weight=1.0, warmup=0)
    grid = bt.cost_sensitivity(df, [0.0, 0.004, 0.008], 0.0)
    assert 0.008 < bt.break_even(grid).first()["break_even"] < 0.016
    assert bt.break_even(bt.cost_sensitivity(df, [0.0, 0.001], 0.0)).first()["break_even"] is None


def check(spark, make_candles, node, values, **columns):
    x = make_candles(values, **columns)
    return [r["c"] for r in x.withColumn("c", node.evaluate(x)).orderBy("open_time").collect()]


def test_missing_values_in_conditions(spark, make_candles):
    above = Threshold("close", Comparison.ABOVE, 1)
    assert check(spark, make_candles, above, [None, 2]) == [False, True]
    assert check(spark, make_candles, Not(above), [None, 2]) == [True, False]
    assert check(spark, make_candles, Range("close", 1, 2), [None, 1, 2, 3]) == [False, True, True, False]
    assert check(spark, make_candles, Event("close"), [None, 0, 5]) == [False, False, True]
    assert check(spark, make_candles, Compare("close", Comparison.AT_MOST, "high"), [1, 2], high=[None, 2]) == [False, True]
    assert check(spark, make_candles, Sustained(above, 2), [2, 2, 0, 2, 2]) == [False, True, False, False, True]


def test_trees():
    a, b = Constant(True), Constant(False)
    assert len((a & b & a).parts) == 3 and isinstance(a | b, AnyOf) and isinstance(~a, Not)
    assert All.of(Crossover("x", CrossDirection.UP, "y"), Sustained(a, 4)).warmup == 3
    with pytest.raises(ValueError, match="lower"):
        Range("x", 2, 1)
    with pytest.raises(ValueError, match="at least 2"):
        Sustained(a, 1)


@pytest.mark.parametrize("spec, message", [
    (ConditionSpec("nothing"), "unknown"), (ConditionSpec("threshold", {"feature": "x", "comparison": "above"}), "value"),
    (ConditionSpec("threshold", {"feature": "x", "comparison": "over", "value": 1}), "comparison"), (ConditionSpec("event", {"feature": "x", "typo": 1}), "typo"),
    (ConditionSpec("not"), "one child"), (ConditionSpec("event", {"feature": "x"}, (ConditionSpec("always"),)), "no children"),
])
def test_bad_conditions(spec, message):
    with pytest.raises(ValueError, match=message):
        build_condition(spec)


def test_depth_limit():
    spec = ConditionSpec("always")
    for _ in range(12):
        spec = ConditionSpec("not", {}, (spec,))
    with pytest.raises(ValueError, match="deep"):
        build_condition(spec)


@pytest.mark.parametrize("spec, name", [
    (FeatureSpec("sma", {"period": 5}), "sma_5"), (FeatureSpec("vwap"), "vwap_session"), (FeatureSpec("vwap", {"mode": "rolling"}), "vwap_rolling_20"), (FeatureSpec("vwap_deviation"), "vwap_session_deviation"),
    (FeatureSpec("activity"), "activity_trade_count_rolling_60"), (FeatureSpec("obi"), "obi_5_mean"), (FeatureSpec("prior_extreme"), "prior_high_20"), (FeatureSpec("breakout", {"side": "low"}), "breakout_low_20"),
    (FeatureSpec("liquidity_swing"), "liquidity_swing_high_5s"), (FeatureSpec("distance_to_poc"), "distance_to_poc_5d"), (FeatureSpec("atr"), "atr_14"), (FeatureSpec("rsi", {"period": 14}), "rsi_14"), (FeatureSpec("ema", {"period": 9}), "ema_9"),
])
def test_feature_names(spec, name):
    assert build_feature(spec).name == name


def test_feature_plan_errors(spark, make_candles):
    with pytest.raises(ValueError, match="share a name"):
        FeaturePlan.of([FeatureSpec("vwap"), FeatureSpec("vwap", {"price_source": "close"})])
    with pytest.raises(ValueError, match="obi_5_mean needs depth"):
        FeaturePlan.of([FeatureSpec("obi")]).table(MarketView(make_candles([1])), HOUR)
    with pytest.raises(ValueError, match="perod"):
        build_feature(FeatureSpec("sma", {"period": 3, "perod": 4}))


def test_unresolved_names_fail_before_any_read():
    spec = StrategySpec("s", (FeatureSpec("ema", {"period": 3}),), ConditionSpec("event", {"feature": "ema_4"}), ConditionSpec("never"))
    with pytest.raises(ValueError, match="ema_4"):
        assemble(spec)


def three_ways(spark, make_candles):
    rng = random.Random(17)
    closes = [100 + i * 0.02 + 5 * np.sin(i / 9) + rng.gauss(0, 0.5) for i in range(300)]
    return make_candles(closes)


def test_three_ways_agree(spark, make_candles):
    """Operators, specification and file give the same positions, bar by bar."""
    c = three_ways(spark, make_candles)
    spec = load_strategy(SHIPPED / "trend.yaml")
    table = FeaturePlan.of(spec.features).table(MarketView(c), HOUR)
    by_hand = Strategy("x", Crossover("ema_12", CrossDirection.UP, "ema_26"), Crossover("ema_12", CrossDirection.DOWN, "ema_26"), ~Threshold("rsi_14", Comparison.ABOVE, 70))
    a, b = held(signals(table, by_hand)), held(signals(table, assemble(spec)))
    rows = table.orderBy("open_time").collect()
    want, on, pending_in, pending_out = [], False, False, False
    for i, r in enumerate(rows):
        above = r["ema_12"] > r["ema_26"]
        was = i > 0 and rows[i - 1]["ema_12"] > rows[i - 1]["ema_26"]
        if pending_in and i >= 2 and not on:
            on = True
        elif pending_out and on:
            on = False
        want.append(int(on))
        pending_in = i > 0 and above and not was and not r["rsi_14"] > 70
        pending_out = i > 0 and not above and was
    assert a == b == want and sum(want) > 0


def test_search_space():
    space = SearchSpace(shipped()[0], (FeatureAxis(0, "period", (8, 12, 21)), FeatureAxis(1, "period", (21, 26, 34, 55)), ConditionAxis(ConditionTree.FILTERS, "value", (60, 65, 70, 75))), (Increasing(0, 1),))
    specs = space.expand()
    assert space.combinations == 48 and len(specs) == 44
    first = specs[0]
    assert first.entry.parameters == {"fast": "ema_8", "direction": "up", "slow": "ema_21"} and first.filters.children[0].parameters["value"] == 60
    assert len(merge_features(*(s.features for s in specs))) == 3 + 4 - 1 + 1


def test_search_restarts_each_fold(spark, make_candles):
    c = three_ways(spark, make_candles)
    space = SearchSpace(shipped()[0], (FeatureAxis(0, "period", (5, 8)),), ())
    trials = search(MarketView(c), space, HOUR)
    rows = trials.orderBy("trial").collect()
    assert [r["trial"] for r in rows] == [0, 1] and all(r["in_return"] is not None and r["out_return"] is not None for r in rows)
    spec = space.expand()[0]
    table = walk_forward(FeaturePlan.of(merge_features(*(s.features for s in space.expand()))).table(MarketView(c), HOUR))
    part = table.where("fold = 'out'").drop("fold")
    curve = bt.equity_curve(signals(part, assemble(spec)), CostModel())
    assert curve.orderBy(F.desc("open_time")).first()["equity"] / 10_000 - 1 == pytest.approx(rows[0]["out_return"])
    assert search_summary(trials).first()["trials"] == 2


def test_folds(spark, make_candles):
    x = expanding_folds(make_candles([1] * 20), 3)
    n = {(r["number"], r["fold"]): r["n"] for r in x.groupBy("number", "fold").agg(F.count("*").alias("n")).collect()}
    assert n == {(1, "in"): 7, (1, "out"): 3, (2, "in"): 10, (2, "out"): 5, (3, "in"): 14, (3, "out"): 6}


def test_exit_crossing():
    a, b = shipped()[0], shipped()[1]
    crossed = a.with_exit_from(b)
    assert crossed.exit == b.exit and crossed.entry == a.entry and crossed.holding == b.holding
    assemble(crossed)


@pytest.mark.parametrize("text, message", [
    ("name: x\nfeatures: []\nentry: {kind: always}\nexit: {kind: never}", "features"), ("name: x\nfeatures: [{kind: sma, period: 3}]\nentry: {kind: threshold, of: []}\nexit: {kind: never}", "no children"),
    ("name: x\nfeatures: [{kind: sma, period: true}]\nentry: {kind: always}\nexit: {kind: never}", "period"), ("name: x\nfeatures: [{kind: sma, period: 3}]\nentry: {}\nexit: {kind: never}", "entry"),
    ("name: x\nfeatures: [{kind: sma, period: 3}]\nentry: {kind: always}\nexit: {kind: never}\nholding: {bars: 3}", "holding"), ("- 1", "mapping"),
])
def test_bad_yaml(text, message):
    with pytest.raises(ValueError, match=message):
        parse_strategy(text)


def test_pipeline_yaml():
    conf = parse_pipeline("defaults: {market: spot, start: '2024-01-01', max_concurrency: 2}\nsymbols:\n  - {symbol: BTC/USDT, timeframes: ['1m', '1h']}\ncrosscheck: {tolerance: 0.02}")
    assert [i.storage_key for i in conf.instruments] == ["spot_BTCUSDT_1m", "spot_BTCUSDT_1h"] and conf.tolerance == 0.02


def test_information_coefficient(spark):
    rows = [("s", float(i), float(i * i)) for i in range(20)]
    x = spark.createDataFrame(rows, "k string, feature double, forward double")
    r = research.information_coefficient(x, ["k"]).first()
    assert r["coefficient"] == pytest.approx(1.0)
    b = research.quantile_buckets(x, ["k"], 4).orderBy("bucket").collect()
    assert [y["samples"] for y in b] == [5, 5, 5, 5]


def test_ic_and_buckets_equal_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    p = pd.DataFrame({"k": "s", "feature": rng.integers(-3, 4, 300) / 3.0, "forward": rng.normal(size=300)})
    x = spark.createDataFrame(p)
    assert research.information_coefficient(x, ["k"]).first()["coefficient"] == pytest.approx(p["feature"].rank().corr(p["forward"].rank()))
    want = p["forward"].groupby(pd.qcut(p["feature"], 5, labels=False, duplicates="drop")).mean()
    got = [r["mean_forward"] for r in research.quantile_buckets(x, ["k"], 5).orderBy("bucket").collect()]
    assert got == pytest.approx(list(want))


def test_forward_return_skips_gaps(spark, make_candles):
    from support import START
    from datetime import timedelta

    x = make_candles([1, 2, 4], times=[START, START + timedelta(hours=1), START + timedelta(hours=9)])
    w = ordered()
    got = [r["f"] for r in x.withColumn("f", research.forward_return(F.col("close"), 1, w, "open_time", 3600 * 2)).orderBy("open_time").collect()]
    assert got == [1.0, None, None]


def test_shuffle_keeps_ends_and_returns(spark, make_candles):
    closes = [100 + 7 * np.sin(i) for i in range(50)]
    c = make_candles(closes)
    a = [r["close"] for r in research.shuffle_returns(c, 1).orderBy("open_time").collect()]
    assert a[0] == pytest.approx(closes[0]) and a[-1] == pytest.approx(closes[-1]) and a != pytest.approx(closes)
    assert sorted(np.diff(np.log(a))) == pytest.approx(sorted(np.diff(np.log(closes))))


def test_deflation():
    assert research.expected_maximum_sharpe(1, 100, 8760) == 0
    assert research.expected_maximum_sharpe(44, 8760, 8760) == pytest.approx((2 * np.log(44)) ** 0.5)
