"""Several instruments in one plan: each fares as if it were alone."""

import os

import pytest
from pyspark.sql import functions as F

from support import SMALL
from tapewright import views
from tapewright.functions import features as fn
from tapewright.functions.windows import KEYS, ordered
from tapewright.model import ExtremeSide, Timeframe
from tapewright.operators import backtest as bt, quality, research
from tapewright.plans.features import FeaturePlan, MarketView
from tapewright.plans.strategy import compare
from tapewright.plans.yaml_specs import load_features
from tapewright.queries import COSTS, HOUR, SHIPPED, shipped

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def trades(spark):
    return views.trades(spark, SMALL, per_venue=True).where("symbol in ('click', 'view')").cache()


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def apart(spark, f):
    """``f`` over both instruments, and over each alone."""
    t = trades(spark)
    return rows(f(t)), sorted(r for symbol in ("click", "view") for r in rows(f(t.where(F.col("symbol") == symbol))))


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def labelled(t):
    level = fn.prior_extreme(ExtremeSide.HIGH, 5, ordered())
    x = views.candles(t).withColumn("level", level)
    return research.breakout_labels(x.withColumn("event", fn.broken(ExtremeSide.HIGH, F.col("level"))), ExtremeSide.HIGH, "level", "event", 4)


CASES = {
    "features": lambda t: FeaturePlan.of(load_features(SHIPPED / "features.yaml")).table(MarketView(views.candles(t), t, views.depth(t)), HOUR, trim=False),
    "trimmed": lambda t: FeaturePlan.of(load_features(SHIPPED / "features.yaml")).table(MarketView(views.candles(t)), Timeframe("1h")),
    "compare": lambda t: compare(MarketView(views.candles(t), t, views.depth(t)), shipped(), HOUR, COSTS),
    "flags": lambda t: quality.flag(views.candles(t), HOUR),
    "sanitation": lambda t: quality.sanitation_summary(quality.flag(views.candles(t), HOUR), KEYS),
    "completeness": lambda t: quality.completeness(views.candles(t).where("trade_count % 3 <> 0"), views.candles(t), KEYS),
    "agreement": lambda t: quality.agreement(views.candles(t), views.candles(t).where("trade_count % 5 <> 0").withColumn("close", F.col("close") * 1.01), 1e-6, ["symbol", "market"]),
    "breakouts": lambda t: research.breakout_statistics(labelled(t), ["volume"], KEYS),
    "availability": lambda t: quality.availability(views.candles(t).withColumn("odd", F.when(F.col("trade_count") % 2 == 1, F.col("close"))), ["odd", "volume"], KEYS),
    "slippage": lambda t: research.slippage(views.depth(t)),
    "turning_points": lambda t: research.turning_points(views.candles(t)),
    "heatmap": lambda t: research.activity_heatmap(views.candles(t)),
    "around": lambda t: research.around(views.candles(t), research.turning_points(views.candles(t)), bars=9),
    "buckets": lambda t: research.quantile_buckets(views.candles(t).select(*KEYS, F.col("volume").alias("feature"), F.col("close").alias("forward")), KEYS, 5),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_alone_and_together(spark, name):
    together, alone = apart(spark, lambda t: rounded(CASES[name](t)))
    assert together and together == alone


def test_ranks_and_percentiles_equal_sorting(spark):
    import random

    r = random.Random(5)
    values = {k: [r.choice([r.gauss(0, 1), float(r.randrange(4)), None]) for _ in range(n)] for k, n in (("a", 700), ("b", 1), ("c", 2), ("d", 90))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {}
    for x in research.average_ranks(df, ["k"], "v", "rank").collect():
        got.setdefault(x.k, []).append((x.v, x["rank"]))
    shares = (0.0, 0.3, 0.5, 0.95, 1.0)
    cut = {x.k: x.percentiles for x in research.percentiles(df, ["k"], "v", shares).collect()}
    for k, vs in values.items():
        known = sorted(v for v in vs if v is not None)
        want = [(v, sum(u < v for u in known) + (sum(u == v for u in known) + 1) / 2) for v in known]
        assert sorted(got.get(k, [])) == want
        if known:
            at = [s * (len(known) - 1) for s in shares]
            line = [known[int(i)] + (i - int(i)) * (known[min(int(i) + 1, len(known) - 1)] - known[int(i)]) for i in at]
            assert cut[k] == pytest.approx(line)
    assert research.percentiles(df.where("false"), ["k"], "v", shares).count() == 0


def test_holes_in_a_declared_grid_fail(make_candles):
    from support import hours
    from tapewright.functions.indicators import sma

    whole, times = make_candles([1.0, 2.0, 3.0, 4.0, 5.0]), hours(5)
    holed = make_candles([1.0, 2.0, 4.0, 5.0], symbol="ETH/USDT", times=[t for t in times if t != times[2]])
    mean = lambda df: df.select("symbol", "open_time", sma(F.col("close"), 3, ordered()).alias("m"))
    assert [x.m for x in mean(quality.on_grid(whole.withColumn("checked", F.lit(1)), HOUR)).orderBy("open_time").collect()] == [None, None, 2.0, 3.0, 4.0]
    with pytest.raises(Exception, match="has a hole before 2024-01-01 03"):
        mean(quality.on_grid(whole.unionByName(holed), HOUR)).collect()
    assert [x.m for x in mean(holed).orderBy("open_time").collect()][2] == pytest.approx((1 + 2 + 4) / 3)  # undeclared, it widens silently
    with pytest.raises(Exception, match="has a hole"):
        quality.on_grid(whole, Timeframe("15m")).collect()
