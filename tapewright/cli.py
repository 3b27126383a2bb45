"""``python -m tapewright.cli COMMAND``: the engine's commands over a store."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions import features as fn
from .functions.indicators import Recursive, crosses, sma, with_recursive
from .functions.windows import KEYS, longest_run, ordered
from .model import ActivityMeasure, ConditionTree, CostModel, ExtremeSide, Instrument, Market, PriceSource, SourceKind, Timeframe, TimeRange
from .operators import backtest as bt, profile, quality, research
from .operators.bars import resample
from .plans import ingest as ing, reports
from .plans.features import FeaturePlan, MarketView
from .plans.strategy import ConditionAxis, FeatureAxis, Increasing, SearchSpace, assemble, beating_the_baseline, compare, ranked_by_sharpe, search, search_summary, signals, strategy_curves, strategy_table
from .plans.yaml_specs import load_features, load_strategy, parse_pipeline
from .session import build_session
from .sources import files, payloads, rest
from .sources.store import CANDLE_TABLE, DEPTH_TABLE, TRADE_TABLE, Store, write_gaps, write_with_identity
from .streaming import recorder

SHIPPED = Path(__file__).parent / "plans" / "shipped"
STRATEGIES = {"trend_ema_rsi": "trend.yaml", "mean_reversion_vwap": "mean_reversion.yaml", "momentum_breakout": "breakout.yaml"}
COMMANDS: dict[str, Callable] = {}


def command(f):
    COMMANDS[f.__name__.replace("_", "-")] = f
    return f


class Context:
    def __init__(self, spark: SparkSession, a: argparse.Namespace):
        self.spark, self.a = spark, a
        self.store = Store(spark, a.store)
        self.timeframe = Timeframe(a.timeframe)
        self.instrument = Instrument(a.symbol, Market(a.market), self.timeframe)
        utc = lambda t: t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        self.period = TimeRange(utc(datetime.fromisoformat(a.start)), utc(datetime.fromisoformat(a.end)))

    @property
    def candles(self) -> DataFrame:
        """Stored bars of the timeframe, else finer ones rolled up."""
        own = self.store.read(self.store.candle_table(self.timeframe), self.instrument, self.period)
        if self.timeframe.value in ("1m", "5m", "1h"):
            return own.drop("source", "ingested_at")
        minute = Instrument(self.a.symbol, Market(self.a.market), Timeframe("1m"))
        return resample(self.store.read(CANDLE_TABLE, minute, self.period), self.timeframe)

    @property
    def view(self) -> MarketView:
        return MarketView(self.candles, self.store.read(TRADE_TABLE, self.instrument.listing, self.period), self.store.read(DEPTH_TABLE, self.instrument.listing, self.period))

    def spec(self, name: str):
        return load_strategy(SHIPPED / STRATEGIES[name] if name in STRATEGIES else name)


@command
def migrate(c: Context) -> str:
    return "created: " + (", ".join(c.store.migrate()) or "nothing")


@command
def fetch_candles(c: Context) -> str:
    got = files.archive_candles(c.spark, c.a.archive, c.instrument, c.period)
    return f"written: {c.store.save(CANDLE_TABLE, got.withColumn('source', F.lit('archive')))}"


@command
def backfill(c: Context) -> str:
    """Archive bars, preferred, and paged ones; then the gaps that are left."""
    archive = files.archive_candles(c.spark, c.a.archive, c.instrument, c.period)
    paged = rest.rest_candles(c.spark, c.a.fetcher, c.instrument, c.period) if c.a.fetcher else archive.limit(0)
    for col in archive.columns:
        if col not in paged.columns:
            paged = paged.withColumn(col, F.lit(None).cast(archive.schema[col].dataType))
    n = ing.backfill_candles(c.store, c.instrument, archive, paged)
    expected = quality.expected_bars(c.spark, c.period, c.timeframe)
    missing = quality.gaps(quality.missing_bars(c.store.existing_open_times(c.instrument, c.period), expected), c.timeframe)
    if c.a.out:
        write_with_identity(c.store.read(CANDLE_TABLE, c.instrument, c.period), f"{c.a.out}/candles")
        write_gaps(missing, f"{c.a.out}/gaps")
    return f"written: {n}\n" + reports.table(missing, "gaps")


@command
def backfill_trades(c: Context) -> str:
    got = files.archive_trades(c.spark, c.a.archive, c.instrument.listing, c.period)
    n, agreement = ing.backfill_trades(c.store, c.instrument.listing, got, c.candles, c.timeframe)
    return f"written: {n}\n" + reports.table(agreement, "agreement") + "\n" + reports.table(quality.missing_trade_ids(got), "missing trade ids")


@command
def ingest_pipeline(c: Context) -> str:
    conf = parse_pipeline(Path(c.a.config).read_text(encoding="utf-8"))
    loaders = {SourceKind.ARCHIVE: lambda i, p: files.archive_candles(c.spark, c.a.archive, i, p), SourceKind.REST: lambda i, p: rest.rest_candles(c.spark, c.a.fetcher, i, p)}
    out = ing.ingest(c.spark, c.store, conf.instruments, TimeRange(conf.start, c.period.end), c.period.end, loaders, concurrency=conf.max_concurrency, tolerance=conf.tolerance)
    return "\n".join(f"{r.instrument.storage_key}: {'ok' if r.ok else r.failure or 'price check failed'}; {r.before} -> {r.after} of {r.expected}; written {r.written}; flags {r.anomalies}" for r in out)


@command
def features(c: Context) -> str:
    plan = FeaturePlan.of(load_features(c.a.config or SHIPPED / "features.yaml"))
    x = plan.table(c.view, c.timeframe)
    if c.a.out:
        write_with_identity(x, c.a.out)
    known = x.agg(*[F.avg(F.col(n).isNotNull().cast("double")).alias(n) for n in plan.names])
    last = x.agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("open_time"))).alias(n) for n in plan.names])
    return reports.summary(known, "share of bars known") + "\n" + reports.summary(last, "last values")


@command
def signals_report(c: Context) -> str:
    spec = c.spec(c.a.strategy)
    s = assemble(spec)
    x = signals(strategy_table(c.view, [spec], c.timeframe), s)
    return s.describe() + "\n" + reports.table(bt.signal_counts(x), "signals")


@command
def backtest(c: Context) -> str:
    """The strategy, holding, and the strategy without delay as a demonstration of look-ahead."""
    spec = c.spec(c.a.strategy)
    if c.a.exit_from:
        spec = spec.with_exit_from(c.spec(c.a.exit_from))
    costs, s = CostModel(), assemble(spec)
    table = strategy_table(c.view, [spec], c.timeframe)
    out = []
    for title, x in (("strategy", signals(table, s)), ("look-ahead", signals(table, s, delay=0))):
        curve = bt.equity_curve(x, costs)
        out.append(reports.table(bt.performance(curve, bt.trades(curve, costs), c.a.periods_per_year), title))
    return "\n".join([*out, reports.table(compare(c.view, [spec], c.timeframe, costs, c.a.periods_per_year), "against holding")])


@command
def compare_strategies(c: Context) -> str:
    specs = [c.spec(n) for n in c.a.strategies.split(",")]
    perf = compare(c.view, specs, c.timeframe, CostModel(), c.a.periods_per_year)
    curves = strategy_curves(strategy_table(c.view, specs, c.timeframe), [assemble(s) for s in specs], CostModel())
    pairs = research.strategy_correlation(curves, [*KEYS, "open_time"])
    return reports.table(ranked_by_sharpe(perf), "comparison") + "\n" + reports.table(pairs.orderBy(F.desc_nulls_last("correlation")), "correlations") + "\n" + reports.table(beating_the_baseline(perf).select("strategy", "excess_return"), "better than holding")


@command
def cost_analysis(c: Context) -> str:
    spec = c.spec(c.a.strategy)
    x = signals(strategy_table(c.view, [spec], c.timeframe), assemble(spec))
    grid = bt.cost_sensitivity(x, [i * 0.00025 for i in range(13)], CostModel().slippage_rate)
    return "\n".join([reports.table(research.slippage(c.view.depth), "slippage"), reports.table(grid.orderBy("fee"), "fees"), reports.table(bt.break_even(grid), "break even")])


def _search_space(c: Context) -> SearchSpace:
    return SearchSpace(c.spec("trend_ema_rsi"), (FeatureAxis(0, "period", (8, 12, 21)), FeatureAxis(1, "period", (21, 26, 34, 55)), ConditionAxis(ConditionTree.FILTERS, "value", (60, 65, 70, 75))), (Increasing(0, 1),))


@command
def search_combinations(c: Context) -> str:
    """The trend strategy's space on the bars, and on the same bars with shuffled returns."""
    out = []
    for title, bars in (("as traded", c.candles), ("shuffled", research.shuffle_returns(c.candles, c.a.seed))):
        trials = search(MarketView(bars), _search_space(c), c.timeframe, CostModel(), c.a.periods_per_year)
        out += [reports.table(search_summary(trials, c.a.periods_per_year), title), reports.table(trials.orderBy(F.desc_nulls_last("in_sharpe")), "best trials", rows=5)]
    return "\n".join(out)


@command
def breakouts(c: Context) -> str:
    side, w, n = ExtremeSide(c.a.side), ordered(), 20
    x = FeaturePlan.of(load_features(SHIPPED / "features.yaml")).table(c.view, c.timeframe, trim=False)
    x = x.withColumn("level", fn.prior_extreme(side, n, w))
    x = x.withColumns({"event": fn.broken(side, F.col("level")), "excess_over_atr": F.try_divide(fn.excess(side, F.col("level")), F.col("atr_14"))})
    labelled = research.breakout_labels(x, side, "level", "event", 10)
    return reports.table(research.breakout_statistics(labelled, ["excess_over_atr", "activity_trade_count_rolling_168", "activity_absolute_return_rolling_168"]), "breakouts")


@command
def imbalance_power(c: Context) -> str:
    """Predictive power of the imbalance, sample by sample and bar by bar."""
    w = W.partitionBy("symbol", "market").orderBy("captured_at")
    d = c.view.depth.withColumns({"feature": fn.imbalance(5), "mid": (F.col("best_bid_price") + F.col("best_ask_price")) / 2})
    out = []
    for h in (1, 5, 30):
        pairs = d.withColumn("forward", research.forward_return(F.col("mid"), h, w, "captured_at", 5.0 * h))
        out += [reports.table(research.information_coefficient(pairs, ["symbol", "market"]), f"samples, horizon {h}"), reports.table(research.quantile_buckets(pairs, ["symbol", "market"], 5).orderBy("bucket"), "by bucket")]
    plan = FeaturePlan.of(load_features(c.a.config)) if c.a.config else None
    x = plan.table(c.view, c.timeframe) if plan else None
    for h in (1, 3) if plan else ():
        pairs = x.withColumns({"feature": F.col(plan.names[0]), "forward": research.forward_return(F.col("close"), h, ordered())})
        out.append(reports.table(research.information_coefficient(pairs, KEYS), f"bars, horizon {h}"))
    return "\n".join(out)


@command
def liquidity_swing(c: Context) -> str:
    swings = fn.liquidity_swing(c.view.trades, c.view.depth, ExtremeSide(c.a.side), c.a.window_seconds)
    return reports.table(swings.where("swing is not null").agg(F.count("*").alias("samples"), F.median("swing").alias("median"), F.percentile("swing", F.lit(0.95)).alias("p95")), "liquidity swing")


@command
def volume_profile(c: Context) -> str:
    keys = ["symbol", "market"]
    exact = profile.value_area(profile.histogram(c.view.trades, keys, 100), keys)
    bars = profile.value_area(profile.histogram(c.candles.withColumn("price", fn.price(PriceSource.TYPICAL)), keys, 100, volume="volume"), keys)
    return "\n".join([reports.table(exact, "from trades"), reports.table(bars, "from bars"), reports.table(profile.compare(exact, bars, keys), "difference")])


@command
def vwap(c: Context) -> str:
    f = fn.session_frame()
    x = c.candles.withColumn("centred", fn.centred(PriceSource.TYPICAL)).withColumns({"vwap": fn.vwap(f), "spread": fn.vwap_spread(f, F.col("centred"))})
    x = x.withColumns(fn.vwap_bands(F.col("vwap"), F.col("spread")))
    return reports.table(x.orderBy(F.desc("open_time")).select("open_time", "close", "vwap", *[n for n in x.columns if n.startswith("band_")]), "session vwap", rows=24)


@command
def activity(c: Context) -> str:
    w = ordered()
    x = c.candles.withColumn("n", fn.activity(ActivityMeasure(c.a.measure), w))
    by_hour = x.withColumns({"weekday": F.weekday("open_time"), "hour": F.hour("open_time")}).groupBy("weekday").pivot("hour", list(range(24))).agg(F.avg("n"))
    return reports.summary(x.agg(F.avg("n").alias("overall")), "mean activity") + "\n" + reports.table(by_hour.orderBy("weekday"), "mean by weekday and hour")


@command
def crossover(c: Context) -> str:
    w = ordered()
    x = c.candles.withColumns({"fast": sma(F.col("close"), 20, w), "slow": sma(F.col("close"), 60, w)})
    golden, death = crosses(F.col("fast"), F.col("slow"), w)
    x = x.withColumns({"golden": golden, "death": death}).where("golden or death")
    return reports.table(x.orderBy("open_time").select("open_time", "close", "golden", "death"), "crossings", rows=10)


@command
def relative_strength(c: Context) -> str:
    """RSI, and the longest runs above 70 and below 30."""
    w = ordered()
    x = FeaturePlan.of(load_features(SHIPPED / "features.yaml")).table(c.view, c.timeframe).withColumns({"over": longest_run(F.col("rsi_14") > 70, w), "under": longest_run(F.col("rsi_14") < 30, w)})
    return reports.summary(x.agg(F.avg("rsi_14").alias("mean"), F.max("over").alias("longest_over_70"), F.max("under").alias("longest_under_30")), "rsi_14")


@command
def smoothing_comparison(c: Context) -> str:
    """How often moving averages change direction."""
    w = ordered()
    x = with_recursive(c.candles.withColumn("sma_20", sma(F.col("close"), 20, w)), [Recursive("ema_20", "ema", "close", 20)])
    names = ("close", "sma_20", "ema_20")
    x = x.withColumns({f"d_{n}": F.signum(F.col(n) - F.lag(n).over(w)) for n in names})
    x = x.withColumns({f"f_{n}": (F.col(f"d_{n}") != F.lag(f"d_{n}").over(w)).cast("long") for n in names})
    return reports.summary(x.agg(*[F.sum(f"f_{n}").alias(n) for n in names]), "direction changes")


@command
def record(c: Context) -> str:
    """Record frames that another process drops into a folder."""
    raw = recorder.frames(c.spark, f"{c.a.frames}/stream")
    shots = payloads.snapshots(recorder.frames(c.spark, f"{c.a.frames}/snapshots"))
    shots = shots.withColumns({"symbol": F.lit(c.a.symbol), "market": F.lit(c.a.market), "seq": F.col("last_update_id")})
    return str(recorder.record(c.spark, raw, shots, c.instrument.listing, c.store, f"{c.a.out}/checkpoint", timeout=c.a.seconds))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tapewright")
    p.add_argument("command", choices=sorted(COMMANDS))
    for name, default in (("store", "store"), ("symbol", "BTC/USDT"), ("market", "spot"), ("timeframe", "1h"), ("start", "2024-01-01"), ("end", "2025-01-01"), ("archive", files.BASE_URL), ("fetcher", ""), ("config", ""), ("out", ""), ("strategy", "trend_ema_rsi"), ("strategies", ",".join(STRATEGIES)), ("exit-from", ""), ("side", "high"), ("measure", "trade_count"), ("frames", "frames")):
        p.add_argument(f"--{name}", default=default)
    p.add_argument("--periods-per-year", type=float, default=8760.0)
    p.add_argument("--window-seconds", type=float, default=5.0)
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--seconds", type=float, default=None)
    a = p.parse_args(argv)
    print(COMMANDS[a.command](Context(build_session(), a)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
