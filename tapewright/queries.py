"""The engine's queries over the market views, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import views
from .functions import features as fn
from .functions.indicators import PointOfControl, Recursive, crosses, gains, rsi, sma, true_range, with_recursive
from .functions.windows import KEYS, last_rows, longest_run as runs, ordered
from .model import ActivityMeasure, Comparison, ConditionTree, CostModel, CrossDirection, DepthAggregation, ExtremeSide, HoldingRules, PriceSource, StrategySpec, Timeframe
from .operators import backtest as bt, bars, merge, profile, quality, research
from .plans.conditions import AnyOf, Compare, Constant, Crossover, Event, Not, Range, Sustained, Threshold
from .plans.features import FeaturePlan, MarketView, trimmed
from .plans.strategy import ConditionAxis, FeatureAxis, Increasing, SearchSpace, compare, expanding_folds, search, walk_forward
from .plans.yaml_specs import load_features, load_strategy
from .sources.columns import epoch_to_timestamp
from .session import workspace
from .streaming import orderbook
from .views import HOUR, SQL_DEPTH, SQL_TRADES, sql_candles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

T, D, C = SQL_TRADES, f"{SQL_TRADES}, {SQL_DEPTH}", f"{SQL_TRADES}, {sql_candles()}"
W = "WINDOW w AS (ORDER BY open_time)"


SHIPPED = Path(__file__).parent / "plans" / "shipped"


def shipped() -> list[StrategySpec]:
    return [load_strategy(SHIPPED / f"{n}.yaml") for n in ("trend", "mean_reversion", "breakout")]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def q(x: str, digits: int = 6) -> str:
    """The same rounding in SQL, without negative zeros."""
    return f"(round({x}, {digits}) + 0)"


def ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


def _trades(s: SparkSession, d: str) -> DataFrame:
    return views.trades(s, d)


def _depth(s: SparkSession, d: str, per_venue: bool = False) -> DataFrame:
    return views.depth(views.trades(s, d, per_venue))


def _candles(s: SparkSession, d: str, per_venue: bool = False) -> DataFrame:
    return views.candles(views.trades(s, d, per_venue))


BAR = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume"]
BAR_SQL = ", ".join(f"{q(c)} AS {c}" for c in BAR)


def _bars(df: DataFrame) -> DataFrame:
    return df.select("symbol", "market", ntz("open_time"), *[r(c).alias(c) for c in BAR], "trade_count")


# --- bars, merging, quality --------------------------------------------------


@query(f"WITH {C} SELECT symbol, market, open_time, {BAR_SQL}, trade_count FROM candles")
def trades_to_candles(s, d):
    return _bars(_candles(s, d))


@query(f"""WITH {C}, bars AS (SELECT *, time_bucket(INTERVAL '4 hours', open_time) AS bar FROM candles), b AS (
  SELECT symbol, market, bar AS open_time, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY open_time) AS close, sum(volume) AS volume,
    sum(quote_volume) AS quote_volume, sum(taker_buy_base_volume) AS taker_buy_base_volume, sum(taker_buy_quote_volume) AS taker_buy_quote_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count
  FROM bars GROUP BY symbol, market, bar)
SELECT symbol, market, open_time, {BAR_SQL}, trade_count FROM b""")
def candles_resample_4h(s, d):
    return _bars(bars.resample(_candles(s, d), Timeframe("4h")))


@query(f"""WITH {T}, {sql_candles("m", "minute")} SELECT symbol, market, time_bucket(INTERVAL '1 hour', open_time) AS open_time, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY open_time) AS close, sum(volume) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM m GROUP BY symbol, market, time_bucket(INTERVAL '1 hour', open_time)""")
def continuous_aggregate_1h(s, d):
    minutes = views.candles(_trades(s, d), Timeframe("1m"))
    return bars.continuous_aggregate(minutes, HOUR).select("symbol", "market", ntz("open_time"), "open", "high", "low", "close", "volume", "trade_count")


@query(f"""WITH {C}, a AS (SELECT open_time, close, 0 AS part FROM candles WHERE trade_count % 2 = 0), b AS (SELECT open_time, close + 1 AS close, 1 AS part FROM candles WHERE trade_count % 3 <> 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT open_time, round(arg_min(close, part), 6) AS close, CAST(min(part) AS INTEGER) AS part FROM u GROUP BY open_time""")
def merge_candles_priority(s, d):
    c = _candles(s, d)
    a = c.where("trade_count % 2 = 0").withColumn("part", F.lit(0))
    b = c.where("trade_count % 3 <> 1").withColumn("close", F.col("close") + 1).withColumn("part", F.lit(1))
    return merge.merge_candles(a, b).select(ntz("open_time"), r("close").alias("close"), "part")


@query(f"""WITH {T}, u AS (SELECT trade_id, price, 0 AS part FROM trades WHERE trade_id % 2 = 0 UNION ALL SELECT trade_id, price + 1, 1 FROM trades WHERE trade_id % 3 <> 0)
SELECT trade_id, round(arg_min(price, part), 6) AS price FROM u GROUP BY trade_id""")
def merge_trades_dedupe(s, d):
    t = _trades(s, d)
    other = t.where("trade_id % 3 <> 0").withColumn("price", F.col("price") + 1)
    return merge.merge_trades(t.where("trade_id % 2 = 0"), other).select("trade_id", r("price").alias("price"))


@query(f"""WITH {T}, x AS (SELECT greatest(first_trade_id - lag(last_trade_id) OVER (ORDER BY transact_time, trade_id) - 1, 0) AS lost FROM trades)
SELECT 'ALL/USDT' AS symbol, 'spot' AS market, CAST(coalesce(sum(lost), 0) AS BIGINT) AS missing FROM x""")
def missing_trade_ids(s, d):
    return quality.missing_trade_ids(_trades(s, d))


@query(f"WITH {T} SELECT symbol, market, max(trade_id) AS latest FROM trades GROUP BY symbol, market")
def latest_trade_id(s, d):
    return _trades(s, d).groupBy("symbol", "market").agg(F.max("trade_id").alias("latest"))


def _expected(c: DataFrame, step: int = 3600) -> DataFrame:
    """Every bar between the first and the last of each instrument, made in tasks."""
    span = c.groupBy(*KEYS).agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    return span.select(*KEYS, F.explode(F.sequence("a", "b", F.expr(f"interval {step} seconds"))).alias("open_time"))


@query(f"""WITH {T}, v AS (SELECT *, venue AS sym FROM trades), c AS (SELECT DISTINCT sym AS symbol, date_trunc('hour', transact_time) AS open_time FROM v),
e AS (SELECT symbol, unnest(generate_series(min(open_time), max(open_time), INTERVAL 1 HOUR)) AS open_time FROM c GROUP BY symbol),
m AS (SELECT * FROM e ANTI JOIN c USING (symbol, open_time)), i AS (SELECT symbol, open_time, epoch(open_time) - 3600 * row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS island FROM m)
SELECT symbol, min(open_time) AS gap_start, max(open_time) AS gap_end, count(*) AS missing FROM i GROUP BY symbol, island""")
def integrity_gaps(s, d):
    c = views.candles(views.trades(s, d, per_venue=True))
    missing = _expected(c).join(c.select(*KEYS, "open_time"), [*KEYS, "open_time"], "left_anti")
    return quality.gaps(missing, HOUR, KEYS).select("symbol", ntz("gap_start"), ntz("gap_end"), "missing")


def _dirty(c: DataFrame) -> DataFrame:
    """Candles with planted faults."""
    bad = {"high": F.when(F.col("trade_count") % 5 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(F.col("trade_count") % 7 == 0, 0.0).when(F.col("trade_count") % 11 == 0, -1.0).otherwise(F.col("volume"))}
    return c.withColumns(bad)


_DIRTY = """dirty AS (SELECT open_time, open, CASE WHEN trade_count % 5 = 0 THEN low - 1 ELSE high END AS high, low, close,
  CASE WHEN trade_count % 7 = 0 THEN 0.0 WHEN trade_count % 11 = 0 THEN -1.0 ELSE volume END AS volume, trade_count FROM candles),
flags AS (SELECT open_time, (high < greatest(open, close, low) OR low > least(open, close, high)) AS ohlc_invalid, volume < 0 AS negative_value, volume = 0 AS zero_volume,
  coalesce(abs(close / lag(close) OVER (ORDER BY open_time) - 1) > 0.2, false) AS price_jump FROM dirty)"""


@query(f"WITH {C}, {_DIRTY} SELECT * FROM flags")
def sanitation_flags(s, d):
    return quality.flag(_dirty(_candles(s, d)), HOUR).select(ntz("open_time"), *quality.FLAGS)


@query(f"""WITH {C}, {_DIRTY} SELECT count(*) FILTER (ohlc_invalid) AS ohlc_invalid, count(*) FILTER (negative_value) AS negative_value, count(*) FILTER (zero_volume) AS zero_volume,
  count(*) FILTER (price_jump) AS price_jump, count(*) FILTER (NOT (ohlc_invalid OR negative_value)) AS accepted, count(*) FILTER (ohlc_invalid OR negative_value) AS rejected FROM flags""")
def sanitation_summary(s, d):
    return quality.sanitation_summary(quality.flag(_dirty(_candles(s, d)), HOUR))


def _agreement_sql() -> str:
    """Every compared column: the largest difference, and the bars that one side lacks."""
    changed = {"close": "close * 1.001", "taker_buy_base_volume": "taker_buy_base_volume + 1", "trade_count": "trade_count + 2"}
    official = ", ".join(f"CASE WHEN trade_count % 4 = 0 THEN {changed[c]} ELSE {c} END AS {c}" if c in changed else c for c in quality.AGREEMENT)
    part = lambda c: f"CASE WHEN o.{c} = 0 THEN abs(rb.{c} - o.{c}) ELSE abs(rb.{c} - o.{c}) / abs(o.{c}) END"
    counts = "count(*) FILTER (rb.open_time IS NOT NULL AND o.open_time IS NOT NULL) AS common, count(*) FILTER (rb.open_time IS NULL) AS missing_in_rebuilt, count(*) FILTER (o.open_time IS NULL) AS missing_in_official"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS name, {q(f'max({part(c)})', 9)} AS difference, max({part(c)}) <= 1e-6 AS passed, {counts} FROM rb FULL OUTER JOIN o ON rb.open_time = o.open_time" for c in quality.AGREEMENT)
    return f"WITH {C}, o AS (SELECT open_time, {official} FROM candles WHERE trade_count % 6 <> 0), rb AS (SELECT * FROM candles WHERE trade_count % 10 <> 0) {rows}"


@query(_agreement_sql())
def candle_agreement(s, d):
    c = _candles(s, d)
    other = {"close": F.col("close") * 1.001, "taker_buy_base_volume": F.col("taker_buy_base_volume") + 1, "trade_count": F.col("trade_count") + 2}
    fourth = F.col("trade_count") % 4 == 0
    official = c.where("trade_count % 6 <> 0").withColumns({k: F.when(fourth, v).otherwise(F.col(k)) for k, v in other.items()})
    found = quality.agreement(c.where("trade_count % 10 <> 0"), official)
    return found.withColumn("difference", r("difference", 9))


@query(f"""WITH {C}, day AS (SELECT CAST(open_time AS DATE) AS day, last(close ORDER BY open_time) AS ours FROM candles GROUP BY ALL),
x AS (SELECT day, ours, ours * CASE WHEN day(day) % 3 = 0 THEN 1.02 ELSE 1.001 END AS reference FROM day WHERE day(day) % 5 <> 0)
SELECT day, {q("ours")} AS ours, {q("reference")} AS reference, {q("abs(ours - reference) / reference", 9)} AS difference, abs(ours - reference) / reference <= 0.01 AS passed FROM x""")
def price_cross_check(s, d):
    ours = bars.daily_close(_candles(s, d))
    factor = F.when(F.dayofmonth("day") % 3 == 0, 1.02).otherwise(1.001)
    reference = ours.where(F.dayofmonth("day") % 5 != 0).select("day", (F.col("close") * factor).alias("close"))
    x = quality.price_cross_check(ours, reference)
    return x.select("day", r("ours").alias("ours"), r("reference").alias("reference"), r("difference", 9).alias("difference"), "passed")


@query(f"""WITH {C}, target AS (SELECT open_time FROM candles WHERE trade_count % 2 = 0),
batch AS (SELECT open_time, close, 'rest' AS source FROM candles UNION ALL SELECT open_time, close + 1, 'archive' FROM candles WHERE trade_count % 3 = 0),
one AS (SELECT open_time, arg_min(close, source) AS close, min(source) AS source FROM batch GROUP BY open_time)
SELECT open_time, round(close, 6) AS close, source FROM one ANTI JOIN target USING (open_time)""")
def idempotent_merge(s, d):
    c = _candles(s, d)
    batch = c.withColumn("source", F.lit("rest")).unionByName(c.where("trade_count % 3 = 0").withColumns({"close": F.col("close") + 1, "source": F.lit("archive")}))
    fresh = merge.new_rows(batch, c.where("trade_count % 2 = 0"), merge.CANDLE_KEY, F.col("source"))
    return fresh.select(ntz("open_time"), r("close").alias("close"), "source")


@query("""WITH x AS (SELECT event_id, event_id % 3 AS file, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000000 WHEN 1 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) END AS epoch FROM events)
SELECT event_id, make_timestamp(CASE file WHEN 0 THEN epoch * 1000000 WHEN 1 THEN epoch * 1000 ELSE epoch END) AS moment FROM x""")
def epoch_to_utc(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    x = e.select("event_id", (F.col("event_id") % 3).alias("file"), us.alias("us"))
    x = x.withColumn("epoch", F.when(F.col("file") == 0, F.expr("us div 1000000")).when(F.col("file") == 1, F.expr("us div 1000")).otherwise(F.col("us")))
    return epoch_to_timestamp(x, "epoch", "moment", by=("file",)).select("event_id", ntz("moment"))


@query(f"""WITH {T} SELECT CASE WHEN buyer_is_maker THEN 'sell' ELSE 'buy' END AS side, count(*) AS trades, {q("sum(quantity)")} AS quantity FROM trades GROUP BY ALL""")
def taker_sides(s, d):
    return _trades(s, d).groupBy(research.taker_side().alias("side")).agg(F.count("*").alias("trades"), r(F.sum("quantity")).alias("quantity"))


@query(f"""WITH {D} SELECT captured_at, {q("best_ask_price - best_bid_price")} AS spread, {q("(best_ask_price + best_bid_price) / 2")} AS mid FROM depth""")
def depth_mid_spread(s, d):
    return _depth(s, d).select(ntz("captured_at"), r(research.spread()).alias("spread"), r(research.mid()).alias("mid"))


# --- indicators and features -------------------------------------------------


def _feature(s, d, **columns: Column) -> DataFrame:
    c = _candles(s, d)
    return c.withColumns(columns).select(ntz("open_time"), *[r(n).alias(n) for n in columns])


def _rolling_sql(n: int, value: str, counted: str, frame: str) -> str:
    return f"CASE WHEN count({counted}) OVER (ORDER BY open_time {frame}) = {n} THEN {value} OVER (ORDER BY open_time {frame}) END"


_LAST3, _PRIOR20 = "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING"


@query(f"WITH {C} SELECT open_time, {q(_rolling_sql(3, 'avg(close)', 'close', _LAST3))} AS sma_3 FROM candles")
def sma_3(s, d):
    return _feature(s, d, sma_3=sma(F.col("close"), 3, ordered()))


def _recursive_sql(start: str, alpha: str, value: str, first: str) -> str:
    return f"""n AS (SELECT *, row_number() OVER (ORDER BY open_time) - 1 AS i FROM x),
f AS (SELECT i, {first} AS y FROM n WHERE i = {start} UNION ALL SELECT n.i, (1 - {alpha}) * f.y + {alpha} * n.{value} FROM f JOIN n ON n.i = f.i + 1)"""


@query(f"""WITH RECURSIVE {C}, x AS (SELECT open_time, close AS v FROM candles), {_recursive_sql("11", "(2.0::DOUBLE / 13)", "v", "(SELECT avg(v) FROM n WHERE i < 12)")}
SELECT n.open_time, {q("f.y")} AS ema_12 FROM n LEFT JOIN f USING (i)""")
def ema_12(s, d):
    x = with_recursive(_candles(s, d), [Recursive("ema_12", "ema", "close", 12)])
    return x.select(ntz("open_time"), r("ema_12").alias("ema_12"))


@query(f"""WITH RECURSIVE {C}, x AS (SELECT open_time, greatest(close - lag(close) OVER w, 0) AS u, greatest(lag(close) OVER w - close, 0) AS v FROM candles {W}),
n AS (SELECT *, row_number() OVER (ORDER BY open_time) - 1 AS i FROM x),
f AS (SELECT CAST(14 AS BIGINT) AS i, (SELECT avg(u) FROM n WHERE i BETWEEN 1 AND 14) AS g, (SELECT avg(v) FROM n WHERE i BETWEEN 1 AND 14) AS l
  UNION ALL SELECT n.i, g * 13.0::DOUBLE / 14 + n.u / 14, l * 13.0::DOUBLE / 14 + n.v / 14 FROM f JOIN n ON n.i = f.i + 1)
SELECT n.open_time, {q("CASE WHEN g + l = 0 THEN 50 ELSE 100 * g / (g + l) END")} AS rsi_14 FROM n LEFT JOIN f USING (i)""")
def wilder_rsi(s, d):
    w = ordered()
    up, down = gains(F.col("close"), w)
    x = with_recursive(_candles(s, d).withColumns({"up": up, "down": down}), [Recursive("g", "wilder", "up", 14), Recursive("l", "wilder", "down", 14)])
    return x.select(ntz("open_time"), r(rsi(F.col("g"), F.col("l"))).alias("rsi_14"))


@query(ORACLES["ema_12"])
def ema_12_in_chunks(s, d):
    """As a scan over chunks of three days."""
    x = with_recursive(_candles(s, d), [Recursive("ema_12", "ema", "close", 12)], chunk_days=3)
    return x.select(ntz("open_time"), r("ema_12").alias("ema_12"))


@query(ORACLES["wilder_rsi"])
def wilder_rsi_in_chunks(s, d):
    up, down = gains(F.col("close"), ordered())
    x = with_recursive(_candles(s, d).withColumns({"up": up, "down": down}), [Recursive("g", "wilder", "up", 14), Recursive("l", "wilder", "down", 14)], chunk_days=2)
    return x.select(ntz("open_time"), r(rsi(F.col("g"), F.col("l"))).alias("rsi_14"))


_TR = "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"


@query(f"""WITH RECURSIVE {C}, x AS (SELECT open_time, CASE WHEN lag(close) OVER w IS NOT NULL THEN {_TR} END AS v FROM candles {W}),
{_recursive_sql("14", "(1.0::DOUBLE / 14)", "v", "(SELECT avg(v) FROM n WHERE i BETWEEN 1 AND 14)")}
SELECT n.open_time, {q("f.y")} AS atr_14 FROM n LEFT JOIN f USING (i)""")
def atr_14(s, d):
    x = _candles(s, d).withColumn("range", true_range(F.col("high"), F.col("low"), F.col("close"), ordered()))
    return with_recursive(x, [Recursive("atr_14", "wilder", "range", 14)]).select(ntz("open_time"), r("atr_14").alias("atr_14"))


_TP = "((high + low + close) / 3)"
_SESSION = "(PARTITION BY CAST(open_time AS DATE) ORDER BY open_time ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {C} SELECT open_time, {q(f'sum({_TP} * volume) OVER {_SESSION} / sum(volume) OVER {_SESSION}')} AS vwap_session FROM candles")
def vwap_session(s, d):
    return _feature(s, d, vwap_session=fn.vwap(fn.session_frame()))


_LAST20 = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"


@query(f"""WITH {C} SELECT open_time, {q(f"CASE WHEN count(*) OVER (ORDER BY open_time {_LAST20}) = 20 THEN sum({_TP} * volume) OVER (ORDER BY open_time {_LAST20}) / sum(volume) OVER (ORDER BY open_time {_LAST20}) END")} AS vwap_rolling_20 FROM candles""")
def vwap_rolling(s, d):
    return _feature(s, d, vwap_rolling_20=fn.vwap(last_rows(ordered(), 20), PriceSource.TYPICAL, 20))


@query(f"""WITH {C}, p AS (SELECT open_time, volume AS v, {_TP} AS tp, {_TP} - (SELECT avg({_TP}) FROM candles) AS c FROM candles),
m AS (SELECT open_time, tp, sum(tp * v) OVER {_SESSION} / sum(v) OVER {_SESSION} AS vwap, sum(c * v) OVER {_SESSION} / sum(v) OVER {_SESSION} AS m1, sum(c * c * v) OVER {_SESSION} / sum(v) OVER {_SESSION} AS m2 FROM p),
s AS (SELECT *, sqrt(greatest(m2 - m1 * m1, 0)) AS sd FROM m)
SELECT open_time, {q("CASE WHEN sd > 1e-6 THEN (tp - vwap) / sd END", 4)} AS vwap_session_deviation, {q("vwap + 2 * sd", 4)} AS band_upper_2 FROM s""")
def vwap_deviation(s, d):
    f = fn.session_frame()
    x = _candles(s, d).withColumn("centred", fn.centred(PriceSource.TYPICAL))
    x = x.withColumns({"spread": fn.vwap_spread(f, F.col("centred")), "vwap": fn.vwap(f)})
    deviation = F.when(F.col("spread") > 1e-6, (fn.price(PriceSource.TYPICAL) - F.col("vwap")) / F.col("spread"))
    band = fn.vwap_bands(F.col("vwap"), F.col("spread"))["band_upper_2"]
    return x.select(ntz("open_time"), r(deviation, 4).alias("vwap_session_deviation"), r(band, 4).alias("band_upper_2"))


def _z_sql(x: str, over: str, need: str) -> str:
    return f"CASE WHEN {need} AND stddev_samp({x}) OVER {over} > 0 THEN ({x} - avg({x}) OVER {over}) / stddev_samp({x}) OVER {over} END"


_P20 = f"(ORDER BY open_time {_PRIOR20})"


@query(f"""WITH {C}, x AS (SELECT open_time, CAST(trade_count AS DOUBLE) AS n, abs(ln(close / lag(close) OVER w)) AS a FROM candles {W})
SELECT open_time, {q(_z_sql("n", _P20, f"count(n) OVER {_P20} = 20"))} AS activity_trade_count, {q(_z_sql("a", _P20, f"count(a) OVER {_P20} = 20"))} AS activity_absolute_return FROM x""")
def activity_rolling(s, d):
    w = ordered()
    x = _candles(s, d).withColumns({"n": fn.activity(ActivityMeasure.TRADE_COUNT, w), "a": fn.activity(ActivityMeasure.ABSOLUTE_RETURN, w)})
    return x.select(ntz("open_time"), r(fn.z_rolling(F.col("n"), 20, w)).alias("activity_trade_count"), r(fn.z_rolling(F.col("a"), 20, w)).alias("activity_absolute_return"))


_HOURS = "(PARTITION BY hour(open_time) ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {C} SELECT open_time, {q(_z_sql('CAST(trade_count AS DOUBLE)', _HOURS, f'count(*) OVER {_HOURS} > 1'))} AS activity_hour FROM candles")
def activity_hour_of_day(s, d):
    return _feature(s, d, activity_hour=fn.z_hour_of_day(F.col("trade_count").cast("double")))


_PRIOR_HIGH, _PRIOR_LOW = _rolling_sql(20, "max(high)", "high", _PRIOR20), _rolling_sql(20, "min(low)", "low", _PRIOR20)


@query(f"WITH {C} SELECT open_time, {q(_PRIOR_HIGH)} AS prior_high_20, {q(_PRIOR_LOW)} AS prior_low_20 FROM candles")
def prior_extreme(s, d):
    w = ordered()
    return _feature(s, d, prior_high_20=fn.prior_extreme(ExtremeSide.HIGH, 20, w), prior_low_20=fn.prior_extreme(ExtremeSide.LOW, 20, w))


_LEVELS = f"lv AS (SELECT *, {_PRIOR_HIGH} AS hi, {_PRIOR_LOW} AS lo FROM candles)"


@query(f"""WITH {C}, {_LEVELS} SELECT open_time, CAST(coalesce(high > hi, false) AS DOUBLE) AS breakout_high_20, CAST(coalesce(low < lo, false) AS DOUBLE) AS breakout_low_20, {q("CASE WHEN hi IS NOT NULL THEN greatest(high - hi, 0) END")} AS excess FROM lv""")
def breakout(s, d):
    w = ordered()
    x = _candles(s, d).withColumns({"hi": fn.prior_extreme(ExtremeSide.HIGH, 20, w), "lo": fn.prior_extreme(ExtremeSide.LOW, 20, w)})
    return x.select(ntz("open_time"), fn.broken(ExtremeSide.HIGH, F.col("hi")).cast("double").alias("breakout_high_20"), fn.broken(ExtremeSide.LOW, F.col("lo")).cast("double").alias("breakout_low_20"), r(fn.excess(ExtremeSide.HIGH, F.col("hi"))).alias("excess"))


@query(f"""WITH {C}, f AS (SELECT open_time, {_rolling_sql(8, "avg(close)", "close", "ROWS BETWEEN 7 PRECEDING AND CURRENT ROW")} AS a, {_PRIOR_HIGH} AS b, close FROM candles)
SELECT open_time, {q("a")} AS sma_8, {q("b")} AS prior_high_20 FROM f WHERE open_time >= (SELECT min(open_time) FROM f WHERE a IS NOT NULL AND b IS NOT NULL)""")
def feature_table_trimmed(s, d):
    w = ordered()
    x = _candles(s, d).withColumns({"sma_8": sma(F.col("close"), 8, w), "prior_high_20": fn.prior_extreme(ExtremeSide.HIGH, 20, w)})
    return trimmed(x, ["sma_8", "prior_high_20"]).select(ntz("open_time"), r("sma_8").alias("sma_8"), r("prior_high_20").alias("prior_high_20"))


@query(f"""WITH {C}, x AS (SELECT CAST(isodow(open_time) - 1 AS INTEGER) AS weekday, CAST(hour(open_time) AS INTEGER) AS hour, CAST(trade_count AS DOUBLE) AS n FROM candles)
SELECT weekday, hour, {q("avg(n) / (SELECT avg(n) FROM x)")} AS relative FROM x GROUP BY weekday, hour""")
def activity_heatmap(s, d):
    return research.activity_heatmap(_candles(s, d)).select("weekday", "hour", r("relative").alias("relative"))


@query(f"""WITH {C}, x AS (SELECT open_time, close, sign(close - lag(close) OVER w) AS g, close / lag(close, 6) OVER w - 1 AS drop6 FROM candles {W}), y AS (SELECT *, lag(g) OVER (ORDER BY open_time) AS pg FROM x)
SELECT count(*) FILTER (g <> pg) AS flips, arg_min(open_time, drop6) AS steepest FROM y""")
def direction_flips(s, d):
    return research.turning_points(_candles(s, d)).select("flips", ntz("steepest"))


@query(f"""WITH {C}, x AS (SELECT open_time, close, row_number() OVER w AS n, close / lag(close, 6) OVER w - 1 AS fall FROM candles {W}), p AS (SELECT arg_min(n, fall) AS lowest FROM x)
SELECT open_time, {q("close")} AS close, CAST(n - lowest AS INTEGER) AS "offset" FROM x, p WHERE abs(n - lowest) <= 120""")
def steepest_drop(s, d):
    c = _candles(s, d)
    return research.around(c, research.turning_points(c)).select(ntz("open_time"), r("close").alias("close"), "offset")


@query(f"""WITH {C}, x AS (SELECT open_time, close > {_rolling_sql(8, "avg(close)", "close", "ROWS BETWEEN 7 PRECEDING AND CURRENT ROW")} AS up, row_number() OVER (ORDER BY open_time) AS n FROM candles),
y AS (SELECT n - coalesce(max(CASE WHEN up THEN NULL ELSE n END) OVER (ORDER BY n), 0) AS run FROM x) SELECT CAST(max(run) AS BIGINT) AS longest FROM (SELECT run FROM y)""")
def longest_run(s, d):
    w = ordered()
    x = _candles(s, d).withColumn("up", F.col("close") > sma(F.col("close"), 8, w))
    return x.withColumn("run", runs(F.col("up"), w)).agg(F.max("run").cast("long").alias("longest"))


# --- depth and profiles ------------------------------------------------------


@query(f"""WITH {D}, x AS (SELECT date_trunc('hour', captured_at) AS open_time, captured_at, CASE WHEN bid_quantity_5 + ask_quantity_5 > 0 THEN (bid_quantity_5 - ask_quantity_5) / (bid_quantity_5 + ask_quantity_5) END AS x FROM depth)
SELECT open_time, {q("avg(x)")} AS obi_5_mean, {q("arg_max(x, captured_at)")} AS obi_5_last FROM x GROUP BY open_time""")
def obi_mean_last(s, d):
    depth, c = _depth(s, d), _candles(s, d)
    mean = fn.imbalance_per_bar(depth, 5, DepthAggregation.MEAN, 3600, "obi_5_mean")
    last = fn.imbalance_per_bar(depth, 5, DepthAggregation.LAST, 3600, "obi_5_last")
    on = ["symbol", "market", "open_time"]
    return c.join(mean, on, "left").join(last, on, "left").select(ntz("open_time"), r("obi_5_mean").alias("obi_5_mean"), r("obi_5_last").alias("obi_5_last"))


@query(f"""WITH {D}, v AS (SELECT transact_time AS t, sum(CASE WHEN buyer_is_maker THEN 0 ELSE quantity END) OVER (ORDER BY transact_time RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS volume FROM trades),
l AS (SELECT captured_at AS t, max(ask_quantity_20) OVER (ORDER BY captured_at RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) - ask_quantity_20 AS loss FROM depth),
j AS (SELECT l.t, l.loss, v.volume FROM l ASOF LEFT JOIN v ON l.t >= v.t)
SELECT date_trunc('hour', t) AS open_time, {q("median(CASE WHEN loss > 0 THEN volume / loss END)")} AS swing FROM j GROUP BY ALL""")
def liquidity_swing(s, d):
    t = _trades(s, d)
    swings = fn.liquidity_swing(t, views.depth(t), ExtremeSide.HIGH, 3600.0)
    return fn.swing_per_bar(swings, 3600, "swing").select(ntz("open_time"), r("swing").alias("swing"))


def _hist_sql(rows: str, n: int) -> str:
    """Buckets from explicit edges; the rows' columns are p and v."""
    return f"""rows AS ({rows}), b AS (SELECT min(p) AS lo, max(p) AS hi, (max(p) - min(p)) / {n} AS step FROM rows),
e AS (SELECT CAST(i AS INTEGER) AS bucket, lo + i * step AS low, CASE WHEN i = {n} - 1 THEN hi ELSE lo + (i + 1) * step END AS high FROM b, range({n}) t(i)),
h AS (SELECT e.bucket, e.low, e.high, (e.low + e.high) / 2 AS centre, coalesce(sum(v), 0) AS volume FROM e LEFT JOIN rows ON p >= e.low AND (p < e.high OR (e.bucket = {n} - 1 AND p <= e.high)) GROUP BY ALL)"""


@query(f"WITH {T}, {_hist_sql('SELECT price AS p, quantity AS v FROM trades', 50)} SELECT bucket, {q('low')} AS low, {q('high')} AS high, {q('volume')} AS volume FROM h")
def volume_profile_trades(s, d):
    h = profile.histogram(_trades(s, d), ["symbol", "market"], 50)
    return h.select("bucket", r("low").alias("low"), r("high").alias("high"), r("volume").alias("volume"))


def _area_sql(rows: str) -> str:
    """One row: point_of_control, area_low, area_high, total of the rows' profile in 50 buckets."""
    above, below = "(SELECT volume FROM h WHERE bucket = hi + 1)", "(SELECT volume FROM h WHERE bucket = lo - 1)"
    return f"""WITH RECURSIVE {_hist_sql(rows, 50)}, t AS (SELECT sum(volume) AS total FROM h), p AS (SELECT bucket AS poc FROM h ORDER BY volume DESC, bucket LIMIT 1),
g AS (SELECT poc AS lo, poc AS hi, (SELECT volume FROM h WHERE bucket = poc) AS held, 0 AS n FROM p
  UNION ALL SELECT CASE WHEN up THEN lo ELSE lo - 1 END, CASE WHEN up THEN hi + 1 ELSE hi END, held + CASE WHEN up THEN a ELSE b END, n + 1
  FROM (SELECT g.*, {above} AS a, {below} AS b, {above} IS NOT NULL AND ({below} IS NULL OR {above} >= {below}) AS up FROM g)
  WHERE held < 0.7::DOUBLE * (SELECT total FROM t) AND (a IS NOT NULL OR b IS NOT NULL)),
f AS (SELECT * FROM g ORDER BY n DESC LIMIT 1)
SELECT (SELECT centre FROM h JOIN p ON bucket = poc) AS point_of_control, (SELECT low FROM h WHERE bucket = f.lo) AS area_low, (SELECT high FROM h WHERE bucket = f.hi) AS area_high, (SELECT total FROM t) AS total FROM f"""


_EXACT_AREA = _area_sql("SELECT price AS p, quantity AS v FROM trades")


@query(f"""WITH {T}, area AS ({_EXACT_AREA}) SELECT 'ALL/USDT' AS symbol, 'spot' AS market, {q("point_of_control")} AS point_of_control, {q("area_low")} AS area_low, {q("area_high")} AS area_high, {q("total")} AS total FROM area""")
def volume_profile_poc_value_area(s, d):
    keys = ["symbol", "market"]
    a = profile.value_area(profile.histogram(_trades(s, d), keys, 50), keys)
    return a.select(*keys, *[r(c).alias(c) for c in ("point_of_control", "area_low", "area_high", "total")])


@query(f"""WITH {C}, a AS ({_EXACT_AREA}), b AS ({_area_sql("SELECT (high + low + close) / 3 AS p, volume AS v FROM candles")})
SELECT 'ALL/USDT' AS symbol, 'spot' AS market, {q("(b.point_of_control - a.point_of_control) / a.point_of_control")} AS poc_difference,
  {q("greatest(least(a.area_high, b.area_high) - greatest(a.area_low, b.area_low), 0) / (a.area_high - a.area_low)")} AS area_overlap FROM a, b""")
def volume_profile_comparison(s, d):
    keys = ["symbol", "market"]
    exact = profile.value_area(profile.histogram(_trades(s, d), keys, 50), keys)
    bars_ = _candles(s, d).withColumn("price", fn.price(PriceSource.TYPICAL))
    x = profile.compare(exact, profile.value_area(profile.histogram(bars_, keys, 50, volume="volume"), keys), keys)
    return x.select(*keys, r("poc_difference").alias("poc_difference"), r("area_overlap").alias("area_overlap"))


@query(f"""WITH {C}, x AS (SELECT open_time, close, {_TP} AS p, volume AS v FROM candles), j AS (SELECT a.open_time, a.close, b.p, b.v FROM x a JOIN x b ON b.open_time >= a.open_time - INTERVAL 2 DAY AND b.open_time < a.open_time),
b AS (SELECT open_time, any_value(close) AS close, min(p) AS lo, max(p) AS hi, (max(p) - min(p)) / 20 AS step FROM j GROUP BY open_time),
k AS (SELECT j.open_time, b.close, b.lo, b.hi, b.step, j.v, CASE WHEN step = 0 THEN 0 ELSE len(list_filter(range(1, 20), lambda i: b.lo + i * b.step <= j.p)) END AS bucket FROM j JOIN b USING (open_time)),
h AS (SELECT open_time, any_value(close) AS close, any_value(lo) AS lo, any_value(hi) AS hi, any_value(step) AS step, bucket, sum(v) AS volume FROM k GROUP BY open_time, bucket),
p AS (SELECT *, row_number() OVER (PARTITION BY open_time ORDER BY volume DESC, bucket) AS n FROM h),
f AS (SELECT open_time, close, CASE WHEN step = 0 THEN lo ELSE ((lo + bucket * step) + CASE WHEN bucket = 19 THEN hi ELSE lo + (bucket + 1) * step END) / 2 END AS poc FROM p WHERE n = 1)
SELECT x.open_time, {q("(f.close - poc) / poc")} AS distance_to_poc_2d FROM x LEFT JOIN f USING (open_time)""")
def distance_to_poc(s, d):
    x = _candles(s, d).withColumn("typical", fn.price(PriceSource.TYPICAL))
    x = with_recursive(x, [PointOfControl("poc", "typical", 2, 20)])
    return x.select(ntz("open_time"), r(F.try_divide(F.col("close") - F.col("poc"), F.col("poc"))).alias("distance_to_poc_2d"))


@query(ORACLES["distance_to_poc"])
def distance_to_poc_in_chunks(s, d):
    x = _candles(s, d).withColumn("typical", fn.price(PriceSource.TYPICAL))
    x = with_recursive(x, [PointOfControl("poc", "typical", 2, 20)], chunk_days=4)
    return x.select(ntz("open_time"), r(F.try_divide(F.col("close") - F.col("poc"), F.col("poc"))).alias("distance_to_poc_2d"))


@query(f"""WITH {D}, x AS (SELECT captured_at, (best_ask_price - best_bid_price) / 2 / ((best_ask_price + best_bid_price) / 2) AS rate, greatest(bid_quantity_5, 0) * (best_ask_price + best_bid_price) / 2 AS notional FROM depth)
SELECT count(rate) AS samples, {q("(epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 3600000000.0::DOUBLE")} AS covered_hours, {q("avg(rate)", 9)} AS mean_rate, {q("median(rate)", 9)} AS median_rate,
  {q("quantile_cont(rate, 0.95)", 9)} AS p95_rate, {q("median(notional)")} AS median_notional FROM x""")
def slippage_estimate(s, d):
    x = research.slippage(_depth(s, d))
    return x.select("samples", r("covered_hours").alias("covered_hours"), *[r(c, 9).alias(c) for c in ("mean_rate", "median_rate", "p95_rate")], r("median_notional").alias("median_notional"))


# --- research ----------------------------------------------------------------


def _pairs(s, d, per_venue: bool = False) -> DataFrame:
    w = ordered()
    x = _candles(s, d, per_venue)
    feature = F.try_divide(F.col("taker_buy_base_volume"), F.col("volume"))
    return x.select(*KEYS, "open_time", r(feature).alias("feature"), research.forward_return(F.col("close"), 3, w, "open_time", 4 * 3600).alias("forward"))


_PAIRS = f"""{C}, pr AS (SELECT open_time, round(taker_buy_base_volume / volume, 6) AS x, CASE WHEN lead(open_time, 3) OVER w - open_time <= INTERVAL 4 HOUR THEN lead(close, 3) OVER w / close - 1 END AS y FROM candles {W}),
k AS (SELECT * FROM pr WHERE x IS NOT NULL AND y IS NOT NULL)"""


@query(f"""WITH {_PAIRS}, rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM k),
c AS (SELECT count(*) AS samples, corr(rx, ry) AS ic FROM rk) SELECT samples, {q("ic", 9)} AS coefficient, {q("ic * sqrt(samples - 2) / sqrt(1 - ic * ic)")} AS t_statistic FROM c""")
def forward_returns_ic(s, d):
    x = research.information_coefficient(_pairs(s, d), KEYS)
    return x.select("samples", r("coefficient", 9).alias("coefficient"), r("t_statistic").alias("t_statistic"))


@query(f"""WITH {_PAIRS}, e AS (SELECT list_distinct(quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM k), m AS (SELECT list_min(edges) AS lo, edges FROM e)
SELECT CAST(len(list_filter(edges, lambda v: v < x AND v > lo)) AS INTEGER) AS bucket, count(*) AS samples, {q("avg(y)", 9)} AS mean_forward FROM k, m GROUP BY 1""")
def ic_quantile_buckets(s, d):
    x = research.quantile_buckets(_pairs(s, d), KEYS, 5)
    return x.select("bucket", "samples", r("mean_forward", 9).alias("mean_forward"))


def _labelled(s, d) -> DataFrame:
    w = ordered()
    x = _candles(s, d).withColumn("level", fn.prior_extreme(ExtremeSide.HIGH, 20, w))
    x = x.withColumns({"event": fn.broken(ExtremeSide.HIGH, F.col("level")), "over": fn.excess(ExtremeSide.HIGH, F.col("level")), "n": F.col("trade_count").cast("double")})
    x = x.withColumn("trade_count_z", fn.z_rolling(F.col("n"), 20, w))
    return research.breakout_labels(x, ExtremeSide.HIGH, "level", "event", 10)


_AHEAD = "ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING"
_LABELS = f"""{C}, {_LEVELS}, z AS (SELECT open_time, {_z_sql("CAST(trade_count AS DOUBLE)", _P20, f"count(*) OVER {_P20} = 20")} AS tz FROM candles),
ah AS (SELECT *, {_rolling_sql(10, "max(high)", "high", _AHEAD)} AS fh, {_rolling_sql(10, "min(low)", "low", _AHEAD)} AS fl FROM lv),
lb AS (SELECT open_time, CASE WHEN fl < hi THEN 'failed' ELSE 'held' END AS label, greatest(fh - hi, 0) AS fav, greatest(hi - fl, 0) AS adv, greatest(high - hi, 0) AS over FROM ah WHERE high > hi AND fh IS NOT NULL AND fl IS NOT NULL)"""


@query(f"WITH {_LABELS} SELECT open_time, label, {q('fav')} AS favourable_excursion, {q('adv')} AS adverse_excursion FROM lb")
def breakout_labels(s, d):
    return _labelled(s, d).select(ntz("open_time"), "label", r("favourable_excursion").alias("favourable_excursion"), r("adverse_excursion").alias("adverse_excursion"))


def _obs(name: str, c: str) -> str:
    return f"""SELECT '{name}' AS observable, count(*) AS events, count(*) FILTER (label = 'held') AS held, {q(f"median({c}) FILTER (label = 'held')")} AS held_median, {q(f"median({c}) FILTER (label = 'failed')")} AS failed_median FROM lz"""


@query(f"WITH {_LABELS}, lz AS (SELECT * FROM lb LEFT JOIN z USING (open_time)) " + " UNION ALL ".join(_obs(*x) for x in (("favourable_excursion", "fav"), ("adverse_excursion", "adv"), ("over", "over"), ("trade_count_z", "tz"))))
def breakout_statistics(s, d):
    x = research.breakout_statistics(_labelled(s, d), ["over", "trade_count_z"])
    return x.select("observable", "events", "held", r("held_median").alias("held_median"), r("failed_median").alias("failed_median"))


@query(f"""WITH {T}, v AS (SELECT venue AS symbol, date_trunc('hour', transact_time) AS open_time, last(price ORDER BY transact_time, trade_id) AS close FROM trades GROUP BY 1, 2),
x AS (SELECT symbol, hour(open_time) AS h, close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS r FROM v), b AS (SELECT symbol, count(*) AS observations FROM v GROUP BY symbol),
t AS (SELECT symbol, h, CASE WHEN count(r) > 1 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(8760.0::DOUBLE) END AS s FROM x GROUP BY symbol, h),
m AS (SELECT symbol, count(s) AS trials, max(s) AS best FROM t GROUP BY symbol)
SELECT symbol, trials, observations, {q("best", 4)} AS best, {q("CASE WHEN trials <= 1 THEN 0 ELSE sqrt(2 * ln(trials)) * sqrt(8760.0::DOUBLE / observations) END")} AS expected_maximum_sharpe FROM m JOIN b USING (symbol)""")
def trial_deflation(s, d):
    """Each hour of the day as a trial: the best one's ratio against what so many worthless ones would show by luck."""
    c = _candles(s, d, per_venue=True)
    x = c.select("symbol", F.hour("open_time").alias("h"), (F.try_divide(F.col("close"), F.lag("close").over(ordered())) - 1).alias("r"))
    trials = x.groupBy("symbol", "h").agg(bt.sharpe(F.col("r"), 8760.0).alias("s")).groupBy("symbol").agg(F.count("s").alias("trials"), F.max("s").alias("best"))
    y = trials.join(c.groupBy("symbol").agg(F.count("*").alias("observations")), "symbol")
    return y.select("symbol", "trials", "observations", r("best", 4).alias("best"), r(research.expected_maximum_sharpe_column(F.col("trials"), F.col("observations"), 8760.0)).alias("expected_maximum_sharpe"))


@query(f"""WITH {C}, x AS (SELECT ln(close / lag(close) OVER w) AS r FROM candles {W}) SELECT (SELECT count(*) FROM candles) AS bars, {q("(SELECT first(close ORDER BY open_time) FROM candles)")} AS first_close,
  {q("(SELECT last(close ORDER BY open_time) FROM candles)")} AS last_close, {q("sum(r * r)")} AS squares, {q("max(r)")} AS largest FROM x""")
def return_shuffle_invariants(s, d):
    x = research.shuffle_returns(_candles(s, d), 7)
    x = x.withColumn("r", F.ln(F.col("close") / F.lag("close").over(ordered())))
    return x.groupBy(*KEYS).agg(F.count("*").alias("bars"), r(F.min_by("close", "open_time")).alias("first_close"), r(F.max_by("close", "open_time")).alias("last_close"), r(F.sum(F.col("r") * F.col("r"))).alias("squares"), r(F.max("r")).alias("largest")).drop(*KEYS)


# --- conditions, positions, backtests ----------------------------------------


def _averages(s, d, per_venue: bool = False) -> DataFrame:
    w = ordered()
    return _candles(s, d, per_venue).withColumns({"sma_3": sma(F.col("close"), 3, w), "sma_8": sma(F.col("close"), 8, w), "burst": F.when(F.col("trade_count") % 4 == 0, 1.0).otherwise(0.0)})


_MA = f"""{C}, ma AS (SELECT *, {_rolling_sql(3, "avg(close)", "close", _LAST3)} AS sma_3, {_rolling_sql(8, "avg(close)", "close", "ROWS BETWEEN 7 PRECEDING AND CURRENT ROW")} AS sma_8 FROM candles)"""
_X = f"""{_MA}, rd AS (SELECT *, coalesce(sma_3 > sma_8, false) AS above, (sma_3 IS NOT NULL AND sma_8 IS NOT NULL) AS ready, row_number() OVER (ORDER BY open_time) - 1 AS i FROM ma),
xo AS (SELECT *, above AND NOT lag(above, 1, false) OVER w AND lag(ready, 1, false) OVER w AS golden, NOT above AND lag(above, 1, false) OVER w AND ready AS death FROM rd {W})"""


def _conditions(s, d, **nodes) -> DataFrame:
    x = _averages(s, d)
    return x.withColumns({n: c.evaluate(x) for n, c in nodes.items()}).select(ntz("open_time"), *nodes)


_ABOVE_8 = Compare("close", Comparison.ABOVE, "sma_8")


@query(f"""WITH {_MA} SELECT open_time, coalesce(sma_8 > 105, false) AS threshold, coalesce(close > sma_8, false) AS compare, coalesce(close BETWEEN 100 AND 105, false) AS inside, trade_count % 4 = 0 AS event, true AS always, false AS never FROM ma""")
def cond_threshold_compare_range_event(s, d):
    return _conditions(s, d, threshold=Threshold("sma_8", Comparison.ABOVE, 105), compare=_ABOVE_8, inside=Range("close", 100, 105), event=Event("burst"), always=Constant(True), never=Constant(False))


@query(f"""WITH {_MA}, b AS (SELECT open_time, coalesce(close > sma_8, false) AS a, trade_count % 4 = 0 AS e, coalesce(sma_8 > 105, false) AS t FROM ma)
SELECT open_time, a AND e AS both_, a OR e AS either_, NOT t AS not_, coalesce(sum(a::INT) OVER (ORDER BY open_time {_LAST3}) = 3, false) AS sustained FROM b""")
def cond_all_any_not_sustained(s, d):
    return _conditions(s, d, both_=_ABOVE_8 & Event("burst"), either_=AnyOf.of(_ABOVE_8, Event("burst")), not_=Not(Threshold("sma_8", Comparison.ABOVE, 105)), sustained=Sustained(_ABOVE_8, 3))


@query(f"WITH {_X} SELECT open_time, golden, death FROM xo")
def cond_crossover(s, d):
    return _conditions(s, d, golden=Crossover("sma_3", CrossDirection.UP, "sma_8"), death=Crossover("sma_3", CrossDirection.DOWN, "sma_8"))


def _positions(s, d, holding: HoldingRules = HoldingRules(), per_venue: bool = False, chunk_days: int | None = None) -> DataFrame:
    x = _averages(s, d, per_venue)
    golden, death = crosses(F.col("sma_3"), F.col("sma_8"), ordered())
    return bt.with_positions(x.withColumns({"entry": golden, "exit": death}), weight=1.0, warmup=1, holding=holding, chunk_days=chunk_days)


_POS = f"""{_X}, dl AS (SELECT *, lag(golden, 1, false) OVER w AND i >= 2 AS en, lag(death, 1, false) OVER w AS ex FROM xo {W}),
ps AS (SELECT *, CAST(coalesce(last_value(CASE WHEN en OR ex THEN en END IGNORE NULLS) OVER w, false) AS DOUBLE) AS position FROM dl {W})"""


@query(f"WITH {_POS} SELECT open_time, position FROM ps")
def positions_no_time_rules(s, d):
    return _positions(s, d).select(ntz("open_time"), "position")


@query(f"""WITH RECURSIVE {_X}, dl AS (SELECT open_time, i, lag(golden, 1, false) OVER w AS en, lag(death, 1, false) OVER w AS ex FROM xo {W}),
st AS (SELECT CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS opened, CAST(2 AS BIGINT) AS cursor, false AS held
  UNION ALL SELECT dl.i,
    CASE WHEN held AND NOT (dl.ex AND dl.i > opened) AND dl.i < opened + 6 THEN opened WHEN dl.en AND dl.i >= (CASE WHEN held THEN dl.i + 3 ELSE cursor END) THEN dl.i ELSE opened END,
    CASE WHEN held AND (dl.ex OR dl.i >= opened + 6) THEN dl.i + 3 ELSE cursor END,
    CASE WHEN held AND NOT (dl.ex AND dl.i > opened) AND dl.i < opened + 6 THEN true WHEN held THEN false ELSE dl.en AND dl.i >= cursor END
  FROM st JOIN dl ON dl.i = st.i + 1)
SELECT dl.open_time, CAST(st.held AS DOUBLE) AS position FROM dl JOIN st USING (i)""")
def positions_with_time_rules(s, d):
    return _positions(s, d, HoldingRules(6, 3)).select(ntz("open_time"), "position")


@query(ORACLES["positions_with_time_rules"])
def positions_in_chunks(s, d):
    """The same rules, each chunk of a day as a map between states."""
    return _positions(s, d, HoldingRules(6, 3), chunk_days=1).select(ntz("open_time"), "position")


COSTS = CostModel()


def _curve(s, d, per_venue: bool = False) -> DataFrame:
    return bt.equity_curve(_positions(s, d, per_venue=per_venue), COSTS)


_CURVE = f"""{_POS}, gr AS (SELECT *, position * coalesce(close / lag(close) OVER w - 1, 0) AS gross, abs(position - lag(position, 1, 0) OVER w) AS turnover FROM ps {W}),
cv AS (SELECT *, (1 - turnover * 0.0015::DOUBLE) * (1 + gross) - 1 AS ret FROM gr),
eq AS (SELECT *, 10000 * product(1 + ret) OVER w AS equity, 10000 * product(1 + gross) OVER w AS gross_equity FROM cv {W})"""


@query(f"WITH {_CURVE} SELECT open_time, {q('ret', 9)} AS returns, {q('turnover')} AS turnover, {q('equity', 4)} AS equity, {q('gross_equity', 4)} AS gross_equity FROM eq")
def backtest_equity(s, d):
    return _curve(s, d).select(ntz("open_time"), r("returns", 9).alias("returns"), r("turnover").alias("turnover"), r("equity", 4).alias("equity"), r("gross_equity", 4).alias("gross_equity"))


_TRADES = f"""{_CURVE}, nb AS (SELECT *, lag(close) OVER w AS before, lead(open_time) OVER w AS nxt, position <> 0 AND lag(position, 1, 0) OVER w = 0 AS starts FROM eq {W}),
tn AS (SELECT *, sum(starts::INT) OVER w AS trade FROM nb {W}),
tr AS (SELECT trade, min(open_time) AS opened_at, last(coalesce(nxt, open_time) ORDER BY i) AS closed_at, count(*) AS bars_held, first(before ORDER BY i) AS entry_price, last(close ORDER BY i) AS exit_price FROM tn WHERE position <> 0 GROUP BY trade)"""


@query(f"WITH {_TRADES} SELECT opened_at, closed_at, bars_held, {q('entry_price')} AS entry_price, {q('exit_price')} AS exit_price, {q('exit_price / entry_price - 1', 9)} AS gross_return, {q('exit_price / entry_price - 1 - 0.003', 9)} AS net_return FROM tr")
def backtest_trades(s, d):
    x = bt.trades(_positions(s, d), COSTS)
    return x.select(ntz("opened_at"), ntz("closed_at"), "bars_held", r("entry_price").alias("entry_price"), r("exit_price").alias("exit_price"), r("gross_return", 9).alias("gross_return"), r("net_return", 9).alias("net_return"))


_PERF = f"""{_TRADES}, pk AS (SELECT *, equity / max(equity) OVER w - 1 AS dd, lag(equity, 1, 10000) OVER w * turnover * 0.0015::DOUBLE AS paid FROM eq {W}),
dr AS (SELECT *, i + 1 - coalesce(max(CASE WHEN dd < 0 THEN NULL ELSE i + 1 END) OVER w, 0) AS run FROM pk {W}), nt AS (SELECT exit_price / entry_price - 1 - 0.003::DOUBLE AS net FROM tr)"""


@query(f"""WITH {_PERF} SELECT count(*) AS bars, {q("last(equity ORDER BY i) / 10000 - 1")} AS total_return, {q("min(dd)")} AS maximum_drawdown, CAST(max(run) AS BIGINT) AS longest_drawdown_bars,
  {q("avg(ret) / stddev_samp(ret) * sqrt(8760)", 4)} AS sharpe, {q("avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(8760)", 4)} AS sortino, {q("sum(turnover)")} AS turnover, {q("sum(paid)", 4)} AS cost_paid,
  (SELECT count(*) FROM nt) AS trades, {q("(SELECT avg((net > 0)::DOUBLE) FROM nt)")} AS win_rate, {q("(SELECT avg(net) FILTER (net > 0) / abs(avg(net) FILTER (net < 0)) FROM nt)")} AS payoff_ratio, {q("avg((position <> 0)::DOUBLE)")} AS exposure FROM dr""")
def performance_summary(s, d):
    curve = _curve(s, d)
    x = bt.performance(curve, bt.trades(curve, COSTS), 8760.0)
    return x.select("bars", r("total_return").alias("total_return"), r("maximum_drawdown").alias("maximum_drawdown"), F.col("longest_drawdown_bars").cast("long").alias("longest_drawdown_bars"), r("sharpe", 4).alias("sharpe"), r("sortino", 4).alias("sortino"), r("turnover").alias("turnover"), r("cost_paid", 4).alias("cost_paid"), "trades", r("win_rate").alias("win_rate"), r("payoff_ratio").alias("payoff_ratio"), r("exposure").alias("exposure"))


@query(f"WITH {_PERF} SELECT open_time, {q('dd')} AS drawdown, CAST(run AS BIGINT) AS drawdown_bars FROM dr")
def longest_drawdown(s, d):
    x = bt.with_drawdown(_curve(s, d))
    return x.select(ntz("open_time"), r("drawdown").alias("drawdown"), F.col("drawdown_bars").cast("long").alias("drawdown_bars"))


@query(f"""WITH {_CURVE}, m AS (SELECT CAST(date_trunc('month', open_time) AS DATE) AS month, last(equity ORDER BY open_time) AS l, first(equity ORDER BY open_time) AS f FROM eq GROUP BY 1)
SELECT month, {q("l / coalesce(lag(l) OVER (ORDER BY month), f) - 1")} AS monthly_return FROM m""")
def monthly_returns(s, d):
    return bt.monthly_returns(_curve(s, d)).select("month", r("monthly_return").alias("monthly_return"))


@query(f"""WITH {_POS}, gr AS (SELECT *, position * coalesce(close / lag(close) OVER w - 1, 0) AS gross, abs(position - lag(position, 1, 0) OVER w) AS turnover FROM ps {W}), fees(fee) AS (VALUES (0.0::DOUBLE), (0.0005), (0.001), (0.002)),
cv AS (SELECT fee, open_time, turnover * (fee + 0.0005) AS cost, (1 - turnover * (fee + 0.0005)) * (1 + gross) AS growth FROM gr, fees),
eq AS (SELECT *, 10000 * product(growth) OVER (PARTITION BY fee ORDER BY open_time) AS equity FROM cv), pd AS (SELECT *, lag(equity, 1, 10000) OVER (PARTITION BY fee ORDER BY open_time) * cost AS paid FROM eq)
SELECT fee, {q("2 * (fee + 0.0005)")} AS round_trip, {q("last(equity ORDER BY open_time) / 10000 - 1")} AS total_return, {q("sum(paid)", 4)} AS cost_paid FROM pd GROUP BY fee""")
def cost_sensitivity(s, d):
    x = bt.cost_sensitivity(_positions(s, d), [0.0, 0.0005, 0.001, 0.002], 0.0005)
    return x.select("fee", r("round_trip").alias("round_trip"), r("total_return").alias("total_return"), r("cost_paid", 4).alias("cost_paid"))


@query(f"""WITH {_X}, dl AS (SELECT *, lag(golden, 1, false) OVER w AND i >= 2 AS en, lag(death, 1, false) OVER w AS ex FROM xo {W}),
ps AS (SELECT *, CAST(coalesce(last_value(CASE WHEN en OR ex THEN en END IGNORE NULLS) OVER w, false) AS DOUBLE) AS position FROM dl {W}),
sg AS (SELECT *, trade_count % 4 = 0 AS allowed, position <> 0 AND lag(position, 1, 0) OVER w = 0 AS starts FROM ps {W})
SELECT count(*) AS bars, count(*) FILTER (position <> 0) AS held_bars, count(*) FILTER (starts) AS trades, count(*) FILTER (golden) AS entry_signals, count(*) FILTER (golden AND NOT allowed) AS vetoed_entries FROM sg""")
def signal_counts(s, d):
    x = _averages(s, d)
    golden, _ = crosses(F.col("sma_3"), F.col("sma_8"), ordered())
    x = _positions(s, d).withColumns({"entry_signal": F.col("entry"), "allowed": F.col("burst") != 0})
    return bt.signal_counts(x).drop(*KEYS)


@query(f"""WITH {_CURVE}, h AS (SELECT open_time, coalesce(close / lag(close) OVER w - 1, 0) AS hr FROM candles {W}), j AS (SELECT ret, hr FROM eq JOIN h USING (open_time) WHERE ret <> 0 OR hr <> 0)
SELECT 'cross' AS first, 'hold' AS second, count(*) AS bars, {q("corr(ret, hr)")} AS correlation FROM j""")
def strategy_correlation(s, d):
    curve = _curve(s, d)
    hold = F.coalesce(F.col("close") / F.lag("close").over(ordered()) - 1, F.lit(0.0))
    both = curve.select(*KEYS, "open_time", F.lit("cross").alias("strategy"), "returns").unionByName(_candles(s, d).select(*KEYS, "open_time", F.lit("hold").alias("strategy"), hold.alias("returns")))
    return research.strategy_correlation(both, [*KEYS, "open_time"]).withColumn("correlation", r("correlation"))


@query(f"""WITH {C}, x AS (SELECT open_time, row_number() OVER (ORDER BY open_time) AS n, count(*) OVER () AS c FROM candles) SELECT open_time, CASE WHEN n <= floor(c * 0.7::DOUBLE) THEN 'in' ELSE 'out' END AS fold FROM x""")
def walk_forward_split(s, d):
    return walk_forward(_candles(s, d)).select(ntz("open_time"), "fold")


@query(f"""WITH {C}, x AS (SELECT open_time, row_number() OVER (ORDER BY open_time) AS n, count(*) OVER () // 4 AS b FROM candles), y AS (SELECT open_time, n, b, CAST(k AS INTEGER) AS number FROM x, range(1, 4) t(k) WHERE n <= b * (k + 1))
SELECT open_time, number, CASE WHEN n <= floor(b * (number + 1) * 0.7::DOUBLE) THEN 'in' ELSE 'out' END AS fold FROM y""")
def walk_forward_folds(s, d):
    return expanding_folds(_candles(s, d), 3).select(ntz("open_time"), "number", "fold")


# --- several instruments -----------------------------------------------------


def _each(sql: str) -> str:
    """The same SQL with the event type as the symbol, and windows and ranks within it."""
    sql = sql.replace("'ALL/USDT' AS symbol", "event_type AS symbol").replace("(PARTITION BY ", "(PARTITION BY symbol, ")
    return sql.replace("(ORDER BY ", "(PARTITION BY symbol, market ORDER BY ")


_EACH_FEATURES = {
    "sma_3": _rolling_sql(3, "avg(close)", "close", _LAST3), "prior_high_20": _PRIOR_HIGH, "prior_low_20": _PRIOR_LOW,
    # the logarithm, as quotients of short decimals lie exactly between two rounded values
    "log_vwap_session": f"ln(sum({_TP} * volume) OVER {_SESSION} / sum(volume) OVER {_SESSION})", "activity_hour": _z_sql("CAST(trade_count AS DOUBLE)", _HOURS, f"count(*) OVER {_HOURS} > 1"),
    "activity_rolling": _z_sql("CAST(trade_count AS DOUBLE)", _P20, f"count(*) OVER {_P20} = 20"), "forward_3": "lead(close, 3) OVER w / close - 1",
}


@query(_each(f"WITH {C} SELECT symbol, open_time, {', '.join(f'{q(e)} AS {n}' for n, e in _EACH_FEATURES.items())} FROM candles {W}"))
def instruments_features(s, d):
    w, n = ordered(), F.col("trade_count").cast("double")
    x = _candles(s, d, True).withColumns({
        "sma_3": sma(F.col("close"), 3, w), "prior_high_20": fn.prior_extreme(ExtremeSide.HIGH, 20, w), "prior_low_20": fn.prior_extreme(ExtremeSide.LOW, 20, w),
        "log_vwap_session": F.ln(fn.vwap(fn.session_frame())), "activity_hour": fn.z_hour_of_day(n), "activity_rolling": fn.z_rolling(n, 20, w), "forward_3": research.forward_return(F.col("close"), 3, w),
    })
    return x.select("symbol", ntz("open_time"), *[r(c).alias(c) for c in _EACH_FEATURES])


@query(_each(f"""WITH {_PAIRS.replace("SELECT open_time", "SELECT symbol, market, open_time")}, rk AS (SELECT symbol, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM k),
c AS (SELECT symbol, count(*) AS samples, corr(rx, ry) AS ic FROM rk GROUP BY symbol) SELECT symbol, samples, {q("ic", 9)} AS coefficient FROM c"""))
def instruments_ic(s, d):
    return research.information_coefficient(_pairs(s, d, True), KEYS).select("symbol", "samples", r("coefficient", 9).alias("coefficient"))


@query(_each(f"""WITH {D}, x AS (SELECT symbol, (best_ask_price - best_bid_price) / 2 / ((best_ask_price + best_bid_price) / 2) AS rate, greatest(bid_quantity_5, 0) * (best_ask_price + best_bid_price) / 2 AS notional FROM depth)
SELECT symbol, count(rate) AS samples, {q("median(rate)", 9)} AS median_rate, {q("quantile_cont(rate, 0.95)", 9)} AS p95_rate, {q("median(notional)")} AS median_notional FROM x GROUP BY symbol"""))
def instruments_slippage(s, d):
    x = research.slippage(_depth(s, d, True))
    return x.select("symbol", "samples", r("median_rate", 9).alias("median_rate"), r("p95_rate", 9).alias("p95_rate"), r("median_notional").alias("median_notional"))


@query(_each(f"WITH {_CURVE} SELECT symbol, open_time, position, {q('ret', 9)} AS returns, {q('turnover')} AS turnover, {q('equity', 4)} AS equity FROM eq"))
def instruments_equity(s, d):
    return _curve(s, d, True).select("symbol", ntz("open_time"), "position", r("returns", 9).alias("returns"), r("turnover").alias("turnover"), r("equity", 4).alias("equity"))


# --- whole runs --------------------------------------------------------------


@query()
def shipped_strategies_compare(s, d):
    t = _trades(s, d)
    x = compare(MarketView(views.candles(t), t, views.depth(t)), shipped(), HOUR, COSTS)
    return x.select("strategy", "bars", "trades", r("total_return").alias("total_return"), r("maximum_drawdown").alias("maximum_drawdown"), r("sharpe", 4).alias("sharpe"), r("excess_return").alias("excess_return"))


@query()
def shipped_features(s, d):
    t = _trades(s, d)
    plan = FeaturePlan.of(load_features(SHIPPED / "features.yaml"))
    x = plan.table(MarketView(views.candles(t)), HOUR)
    return x.select(ntz("open_time"), *[r(n).alias(n) for n in plan.names])


@query(f"""WITH RECURSIVE {C}, n AS (SELECT open_time, close, row_number() OVER w - 1 AS i, greatest(close - lag(close) OVER w, 0) AS u, greatest(lag(close) OVER w - close, 0) AS d FROM candles {W}),
p(period) AS (VALUES (8), (12), (21), (26), (34), (55)),
e AS (SELECT period, CAST(period - 1 AS BIGINT) AS i, avg(close) AS y FROM p JOIN n ON n.i < period GROUP BY period
  UNION ALL SELECT period, n.i, (1 - 2.0::DOUBLE / (period + 1)) * e.y + 2.0::DOUBLE / (period + 1) * n.close FROM e JOIN n ON n.i = e.i + 1),
f AS (SELECT CAST(14 AS BIGINT) AS i, (SELECT avg(u) FROM n WHERE i BETWEEN 1 AND 14) AS g, (SELECT avg(d) FROM n WHERE i BETWEEN 1 AND 14) AS l
  UNION ALL SELECT n.i, g * 13.0::DOUBLE / 14 + n.u / 14, l * 13.0::DOUBLE / 14 + n.d / 14 FROM f JOIN n ON n.i = f.i + 1),
x AS (SELECT i, close, CASE WHEN g + l = 0 THEN 50 ELSE 100 * g / (g + l) END AS rsi FROM n JOIN f USING (i) WHERE i >= 54),
fo AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY i) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'in' ELSE 'out' END AS fold FROM x),
t AS (SELECT row_number() OVER (ORDER BY a, b, v) - 1 AS trial, 'trend_ema_rsi__period' || a || '_period' || b || '_value' || v AS strategy, a, b, v
  FROM (VALUES (8), (12), (21)) fast(a), (VALUES (21), (26), (34), (55)) slow(b), (VALUES (60), (65), (70), (75)) allowed(v) WHERE a < b),
g AS (SELECT trial, strategy, fold, fo.i, close, rsi > v AS hot, fe.y > se.y AS above FROM t, fo JOIN e fe ON fe.i = fo.i AND fe.period = a JOIN e se ON se.i = fo.i AND se.period = b),
c AS (SELECT *, row_number() OVER k - 1 AS n, above AND NOT lag(above, 1, false) OVER k AND row_number() OVER k > 1 AND NOT hot AS entry, NOT above AND lag(above, 1, false) OVER k AS leave FROM g WINDOW k AS (PARTITION BY trial, fold ORDER BY i)),
dl AS (SELECT *, lag(entry, 1, false) OVER k AND n >= 2 AS en, lag(leave, 1, false) OVER k AS ex FROM c WINDOW k AS (PARTITION BY trial, fold ORDER BY i)),
po AS (SELECT *, CAST(coalesce(last_value(CASE WHEN en OR ex THEN en END IGNORE NULLS) OVER k, false) AS DOUBLE) AS position FROM dl WINDOW k AS (PARTITION BY trial, fold ORDER BY i ROWS UNBOUNDED PRECEDING)),
gr AS (SELECT *, position * coalesce(close / lag(close) OVER k - 1, 0) AS gross, abs(position - lag(position, 1, 0) OVER k) AS turnover, position <> 0 AND lag(position, 1, 0) OVER k = 0 AS starts FROM po WINDOW k AS (PARTITION BY trial, fold ORDER BY i)),
s AS (SELECT trial, strategy, fold, CASE WHEN count(*) > 1 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(8760.0::DOUBLE) END AS sharpe, product(1 + ret) - 1 AS total, CAST(sum(starts::INT) AS BIGINT) AS trades
  FROM (SELECT *, (1 - turnover * 0.0015::DOUBLE) * (1 + gross) - 1 AS ret FROM gr) GROUP BY trial, strategy, fold),
w AS (SELECT trial, strategy, max(trades) FILTER (fold = 'in') AS trades, max(sharpe) FILTER (fold = 'in') AS a, max(total) FILTER (fold = 'in') AS b, max(sharpe) FILTER (fold = 'out') AS c, max(total) FILTER (fold = 'out') AS d FROM s GROUP BY trial, strategy)
SELECT CAST(trial AS INTEGER) AS trial, strategy, trades, {q("a", 4)} AS in_sharpe, {q("b")} AS in_return, {q("c", 4)} AS out_sharpe, {q("d")} AS out_return FROM w""")
def search_trials(s, d):
    space = SearchSpace(shipped()[0], (FeatureAxis(0, "period", (8, 12, 21)), FeatureAxis(1, "period", (21, 26, 34, 55)), ConditionAxis(ConditionTree.FILTERS, "value", (60, 65, 70, 75))), (Increasing(0, 1),))
    x = search(MarketView(_candles(s, d)), space, HOUR, COSTS)
    return x.select("trial", "strategy", "trades", r("in_sharpe", 4).alias("in_sharpe"), r("in_return").alias("in_return"), r("out_sharpe", 4).alias("out_sharpe"), r("out_return").alias("out_return"))


def book_messages(t: DataFrame) -> DataFrame:
    """Updates made from trades, a snapshot every 500 and a lost update every 777.

    Trades count in the order of time and id, repeated ids by price and quantity: all that an update shows.
    """
    total = [F.asc_nulls_last(c) for c in ("transact_time", "trade_id", "price", "quantity")]
    n = F.row_number().over(Window.partitionBy("symbol", "market").orderBy(*total)).cast("long")
    x = t.withColumn("n", n)
    level = lambda p, v: F.struct(p.alias("price"), v.alias("quantity"))
    bids, asks = F.array(level(F.round("price") - 1, F.col("quantity") - 1), level(F.round("price") - 2, F.col("quantity"))), F.array(level(F.round("price") + 1, F.col("quantity") - 1), level(F.round("price") + 2, F.col("quantity")))
    updates = x.where("n % 777 <> 0").select("symbol", "market", (F.col("n") * 2).alias("seq"), F.col("transact_time").alias("event_time"), (F.col("n") * 10 + 1).alias("first_update_id"), (F.col("n") * 10 + 10).alias("final_update_id"), bids.alias("bids"), asks.alias("asks"))
    snapshots = x.where("n % 500 = 1").select("symbol", "market", (F.col("n") * 2 - 1).alias("seq"), (F.col("n") * 10 + 5).alias("last_update_id"), bids.alias("bids"), asks.alias("asks"))
    return orderbook.messages(updates, snapshots)


_LEVELS_SQL = """SELECT {k}, 'bid' AS side, round(price) - 1 AS p, quantity - 1 AS q FROM {t} UNION SELECT {k}, 'bid', round(price) - 2, quantity FROM {t}
  UNION SELECT {k}, 'ask', round(price) + 1, quantity - 1 FROM {t} UNION SELECT {k}, 'ask', round(price) + 2, quantity FROM {t}"""


def book_sql(by: str, sums: tuple[int, ...]) -> str:
    """CTEs behind ``levels`` (by, n, side, p, q) and ``captures`` (by, n): the books there and their summaries, as ``books``."""
    total = ", ".join(f"coalesce(sum(q) FILTER (side = '{s}' AND place <= {n}), 0.0) AS {s}_quantity_{n}" for n in sums for s in ("bid", "ask"))
    on = " AND ".join(f"v.{k} = c.{k}" for k in by.split(", ") if k) or "true"
    keys = "".join(f"c.{k}, " for k in by.split(", ") if k)
    lead = f"{by}, " if by else ""
    return f"""spans AS (SELECT *, lead(n) OVER (PARTITION BY {lead}side, p ORDER BY n) AS until FROM levels),
there AS (SELECT {keys}c.n, side, p, q, row_number() OVER (PARTITION BY {keys}c.n, side ORDER BY CASE side WHEN 'bid' THEN -p ELSE p END) AS place
  FROM captures c LEFT JOIN spans v ON {on} AND v.n <= c.n AND (until IS NULL OR until > c.n) AND q > 0),
books AS (SELECT {lead}n, max(p) FILTER (side = 'bid') AS best_bid_price, min(p) FILTER (side = 'ask') AS best_ask_price, {total} FROM there GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {T}, x AS (SELECT venue AS symbol, row_number() OVER (PARTITION BY venue ORDER BY transact_time, trade_id, price, quantity) AS n, transact_time AS t, price, quantity FROM trades),
u AS (SELECT *, (n - 1) // 500 AS e, 10 * n + 1 AS first, 10 * n + 10 AS final, 10 * (500 * ((n - 1) // 500) + 1) + 5 AS l FROM x WHERE n % 777 <> 0),
m AS (SELECT *, coalesce(max(final) OVER (PARTITION BY symbol, e ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l) AS before FROM u),
j AS (SELECT *, final <= greatest(l, before) AS stale, CASE WHEN before > l THEN first = before + 1 ELSE first <= l + 1 END AS joins FROM m),
w AS (SELECT *, coalesce(sum(CASE WHEN NOT stale AND NOT joins THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, e ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS broken FROM j),
k AS (SELECT *, CASE WHEN broken OR stale THEN 'd' WHEN joins THEN 'a' ELSE 'r' END AS what FROM w),
s AS (SELECT *, {", ".join(f"CAST(count(*) FILTER (what = '{c}') OVER (PARTITION BY symbol ORDER BY n) AS BIGINT) AS {name}" for c, name in (("a", "applied"), ("d", "discarded"), ("r", "resynchronized")))} FROM k),
a AS (SELECT * FROM s WHERE what = 'a'),
due AS (SELECT symbol, min(n) AS n FROM a GROUP BY symbol UNION ALL SELECT due.symbol, min(y.n) FROM due JOIN a p ON p.symbol = due.symbol AND p.n = due.n JOIN a y ON y.symbol = p.symbol AND y.t >= p.t + INTERVAL 1 HOUR GROUP BY due.symbol),
captures AS (SELECT symbol, e, n FROM due JOIN a USING (symbol, n)),
source AS (SELECT symbol, (n - 1) // 500 AS e, n, price, quantity FROM x WHERE n % 500 = 1 OR (symbol, n) IN (SELECT (symbol, n) FROM a)),
levels AS ({_LEVELS_SQL.format(k="symbol, e, n", t="source")}), {book_sql("symbol, e", (5,))}
SELECT symbol, t AS captured_at, best_bid_price, best_ask_price, bid_quantity_5, ask_quantity_5, applied, discarded, resynchronized FROM books JOIN a USING (symbol, e, n)""")
def order_book_replay(s, d):
    x = orderbook.replay(book_messages(views.trades(s, d, per_venue=True)), 3600.0)
    return x.select("symbol", ntz("captured_at"), "best_bid_price", "best_ask_price", "bid_quantity_5", "ask_quantity_5", "applied", "discarded", "resynchronized")


@query(ORACLES["trades_to_candles"])
def stream_trades_to_candles(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    live = bars.trades_to_candles(views.trades_of(s.readStream.schema(schema).parquet(f"{d}/events.parquet*")), HOUR)
    path = workspace(s)
    # the last complete result replaces the table of the one before
    writer = live.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/candles"))
    writer.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return _bars(s.read.schema(live.schema).parquet(f"{path}/candles"))
