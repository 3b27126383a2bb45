from datetime import datetime, timedelta, timezone

import pandas as pd

from support import START
from tapewright.model import Timeframe
from tapewright.operators import merge, quality
from tapewright.operators.align import as_of
from tapewright.operators.bars import continuous_aggregate, resample, trades_to_candles

TRADE = "symbol string, market string, trade_id long, first_trade_id long, last_trade_id long, transact_time timestamp, price double, quantity double, buyer_is_maker boolean"


def trades(spark, prices, quantities=None, makers=None, seconds=None, ids=None):
    n = len(prices)
    rows = []
    for i in range(n):
        a = ids[i] if ids else (i, i)
        t = START + timedelta(seconds=(seconds or [5 * k for k in range(n)])[i])
        rows.append(("BTC/USDT", "spot", i, a[0], a[1], t, float(prices[i]), float((quantities or [1] * n)[i]), bool((makers or [False] * n)[i])))
    return spark.createDataFrame(rows, TRADE)


def test_ticks_to_a_bar(spark):
    t = trades(spark, [100, 105, 95, 102, 101, 103], [1, 2, 3, 4, 5, 6], [False, True] * 3)
    r = trades_to_candles(t, Timeframe("1m")).first()
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"], r["taker_buy_base_volume"], r["trade_count"]) == (100, 105, 95, 103, 21, 9, 6)


def test_merged_trades_count_as_many(spark):
    r = trades_to_candles(trades(spark, [1], ids=[(100, 142)]), Timeframe("1m")).first()
    assert r["trade_count"] == 43


def test_empty_minutes_make_no_bars(spark):
    assert trades_to_candles(trades(spark, [1, 2], seconds=[0, 180]), Timeframe("1m")).count() == 2
    assert trades_to_candles(trades(spark, []), Timeframe("1m")).count() == 0


def test_missing_ids_across_days(spark):
    day = 86_400
    t = trades(spark, [1] * 4, seconds=[0, 10, day + 5, day + 9], ids=[(1, 2), (5, 6), (10, 10), (11, 11)])
    assert quality.missing_trade_ids(t).first()["missing"] == 2 + 3
    assert quality.missing_trade_ids(trades(spark, [1])).first()["missing"] == 0


def test_resample_turns_absent_volumes_to_zero_but_the_stored_view_keeps_null(spark, make_candles):
    from pyspark.sql import functions as F

    c = make_candles([1, 2, 3, 4]).withColumns({"quote_volume": F.lit(None).cast("double"), "taker_buy_base_volume": F.lit(None).cast("double"), "taker_buy_quote_volume": F.lit(None).cast("double"), "trade_count": F.lit(None).cast("long")})
    r = resample(c, Timeframe("4h")).first()
    assert (r["quote_volume"], r["trade_count"], r["close"]) == (0.0, 0, 4.0)
    assert continuous_aggregate(c.withColumn("timeframe", F.lit("1m")), Timeframe("1h")).first()["trade_count"] is None


def test_first_and_last_skip_missing(spark, make_candles):
    r = resample(make_candles([None, 2, 3, None]).selectExpr("*", "1.0D quote_volume", "1.0D taker_buy_base_volume", "1.0D taker_buy_quote_volume"), Timeframe("4h")).first()
    assert (r["open"], r["close"]) == (2.0, 3.0)


def test_merging_prefers_the_first(spark, make_candles):
    a, b = make_candles([1, 2]), make_candles([9, 9, 9])
    assert [r["close"] for r in merge.merge_candles(a, b).orderBy("open_time").collect()] == [1, 2, 9]


def test_new_rows_keep_what_is_stored(spark, make_candles):
    from pyspark.sql import functions as F

    batch = make_candles([1, 2, 3]).withColumn("source", F.lit("rest")).unionByName(make_candles([5, 6, 7]).withColumn("source", F.lit("archive")))
    got = merge.new_rows(batch, make_candles([0]), merge.CANDLE_KEY, F.col("source")).orderBy("open_time").collect()
    assert [(r["close"], r["source"]) for r in got] == [(6, "archive"), (7, "archive")]


def test_as_of_equals_pandas(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    t0 = pd.Timestamp("2024-01-01", tz="UTC")
    right = pd.DataFrame({"k": "a", "t": t0 + pd.to_timedelta(np.sort(rng.integers(0, 400, 150)), unit="h"), "id": range(150), "v": rng.normal(size=150)})
    left = pd.DataFrame({"k": "a", "t": t0 + pd.to_timedelta(np.sort(rng.integers(0, 420, 200)), unit="h"), "n": range(200)})
    right = right.sort_values(["t", "id"])
    got = as_of(spark.createDataFrame(left), spark.createDataFrame(right), "t", ["k"], ["v"], tiebreak="id").toPandas().sort_values("n")
    want = pd.merge_asof(left, right[["t", "v"]], on="t")
    assert got["v"].fillna(-99).tolist() == want["v"].fillna(-99).tolist()


def test_sanitation(spark, make_candles):
    c = make_candles([100, 101, 102, 103, 89.6], high=[101, 102, 101, 104, 104], low=[99, 100, 101.5, 102, 89], open=[100, 101, 102, 103, 103], volume=[1, 1, 1, 0, 1])
    s = quality.sanitation_summary(quality.flag(c, Timeframe("15m"))).first()
    assert (s["accepted"], s["rejected"], s["ohlc_invalid"], s["zero_volume"], s["price_jump"], s["negative_value"]) == (4, 1, 1, 1, 1, 0)


def test_no_cap_for_seconds(spark, make_candles):
    import pytest

    with pytest.raises(ValueError, match="1s"):
        quality.flag(make_candles([1]), Timeframe("1s"))


def test_gaps(spark):
    from tapewright.model import TimeRange

    tf, start = Timeframe("1m"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    expected = quality.expected_bars(spark, TimeRange(start, start + timedelta(minutes=20)), tf)
    there = spark.createDataFrame([(start + timedelta(minutes=i),) for i in range(20) if i not in (3, 4, 5, 11)], "open_time timestamp")
    assert tuple(quality.completeness(there, expected).first()) == (20, 16, 4, 0.8)
    assert [r["missing"] for r in quality.gaps(quality.missing_bars(there, expected), tf).orderBy("gap_start").collect()] == [3, 1]


def test_agreement(spark, make_candles):
    full = "*", "1.0D quote_volume", "0.0D taker_buy_base_volume", "1.0D taker_buy_quote_volume"
    a, b = make_candles([1, 2, 4]).selectExpr(*full), make_candles([1, 2]).selectExpr(*full)
    r = {x["name"]: x for x in quality.agreement(a, b).collect()}
    assert r["close"]["passed"] and (r["close"]["common"], r["close"]["missing_in_official"], r["close"]["missing_in_rebuilt"]) == (2, 1, 0)
