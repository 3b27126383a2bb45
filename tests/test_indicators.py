import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions import features as fn
from tapewright.functions.indicators import PointOfControl, Recursive, crosses, exponential, fullest, fullest_of_windows, gains, rsi, sma, wilder, with_recursive
from tapewright.functions.windows import ordered
from tapewright.model import ActivityMeasure, ExtremeSide, PriceSource
from tapewright.operators import profile


def loop_ema(x, n):
    out, a = [math.nan] * len(x), 2 / (n + 1)
    if len(x) < n:
        return out
    y = sum(x[:n]) / n
    out[n - 1] = y
    for i in range(n, len(x)):
        y = a * x[i] + (1 - a) * y
        out[i] = y
    return out


def walk(n, seed):
    r = random.Random(seed)
    x, p = [], 62_000.0
    for _ in range(n):
        p *= math.exp(r.gauss(0, 0.01))
        x.append(p)
    return x


def values(df, c):
    return [r[c] for r in df.orderBy("open_time").collect()]


def test_ema_equals_the_loop(spark, make_candles):
    x = walk(300, 5)
    got = values(with_recursive(make_candles(x), [Recursive("e", "ema", "close", 20)]), "e")
    want = loop_ema(x, 20)
    assert all((a is None) == math.isnan(b) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want))


def test_ema_across_a_hole():
    y = exponential(np.array([100, 101, np.nan, 103.0]), 3, "first")
    assert y[2] == y[1] and y[3] == pytest.approx(102.375)


def test_ema_too_short():
    assert np.isnan(exponential(np.array([1.0, 2.0]), 3)).all()
    assert np.isnan(wilder(np.arange(14.0), 14)).all()


@pytest.mark.parametrize("closes, want", [(range(1, 40), 100.0), (range(40, 1, -1), 0.0), ([5] * 40, 50.0)])
def test_rsi_degenerate(spark, make_candles, closes, want):
    w = ordered()
    up, down = gains(F.col("close"), w)
    x = with_recursive(make_candles(list(closes)).withColumns({"u": up, "d": down}), [Recursive("g", "wilder", "u", 14), Recursive("l", "wilder", "d", 14)])
    got = values(x.withColumn("r", rsi(F.col("g"), F.col("l"))), "r")
    assert got[:14] == [None] * 14 and set(got[14:]) == {want}


def test_sma_needs_all_its_rows(spark, make_candles):
    x = make_candles([1, 2, None, 4, 5, 6])
    assert values(x.withColumn("s", sma(F.col("close"), 3, ordered())), "s") == [None, None, None, None, None, 5.0]


def test_crosses_need_both_sides_on_both_bars(spark, make_candles):
    x = make_candles([1, 3, 1, 3], high=[2, 2, 2, 2], low=[2, None, 2, 2])
    golden, death = crosses(F.col("close"), F.col("low"), ordered())
    y = x.withColumns({"g": golden, "d": death})
    assert values(y, "g") == [False, False, False, True] and values(y, "d") == [False, False, False, False]


def test_windows_exclude_the_current_bar(spark, make_candles):
    x = make_candles([1, 2, 3, 100, 4])
    assert values(x.withColumn("p", fn.prior_extreme(ExtremeSide.HIGH, 3, ordered())), "p") == [None, None, None, 3.0, 100.0]
    z = values(x.withColumn("z", fn.z_rolling(F.col("close"), 3, ordered())), "z")
    assert z[3] == pytest.approx((100 - 2) / 1.0)


def test_breakout_in_warmup_is_false_not_null(spark, make_candles):
    level = fn.prior_extreme(ExtremeSide.HIGH, 3, ordered())
    assert values(make_candles([1, 2, 3, 100]).withColumn("b", fn.broken(ExtremeSide.HIGH, level)), "b") == [False, False, False, True]


def test_typical_price_counts_a_missing_leg_as_zero(spark, make_candles):
    assert values(make_candles([3], high=[None], low=[3]).withColumn("t", fn.price(PriceSource.TYPICAL)), "t") == [2.0]


def test_session_vwap_restarts_each_day(spark, make_candles):
    x = make_candles([10] * 24 + [20], volume=[1.0] * 25)
    assert values(x.withColumn("v", fn.vwap(fn.session_frame())), "v")[-1] == 20.0
    assert values(make_candles([10], volume=[0.0]).withColumn("v", fn.vwap(fn.session_frame())), "v") == [None]


def test_activity_of_one_bar_is_null(spark, make_candles):
    x = make_candles([1, 2, 4])
    assert values(x.withColumn("a", fn.activity(ActivityMeasure.ABSOLUTE_RETURN, ordered())), "a")[0] is None


def test_point_of_control_compares_with_edges():
    rng = np.random.default_rng(3)
    for _ in range(50):
        p, v = np.round(rng.uniform(1, 2, 200), 2), rng.integers(1, 9, 200).astype(float)
        held, edges = np.histogram(p, 20, weights=v)
        i = int(held.argmax())
        assert fullest(p, v, 20) == pytest.approx((edges[i] + edges[i + 1]) / 2)
    assert fullest(np.array([5.0, 5.0]), np.array([1.0, 1.0]), 10) == 5.0


def test_point_of_control_sees_earlier_bars_only(spark, make_candles):
    x = with_recursive(make_candles([1, 2, 100]), [PointOfControl("p", "close", 1, 10)])
    assert values(x, "p")[0] is None and values(x, "p")[2] < 3


def test_profile_and_value_area(spark):
    rows = [("s", float(p), float(v)) for p, v in zip([1, 2, 3, 4, 5], [1, 2, 10, 2, 1])]
    h = profile.histogram(spark.createDataFrame(rows, "k string, price double, quantity double"), ["k"], 5)
    assert [r["volume"] for r in h.orderBy("bucket").collect()] == [1.0, 2.0, 10.0, 2.0, 1.0]
    a = profile.value_area(h, ["k"]).first()
    # 10 of 16 is below 70 %: of equal neighbours the upper one joins
    assert (round(a["area_low"], 6), round(a["area_high"], 6)) == (2.6, 4.2)
    one = profile.histogram(spark.createDataFrame([("s", 7.0, 2.0)], "k string, price double, quantity double"), ["k"], 5)
    assert [tuple(r) for r in one.collect()] == [("s", 0, 7.0, 7.0, 7.0, 2.0)]


def test_profile_equals_numpy(spark):
    rng = np.random.default_rng(1)
    p, v = np.round(rng.uniform(100, 101, 2000), 2), rng.integers(1, 5, 2000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"k": "s", "price": p, "quantity": v}))
    got = [r["volume"] for r in profile.histogram(df, ["k"], 40).orderBy("bucket").collect()]
    assert got == list(np.histogram(p, 40, weights=v)[0])


def test_swing_equals_pandas_across_chunks(spark):
    """Trailing windows and the as-of join, over several days with repeated times."""
    rng = np.random.default_rng(8)
    t0 = pd.Timestamp("2024-01-01", tz="UTC")
    at = lambda n, end: t0 + pd.to_timedelta(np.sort(rng.integers(0, end, n)), unit="min")
    trades = pd.DataFrame({"symbol": "s", "market": "spot", "transact_time": at(900, 4000), "trade_id": range(900), "quantity": rng.integers(1, 9, 900).astype(float), "buyer_is_maker": rng.random(900) < 0.5})
    depth = pd.DataFrame({"symbol": "s", "market": "spot", "captured_at": np.unique(at(400, 4100)), "ask_quantity_20": 0.0})
    depth["ask_quantity_20"] = rng.integers(1, 30, len(depth)).astype(float)
    depth["bid_quantity_20"] = 1.0
    got = fn.liquidity_swing(spark.createDataFrame(trades), spark.createDataFrame(depth), ExtremeSide.HIGH, 7200.0).toPandas().sort_values("captured_at")
    volume = trades.assign(q=trades["quantity"].where(~trades["buyer_is_maker"], 0.0)).set_index("transact_time")["q"].rolling("7200s").sum().rename("v").reset_index()
    book = depth.set_index("captured_at")["ask_quantity_20"]
    loss = (book.rolling("7200s").max() - book).rename("loss").reset_index()
    joined = pd.merge_asof(loss, volume, left_on="captured_at", right_on="transact_time")
    want = (joined["v"] / joined["loss"].where(joined["loss"] > 0)).fillna(-1).tolist()
    assert got["swing"].astype(float).fillna(-1).tolist() == pytest.approx(want)


def test_trailing_windows_equal_a_loop(spark):
    """Ties, holes, rows without a time, times before 1970 and on the edge of a window, two instruments."""
    from tapewright.functions.windows import with_trailing

    r, w = random.Random(4), 50
    rows = [(k, i, r.randrange(-300, 300) if r.random() < 0.97 else None, None if r.random() < 0.1 else float(r.randrange(20))) for k in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "k string, i int, us long, v double").select("k", "i", F.timestamp_micros("us").alias("at"), "v")
    got = with_trailing(df, {"total": ("v", "sum"), "most": ("v", "max"), "least": ("v", "min")}, w, keys=["k"], time="at")
    assert got.columns == ["k", "i", "at", "v", "total", "most", "least"]
    want = {}
    for k, i, us, _ in rows:
        if us is not None:
            inside = [v for kk, _, u, v in rows if kk == k and u is not None and us - w < u <= us and v is not None]
            want[k, i] = (sum(inside), max(inside), min(inside)) if inside else (None, None, None)
    assert {(x["k"], x["i"]): tuple(x)[4:] for x in got.collect()} == want


def test_trailing_windows_keep_no_sliding_frame(spark):
    """A sliding frame looks at every row of a window for each row; running frames look once."""
    import re

    trades = spark.createDataFrame([], "symbol string, market string, transact_time timestamp, trade_id long, quantity double, buyer_is_maker boolean")
    depth = spark.createDataFrame([], "symbol string, market string, captured_at timestamp, ask_quantity_20 double, bid_quantity_20 double")
    plan = fn.liquidity_swing(trades, depth, ExtremeSide.HIGH, 3600.0)._jdf.queryExecution().analyzed().toString()
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+),", plan)
    assert len(frames) >= 6 and all("unboundedpreceding" in start for _, start in frames)


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("n", [1, 5, 33, 40, 1000])
def test_extremes_of_wide_windows(spark, make_candles, n, ahead):
    """Equal to looking through each window, with holes, several instruments and a column named like a helper."""
    import random

    from tapewright.functions.windows import with_extremes

    r = random.Random(n)
    both = {s: [None if r.random() < 0.01 else float(r.randrange(50)) for _ in range(rows)] for s, rows in (("A", 300), ("B", 41), ("C", 1))}
    df = make_candles([1.0] * 300, symbol="A", high=both["A"]).unionByName(make_candles([1.0] * 41, symbol="B", high=both["B"])).unionByName(make_candles([1.0], symbol="C", high=both["C"])).repartition(3)
    x = with_extremes(df.withColumn(f"BLOCK_{n}", F.lit("kept")), {"most": ("high", "max", n), "least": ("high", "min", n)}, ahead=ahead)
    assert {row[f"BLOCK_{n}"] for row in x.select(f"BLOCK_{n}").collect()} == {"kept"}
    for symbol, h in both.items():
        got = [tuple(row) for row in x.where(F.col("symbol") == symbol).orderBy("open_time").select("most", "least").collect()]
        frames = [h[i + 1 : i + 1 + n] if ahead else h[max(0, i - n) : i] for i in range(len(h))]
        assert got == [(max(f), min(f)) if len(f) == n and None not in f else (None, None) for f in frames]


def test_wide_windows_shuffle_once(make_candles):
    from tapewright.functions.windows import with_extremes

    plan = with_extremes(make_candles([1.0] * 9), {"most": ("high", "max", 500), "least": ("low", "min", 500)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_permutations_are_bijections():
    from tapewright.functions.permutation import permuted

    for n in [*range(1, 400), *range(400, 10_001, 61)]:
        full_ = np.full(n, n)
        assert (np.sort(permuted(np.arange(n), full_, np.full(n, 7))) == np.arange(n)).all()
    a, b = (permuted(np.arange(5_000), np.full(5_000, 5_000), np.full(5_000, s)) for s in (1, 2))
    assert (a == b).mean() < 0.01 and (a == np.arange(5_000)).mean() < 0.01 and abs(np.corrcoef(a, np.arange(5_000))[0, 1]) < 0.05


def scalar_permuted(place, n, seed):
    """The same network in Python's integers, one place at a time."""
    mask, a = 2**64 - 1, math.isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)
    while True:
        left, right = divmod(place, b)
        for r in range(6):
            half = right if r % 2 == 0 else left
            h = (seed & mask) ^ ((half * 0x9E3779B97F4A7C15 + r + 1) & mask)
            for shift in (30, 27, 31):
                h = ((h ^ (h >> shift)) * 0xBF58476D1CE4E5B9) & mask
            h ^= h >> 32
            if r % 2:
                right = (right + h % b) % b
            else:
                left = (left + h % a) % a
        place = left * b + right
        if place < n:
            return place


def test_shuffled_returns_equal_a_loop(spark, make_candles):
    from tapewright.operators.research import shuffle_returns

    closes = {s: [100 + 7 * math.sin(i * k) for i in range(n)] for s, k, n in (("A", 1.3, 90), ("B", 0.7, 2), ("C", 1.0, 1))}
    df = make_candles(closes["A"], symbol="A").unionByName(make_candles(closes["B"], symbol="B")).unionByName(make_candles(closes["C"], symbol="C")).repartition(3)
    got = shuffle_returns(df.selectExpr("*", "'kept' AS place"), 11)
    assert got.columns == [*df.columns, "place"]
    seeds = {r["symbol"]: r["h"] for r in df.select("symbol", F.xxhash64(F.lit(11), "symbol", "market", "timeframe").alias("h")).distinct().collect()}
    for symbol, x in closes.items():
        returns, dealt = [math.log(b / a) for a, b in zip(x, x[1:])], {}
        for i, v in enumerate(returns):
            dealt[scalar_permuted(i, len(returns), seeds[symbol])] = v
        want = [x[0] * math.exp(sum(dealt[j] for j in range(i))) for i in range(len(x))]
        rows = got.where(F.col("symbol") == symbol).orderBy("open_time").collect()
        assert [r["close"] for r in rows] == pytest.approx(want) and {r["place"] for r in rows} == {"kept"}
        assert sorted(dealt) == list(range(len(returns)))


@pytest.mark.parametrize("whole", [True, False])
def test_points_of_control_by_a_wavelet_matrix(whole):
    """Equal to a histogram of each window: ties, flat windows, one price, one row, empty windows."""
    r = np.random.default_rng(1)
    for _ in range(120):
        n, buckets = int(r.integers(1, 90)), int(r.integers(1, 25))
        p = np.round(r.uniform(95, 105, n), int(r.integers(0, 3)))
        v = r.integers(0, 4, n).astype(float) if whole else r.integers(0, 4, n) / 10
        a, b = np.sort(r.integers(0, n + 1, (2, 60)), axis=0)
        got = fullest_of_windows(p, v, a, b, buckets)
        for i, (x, y) in enumerate(zip(a, b)):
            assert np.isnan(got[i]) if x == y else got[i] == fullest(p[x:y], v[x:y], buckets)


def test_long_windows_cost_no_more():
    import time

    r, n = np.random.default_rng(2), 100_000
    p, v, at = r.uniform(90, 110, n), r.integers(1, 50, n).astype(float), np.arange(20_000, n, 16)
    took = {}
    for days in (5, 50, 5, 50):
        began = time.monotonic()
        fullest_of_windows(p, v, at - days * 288, at, 50)
        took[days] = min(took.get(days, 1e9), time.monotonic() - began)
    assert took[50] < 2 * took[5], took


def test_bars_without_a_price_take_no_part(make_candles):
    x = with_recursive(make_candles([1.0, None, 2.0, 2.0, None, 5.0]), [PointOfControl("p", "close", 1, 4)])
    assert values(x, "p") == [None, 1.0, 1.0, 1.125, 1.875, 1.875]
