"""Scans over chunks equal the recursions over whole instruments."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import START
from tapewright.functions import scans
from tapewright.functions.indicators import PointOfControl, Recursive, as_mean, exponential, wilder, with_recursive
from tapewright.model import HoldingRules
from tapewright.operators import backtest as bt


def cut(r, n):
    """Random cuts of n rows, with chunks of one row among them."""
    return [0, *sorted({r.randrange(1, n) for _ in range(r.randrange(0, 8))} if n > 1 else []), n]


@pytest.mark.parametrize("kind", ["ema", "ema_first", "wilder"])
def test_means_by_chunks(kind):
    r = random.Random(kind)
    for _ in range(300):
        n, period = r.randrange(1, 60), r.randrange(1, 20)
        holes = r.choice([0, 0, 0.1, 0.6])
        x = np.array([math.nan if r.random() < holes else r.uniform(50, 150) for _ in range(n)])
        want = wilder(x, period) if kind == "wilder" else exponential(x, period, "first" if kind == "ema_first" else "sma")
        m, at = as_mean(Recursive("y", kind, "x", period)), cut(r, n)
        parts = list(zip(at, at[1:]))
        starts = m.chain([m.summarize(x[a:b], a) for a, b in parts])
        got = np.concatenate([m.values(x[a:b], a, s) for (a, b), s in zip(parts, starts)])
        assert np.allclose(got, want, rtol=1e-12, equal_nan=True)


def test_holdings_by_chunks():
    r = random.Random(3)
    for _ in range(1_500):
        n, delay, warmup = r.randrange(1, 50), r.randrange(0, 4), r.randrange(0, 8)
        rules = HoldingRules(r.choice([None, 1, 2, 5, 30]), r.choice([None, 1, 3, 40]))
        entries, exits = (np.array([r.random() < p for _ in range(n)]) for p in (0.25, 0.2))
        late = lambda x: np.concatenate([np.zeros(delay, bool), x])[:n]  # noqa: B023, E731
        want = bt.resolve(late(entries), late(exits), rules, warmup + delay)
        h, at = scans.Holding(rules.maximum_holding_bars, rules.cooldown_bars or 0, delay, warmup + delay), cut(r, n)
        parts = list(zip(at, at[1:]))
        starts = scans.chain_holdings([scans.moves(entries[a:b], exits[a:b], h) for a, b in parts], h)
        got = np.concatenate([scans.hold(entries[a:b], exits[a:b], h, s) for (a, b), s in zip(parts, starts)])
        assert got.tolist() == want.tolist(), (parts, rules, delay, warmup)


@pytest.fixture(scope="module")
def two(make_candles):
    r = random.Random(1)
    some = lambda n, **k: make_candles([None if r.random() < 0.02 else r.uniform(90, 110) for _ in range(n)], volume=[float(r.randrange(1, 9)) for _ in range(n)], **k)
    df = some(400, symbol="A").unionByName(some(30, symbol="B")).unionByName(some(1, symbol="C"))
    return df.selectExpr("*", "'kept' AS chunk", "close > 104 AS entry", "close < 97 AS exit").repartition(3)


def values(df, c):
    return {(r["symbol"], r["open_time"]): r[c] for r in df.collect()}


def test_columns_in_chunks_of_days(two):
    columns = [Recursive("e", "ema", "close", 12), Recursive("f", "ema_first", "close", 5), Recursive("w", "wilder", "close", 14), PointOfControl("p", "high_", 2, 10)]
    df = two.withColumn("high_", F.coalesce("close", F.lit(100.0)))
    whole, chunks = with_recursive(df, columns), with_recursive(df, columns, chunk_days=3)
    assert sorted(chunks.columns) == sorted(whole.columns) and {r["chunk"] for r in chunks.collect()} == {"kept"}
    for c in "efwp":
        want, got = values(whole, c), values(chunks, c)
        assert want.keys() == got.keys() and all(got[k] == (None if v is None else pytest.approx(v, rel=1e-9)) for k, v in want.items())


@pytest.mark.parametrize("rules", [HoldingRules(), HoldingRules(7, None), HoldingRules(None, 5), HoldingRules(30, 50)])
def test_positions_in_chunks_of_days(two, rules):
    want = values(bt.with_positions(two.na.fill(False, ["entry", "exit"]), weight=-0.5, warmup=6, holding=rules, delay=2), "position")
    assert values(bt.with_positions(two, weight=-0.5, warmup=6, holding=rules, delay=2, chunk_days=1), "position") == want


def test_rows_are_grouped_by_chunk(spark, two):
    """No operator above the rows is distributed by instrument alone."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = with_recursive(two.select("symbol", "market", "timeframe", "open_time", "close"), [Recursive("e", "ema", "close", 12)], chunk_days=1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FlatMapCoGroupsInArrow") == 2 and START is not None
    last = plan.split("FlatMapCoGroupsInArrow")[1]
    assert "chunk" in last.split("\\n")[0]
