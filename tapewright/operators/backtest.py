"""Positions from signals, equity from positions, trades and performance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F, types as T

from ..functions.scans import DAY_US, Holding, with_held
from ..functions.windows import KEYS, longest_run
from ..model import CostModel, HoldingRules

# --- positions ---------------------------------------------------------------


def delayed(signal: Column, bars: int, w: WindowSpec) -> Column:
    return signal if bars == 0 else F.lag(signal, bars, False).over(w)


def resolve(entries: np.ndarray, exits: np.ndarray, holding: HoldingRules, first_allowed: int) -> np.ndarray:
    """Held bars.  A trade opens at the first entry from the cursor on and closes at
    the first exit strictly after it, after the longest holding, or at the end; the
    cursor then skips the cooldown."""
    held = np.zeros(len(entries), bool)
    opens, closes, at = np.flatnonzero(entries), np.flatnonzero(exits), first_allowed
    while (i := np.searchsorted(opens, at)) < len(opens):
        start = int(opens[i])
        j = np.searchsorted(closes, start, side="right")
        end = int(closes[j]) if j < len(closes) else len(held)
        if holding.maximum_holding_bars is not None:
            end = min(end, start + holding.maximum_holding_bars)
        end = min(end, len(held))
        held[start:end] = True
        at = end + (holding.cooldown_bars or 0)
    return held


def with_positions(df: DataFrame, *, weight: float, warmup: int, holding: HoldingRules = HoldingRules(), delay: int = 1, keys: Sequence[str] = KEYS, time: str = "open_time", chunk_days: int | None = None) -> DataFrame:
    """``df`` (Boolean columns ``entry`` with filters applied, and ``exit``) with ``position``.

    Without time rules a bar is held if the latest of its signals so far is an
    entry: one window.  With a longest holding or a cooldown the future depends
    on where a trade opened, and a kernel walks from trade to trade.  With
    ``chunk_days`` no task holds more than so many days of bars: each chunk says
    what it does to every state of the rules, and those moves are chained.
    """
    if chunk_days is not None:
        rules = Holding(holding.maximum_holding_bars, holding.cooldown_bars or 0, delay, warmup + delay)
        return with_held(df, "position", weight, rules, chunk_us=chunk_days * DAY_US, keys=keys, time=time)
    w = W.partitionBy(*keys).orderBy(time)
    first = warmup + delay
    x = df.withColumns({"__in": delayed(F.col("entry"), delay, w), "__out": delayed(F.col("exit"), delay, w), "__n": F.row_number().over(w) - 1})
    if not holding.has_time_rules:
        enter = F.col("__in") & (F.col("__n") >= first)
        state = F.last(F.when(enter | F.col("__out"), enter), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        return x.withColumn("position", F.when(F.coalesce(state, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))).drop("__in", "__out", "__n")
    schema = T.StructType([*df.schema.fields, T.StructField("position", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        held = resolve(table.column("__in").to_numpy().astype(bool), table.column("__out").to_numpy().astype(bool), holding, first)
        return table.append_column("position", pa.array(held * weight, pa.float64())).select(schema.names)

    return x.groupBy(*keys).applyInArrow(run, schema)


def positions_of_many(df: DataFrame, *, time_rules: bool, delay: int = 1, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``with_positions`` for rows of many strategies at once (each a group of ``keys``).

    The rules are columns: ``weight, warmup``, and null or a number in
    ``maximum_holding_bars`` and ``cooldown_bars``.
    """
    w = W.partitionBy(*keys).orderBy(time)
    x = df.withColumns({"__in": delayed(F.col("entry"), delay, w), "__out": delayed(F.col("exit"), delay, w), "__n": F.row_number().over(w) - 1})
    if not time_rules:
        enter = F.col("__in") & (F.col("__n") >= F.col("warmup") + delay)
        state = F.last(F.when(enter | F.col("__out"), enter), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        return x.withColumn("position", F.when(F.coalesce(state, F.lit(False)), F.col("weight")).otherwise(F.lit(0.0))).drop("__in", "__out", "__n")
    schema = T.StructType([*df.schema.fields, T.StructField("position", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        first = {c: table.column(c)[0].as_py() for c in ("weight", "warmup", "maximum_holding_bars", "cooldown_bars")}
        held = resolve(table.column("__in").to_numpy().astype(bool), table.column("__out").to_numpy().astype(bool), HoldingRules(first["maximum_holding_bars"], first["cooldown_bars"]), first["warmup"] + delay)
        return table.append_column("position", pa.array(held * first["weight"], pa.float64())).select(schema.names)

    return x.groupBy(*keys).applyInArrow(run, schema)


# --- equity ------------------------------------------------------------------


def equity_curve(df: DataFrame, costs: CostModel, capital: float = 10_000.0, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``df`` (``close``, ``position``) with returns, turnover, cost, equity and gross equity.

    A change of position pays its cost before the bar's return is earned:
    growth = (1 - cost) * (1 + gross).  The cost paid is of the equity before.
    """
    w = W.partitionBy(*keys).orderBy(time)
    change = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))
    x = df.withColumns({"gross_return": F.col("position") * change, "turnover": F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w))})
    x = x.withColumn("cost_rate", F.col("turnover") * costs.one_way)
    x = x.withColumn("returns", (1 - F.col("cost_rate")) * (1 + F.col("gross_return")) - 1)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"equity": capital * F.product(1 + F.col("returns")).over(so_far), "gross_equity": capital * F.product(1 + F.col("gross_return")).over(so_far)})
    return x.withColumn("cost_paid", F.lag("equity", 1, capital).over(w) * F.col("cost_rate"))


def trades(df: DataFrame, costs: CostModel, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """One row for each run of held bars; an open one closes at the last bar.

    The entry price is the close before the first held bar; a position on the
    very first bar takes the last close there.  Returns carry no direction.
    """
    w = W.partitionBy(*keys).orderBy(time)
    held = F.col("position") != 0
    x = df.select(*keys, time, "close", "position", held.alias("held")).withColumns({
        "starts": held & ~F.lag(held, 1, False).over(w), "n": F.row_number().over(w), "before": F.lag("close").over(w), "next": F.lead(time).over(w),
        "last_close": F.last("close").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })
    x = x.withColumn("trade", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("held")
    per = x.groupBy(*keys, "trade").agg(
        F.min(time).alias("opened_at"), F.max_by(F.coalesce("next", F.col(time)), "n").alias("closed_at"), F.count("*").alias("bars_held"),
        F.min_by(F.coalesce("before", "last_close"), "n").alias("entry_price"), F.max_by("close", "n").alias("exit_price"),
    )
    gross = F.col("exit_price") / F.col("entry_price") - 1
    return per.withColumn("gross_return", gross).withColumn("net_return", gross - costs.round_trip)


# --- performance -------------------------------------------------------------


def sharpe(r: Column, periods_per_year: float) -> Column:
    """Mean over deviation, per year; null below two returns or without deviation."""
    spread = F.stddev_samp(r)
    return F.when((F.count(r) > 1) & (spread > 0), F.avg(r) / spread * periods_per_year**0.5)


def sortino(r: Column, periods_per_year: float) -> Column:
    losses = F.when(r < 0, r)
    spread = F.stddev_samp(losses)
    return F.when((F.count(losses) > 1) & (spread > 0), F.avg(r) / spread * periods_per_year**0.5)


def with_drawdown(curve: DataFrame, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(time)
    peak = F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0))
    x = curve.withColumn("drawdown", F.col("equity") / peak - 1)
    return x.withColumn("drawdown_bars", longest_run(F.col("drawdown") < 0, w))


def performance(curve: DataFrame, trade_table: DataFrame, periods_per_year: float, capital: float = 10_000.0, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """One row for each instrument (and strategy, if that is a key)."""
    r = F.col("returns")
    own = with_drawdown(curve, keys, time).groupBy(*keys).agg(
        F.count("*").alias("bars"), (F.max_by("equity", time) / capital - 1).alias("total_return"), (F.max_by("gross_equity", time) / capital - 1).alias("gross_total_return"),
        F.min("drawdown").alias("maximum_drawdown"), F.max("drawdown_bars").alias("longest_drawdown_bars"),
        sharpe(r, periods_per_year).alias("sharpe"), sortino(r, periods_per_year).alias("sortino"),
        F.sum("turnover").alias("turnover"), F.sum("cost_paid").alias("cost_paid"), F.sum((F.col("position") != 0).cast("long")).alias("held_bars"),
    )
    net = F.col("net_return")
    per = trade_table.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg((net > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.avg(F.when(net > 0, net)), F.abs(F.avg(F.when(net < 0, net)))).alias("payoff_ratio"),
    )
    x = own.join(per, list(keys), "left").withColumn("trades", F.coalesce("trades", F.lit(0)))
    gross_profit = F.col("gross_total_return") * capital
    return x.withColumns({
        "exposure": F.col("held_bars") / F.col("bars"), "cost_share_of_gross_profit": F.when(gross_profit > 0, F.col("cost_paid") / gross_profit),
        "return_over_maximum_drawdown": F.when(F.col("maximum_drawdown") < 0, F.col("total_return") / F.abs(F.nullif(F.col("maximum_drawdown"), F.lit(0.0)))),
    })


def monthly_returns(curve: DataFrame, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """Month-end equity over the month-end before; the first month starts at its first equity."""
    per = curve.groupBy(*keys, F.trunc(F.to_date(time), "month").alias("month")).agg(F.max_by("equity", time).alias("last"), F.min_by("equity", time).alias("first"))
    opening = F.coalesce(F.lag("last").over(W.partitionBy(*keys).orderBy("month")), F.col("first"))
    return per.select(*keys, "month", (F.col("last") / opening - 1).alias("monthly_return"))


def cost_sensitivity(df: DataFrame, fees: Sequence[float], slippage_rate: float, capital: float = 10_000.0, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """The backtest for every fee at once: ``keys, fee, round_trip, total_return, cost_paid``.

    The fees are a column of the same rows, so the bars are scanned and shuffled once.
    """
    w = W.partitionBy(*keys).orderBy(time)
    change = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))
    base = df.select(*keys, time, (F.col("position") * change).alias("gross"), F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w)).alias("turnover"))
    fee = F.explode(F.array(*[F.lit(float(f)) for f in sorted(fees)]))
    x = base.withColumn("fee", fee).withColumn("cost", F.col("turnover") * (F.col("fee") + slippage_rate))
    per = W.partitionBy(*keys, "fee").orderBy(time)
    growth = (1 - F.col("cost")) * (1 + F.col("gross"))
    x = x.withColumn("equity", capital * F.product(growth).over(per.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("paid", F.lag("equity", 1, capital).over(per) * F.col("cost"))
    out = x.groupBy(*keys, "fee").agg((F.max_by("equity", time) / capital - 1).alias("total_return"), F.sum("paid").alias("cost_paid"))
    return out.withColumn("round_trip", 2 * (F.col("fee") + slippage_rate))


def break_even(sensitivity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, break_even``: where the return turns from profit to loss, by interpolation; null outside the grid."""
    w = W.partitionBy(*keys).orderBy("fee")
    x = sensitivity.withColumns({"r0": F.lag("total_return").over(w), "c0": F.lag("round_trip").over(w)})
    turns = (F.col("r0") > 0) & (F.col("total_return") <= 0)
    at = F.col("c0") + F.try_divide(F.col("r0"), F.col("r0") - F.col("total_return")) * (F.col("round_trip") - F.col("c0"))
    per = x.groupBy(*keys).agg(F.min_by("total_return", "fee").alias("first"), F.max_by("total_return", "fee").alias("last"), F.min_by(at, F.when(turns, F.col("fee"))).alias("at"))
    return per.select(*keys, F.when((F.col("first") > 0) & (F.col("last") <= 0), F.col("at")).alias("break_even"))


def signal_counts(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``bars, held_bars, trades, entry_signals, vetoed_entries``; needs ``entry_signal``, ``allowed``, ``position``."""
    w = W.partitionBy(*keys).orderBy(time)
    starts = (F.col("position") != 0) & (F.lag("position", 1, 0.0).over(w) == 0)
    x = df.withColumn("__starts", starts)

    def n(c: Column) -> Column:
        return F.sum(c.cast("long"))

    return x.groupBy(*keys).agg(F.count("*").alias("bars"), n(F.col("position") != 0).alias("held_bars"), n(F.col("__starts")).alias("trades"), n(F.col("entry_signal")).alias("entry_signals"), n(F.col("entry_signal") & ~F.col("allowed")).alias("vetoed_entries"))
