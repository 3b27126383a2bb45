"""Window building blocks with the research engine's null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

#: Columns that name one instrument; every window is partitioned by them.
KEYS = ("symbol", "market", "timeframe")


def ordered(keys: Sequence[str] = KEYS, time: str = "open_time") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(time)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def prior_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def next_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows after the current one."""
    return w.rowsBetween(1, n)


def full(n: int, value: Column, counted: Column, frame: WindowSpec) -> Column:
    """``value`` over the frame, null unless the frame holds n non-null inputs."""
    return F.when(F.count(counted).over(frame) == n, value.over(frame))


def clean(c: Column) -> Column:
    """NaN as null: the engine knows one kind of missing."""
    return F.when(~F.isnan(c), c)


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Up to so many rows a frame is looked through for each row; wider ones are put together from two running extremes.
NARROW = 32


def with_extremes(df: DataFrame, columns: dict[str, tuple[str, str, int]], *, ahead: bool = False, keys: Sequence[str] = KEYS, time: str = "open_time") -> DataFrame:
    """``df`` with extremes of the n rows before the current one (``ahead``: after it); ``columns``: name -> (column, max or min, n).

    Null unless all n rows are there with a value.  Rows are cut into blocks of n: n
    neighbouring rows are the end of one block and the beginning of the next, so their
    extreme is that of a running one from the block's end and one from its start.  The
    cost of a row doesn't grow with n, and all of it needs one shuffle by instrument.
    """
    w = W.partitionBy(*keys).orderBy(F.desc(time) if ahead else time)
    narrow = {}
    for name, (c, kind, n) in columns.items():
        if n <= NARROW:
            narrow[name] = full(n, (F.max if kind == "max" else F.min)(c), F.col(c), prior_rows(w, n))
    df = df.withColumns(narrow) if narrow else df
    wide = {name: spec for name, spec in columns.items() if name not in narrow}
    if not wide:
        return df
    own = {n: unused(f"block_{n}", df) for n in {n for _, _, n in wide.values()}}
    place = F.row_number().over(w) - 1
    kept, x = df.columns, df.withColumns({b: F.floor(place / n) for n, b in own.items()})
    parts, out = {}, {}
    for i, (name, (c, kind, n)) in enumerate(wide.items()):
        extreme, block = F.max if kind == "max" else F.min, W.partitionBy(*keys, own[n])
        start, end, known = (unused(f"{k}_{i}", df) for k in ("from_start", "from_end", "known"))
        so_far = (W.unboundedPreceding, 0)
        parts[start] = extreme(c).over(block.orderBy(F.desc(time) if ahead else time).rowsBetween(*so_far))
        parts[end] = extreme(c).over(block.orderBy(time if ahead else F.desc(time)).rowsBetween(*so_far))
        parts[known] = F.count(c).over(w.rowsBetween(*so_far))
        whole = F.lag(known, 1).over(w) - F.coalesce(F.lag(known, n + 1).over(w), F.lit(0)) == n
        both = (F.greatest if kind == "max" else F.least)(F.lag(start, 1).over(w), F.lag(end, n).over(w))
        out[name] = F.when(whole, both)
    return x.withColumns(parts).withColumns(out).select(*[c for c in kept if c not in out], *out)


def longest_run(flag: Column, w: WindowSpec) -> Column:
    """Length, at each row, of the run of true flags that ends there."""
    broken = F.max(F.when(~F.coalesce(flag, F.lit(False)), F.row_number().over(w))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return F.row_number().over(w) - F.coalesce(broken, F.lit(0))


def with_trailing(df: DataFrame, columns: dict[str, tuple[str, str]], window_us: int, *, keys: Sequence[str], time: str) -> DataFrame:
    """``df`` with sums and extremes of the rows in (t - window, t], ties at t included; ``columns``: name -> (column, sum, max or min).

    Time is cut into blocks as long as the window, so a row's window is its own block up
    to the row and what is left of the block before.  The first is a running value from
    the block's start, the second one from its end: each row comes again as a mark, at
    the time at which it leaves the window, with the value of the later rows of its
    block.  So a row's cost doesn't grow with the rows in its window, and the blocks of
    a busy instrument spread over tasks.  Rows without a time are left out.
    """
    value = {"sum": F.sum, "max": F.max, "min": F.min}
    us, start = F.unix_micros(F.col(time).cast("timestamp")), F.col("__us") - F.pmod("__us", F.lit(window_us))
    x = df.select(*keys, F.struct(*df.columns).alias("__row"), us.alias("__us"), *[F.col(c).alias(f"__{n}") for n, (c, _) in columns.items()])
    x = x.where("__us is not null").withColumn("__block", start)
    block = W.partitionBy(*keys, "__block")
    held = lambda over: F.struct(*[value[kind](f"__{n}").over(over).alias(n) for n, (_, kind) in columns.items()])
    x = x.withColumn("__here", held(block.orderBy("__us").rangeBetween(W.unboundedPreceding, 0))).withColumn("__later", held(block.orderBy(F.desc("__us")).rangeBetween(W.unboundedPreceding, -1)))
    whole = x.groupBy(*keys, "__block").agg(F.struct(*[value[kind](f"__{n}").alias(n) for n, (_, kind) in columns.items()]).alias("__left"))
    after = F.col("__block") + window_us
    marks = x.select(*keys, after.alias("__block"), (F.col("__us") + window_us).alias("__us"), F.col("__later").alias("__left"))
    marks = marks.unionByName(whole.select(*keys, after.alias("__block"), (after - 1).alias("__us"), "__left"))
    nothing = lambda c: F.lit(None).cast(x.schema[c].dataType)
    line = marks.select("*", F.lit(0).alias("__tag"), nothing("__row").alias("__row"), nothing("__here").alias("__here"))
    line = line.unionByName(x.select(*keys, "__block", "__us", nothing("__later").alias("__left"), F.lit(1).alias("__tag"), "__row", "__here"))
    left = F.last("__left", ignorenulls=True).over(block.orderBy("__us", "__tag").rowsBetween(W.unboundedPreceding, 0))

    def both(name: str, kind: str) -> Column:
        a, b = F.col(f"__here.{name}"), F.col(f"__left.{name}")
        return {"sum": F.coalesce(a + b, a, b), "max": F.greatest(a, b), "min": F.least(a, b)}[kind].alias(name)

    return line.withColumn("__left", left).where("__tag = 1").select(*[F.col("__row")[c].alias(c) for c in df.columns if c not in columns], *[both(n, kind) for n, (_, kind) in columns.items()])
