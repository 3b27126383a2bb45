"""Volume profiles: volume by price, the point of control and the value area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def histogram(rows: DataFrame, keys: Sequence[str], buckets: int, price: str = "price", volume: str = "quantity") -> DataFrame:
    """``keys, bucket, low, high, centre, volume`` for buckets 0 to n - 1, empty ones included.

    Buckets are even over [min, max], the last one closed; a single price makes
    one bucket.  Prices are compared with explicit edges ``low + i * step``.
    The bounds are one row for each key; sums combine before the shuffle.
    """
    known = rows.where(F.col(price).isNotNull()).select(*keys, F.col(price).cast("double").alias("p"), F.coalesce(F.col(volume), F.lit(0)).cast("double").alias("v"))
    bounds = known.groupBy(*keys).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    bounds = bounds.withColumn("n", F.when(F.col("lo") == F.col("hi"), 1).otherwise(buckets)).withColumn("step", (F.col("hi") - F.col("lo")) / F.col("n"))
    joined = known.join(bounds, list(keys))
    # the division names a neighbour at worst; the edges decide
    guess = F.least(F.greatest(F.floor(F.try_divide(F.col("p") - F.col("lo"), F.col("step"))), F.lit(0)), F.col("n") - 1).cast("int")
    joined = joined.withColumn("g", F.coalesce(guess, F.lit(0)))
    up = F.when((F.col("g") < F.col("n") - 1) & (F.col("p") >= F.col("lo") + (F.col("g") + 1) * F.col("step")), 1).otherwise(0)
    down = F.when((F.col("g") > 0) & (F.col("p") < F.col("lo") + F.col("g") * F.col("step")), 1).otherwise(0)
    sums = joined.withColumn("bucket", F.col("g") + up - down).groupBy(*keys, "bucket").agg(F.sum("v").alias("volume"))
    every = bounds.select(*keys, "lo", "hi", "n", "step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bucket"))
    low = F.col("lo") + F.col("bucket") * F.col("step")
    high = F.when(F.col("bucket") == F.col("n") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bucket") + 1) * F.col("step"))
    out = every.withColumns({"low": low, "high": high}).join(sums, [*keys, "bucket"], "left")
    return out.select(*keys, "bucket", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("centre"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def value_area(profile: DataFrame, keys: Sequence[str], share: float = 0.7) -> DataFrame:
    """``keys, point_of_control, area_low, area_high, total``.

    The area grows from the fullest bucket (the lowest of equal ones) by its
    larger neighbour, the upper one of equal ones, until it holds ``share`` of
    the volume.  One array of at most n buckets for each key.
    """
    listed = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "low", "high", "centre", "volume"))).alias("b"), F.max_by("bucket", F.struct("volume", -F.col("bucket"))).alias("poc"), F.sum("volume").alias("total"))
    state = F.struct(F.col("poc").alias("lo"), F.col("poc").alias("hi"), F.get("b", F.col("poc"))["volume"].alias("held"))

    def grow(acc: Column, _: Column) -> Column:
        enough = acc["held"] >= share * F.col("total")
        below = F.when(acc["lo"] > 0, F.get("b", acc["lo"] - 1)["volume"])
        above = F.when(acc["hi"] < F.size("b") - 1, F.get("b", acc["hi"] + 1)["volume"])
        up = above.isNotNull() & (below.isNull() | (above >= below))
        down = ~up & below.isNotNull()
        go_up, go_down = ~enough & up, ~enough & down
        return F.struct(
            (acc["lo"] - go_down.cast("int")).alias("lo"), (acc["hi"] + go_up.cast("int")).alias("hi"),
            (acc["held"] + F.when(go_up, above).when(go_down, below).otherwise(0.0)).alias("held"),
        )

    area = F.aggregate(F.sequence(F.lit(1), F.size("b")), state, grow)
    x = listed.withColumn("a", area)
    return x.select(*keys, F.get("b", F.col("poc"))["centre"].alias("point_of_control"), F.get("b", F.col("a.lo"))["low"].alias("area_low"), F.get("b", F.col("a.hi"))["high"].alias("area_high"), "total")


def compare(exact: DataFrame, approximate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relative distance of the points of control; overlap of the value areas over the exact one's width."""
    a = exact.select(*keys, F.col("point_of_control").alias("a_poc"), F.col("area_low").alias("al"), F.col("area_high").alias("ah"))
    b = approximate.select(*keys, F.col("point_of_control").alias("b_poc"), F.col("area_low").alias("bl"), F.col("area_high").alias("bh"))
    shared = F.greatest(F.least("ah", "bh") - F.greatest("al", "bl"), F.lit(0.0))
    width = F.col("ah") - F.col("al")
    return a.join(b, list(keys)).select(*keys, F.try_divide(F.col("b_poc") - F.col("a_poc"), F.col("a_poc")).alias("poc_difference"), F.when(width > 0, shared / width).alias("area_overlap"))
