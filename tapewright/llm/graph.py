"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


#: Parts that the edges of one node are dealt to when they meet its minimum.
PARTS = 8


def _joined(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m`` of their node u; a node with many edges spreads over tasks."""
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")
    many = minima.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return edges.withColumn("part", part).join(many, ["u", "part"]).drop("part")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b); root: the smallest node of its component.

    Each round rewires neighbours to the smallest node in sight; the number of
    rounds grows with the logarithm of the longest chain.  Minima combine before
    they are shuffled, and every star is a written table, so no lineage grows: the
    small star reads the large one three times, each of which would plan it again
    in the driver.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u now hang on the smallest node that u sees
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(_joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its smaller neighbours hang on the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = _joined(large, low)
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
