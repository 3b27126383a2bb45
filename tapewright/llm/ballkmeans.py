"""Exact k-means by balls: only members near a border between clusters are compared again.

A cluster is a ball around its centroid that reaches to its farthest member.  A
centroid can take members from a ball only if it lies within twice the ball's
radius: such centroids are the ball's neighbours.  Members nearer to their centroid
than half-way to the nearest neighbour are the stable core and stay without a
comparison; the others lie in annuli between the half-ways to the neighbours, and
a member is compared with those neighbours alone whose half-way it passes.  All of
it is integer arithmetic, so results equal those of comparing everything.

Vectors are quantised once and written as blocks, in a table bucketed by block.  A
round reads it beside the last round's table of cluster numbers (one small number a
vector, bucketed alike, so that they join without a shuffle) and writes the next
one with what changed: sums move by the vectors that moved.  The driver holds the
centroids, their sums and k x k distances, nothing that grows with the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import rows_of

#: Vectors of a block; components are clamped to this after flooring; the largest long.
BLOCK, CLAMP, LONGEST = 1024, 2**50, 2**63 - 1


@dataclass
class Balls:
    """Centroids, and for each its neighbours by rising squared distance."""

    centroids: list[list[int]]
    neighbours: list[list[tuple[int, int]]]  # (squared distance, number)


def neighbours(centroids: list[list[int]], radii: list[int]) -> list[list[tuple[int, int]]]:
    """Of each centroid, those within twice its ball's radius."""
    x = np.array(centroids, dtype=object)
    out = []
    for i, r in enumerate(radii):
        apart = ((x - x[i]) ** 2).sum(1)
        out.append(sorted((int(d), j) for j, d in enumerate(apart) if j != i and d <= 4 * r * r))
    return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


def assign_all(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, ties to the smaller number, and the squared distances."""
    best, own = np.zeros(len(x), np.int32), _distances(x, centroids[0])
    for j in range(1, len(centroids)):
        d = _distances(x, centroids[j])
        nearer = d < own
        best[nearer], own[nearer] = j, d[nearer]
    return best, own


def assign_near(x: np.ndarray, last: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``assign_all``, from the last clusters; also how many comparisons with neighbours it took."""
    best, own, compared = last.copy(), _distances(x, centroids[last]), 0
    start = own.copy()
    for i in np.unique(last).tolist():
        members = np.flatnonzero(last == i)
        for apart, j in near[i]:
            members = members[4 * start[members] >= apart]  # not nearer to i than half-way to j
            if not len(members):
                break
            compared += len(members)
            d = _distances(x[members], centroids[j])
            better = (d < own[members]) | ((d == own[members]) & (j < best[members]))
            best[members[better]], own[members[better]] = j, d[better]
    return best, own, compared


def _packed(q: np.ndarray) -> tuple[bytes, int]:
    """Integers as bytes, and how many bytes one takes."""
    most = int(np.abs(q).max(initial=0))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return q.astype(f"<i{width}").tobytes(), width


def _exact(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python's integers where four times a squared distance could leave 64 bits."""
    most = max(int(np.abs(a).max(initial=0)) for a in (x, c))
    if 16 * x.shape[1] * most * most < 2**62:
        return x, c
    return x.astype(object), c.astype(object)


def _to_blocks(dims: int, scale: int):
    """Kept vectors -> blocks: number, ids, bytes of the quantised components and their width."""

    def run(batches: Iterator[pa.RecordBatch]):
        part, no = TaskContext.get().partitionId(), 0
        for b in rows_of(batches, BLOCK):
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(x * scale), -CLAMP, CLAMP).astype(np.int64)
            raw, width = _packed(q)
            yield pa.RecordBatch.from_arrays([pa.array([part * 2**33 + no], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), b.column(0)), pa.array([raw], pa.binary()), pa.array([width], pa.int32())], ["block", "ids", "raw", "width"])
            no += 1

    return run


_FIELDS = ["block", "clusters", "distances", "numbers", "counts", "sums", "farthest", "inertias", "compared"]
_ROUND = "block long, clusters binary, distances binary, numbers array<int>, counts array<long>, sums array<array<decimal(38,0)>>, farthest array<long>, inertias array<decimal(38,0)>, compared long"


def _round(dims: int, shared):
    """Blocks beside their last clusters -> clusters now and, by cluster, what came or went and the farthest member."""
    decimals = pa.decimal128(38)

    def run(batches: Iterator[pa.RecordBatch]):
        balls = shared.value
        centroids = np.array(balls.centroids, np.int64)
        for b in batches:
            out = []
            for block, raw, width, last in zip(*(b.column(i).to_pylist() for i in range(4))):
                x, c = _exact(np.frombuffer(raw, f"<i{width}").astype(np.int64).reshape(-1, dims), centroids)
                if last is None:
                    was, compared = None, len(x) * len(c)
                    now, own = assign_all(x, c)
                else:
                    was = np.frombuffer(last, "<i4")
                    now, own, compared = assign_near(x, was, c, balls.neighbours)
                moved = np.arange(len(x)) if was is None else np.flatnonzero(now != was)
                stats: dict[int, list] = {}
                for i in np.unique(np.concatenate([now, was[moved]] if was is not None else [now])).tolist():
                    came = moved[now[moved] == i]
                    went = moved[was[moved] == i] if was is not None else moved[:0]
                    mine = own[now == i]
                    stats[i] = [len(came) - len(went), [Decimal(int(s)) for s in x[came].sum(0) - x[went].sum(0)], _root_above(int(max(mine, default=0))), Decimal(sum(min(LONGEST, int(d)) for d in mine))]
                out.append((block, now.astype("<i4").tobytes(), np.minimum(own, LONGEST).astype("<i8").tobytes(), list(stats), *map(list, zip(*stats.values())), compared))
            columns = list(zip(*out)) or [()] * 9
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(decimals)), pa.list_(pa.int64()), pa.list_(decimals), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], _FIELDS)

    return run


class _Tables:
    """Bucketed tables of one run; dropped when it ends."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.prefix, self.names = spark, buckets, f"ball_{uuid.uuid4().hex}", []

    def save(self, df: DataFrame) -> DataFrame:
        name = f"{self.prefix}_{len(self.names)}"
        df.write.bucketBy(self.buckets, "block").option("compression", "zstd").format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self, *tables: str) -> None:
        for name in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _totals(state: DataFrame, dims: int) -> tuple[dict[int, int], dict[int, list[int]], dict[int, int], dict[int, int]]:
    """Counts, sums, radii and inertias by cluster; added up by cluster and component over all tasks."""
    one = state.select(F.inline(F.arrays_zip("numbers", "counts", "sums", "farthest", "inertias")))
    by = one.groupBy("numbers").agg(F.sum("counts").alias("n"), F.max("farthest").alias("r"), F.sum("inertias").alias("inertia")).collect()
    parts = one.select("numbers", F.posexplode("sums").alias("at", "value")).groupBy("numbers", "at").agg(F.sum("value").alias("value")).collect()
    sums: dict[int, list[int]] = {r["numbers"]: [0] * dims for r in by}
    for r in parts:
        sums[r["numbers"]][r["at"]] = int(r["value"])
    return {r["numbers"]: r["n"] for r in by}, sums, {r["numbers"]: r["r"] for r in by}, {r["numbers"]: int(r["inertia"]) for r in by}


def kept(vectors: DataFrame, dims: int, vector_col: str) -> Column:
    """Vectors of exactly ``dims`` components, none null or non-finite."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dims) & ~bad, F.lit(False))


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding", comparisons: list[int] | None = None) -> DataFrame:
    """Per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Components are floor(scale * x); centroids start as the ``k`` kept vectors whose
    ids have the smallest SHA-256 after ``salt:`` (ids that are null last, of equal ids
    the least vector first).  A round assigns every vector (squared distance, ties to the
    smaller number) and moves non-empty centroids to the floored mean; then vectors
    are assigned once more.  Rounds that move no centroid would repeat, so they are
    not run.  Fewer than ``k`` kept vectors give as many centroids; none, an empty
    result.  Repeated rows count as often as they are there; other columns, whatever
    their names, are not read.  Distances beyond a long are given as the largest long,
    components are held within 2**50.  ``comparisons`` gets, by pass, how many distances
    to other centroids were computed.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    src = vectors.where(kept(vectors, dims, vector_col)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    names = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = src.select(F.col("v"), names.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = [[max(-CLAMP, min(CLAMP, _floor(x, scale))) for x in r["v"]] for r in starts]
    schema = T.StructType([T.StructField("vec_id", kind), *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").fields])
    if not centroids:
        return spark.createDataFrame([], schema)

    blocks = src.mapInArrow(_to_blocks(dims, scale), T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL("raw binary, width int").fields]))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = _Tables(spark, buckets)
    stored = tables.save(blocks.repartition(buckets, "block"))
    state, counts, sums = None, dict.fromkeys(range(len(centroids)), 0), {i: [0] * dims for i in range(len(centroids))}
    radii = [0] * len(centroids)
    for turn in range(rounds + 1):
        balls = Balls(centroids, neighbours(centroids, radii) if state is not None else [])
        shared = spark.sparkContext.broadcast(balls)
        sides = stored.select("block", "raw", "width", F.lit(None).cast("binary").alias("clusters")) if state is None else stored.select("block", "raw", "width").join(state.select("block", "clusters"), "block")
        before = tables.names[1:]
        state = tables.save(sides.select("block", "raw", "width", "clusters").mapInArrow(_round(dims, shared), _ROUND))
        tables.drop(*before)
        came, moved, reach, inertia = _totals(state, dims)
        if comparisons is not None:
            comparisons.append(int(state.agg(F.sum("compared")).first()[0]))
        if turn == rounds:
            break
        for i in came:
            counts[i] += came[i]
            sums[i] = [a + b for a, b in zip(sums[i], moved[i])]
        new = [[s // counts[i] for s in sums[i]] if counts[i] else c for i, c in enumerate(centroids)]
        if new == centroids:
            break
        radii = [reach.get(i, 0) + _root_above(sum((a - b) ** 2 for a, b in zip(centroids[i], new[i]))) for i in range(len(centroids))]
        centroids = new
    return _result(stored, state, tables, centroids, inertia, schema)


def _floor(x: float, scale: int) -> int:
    return int((Fraction(x) * scale).__floor__())


def _root_above(n: int) -> int:
    """A whole number whose square is at least ``n``."""
    return isqrt(n) + 1


def _result(stored: DataFrame, state: DataFrame, tables: _Tables, centroids: list[list[int]], inertia: dict[int, int], schema: T.StructType) -> DataFrame:
    total = min(LONGEST, sum(inertia.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = [min(LONGEST, inertia.get(i, 0)) for i in range(len(centroids))]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(b.num_rows):
                ids = b.column(0)[at].values
                now, far = (np.frombuffer(b.column(i)[at].as_py(), kind) for i, kind in ((1, "<i4"), (2, "<i8")))
                yield pa.RecordBatch.from_arrays([ids, pa.array(now), pa.array(far), pa.array(np.array(of_cluster, np.int64)[now]), pa.array(np.full(len(now), total, np.int64)), pa.array([digests[i] for i in now], pa.string())], schema.names)

    out = stored.select("block", "ids").join(state.select("block", "clusters", "distances"), "block").select("ids", "clusters", "distances")
    return out.mapInArrow(run, schema)
